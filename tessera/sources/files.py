"""Folders, archives, reports and manifests as DataFrames."""

from __future__ import annotations

import hashlib
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import first_of_equal, sort_formats
from ..operators.report import normalise
from ..schemas import REPORT_COLUMNS


def hashed(files: DataFrame) -> DataFrame:
    """Adds sha, the SHA-256 of each image's content in hexadecimal, to files (path, verdict); null for others, and for a file that is gone.

    A task reads its files one after the other, as streams of a megabyte, so a file's size doesn't matter.
    """
    schema = T.StructType([*files.schema.fields, T.StructField("sha", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path, verdict in zip(b.column("path").to_pylist(), b.column("verdict").to_pylist(), strict=True):
                sha = hashlib.sha256() if verdict == "image" else None
                try:
                    if sha:
                        with opened(path) as f:
                            while chunk := f.read(1 << 20):
                                sha.update(chunk)
                except FileNotFoundError:
                    sha = None
                found.append(sha and sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=schema.fieldNames())

    return files.mapInArrow(run, schema)


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder: path, length, modified, format, verdict, sha, first_key, duplicate. Files are judged by their names; of images alone the contents are read, and only their hashes
    leave the scan. A file that is no image has no sha."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    found = hashed(sort_formats(files))
    images = first_of_equal(found.filter("verdict = 'image'"), "path")
    return images.unionByName(found.filter("verdict <> 'image'").withColumns({"first_key": F.col("path"), "duplicate": F.lit(False)}))


def turn_of(content: bytes) -> int:
    """The EXIF orientation (1 to 8) of a JPEG file's bytes; 1 where there is none."""
    at = 2
    while content[:2] == b"\xff\xd8" and content[at : at + 1] == b"\xff" and at + 4 <= len(content):
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        part = content[at + 4 : at + 2 + size]
        if content[at + 1] == 0xE1 and part[:6] == b"Exif\0\0":
            tiff = part[6:]
            order = "little" if tiff[:2] == b"II" else "big"
            number = lambda k, n: int.from_bytes(tiff[k : k + n], order)  # noqa: E731, B023
            tags = number(4, 4)
            for k in range(tags + 2, tags + 2 + 12 * min(number(tags, 2), 500), 12):
                if number(k, 2) == 0x0112 and 1 <= number(k + 8, 2) <= 8:
                    return number(k + 8, 2)
        if content[at + 1] == 0xDA or size < 2:
            break
        at += 2 + size
    return 1


#: What an orientation does to a picture: rows from the bottom, columns from the right, then both exchanged.
TURNS = {1: (0, 0, 0), 2: (0, 1, 0), 3: (1, 1, 0), 4: (1, 0, 0), 5: (0, 0, 1), 6: (1, 0, 1), 7: (1, 1, 1), 8: (0, 1, 1)}


def upright(data: bytes, height: int, width: int, channels: int, turn: int) -> tuple[bytes, int, int]:
    """(pixels, height, width) of a picture as its orientation wants it seen."""
    flip_y, flip_x, swap = TURNS[turn]
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:: -1 if flip_y else 1, :: -1 if flip_x else 1]
    x = x.swapaxes(0, 1) if swap else x
    return x.tobytes(), x.shape[0], x.shape[1]


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded pictures below a folder: origin, height, width, nChannels, data (BGR, turned upright), error.

    A file that can't be decoded (formats that the JVM has no reader for among them) has height -1 and says so in error.
    """
    pictures = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).select("image.*")

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a picture at a time: each may hold many megabytes
                [r] = b.slice(i, 1).to_pylist()
                name = r["origin"].rsplit("/", 1)[-1]
                data, h, w, n = r["data"], r["height"], r["width"], r["nChannels"]
                if h > 0:
                    with opened(r["origin"]) as f:
                        data, h, w = upright(data, h, w, n, turn_of(f.read(1 << 20)))
                error = "" if h > 0 else f"Could not read image: {name}"
                yield pa.RecordBatch.from_pylist([{"origin": r["origin"], "height": h, "width": w, "nChannels": n, "data": data, "error": error}], pa.schema(
                    [("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary()), ("error", pa.string())]))

    return pictures.select("origin", "height", "width", "nChannels", "data").mapInArrow(turn, "origin string, height int, width int, nChannels int, data binary, error string")


def opened(path: str):
    """A file at a path, or at a URI of any file system that Arrow knows, open for reading from any place in it."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path, "rb")
    system, inner = pa_fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _located(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Paths of files; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")


MEMBERS = "archive string, pos long, name string, is_dir boolean, flag_bits int, file_size long, compress_size long"


def zip_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the ZIP files below a folder, in the columns that the archive rules take; a broken archive has one row with pos -1.

    Only an archive's directory is read, which is at its end.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with opened(path) as f, zipfile.ZipFile(f) as z:
                        rows = [(path, i, m.filename, m.is_dir(), m.flag_bits, m.file_size, m.compress_size) for i, m in enumerate(z.infolist())]
                except zipfile.BadZipFile:
                    rows = [(path, -1, None, False, 0, 0, 0)]
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                types = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in MEMBERS.split(", ")])

    return _located(spark, folder, "*.zip").mapInArrow(listed, MEMBERS)


def member_contents(taken: DataFrame) -> DataFrame:
    """archive, pos, final, content of members that were taken (see ingest.archive_targets); a damaged one has a null content.

    Members are spread over tasks one by one, so a large archive is read by many; each is within the rules' limit of a member's size.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, pos, final in zip(*(b.column(c).to_pylist() for c in ("archive", "pos", "final")), strict=True):
                try:
                    with opened(archive) as f, zipfile.ZipFile(f) as z:
                        content = z.read(z.infolist()[pos])
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError):
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([pos], pa.int64()), pa.array([final]), pa.array([content], pa.binary())], names=["archive", "pos", "final", "content"])

    return taken.select("archive", "pos", "final").repartition("archive", "pos").mapInArrow(read, "archive string, pos long, final string, content binary")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report from CSV: all texts, missing ones '', columns in their order whatever the file has."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return normalise(raw, reading=True).select(*REPORT_COLUMNS)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of a JSON manifest with a list `files`."""
    files = spark.read.json(path, multiLine=True).select(F.explode("files").alias("f"))
    return files.select("f.path", F.col("f.size").cast("long").alias("size"), F.upper("f.sha256").alias("sha256"))
