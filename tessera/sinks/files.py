"""Reports and archives written by tasks."""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import normalise
from ..sources.files import opened


def write_report(report: DataFrame, path: str) -> None:
    """A report as CSV that reads back as it was, quotes and line breaks included. Spark's commit makes it whole or absent."""
    normalise(report).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_archives(members: DataFrame, folder: str) -> DataFrame:
    """Writes one stored (uncompressed) ZIP per archive to a folder and says what it holds: archive, file, members, bytes.

    members: archive (the file's name without .zip), name, path. Names come in order. Contents aren't moved by Spark: the task that writes an archive copies
    each member from its path as a stream, into a file of the task's own, which takes its name at the end; so an archive is whole or absent, and a
    repeated task does no harm. The folder must be mounted on every executor.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((a, n, p) for b in batches for a, n, p in zip(*(b.column(c).to_pylist() for c in ("archive", "name", "path")), strict=True))
        for archive, own in groupby(rows, key=lambda r: r[0]):
            target, count = os.path.join(folder, f"{archive}.zip"), 0
            part = f"{target}.{uuid.uuid4()}.part"
            with zipfile.ZipFile(part, "w", zipfile.ZIP_STORED) as z:
                for _, name, path in own:
                    with opened(path) as source, z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as out:
                        shutil.copyfileobj(source, out, 1 << 20)
                    count += 1
            size = os.path.getsize(part)
            os.replace(part, target)
            yield pa.RecordBatch.from_pydict({"archive": [archive], "file": [target], "members": [count], "bytes": [size]})

    rows = members.select("archive", "name", "path").repartition("archive").sortWithinPartitions("archive", "name")
    return rows.mapInArrow(build, "archive string, file string, members long, bytes long")


def png_bytes(pixels: bytes, height: int, width: int, channels: int) -> bytes:
    """A PNG file of 8-bit pixels, row by row: 1 channel grey, 3 BGR, 4 BGRA."""
    x = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    x = x[..., [2, 1, 0, 3][:channels]] if channels > 1 else x
    lines = np.concatenate([np.zeros((height, 1), np.uint8), x.reshape(height, -1)], axis=1)  # no filter

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def as_png(pictures: DataFrame) -> DataFrame:
    """Adds png, the file of each picture (height, width, nChannels, data as images() gives them); null where there is none."""

    @F.arrow_udf("binary")
    def encode(data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (data, height, width, channels)), strict=True)
        return pa.array([png_bytes(*r) if None not in r and r[1] > 0 else None for r in rows], pa.binary())

    return pictures.withColumn("png", encode("data", "height", "width", "nChannels"))
