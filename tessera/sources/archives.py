"""ZIP archives as a Spark data source: members are read, and archives written, by ranges over many tasks.

    spark.dataSource.register(Archives)
    spark.read.format("archives").load(folder).filter("name like '%.jpg' and file_size < 1000000")
    layout(members).write.format("archives").mode("append").save(folder)
"""

from __future__ import annotations

import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from ..operators.naming import placed, running
from .files import opened

MEMBERS = "archive string, pos long, name string, is_dir boolean, flag_bits int, file_size long, compress_size long"
COLUMNS = [c.split()[0] for c in MEMBERS.split(", ")]
LAYOUT = ["archive", "name", "path", "size", "offset", "entry_at", "members", "directory_at", "directory_size"]
SPLIT = 64 << 20


class Archives(ds.DataSource):
    """Reading gives one row per member of the ZIP files at a path (a file, or a folder and all below it): archive, pos, name, is_dir, flag_bits, file_size, compress_size, and
    content with the option `contents`. A broken archive is one row with pos -1, a damaged member has a null content.

    An archive is read in ranges of `split` bytes, each by a task of its own, which takes the members that begin in its range; so one large archive is read by many tasks, and the driver
    opens none. Filters on columns (with spark.sql.python.filterPushdown.enabled) leave out whole archives before tasks are made, and members before their contents are read.
    """

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return MEMBERS + (", content binary" if self._contents() else "")

    def _contents(self) -> bool:
        return str(self.options.get("contents", "false")).lower() == "true"

    def reader(self, schema) -> ds.DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split", SPLIT)), self._contents())

    def writer(self, schema, overwrite: bool) -> ds.DataSourceWriter:
        if overwrite:
            raise ValueError("archives are written beside each other; use mode append")
        if missing := set(LAYOUT) - set(schema.names):
            raise ValueError(f"write what layout() gives; missing: {sorted(missing)}")
        return ArchiveWriter(self.options["path"])


@dataclass
class Range(ds.InputPartition):
    archive: str
    low: int
    high: int | None

    def __post_init__(self):
        super().__init__(self.archive)


@dataclass
class ArchiveReader(ds.DataSourceReader):
    path: str
    split: int
    contents: bool
    filters: list = field(default_factory=list)

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if not isinstance(f, tuple(TESTS)) or f.attribute[0] not in COLUMNS or len(f.attribute) > 1:
                yield f
            else:
                self.filters.append((type(f).__name__, f.attribute[0], getattr(f, "value", None)))

    def _fits(self, row: dict) -> bool:
        return all(test(row[column], value) for kind, column, value in self.filters if column in row for test in [BY_NAME[kind]])

    def partitions(self) -> list[Range]:
        out = []
        for path, size in located(self.path):
            if self._fits({"archive": path}):
                n = max(1, -(-size // self.split))
                out += [Range(path, k * self.split, (k + 1) * self.split if k < n - 1 else None) for k in range(n)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        try:
            with opened(part.archive) as f, zipfile.ZipFile(f) as z:
                for pos, m in enumerate(z.infolist()):
                    row = dict(zip(COLUMNS, (part.archive, pos, m.filename, m.is_dir(), m.flag_bits, m.file_size, m.compress_size), strict=True))
                    if part.low <= m.header_offset and (part.high is None or m.header_offset < part.high) and self._fits(row):
                        yield (*row.values(), self._content(z, m)) if self.contents else tuple(row.values())
        except zipfile.BadZipFile:
            row = dict(zip(COLUMNS, (part.archive, -1, None, False, 0, 0, 0), strict=True))
            if part.low == 0 and self._fits(row):
                yield (*row.values(), None) if self.contents else tuple(row.values())

    @staticmethod
    def _content(z: zipfile.ZipFile, m: zipfile.ZipInfo) -> bytes | None:
        try:
            return z.read(m)
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
            return None


TESTS = {
    ds.EqualTo: lambda a, b: a is not None and a == b,
    ds.EqualNullSafe: lambda a, b: a == b,
    ds.In: lambda a, b: a is not None and a in b,
    ds.GreaterThan: lambda a, b: a is not None and a > b,
    ds.GreaterThanOrEqual: lambda a, b: a is not None and a >= b,
    ds.LessThan: lambda a, b: a is not None and a < b,
    ds.LessThanOrEqual: lambda a, b: a is not None and a <= b,
    ds.StringStartsWith: lambda a, b: a is not None and a.startswith(b),
    ds.StringEndsWith: lambda a, b: a is not None and a.endswith(b),
    ds.StringContains: lambda a, b: a is not None and b in a,
    ds.IsNotNull: lambda a, b: a is not None,
    ds.IsNull: lambda a, b: a is None,
}
BY_NAME = {k.__name__: v for k, v in TESTS.items()}


def located(path: str) -> list[tuple[str, int]]:
    """(path, size) of the ZIP files at a path or URI, in order."""
    if path.startswith("file:") or "://" not in path:
        system, inner, before = pa_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path, ""
    else:
        system, inner = pa_fs.FileSystem.from_uri(path)
        before = path[: path.index("://") + 3] if path.startswith("s3") or path.startswith("gs") else path[: len(path) - len(inner)]
    info = system.get_file_info(inner)
    found = [info] if info.type == pa_fs.FileType.File else system.get_file_info(pa_fs.FileSelector(inner, recursive=True))
    return sorted((before + f.path, f.size) for f in found if f.type == pa_fs.FileType.File and f.path.lower().endswith(".zip"))


# --- writing

LOCAL, ENTRY = 30 + 20, 46 + 28
"""Bytes of a member's header and of its entry in the directory without its name, sizes and places being 64-bit numbers."""


def layout(members: DataFrame) -> DataFrame:
    """Where each member (archive, name, path, size) of a stored archive lies: its size tells it before anything is read.

    Adds offset, entry_at (of its directory entry), members, directory_at and directory_size (of its archive). Members come in order of their names; an archive may hold a large part of all: places are
    sums over blocks. Rows without an archive or a name are left out; a null size is a size of 0.
    """
    rows = members.filter("archive is not null and name is not null").select("archive", "name", "path", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    rows = placed(rows, "archive", [F.col("name"), F.col("path").asc_nulls_first()], "turn")
    length = F.octet_length("name").cast("long")
    x = running(rows.withColumn("__own", length + LOCAL + F.col("size")).withColumn("__entry", length + ENTRY), ["archive"], "turn", {"upto": F.col("__own"), "entries": F.col("__entry")})
    whole = x.groupBy(F.col("archive").alias("__a")).agg(F.count("*").alias("members"), F.max("upto").alias("directory_at"), F.max("entries").alias("directory_size"))
    met = x.join(whole, F.col("archive") == F.col("__a")).withColumn("offset", F.col("upto") - F.col("__own"))
    return met.withColumn("entry_at", F.col("directory_at") + F.col("entries") - F.col("__entry")).select(*LAYOUT)


@dataclass
class Written(ds.WriterCommitMessage):
    archives: dict[str, tuple[int, int, int, int]]
    """Of each archive: members written by the task, and the archive's members, directory's place and size."""


class ArchiveWriter(ds.DataSourceWriter):
    """Tasks write members and their directory entries where they belong, into a file of the job's own (<archive>.zip.<job>.part), each as a stream from its path. Repeated tasks
    write the same bytes again. At the end the driver adds the few bytes that close each archive and gives the files their names; a job that fails leaves none of them. The folder
    must be mounted on every executor."""

    def __init__(self, folder: str):
        self.folder, self.job = "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder, uuid.uuid4().hex

    def _part(self, archive: str) -> str:
        return os.path.join(self.folder, f"{archive}.zip.{self.job}.part")

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        told: dict[str, tuple] = {}
        for r in rows:
            part = self._part(r["archive"])
            f = os.open(part, os.O_WRONLY | os.O_CREAT, 0o644)  # not cut: other tasks write to it, too
            try:
                self._member(f, r)
            finally:
                os.close(f)
            told[r["archive"]] = (told.get(r["archive"], (0,))[0] + 1, r["members"], r["directory_at"], r["directory_size"])
        return Written(told)

    @staticmethod
    def _member(f: int, r) -> None:
        name, size, crc, done = r["name"].encode(), r["size"], 0, 0
        at = r["offset"] + LOCAL + len(name)
        with opened(r["path"]) as source:
            while chunk := source.read(1 << 20):
                if done + len(chunk) > size:
                    raise ValueError(f"{r['path']} has grown since it was listed")
                crc, done = zlib.crc32(chunk, crc), done + os.pwrite(f, chunk, at + done)
        if done != size:
            raise ValueError(f"{r['path']} has {done} bytes, {size} were listed")
        flags = 0 if name.isascii() else 0x800
        common = struct.pack("<HHHHHIII", 45, flags, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF)
        os.pwrite(f, struct.pack("<I", 0x04034B50) + common + struct.pack("<HH", len(name), 20) + name + struct.pack("<HHQQ", 1, 16, size, size), r["offset"])
        extra = struct.pack("<HHQQQ", 1, 24, size, size, r["offset"])
        entry = struct.pack("<IH", 0x02014B50, 45) + common + struct.pack("<HHHHHII", len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
        os.pwrite(f, entry, r["entry_at"])

    def commit(self, messages: list) -> None:
        whole: dict[str, list] = {}
        for m in messages:
            for archive, (n, *rest) in (m.archives if m else {}).items():
                whole.setdefault(archive, [0, *rest])[0] += n
        if short := [a for a, (n, members, *_) in whole.items() if n != members]:
            self.abort(messages)
            raise RuntimeError(f"archives lack members: {short[:5]}")
        for archive, (_, members, at, size) in whole.items():
            end = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, members, members, size, at) + struct.pack("<IIQI", 0x07064B50, 0, at + size, 1)
            end += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, min(members, 0xFFFF), min(members, 0xFFFF), min(size, 0xFFFFFFFF), min(at, 0xFFFFFFFF), 0)
            with open(self._part(archive), "r+b") as f:
                f.seek(at + size)
                f.write(end)
                f.flush()
                os.fsync(f.fileno())
        for archive in whole:
            os.replace(self._part(archive), os.path.join(self.folder, f"{archive}.zip"))

    def abort(self, messages: list) -> None:
        if os.path.isdir(self.folder):
            for root, _, names in os.walk(self.folder):
                for n in names:
                    if n.endswith(f".zip.{self.job}.part"):
                        os.unlink(os.path.join(root, n))
