"""A report that many read while a few write it: whole versions, each made current by one step that only one writer can win."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.report import matches, normalise, update
from ..schemas import REPORT_COLUMNS
from ..tables import stored

SCHEMA = ", ".join(f"{c} string" for c in REPORT_COLUMNS)
EMPTY = {"parts": [], "batches": {}}


class Conflict(Exception):
    """Another writer has made a version since the one that this change was made from."""


class VersionedReport:
    """A report as parts (folders of Parquet) and versions (small files that name the parts which count, and the last batch of each stream).

    A reader takes the newest version and sees its parts whole. A writer writes new parts beside the old ones, then the next version's file, which is put in place only if no file
    has its number: of two writers one wins, and the other begins again from the winner's version. What a writer that fails leaves behind no version names; vacuum() removes it. A batch of photos adds a part, an
    edit rewrites only the parts that hold the rows it means.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._path("versions").getFileSystem(self.conf)

    def _path(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def versions(self) -> list[int]:
        folder = self._path("versions")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _info(self, version: int) -> dict:
        if not version:
            return EMPTY
        stream = self.fs.open(self._path("versions", f"{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> int:
        """The newest version, 0 if there is none yet."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The report as of a version, the newest one if none is named: all columns of a report, as texts."""
        return self._read(self._info(self.current() if version is None else version)).select(*REPORT_COLUMNS)

    def _read(self, info: dict) -> DataFrame:
        if not info["parts"]:
            return self.spark.createDataFrame([], f"{SCHEMA}, part string")
        paths = [f"{self.folder}/data/part={p}" for p in info["parts"]]
        return self.spark.read.schema(f"{SCHEMA}, part string").option("basePath", f"{self.folder}/data").parquet(*paths)

    def _part(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        normalise(rows).write.parquet(f"{self.folder}/data/part={name}")
        return name

    def _commit(self, base: int, info: dict) -> int:
        """Makes version base + 1, or raises Conflict."""
        target, spare = self._path("versions", f"{base + 1:012d}.json"), self._path("versions", f".{uuid.uuid4().hex}.tmp")
        out = self.fs.create(spare, False)
        out.write(bytearray(json.dumps(info).encode()))
        out.close()
        try:
            if self.fs.getScheme() == "file":  # a local rename replaces its target, a link doesn't
                os.link(spare.toUri().getPath(), target.toUri().getPath())
            else:
                options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(spare, target, options)
        except FileExistsError as e:
            raise Conflict(base) from e
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(base) from e
            raise
        finally:
            self.fs.delete(spare, False)
        return base + 1

    def _change(self, step: Callable[[int, dict], dict | None]) -> int:
        """Applies a step to the newest version until no other writer has come first; a step that gives None changes nothing."""
        while True:
            base = self.current()
            info = step(base, self._info(base))
            if info is None:
                return base
            try:
                return self._commit(base, info)
            except Conflict:
                continue

    def write(self, report: DataFrame) -> int:
        """A whole report as the next version."""
        part = self._part(report)
        return self._change(lambda base, info: {**info, "parts": [part]})

    def add_batch(self, rows: DataFrame, batch_id: int, stream: str = "report") -> int:
        """Adds the rows of one batch of a stream; a batch that has been added before, and any before that, changes nothing."""
        made: list[str] = []

        def step(base: int, info: dict) -> dict | None:
            if batch_id <= info["batches"].get(stream, -1):
                return None
            if not made:
                made.append(self._part(rows))
            return {"parts": info["parts"] + made, "batches": {**info["batches"], stream: batch_id}}

        return self._change(step)

    def writer(self, stream: str = "report") -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: the report is current while photos still come, and a batch that Spark repeats counts once."""

        def write(rows: DataFrame, batch_id: int) -> None:
            self.add_batch(rows, batch_id, stream)

        return write

    def edit(self, edits: DataFrame) -> int:
        """report.update (selector, updates) on the newest version; an edit that meets another writer's is worked out again on the other's result."""

        def step(base: int, info: dict) -> dict | None:
            rows = self._read(info)
            lone = stored(matches(rows, edits).groupBy("selector").agg(F.count("*").alias("n"), F.min("item_id").alias("item_id")).filter("n = 1").drop("n"))
            touched = {r["part"] for r in rows.hint("merge").join(lone.select("item_id").distinct(), "item_id", "left_semi").select("part").distinct().collect()}  # names of parts, one a batch at most
            if not touched:
                return None
            # selectors are looked up in the whole report, so a part is changed by the item ids that came out
            known = edits.hint("merge").join(lone, "selector").select(F.col("item_id").alias("selector"), "updates", F.col("selector").alias("by"))
            changed = update(rows.filter(F.col("part").isin(*touched)).select(*REPORT_COLUMNS), _in_order(known))
            return {**info, "parts": [p for p in info["parts"] if p not in touched] + [self._part(changed)]}

        return self._change(step)

    def compact(self) -> int:
        """All parts as one."""
        return self._change(lambda base, info: {**info, "parts": [self._part(self._read(info))]} if len(info["parts"]) > 1 else None)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all versions but the newest `keep`, and the parts that none of these names. Only while nobody writes or reads an older version."""
        kept = self.versions()[-keep:]
        named = {p for v in kept for p in self._info(v)["parts"]}
        for v in self.versions()[:-keep]:
            self.fs.delete(self._path("versions", f"{v:012d}.json"), False)
        folder, gone = self._path("data"), []
        if self.fs.exists(folder):
            for f in self.fs.listStatus(folder):
                name = f.getPath().getName().removeprefix("part=")
                if name not in named:
                    self.fs.delete(f.getPath(), True)
                    gone.append(name)
        return gone


def _in_order(edits: DataFrame) -> DataFrame:
    """Edits of one item as one: of several the one with the last selector counts for a column, as in report.update."""
    last = edits.select("selector", "by", F.explode("updates").alias("name", "value")).groupBy("selector", "name").agg(F.max_by("value", "by").alias("value"))
    return last.groupBy("selector").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("updates"))
