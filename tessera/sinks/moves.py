"""Changes of many files as actions that tasks carry out: written down first, done whole or not at all, finished after a crash."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ["action", "step", "kind", "source", "target"]
OUTCOME = "outcome string, error string"


class FileActions:
    """A log of actions on files in a folder that every executor has mounted.

    An action is its steps, in order: copy, move or delete a file (kind, source, target), or delete? and copy?, which a file that isn't there doesn't stop. It is done by one task. A step that has been done already is left as it is (a moved file is at its
    target, a deleted one is gone, a copy is put in place in one step), so a task that is repeated does no harm. If a step fails, the copies and moves before it are taken back; deletes come last in an action, as nothing takes
    them back. apply() writes the actions down before the first file is touched, and their outcomes after the last; recover() carries out what was written down and not finished.
    """

    def __init__(self, spark: SparkSession, log: str):
        self.spark, self.log = spark, log.rstrip("/")

    def _there(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)

    def apply(self, actions: DataFrame, name: str) -> DataFrame:
        """Carries out actions (action, step, kind, source, target; the paths whole) under a name of their own: action, outcome ('done' or 'taken back'), error. A name that has been finished before gives
        its outcomes again."""
        if not self._there(f"{self.log}/{name}/planned/_SUCCESS"):
            actions.select(*COLUMNS).repartition("action").sortWithinPartitions("action", "step").write.mode("overwrite").parquet(f"{self.log}/{name}/planned")
        return self._finish(name)

    def _finish(self, name: str) -> DataFrame:
        done = f"{self.log}/{name}/outcomes"
        if not self._there(f"{done}/_SUCCESS"):
            planned = self.spark.read.parquet(f"{self.log}/{name}/planned").repartition("action").sortWithinPartitions("action", "step")
            schema = T.StructType([planned.schema["action"], *T._parse_datatype_string(OUTCOME).fields])
            planned.mapInArrow(_carry_out(schema), schema).write.mode("overwrite").parquet(done)
        return self.spark.read.parquet(done)

    def recover(self) -> list[str]:
        """Finishes what was planned and not finished; gives its names. What wasn't planned to the end has touched no file."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.log)
        fs = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []
        open_ = [n for n in names if self._there(f"{self.log}/{n}/planned/_SUCCESS") and not self._there(f"{self.log}/{n}/outcomes/_SUCCESS")]
        for n in open_:
            self._finish(n)
        return open_


def _carry_out(schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        rows = []

        def told(out: list) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.string(), pa.string()), strict=True)], names=schema.fieldNames())

        for b in batches:
            kind = b.schema.field("action").type
            rows += b.select(COLUMNS).to_pylist()
            last = rows[-1]["action"] if rows else None
            whole, rows = [r for r in rows if r["action"] != last], [r for r in rows if r["action"] == last]
            yield told([(a, *_action(list(steps))) for a, steps in groupby(whole, key=lambda r: r["action"])])
        if rows:
            yield told([(rows[0]["action"], *_action(rows))])

    return run


def _action(steps: list[dict]) -> tuple[str, str]:
    done = []
    try:
        for s in steps:
            if _step(s["kind"], s["source"], s["target"]):
                done.append(s)
    except OSError as e:
        for s in reversed(done):
            if s["kind"].startswith("copy"):
                os.unlink(s["target"])
            elif s["kind"] == "move":
                os.replace(s["target"], s["source"])
        return "taken back", f"{type(e).__name__}: {e.strerror or e} ({s['source']})"
    return "done", ""


def _step(kind: str, source: str, target: str | None) -> bool:
    """Carries out a step; whether there is something to take back."""
    if kind in ("delete", "delete?"):
        if os.path.exists(source):
            os.unlink(source)
        return True
    if kind == "copy?" and not os.path.exists(source):
        return False
    if kind == "move" and not os.path.exists(source) and os.path.exists(target):
        return True  # by an earlier attempt, and this one's to take back
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if kind == "move":
        if os.path.exists(target):
            raise FileExistsError(17, "File exists", target)
        os.rename(source, target)
        return True
    if kind not in ("copy", "copy?"):
        raise OSError(f"no such kind of step: {kind}")
    if os.path.exists(target):
        if not _equal(source, target):
            raise FileExistsError(17, "File exists", target)
        return True  # an earlier attempt's copy: this one's to take back
    part = f"{target}.{os.getpid()}.part"
    try:
        shutil.copy2(source, part)
        os.replace(part, target)
    finally:
        if os.path.exists(part):
            os.unlink(part)
    return True


def _equal(source: str, target: str) -> bool:
    """Whether two files are equal; a source that a later step of an earlier attempt has deleted counts as copied."""
    if not os.path.exists(source):
        return True
    if os.path.getsize(source) != os.path.getsize(target):
        return False
    with open(source, "rb") as a, open(target, "rb") as b:
        while True:
            x, y = a.read(1 << 20), b.read(1 << 20)
            if x != y:
                return False
            if not x:
                return True
