"""Tables that cut a plan in two."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one that the context was given.

    Only on one machine (tests, a laptop) is a folder of its own made where neither is set; elsewhere that is an error.
    """
    if shared := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tessera-")


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A path in the shared folder for what this driver needs until it ends; discard() removes it then, or before."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4()}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder, until the driver ends."""
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame as a table, and where it is, for loops that remove what the next round has read: discard(lambda p: p != path)."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(keep: Callable[[str], bool] = lambda path: False) -> None:
    """Removes the folders that new_folder() gave out, but those to keep; frames that read them are of no use after that."""
    left = [(s, p) for s, p in _written if keep(p)]
    for spark, path in _written:
        if not keep(path):
            with contextlib.suppress(Exception):  # a session that has ended can't remove anything
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _written[:] = left


atexit.register(discard)
