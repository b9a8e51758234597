"""Photos that keep arriving: a stream over a folder, each content taken once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import sort_formats
from ..operators.naming import given_names
from ..sources.files import hashed

FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New files below a folder as a stream: path, modified, format, verdict, sha. Only images are read, as streams. The source leaves out empty files."""
    # the source would leave out files a week older than the newest
    raw = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFileAge", "36500d").load(folder)
    return hashed(sort_formats(raw.select("path", F.col("modificationTime").alias("modified"))))


def once(files: DataFrame) -> DataFrame:
    """Images of a stream, each content once, however old its file is; the stream remembers the hash of every content taken, so this is for streams that end. See KnownContents."""
    return files.filter("verdict = 'image'").dropDuplicates(["sha"])


class KnownContents:
    """Contents that have been taken, as a table that every batch of a stream is compared with and added to: the stream itself keeps no state.

        arrivals(...).writeStream.foreachBatch(known.writer()).option("checkpointLocation", ...).start()

    The table lies in a folder by batch and by the first two digits of the hash; its files carry Bloom filters of their hashes. A batch finds those of its hashes that are known by a semi-join, in which the
    table's hashes alone are read, where they lie; only what is found, never more than the batch, meets the batch again. A batch that is repeated replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, but: int | None = None) -> DataFrame | None:
        """path, modified, format, sha, head and batch of the contents taken; None if there are none yet."""
        return given_names(self.spark, self.folder, but)

    def add_batch(self, files: DataFrame, batch: int) -> None:
        """Takes the images of a batch whose content is new: of equal ones that with the least path. Images without a hash are left out."""
        own = files.filter("verdict = 'image' and sha is not null").select("path", "modified", "format", "sha")
        own = own.groupBy("sha").agg(F.min_by(F.struct("path", "modified", "format"), "path").alias("f")).select("f.*", "sha").withColumn("head", F.substring("sha", 1, 2))
        known = self.read(but=batch)
        if known is not None:
            seen = known.select("head", "sha").join(own.select("head", "sha"), ["head", "sha"], "left_semi").select("sha").distinct()
            own = own.join(seen, "sha", "left_anti")
        own.write.mode("overwrite").partitionBy("head").option("parquet.bloom.filter.enabled#sha", "true").parquet(f"{self.folder}/batch={batch}")

    def writer(self) -> Callable[[DataFrame, int], None]:
        return self.add_batch
