"""Decisions while readings still arrive: an item's reading stops at the first checkpoint that is safe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.planner import reading, stops
from ..tables import new_folder, stored

#: What is kept of a reading; `next` is the first of its item's checkpoints that hasn't counted yet.
KEPT = ("item_id", "pos", "checkpoint", "expected", "last", "at", "text", "confidence", "bbox", "source_rotation", "source_crop")


@dataclass
class Decisions:
    """A stream of readings and how it is decided; settled() runs it."""

    readings: DataFrame
    delay: str
    patience_ms: int
    threshold: float

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802
        return self.readings.sparkSession

    @property
    def schema(self) -> str:
        item = self.readings.schema["item_id"].dataType.simpleString()
        return f"item_id {item}, checkpoint bigint, safe boolean, tag_number string, confidence double, status string, notes string"

    def _later(self, at: Column, times: int) -> Column:
        return F.unix_micros(at) + times * self.patience_ms * 1000

    def step(self, batch: DataFrame, number: int, state: str, into: str) -> None:
        """One batch: reads the state that the batch before has left, writes its own and its decisions. Repeated after a failure, it writes the same again."""
        spark, before, after = self.sparkSession, f"{state}/{number - 1}", f"{state}/{number}"
        known = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.readings.select(*KEPT).schema)
        types = {"open": f"{known}, next bigint", "told": f"item_id {self.readings.schema['item_id'].dataType.simpleString()}, until bigint", "clock": "newest bigint, before bigint"}
        held = {k: spark.read.schema(t).parquet(f"{before}/{k}") if number else spark.createDataFrame([], t) for k, t in types.items()}
        rows = stored(batch.filter("item_id is not null").select(*KEPT))
        clock = held["clock"].agg(F.max("newest").alias("last"), F.max("before").alias("before")).crossJoin(rows.agg(F.unix_micros(F.max("at")).alias("new"))).select("before", "last", F.greatest("last", "new").alias("newest"))
        behind = lambda c: F.unix_micros(F.timestamp_micros(c) - F.expr(f"interval '{self.delay}'"))
        old, mark, last, newest = clock.select(behind("before"), behind("newest"), "last", "newest").first()  # microseconds; as in Spark, what a batch brings is late by the mark that the batch before it began with
        new = rows if old is None else rows.filter(F.unix_micros("at") > old)
        both = held["open"].withColumn("seen", F.lit(0)).unionByName(new.withColumn("next", F.lit(1).cast("bigint")).withColumn("seen", F.lit(1)))
        both = both.join(held["told"].hint("merge"), "item_id", "left_anti").repartition("item_id")
        first = F.row_number().over(Window.partitionBy("item_id", "pos").orderBy("seen"))  # a pos that has come before changes nothing
        item = Window.partitionBy("item_id")
        both = both.withColumn("nth", first).withColumn("next", F.max("next").over(item)).filter("nth = 1 and (seen = 0 or checkpoint >= next)")
        kept = F.struct(*KEPT[1:])
        items = both.groupBy("item_id").agg(F.collect_list(F.struct(kept.alias("kept"), reading().alias("r"))).alias("all"), F.max("at").alias("latest"))
        whole = lambda c: F.filter("all", lambda x: x["r"]["checkpoint"] == c)
        points = F.array_sort(F.array_distinct(F.transform("all", lambda x: x["r"]["checkpoint"])))
        full = F.filter(points, lambda c: F.size(whole(c)) >= F.get(whole(c), F.lit(0))["kept"]["expected"])
        items = items.withColumn("counted", F.aggregate(full, F.lit(0).cast("bigint"), lambda upto, c: F.when(c == upto + 1, c).otherwise(upto)))
        over = F.exists("all", lambda x: (x["r"]["checkpoint"] <= F.col("counted")) & x["kept"]["last"])
        items = items.withColumn("over", over).withColumn("late", ~F.col("over") & F.coalesce(self._later(F.col("latest"), 1) <= F.lit(mark), F.lit(False)))
        items = stored(items)
        # of an item that ends for want of readings, those that still wait count together, as its last checkpoint
        end = F.array_max(F.transform("all", lambda x: x["r"]["checkpoint"]))
        rows = F.transform(F.filter("all", lambda x: F.col("late") | (x["r"]["checkpoint"] <= F.col("counted"))), lambda x: F.when(x["r"]["checkpoint"] <= F.col("counted"), x["r"]).otherwise(x["r"].withField("checkpoint", end)))
        made = stops(items.select("item_id", "latest", "over", "late", rows.alias("rows")), self.threshold, "latest", "over", "late").filter("safe or over or late")
        made = stored(made)
        made.select("item_id", "checkpoint", "safe", "tag_number", "confidence", "status", "notes").write.mode("overwrite").parquet(f"{into}/batch={number}")
        still = items.join(made.select("item_id").hint("merge"), "item_id", "left_anti")
        still.select("item_id", (F.col("counted") + 1).alias("next"), F.explode("all").alias("x")).select("item_id", "x.kept.*", "next").select(*KEPT, "next").write.mode("overwrite").parquet(f"{after}/open")
        told = held["told"].filter(F.coalesce(F.col("until") > F.lit(mark), F.lit(True))).unionByName(made.select("item_id", self._later(F.col("latest"), 3).alias("until")))
        told.write.mode("overwrite").parquet(f"{after}/told")
        spark.createDataFrame([(newest, last)], types["clock"]).write.mode("overwrite").parquet(f"{after}/clock")
        if number > 1:
            _remove(spark, f"{state}/{number - 2}")


def live_decisions(readings: DataFrame, delay: str = "10 minutes", patience_ms: int = 1_800_000, threshold: float = 0.45) -> Decisions:
    """A stream of readings as decisions, one row an item: item_id, checkpoint, safe, tag_number, confidence, status, notes.

    readings: those of evidence.decide, and checkpoint (from 1, none left out), expected (readings of the checkpoint, those without a text included), last (whether reading ends with this
    checkpoint) and at (event time). A decision is given as soon as a checkpoint makes it safe, as planner.replay decides over whole items, whatever the order in which readings
    arrive and however often; else with the last checkpoint, or when nothing has come for `patience`. Readings that come later than `delay` behind the newest of all batches but the last one change nothing, nor do those
    that come after the decision, until the item is forgotten, three times `patience` after its last reading. Readings without an item_id are left out.

    The state is tables beside the stream's progress: readings of items that are open, and ids of those decided. A batch joins them by item in whole columns; no row goes through Python.
    """
    return Decisions(readings, delay, patience_ms, threshold)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def settled(decisions: Decisions, checkpoint: str | None = None, into: str | None = None) -> DataFrame:
    """Runs a stream of decisions over all that has arrived, and gives the table it has written to. With folders of one's own it goes on where it stopped."""
    spark = decisions.sparkSession
    into, progress = into or new_folder(spark, "decisions"), checkpoint or new_folder(spark, "progress")
    run = decisions.readings.writeStream.option("checkpointLocation", progress).foreachBatch(lambda batch, number: decisions.step(batch, number, f"{progress}/tables", into))
    run.trigger(availableNow=True).start().awaitTermination()
    names = [c.split()[0] for c in decisions.schema.split(", ")]
    return spark.read.schema(decisions.schema).parquet(into).select(*names)
