"""Which readings an item gets: a budget of attempts, and the checkpoint at which reading may stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.readings import canonical_crop
from .evidence import STRONG_CONFIDENCE, entry, joined, numbers_of, safe_consensus, settle

#: fixed values: attempts that an item may take
BUDGET = {"fast": 16, "deep": 28}


def within_budget(attempts: DataFrame, mode: str = "fast") -> DataFrame:
    """Attempts (item_id, attempt_no, planned) that are made: reading stops at the first whose plan would go beyond the budget.

    Adds used, the attempts spent up to here.
    """
    so_far = Window.partitionBy("item_id").orderBy("attempt_no").rowsBetween(Window.unboundedPreceding, 0)
    x = attempts.withColumn("used", F.sum("planned").over(so_far))
    return x.filter(F.col("used") <= BUDGET[mode])


def reading() -> Column:
    """What a decision takes of a reading: a struct of its checkpoint, place, text and source and the numbers in it."""
    return F.struct("checkpoint", "pos", "text", "confidence", "source_rotation", "source_crop", canonical_crop(F.col("source_crop")).alias("crop"), numbers_of().alias("numbers"))


def _found(rows: Column) -> Column:
    """Each number of an item's readings: its checkpoint, value and source and what it may be the best or the first by."""

    def one(r: Column, n: Column) -> Column:
        best = F.struct(n["score"].alias("score"), (-r["pos"]).alias("p"), (-n["match_no"]).alias("m"), r["confidence"].alias("confidence"), r["source_rotation"].alias("source_rotation"), r["source_crop"].alias("source_crop"))
        return F.struct(
            r["checkpoint"].alias("checkpoint"), n["value"].alias("value"), best.alias("best"), F.struct(r["pos"].alias("pos"), n["match_no"].alias("match_no")).alias("first_seen"),
            F.struct(r["crop"].alias("crop"), r["source_rotation"].alias("rotation")).alias("source"), (r["confidence"] >= STRONG_CONFIDENCE).alias("strong"),
        )

    return F.flatten(F.transform(rows, lambda r: F.transform(r["numbers"], lambda n: one(r, n))))


def _values(found: Column) -> Column:
    """The entries of the values among some numbers, by the measures of evidence.measures()."""
    groups = F.transform(F.array_distinct(F.transform(found, lambda f: f["value"])), lambda v: F.struct(v.alias("value"), F.filter(found, lambda f: f["value"] == v).alias("own")))
    sums = F.transform(groups, lambda g: F.struct(
        g["value"].alias("value"), F.array_max(F.transform(g["own"], lambda f: f["best"])).alias("best"), F.array_min(F.transform(g["own"], lambda f: f["first_seen"])).alias("first_seen"),
        F.array_distinct(F.transform(g["own"], lambda f: f["source"])).alias("sources"),
        F.array_distinct(F.transform(F.filter(g["own"], lambda f: f["strong"]), lambda f: f["source"])).alias("strong_sources"),
    ))
    return F.transform(sums, lambda x: entry(lambda name: x[name]))


def stops(items: DataFrame, threshold: float = 0.45, *kept: str) -> DataFrame:
    """Per item (item_id, rows: array of reading(), and columns to keep) the checkpoint at which its reading stops, and the decision there: the first that is safe, else the last."""
    x = items.select("item_id", *kept, "rows", _found(F.col("rows")).alias("found"))
    x = x.withColumn("at", F.explode(F.array_distinct(F.transform("rows", lambda r: r["checkpoint"]))))
    texts = F.filter("rows", lambda r: (r["checkpoint"] <= F.col("at")) & (F.trim(r["text"]) != ""))
    x = x.select("item_id", *kept, "at", F.filter("found", lambda f: f["checkpoint"] <= F.col("at")).alias("found"), joined(F.transform(texts, lambda r: F.struct(r["pos"].alias("pos"), r["text"].alias("text")))).alias("raw_text"))
    made = settle(x.select("item_id", *kept, "at", _values(F.col("found")).alias("values"), "raw_text"), threshold)
    safe = F.coalesce(safe_consensus(made, threshold), F.lit(False))
    told = F.struct("at", "tag_number", "confidence", "status", "notes")
    stop = made.groupBy("item_id").agg(F.min(F.when(safe, told)).alias("s"), F.max(told).alias("l"), *(F.first(c).alias(c) for c in kept))
    end = F.coalesce("s", "l")
    return stop.select("item_id", *kept, end["at"].alias("checkpoint"), F.col("s").isNotNull().alias("safe"), *(end[c].alias(c) for c in ("tag_number", "confidence", "status", "notes")))


def replay(readings: DataFrame, threshold: float = 0.45) -> DataFrame:
    """Per item the checkpoint at which its reading stops, and the decision there: the first that is safe, else the last.

    readings have a column `checkpoint`; every decision takes all readings up to its checkpoint. An item's readings come together once, in an array that
    the budget of attempts bounds; nothing else is moved, and only decisions are sorted.
    """
    items = readings.select("item_id", reading().alias("r")).groupBy("item_id").agg(F.collect_list("r").alias("rows"))
    return stops(items, threshold).drop("notes")
