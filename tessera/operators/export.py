"""Exports with a size budget: which quality and edge an image gets, and what of an export is still current."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import stored

# fixed values: the ladder of sizes
BUDGET, LEAST_BUDGET = 20_000, 1_000
QUALITY_FLOORS = (60, 50, 40, 30, 20, 10)
LONG_EDGES = (1500, 1200, 1000, 800, 640, 512, 400, 320, 256, 192, 128, 96, 64)
LAST_EDGES = (48, 32, 24, 16)
BEST_QUALITY = 95
#: Bits of the lower of two numbers that are compared as one; a budget and an edge have fewer.
SHIFT = 40


def long_edges(w: Column, h: Column) -> Column:
    """Edges to try, from the largest: the image's own and the ladder's that are no larger."""
    own = F.greatest(w, h).cast("int")
    steps = F.array(*map(F.lit, LONG_EDGES))
    return F.sort_array(F.array_distinct(F.concat(F.transform(steps, lambda e: F.least(e, own)), F.array(own))), asc=False)


def pick(encodings: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Per image the encoding that it gets, from the sizes of encodings (image, quality, long_edge, bytes).

    The floor of quality counts before the edge: the first floor for which some edge fits, the largest such edge, and of that edge the
    highest quality that fits. Where none does, the largest of the last edges at quality 1. Null if nothing fits.
    """
    step = F.array_position(F.array(*map(F.lit, QUALITY_FLOORS)), F.col("quality"))
    fits = (F.col("bytes") <= budget) & (F.col("bytes") > 0)
    # pairs are compared as one whole number, quality or step above and bytes or edge below: sums of numbers need no sort, those of structs do
    pair = F.shiftleft(F.col("quality").cast("long"), SHIFT).bitwiseOR(F.col("bytes").cast("long"))
    # of an edge on which a floor fits, the highest quality that fits is the one to take
    edges = encodings.groupBy("image", "long_edge").agg(
        F.min(F.when(fits & (step > 0), step)).alias("step"), F.max(F.when(fits, pair)).alias("top"),
        F.max(F.when(fits & (F.col("quality") == 1) & F.col("long_edge").isin(*LAST_EDGES), F.col("bytes"))).alias("last"),
    )
    edge = F.col("long_edge").cast("long")
    found = edges.groupBy("image").agg(
        F.min(F.shiftleft(F.col("step"), SHIFT) - edge).alias("b"), F.min_by("top", F.shiftleft(F.col("step"), SHIFT) - edge).alias("top"),
        F.max(F.when(F.col("last").isNotNull(), edge)).alias("l"), F.max_by("last", F.when(F.col("last").isNotNull(), edge)).alias("last"),
    )
    low, types = F.lit((1 << SHIFT) - 1), {f.name: f.dataType for f in encodings.schema}
    best = {"quality": F.shiftright("top", SHIFT), "long_edge": (-F.col("b")).bitwiseAND(low), "bytes": F.col("top").bitwiseAND(low)}
    least = {"quality": F.when(F.col("l").isNotNull(), 1), "long_edge": F.col("l"), "bytes": F.col("last")}
    return found.select("image", *(F.when(F.col("b").isNotNull(), best[c]).otherwise(least[c]).cast(types[c]).alias(c) for c in best))


def search(images: DataFrame, sizes: Callable[[DataFrame], DataFrame], budget: int = BUDGET) -> DataFrame:
    """The encoding that pick() chooses, found by asking for few sizes instead of all.

    images: image (unique), w, h, and whatever else an encoder needs. sizes: gets rows of images with long_edge and quality, and adds bytes (null or 0: there
    is no such encoding). Sizes must not shrink when quality or edge grow. A round asks for one size of each image that is still open, so an image costs at most
    3 (floor) + 4 (edge) + 7 (quality) or 3 + 3 (last edges) sizes. Gives image, quality, long_edge, bytes (all null if nothing fits) and how many were asked.

    An image is in one of four steps; lo .. hi is where the first candidate that fits lies (hi fits, with `best` bytes, or is one past the last). Open images are a table, written once a round.
    """
    FLOOR, EDGE, QUALITY, LAST, DONE = range(5)
    c, floors, last = F.col, F.array(*map(F.lit, QUALITY_FLOORS)), F.array(*map(F.lit, LAST_EDGES))
    begin = {"step": F.lit(FLOOR), "lo": F.lit(0), "hi": F.lit(len(QUALITY_FLOORS)), "floor": F.lit(0), "edge": F.lit(0), "best": F.lit(None).cast("long"), "asked": F.lit(0)}
    rows, finished = images.withColumns(begin | {"edges": long_edges(c("w"), c("h"))}), []
    names = rows.columns
    while not finished or not rows.isEmpty():
        mid, step = F.floor((c("lo") + c("hi")) / 2).cast("int"), c("step")
        asked = rows.withColumn("mid", mid).withColumns({
            "long_edge": F.when(step == FLOOR, F.element_at("edges", -1)).when(step == EDGE, F.get("edges", c("mid"))).when(step == QUALITY, F.get("edges", c("edge"))).otherwise(F.get(last, c("mid"))),
            "quality": F.when(step == FLOOR, F.get(floors, c("mid"))).when(step == EDGE, F.get(floors, c("floor"))).when(step == QUALITY, BEST_QUALITY - c("mid")).otherwise(1),
        })
        fits = F.coalesce((c("bytes") > 0) & (c("bytes") <= budget), F.lit(False))
        told = sizes(asked).withColumns({
            "lo": F.when(fits, c("lo")).otherwise(c("mid") + 1), "hi": F.when(fits, c("mid")).otherwise(c("hi")), "best": F.when(fits, c("bytes").cast("long")).otherwise(c("best")), "asked": c("asked") + 1,
        })
        over, found = c("lo") >= c("hi"), c("lo") < len(QUALITY_FLOORS)
        one = F.size("edges") == 1
        move = F.when(~over, step).when((step == FLOOR) & ~found, LAST).when((step == FLOOR) & ~one, EDGE).when(step.isin(FLOOR, EDGE), QUALITY).otherwise(DONE)
        told = told.withColumn("move", move).withColumn("floor", F.when(over & (step == FLOOR), c("lo")).otherwise(c("floor"))).withColumns({
            "edge": F.when((c("move") == QUALITY) & (step == EDGE), c("lo")).otherwise(c("edge")),
            "hi": F.when(c("move") == step, c("hi")).when(c("move") == LAST, len(LAST_EDGES)).when(c("move") == EDGE, F.size("edges") - 1).when(c("move") == QUALITY, BEST_QUALITY - F.get(floors, c("floor"))).otherwise(c("hi")),
            "lo": F.when((c("move") == step) | (c("move") == DONE), c("lo")).otherwise(0),
            "was": step, "step": c("move"),
        })
        told = stored(told.select(*names, "was"))
        finished.append(told.filter(c("step") == DONE).select(
            "image", F.when(c("best").isNull(), None).when(c("was") == LAST, 1).otherwise(BEST_QUALITY - c("lo")).alias("quality"),
            F.when(c("best").isNull(), None).when(c("was") == LAST, F.get(last, c("lo"))).otherwise(F.get("edges", c("edge"))).alias("long_edge"), c("best").alias("bytes"), "asked",
        ))
        rows = told.filter(c("step") != DONE).select(*names)
    return reduce(DataFrame.unionByName, finished)


def current(exports: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Adds state: 'reused' for a target that is there, within budget, a JPEG and no older than its source, else 'convert'; 'orphan' without a source.

    exports: name, source_modified, target_modified, bytes, is_jpeg.
    """
    good = F.col("target_modified").isNotNull() & F.col("bytes").between(1, budget) & F.col("is_jpeg") & (F.col("target_modified") >= F.col("source_modified"))
    return exports.withColumn("state", F.when(F.col("source_modified").isNull(), "orphan").when(F.coalesce(good, F.lit(False)), "reused").otherwise("convert"))


def totals(done: DataFrame) -> DataFrame:
    """Counts of an export (state: reused, converted, skipped; bytes), with how many are ready and the largest size."""
    n = lambda s: F.count_if(F.col("state") == s)
    return done.agg(n("converted").alias("converted"), n("reused").alias("reused"), n("skipped").alias("skipped"), F.count_if(F.col("state").isin("converted", "reused")).alias("ready"), F.max("bytes").alias("largest"))


def export_current(names: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: whether an export as a whole is current: some source, equal names, every target reused, its zip no older.

    names: name, state, target_modified, zip_modified.
    """
    met = expected.select("name").distinct().withColumn("e", F.lit(1)).join(names, "name", "full")
    fine = F.col("e").isNotNull() & (F.col("state") == "reused") & (F.col("zip_modified") >= F.col("target_modified"))
    return met.agg(((F.count("*") > 0) & (F.count_if(~F.coalesce(fine, F.lit(False))) == 0)).alias("current"))


def within_limit(files: DataFrame, limit: int = BUDGET) -> DataFrame:
    """The JPEG files (name, bytes) of a folder that go into its archive of small files: those with a size from 1 to the limit. The archive's writer orders them."""
    return files.filter(F.lower(F.col("name")).endswith(".jpg") & F.col("bytes").between(1, limit))


def downloads(runs: DataFrame) -> DataFrame:
    """Which artifacts of a run can be downloaded. runs: run, full, report (bytes, null without the file), processed, transparent, debug (how many pictures), compressed (current).

    One row per run and artifact: run, artifact, available.
    """
    kinds = {
        "full": F.col("full").isNotNull() & F.col("report").isNotNull(), "processed": F.col("processed") > 0, "transparent": F.col("transparent") > 0,
        "compressed": F.coalesce("compressed", F.lit(False)), "report": F.coalesce(F.col("report") > 0, F.lit(False)), "debug": F.col("debug") > 0,
    }
    each = F.array(*(F.struct(F.lit(k).alias("artifact"), c.alias("available")) for k, c in kinds.items()))
    return runs.select("run", F.explode(each).alias("a")).select("run", "a.artifact", "a.available")
