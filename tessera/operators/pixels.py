"""Measures of pixels that come in tiles: all of them are sums, extremes and counts that combine before they are moved, so a picture may be larger than a task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import stored
from .links import components

# fixed values: what counts as foreground, and what a hanging line may be at most
FOREGROUND, BRIGHT = 18, 225
LEAST_COVERAGE, LEAST_RESIDUAL, RESIDUAL_SHARE, MOST_MEDIAN, MOST_BRIGHT = 0.6, 5.0, 0.008, 190, 0.25


def pixels(tiles: DataFrame) -> DataFrame:
    """One row per pixel (image_id, y, x, alpha) of tiles (image_id, top, left, width, alpha: an array, row by row). Pixels that are null are left out."""
    x = tiles.select("image_id", "top", "left", "width", F.posexplode("alpha").alias("i", "alpha")).filter(F.col("alpha").isNotNull())
    return x.select("image_id", (F.col("top") + F.floor(F.col("i") / F.col("width"))).alias("y"), (F.col("left") + F.col("i") % F.col("width")).alias("x"), "alpha")


def histogram(tiles: DataFrame) -> DataFrame:
    """(image_id, alpha, n): how many pixels have each opacity; at most 256 rows a picture, counted within tasks first."""
    return pixels(tiles).groupBy("image_id", "alpha").agg(F.count("*").alias("n"))


def lines(tiles: DataFrame, sizes: DataFrame, most_width: float = 6.0) -> DataFrame:
    """Per picture the straight line that its foreground's rows follow, and whether this is a thread that something hangs on.

    sizes: image_id, width, height of the pictures. Of each row of foreground pixels the extent and the median place are taken; through the places goes the least-squares line x = slope * y + intercept.
    Gives image_id, occupied (rows), coverage (of the height), width_p90, slope, intercept, residual_p90, alpha_median, bright_share, is_line. Quantiles interpolate. A picture without foreground has no row; of
    a single row slope, intercept and residual are null and it is no line.
    """
    shown = pixels(tiles).filter(F.col("alpha") >= FOREGROUND)
    rows = shown.groupBy("image_id", "y").agg((F.max("x") - F.min("x") + 1).alias("extent"), F.percentile("x", F.lit(0.5)).alias("center"))
    fits = rows.groupBy("image_id").agg(
        F.count("*").alias("occupied"), F.percentile("extent", F.lit(0.9)).alias("width_p90"), F.regr_slope("center", "y").alias("slope"), F.regr_intercept("center", "y").alias("intercept"))
    away = rows.join(fits.select("image_id", "slope", "intercept"), "image_id").withColumn("off", F.abs(F.col("center") - (F.col("slope") * F.col("y") + F.col("intercept"))))
    away = away.groupBy("image_id").agg(F.percentile("off", F.lit(0.9)).alias("residual_p90"))
    counts = histogram(tiles).filter(F.col("alpha") >= FOREGROUND).groupBy("image_id")
    opacity = counts.agg(F.percentile("alpha", F.lit(0.5), F.col("n")).alias("alpha_median"), (F.sum(F.when(F.col("alpha") > BRIGHT, F.col("n")).otherwise(0)) / F.sum("n")).alias("bright_share"))
    met = fits.join(away, "image_id").join(opacity, "image_id").join(sizes.select("image_id", "width", "height"), "image_id").withColumn("coverage", F.col("occupied") / F.col("height"))
    straight = F.col("residual_p90") <= F.greatest(F.lit(LEAST_RESIDUAL), F.col("width") * RESIDUAL_SHARE)
    thin = (F.col("coverage") >= LEAST_COVERAGE) & (F.col("width_p90") <= most_width)
    faint = (F.col("alpha_median") < MOST_MEDIAN) & (F.col("bright_share") < MOST_BRIGHT)
    return met.select("image_id", "occupied", "coverage", "width_p90", "slope", "intercept", "residual_p90", "alpha_median", "bright_share", F.coalesce(thin & straight & faint, F.lit(False)).alias("is_line"))


#: Width of the strips in which runs of neighbouring rows are compared.
STRIP = 256


def runs(tiles: DataFrame, shown: Callable[[Column], Column]) -> DataFrame:
    """(image_id, y, x0, x1) of each row of shown pixels that nothing interrupts, cut at tiles' borders. Found within the tile's own row; null pixels aren't shown."""
    n, w = F.size("alpha"), F.col("width")
    lit = lambda i: F.coalesce(shown(F.get("alpha", i)), F.lit(False))
    spots = F.sequence(F.lit(0), n - 1)
    first = F.filter(spots, lambda i: lit(i) & ((i % w == 0) | ~lit(i - 1)))
    last = F.filter(spots, lambda i: lit(i) & ((i % w == w - 1) | ~lit(i + 1)))
    each = tiles.filter((n > 0) & (w > 0)).select("image_id", "top", "left", "width", F.explode(F.arrays_zip(first.alias("a"), last.alias("z"))).alias("r"))
    return each.select(
        "image_id", (F.col("top") + F.floor(F.col("r.a") / w)).alias("y"), (F.col("left") + F.col("r.a") % w).alias("x0"), (F.col("left") + F.col("r.z") % w).alias("x1")
    )


def parts(tiles: DataFrame, shown: Callable[[Column], Column] = lambda a: a >= FOREGROUND, diagonal: bool = True) -> DataFrame:
    """One row per connected part of shown pixels: image_id, y, x (its first pixel in reading order), area, top, left, bottom, right (all within).

    Pictures come in tiles that don't overlap and may be larger than a task: rows of pixels become runs within each tile, runs that touch (below one
    another, corners too if `diagonal`, or side by side at a tile's border) are links, and what hangs together is found over the links. Runs of two rows
    are compared in strips of 256 columns, so that a crowded row stays a bounded number of pairs. Null pixels aren't shown; a picture without shown pixels has no part.
    """
    found = stored(runs(tiles, shown).withColumn("id", F.monotonically_increasing_id()))  # ids are of use only once they are written down
    d = 1 if diagonal else 0
    strips = F.explode(F.sequence(F.floor((F.col("x0") - d) / STRIP), F.floor((F.col("x1") + d) / STRIP)))
    here = found.withColumn("strip", strips)
    over = here.select("image_id", "strip", (F.col("y") + 1).alias("y"), F.col("x0").alias("o0"), F.col("x1").alias("o1"), F.col("id").alias("other"))
    below = here.join(over, ["image_id", "strip", "y"]).filter((F.col("x0") <= F.col("o1") + d) & (F.col("o0") <= F.col("x1") + d))
    beside = found.join(found.select("image_id", "y", (F.col("x1") + 1).alias("x0"), F.col("id").alias("other")), ["image_id", "y", "x0"])
    links = below.select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(beside.select(F.col("id").alias("a"), F.col("other").alias("b")))
    whole = found.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    out = whole.groupBy("image_id", "component").agg(
        F.min(F.struct("y", "x0")).alias("f"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("y").alias("top"), F.min("x0").alias("left"), F.max("y").alias("bottom"), F.max("x1").alias("right")
    )
    return out.select("image_id", F.col("f.y").alias("y"), F.col("f.x0").alias("x"), "area", "top", "left", "bottom", "right")
