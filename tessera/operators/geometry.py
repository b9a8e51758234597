"""Boxes and points: crops and their scores, overlap, rotation, the layout of a catalogue page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: weights of a crop's score, limits of its shape, and of its overlap with others
LIGHT, LOW_SATURATION, EXTENT, TEXT, SIZE = 0.24, 0.18, 0.16, 0.24, 0.18
BORDER, STRICT_BONUS, LARGE_BONUS = 0.72, 0.06, 0.03
MOST_OVERLAP, MOST_CROPS = 0.42, 4
FIT_WIDTH, FIT_HEIGHT, MOST_SCALE, CENTRE, MARGIN = 0.84, 0.72, 1.7, 0.54, 0.065
# fixed values: scores of the regions that are read where no tag is found, and their left, top, right and bottom as shares of the image
FALLBACKS = {
    "fallback_full": (0.20, 0.0, 0.0, 1.0, 1.0),
    "fallback_lower": (0.18, 0.0, 0.45, 1.0, 1.0),
    "fallback_center": (0.16, 0.12, 0.18, 0.88, 0.82),
    "fallback_right": (0.14, 0.48, 0.0, 1.0, 1.0),
}


def crop_verdict(w: Column, h: Column, area: Column, image: Column) -> Column:
    """Whether a light region of an image (its number of pixels) may be a tag."""
    rect, aspect = w * h, w / F.greatest(h, F.lit(1))
    return (
        rect.between(image * 0.0012, image * 0.14) & area.between(image * 0.00035, image * 0.12)
        & (w >= 24) & (h >= 24) & aspect.between(0.18, 7.0)
    )


def crop_score(x, y, w, h, area, light, saturation, dark, image_w, image_h, strict) -> Column:
    """How much a region looks like a tag. light, saturation: 0 to 1; dark: share of dark pixels; area: of its contour."""
    one, image, rect = F.lit(1.0), image_w * image_h, w * h
    extent = F.least(area / F.greatest(rect, one), one)
    size = one - F.least(F.abs(rect - image * 0.018) / F.greatest(image * 0.05, one), one)
    parts = light * LIGHT + (one - F.least(saturation, one)) * LOW_SATURATION + extent * EXTENT + F.least(dark / 0.07, one) * TEXT + size * SIZE
    border = F.when((x <= 3) | (y <= 3) | (x + w >= image_w - 3) | (y + h >= image_h - 3), BORDER).otherwise(1.0)
    large = (F.least(w, h) >= 55) & (F.greatest(w, h) >= 150)
    return parts * border + F.when(strict, STRICT_BONUS).otherwise(0.0) + F.when(large, LARGE_BONUS).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (struct x, y, w, h); 0 if they have no area."""
    side = lambda p, n: F.greatest(F.least(a[p] + a[n], b[p] + b[n]) - F.greatest(a[p], b[p]), F.lit(0))
    both = (side("x", "w") * side("y", "h")).cast("double")
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def distinct_crops(crops: DataFrame, most: int | None = MOST_CROPS) -> DataFrame:
    """Per item the best crops that overlap little: item_id, kept (array of pos, score, x, y, w, h in order).

    crops: item_id, pos, score, x, y, w, h, with null boxes for crops that overlap with nothing. Greedy: a crop stays if it overlaps
    with no better one that stays; of equal scores the first comes first. An item's crops are the regions of one image.
    """
    one = F.struct((-F.col("score")).alias("down"), "pos", "score", "x", "y", "w", "h")
    rows = crops.groupBy("item_id").agg(F.array_sort(F.collect_list(one)).alias("r"))
    none = F.slice("r", 1, 0)
    fits = lambda kept, c: c["w"].isNull() | ~F.exists(kept, lambda k: F.coalesce(overlap(k, c) >= MOST_OVERLAP, F.lit(False)))
    kept = F.aggregate("r", none, lambda a, c: F.when(fits(a, c), F.concat(a, F.array(c))).otherwise(a))
    kept = F.transform(F.slice(kept, 1, most) if most else kept, lambda c: F.struct(*(c[n].alias(n) for n in ("pos", "score", "x", "y", "w", "h"))))
    return rows.select("item_id", kept.alias("kept"))


def crop_candidates(crops: DataFrame, images: DataFrame, most: int = MOST_CROPS) -> DataFrame:
    """The crops to read of each image: its best distinct ones in order, then the four regions that every image has. images: item_id, image_w, image_h, one row each.

    Gives item_id, place (from 1), label (tag_crop_1, ... or the region's), pos (null for a region), score, x, y, w, h. An image without crops has its regions alone, crops of an unknown image are left out.
    """
    w, h = F.col("image_w"), F.col("image_h")
    found = distinct_crops(crops, most)
    regions = []
    for label, (score, left, top, right, bottom) in FALLBACKS.items():
        x0, y0, x1, y1 = (F.floor(side * share).cast("long") for side, share in ((w, left), (h, top), (w, right), (h, bottom)))
        regions.append(F.struct(F.lit(label).alias("label"), F.lit(None).cast(crops.schema["pos"].dataType).alias("pos"), F.lit(score).alias("score"), x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))
    long = lambda c, n: c[n].cast("long").alias(n)
    kept = F.transform(F.coalesce("kept", F.slice("kept", 1, 0)), lambda c, i: F.struct(
        F.concat(F.lit("tag_crop_"), (i + 1).cast("string")).alias("label"), c["pos"].alias("pos"), c["score"].cast("double").alias("score"), *(long(c, n) for n in "xywh")))
    met = images.join(found, "item_id", "left").withColumn("all", F.concat(F.when(F.col("kept").isNull(), F.slice(F.array(regions[0]), 1, 0)).otherwise(kept), F.array(*regions)))
    return met.select("item_id", F.posexplode("all").alias("i", "c")).select("item_id", (F.col("i") + 1).cast("long").alias("place"), "c.*")


def distinct_shapes(crops: DataFrame, most: int = MOST_CROPS + 4) -> DataFrame:
    """Of an item's crops of nearly equal size and the same label the first; none under 21 pixels; at most so many."""
    shape = [F.bround(F.col("w") / 20).alias("sw"), F.bround(F.col("h") / 20).alias("sh")]
    rows = crops.filter("w > 20 and h > 20").select("*", *shape)
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("item_id", "sw", "sh", "label").orderBy("pos"))).filter("nth = 1").drop("nth", "sw", "sh")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("pos"))).filter(F.col("place") <= most)


def crop_priority(crops: DataFrame, most: int | None = 7) -> DataFrame:
    """Adds place, the order of reading: strongest detected crop, whole frame, other detected, other fallbacks; at most so many."""
    fall = F.col("label").startswith("fallback")
    by_item = Window.partitionBy("item_id")
    nth = F.row_number().over(by_item.orderBy(fall, "pos"))
    rank = F.when(~fall & (nth == 1), 0).when(F.col("label") == "fallback_full", 1).when(~fall, 2).otherwise(3)
    out = crops.withColumn("__rank", rank).withColumn("place", F.row_number().over(by_item.orderBy("__rank", "pos"))).drop("__rank")
    return out.filter(F.col("place") <= most) if most else out


def rotations(label: Column, w: Column, h: Column) -> Column:
    """Order in which a crop is turned: tall detected crops lie on their side first."""
    tall = ~label.startswith("fallback") & (h > w * 1.2)
    side = F.array(*map(F.lit, ("ccw90", "cw90", "original", "rot180")))
    return F.when(tall, side).otherwise(F.array(*map(F.lit, ("original", "rot180", "cw90", "ccw90"))))


def turn_back(x: Column, y: Column, rotation: Column, w: Column, h: Column) -> Column:
    """A point of a turned image in the image as it was (w by h), as struct x, y."""
    px = F.when(rotation == "rot180", w - 1 - x).when(rotation == "cw90", y).when(rotation == "ccw90", w - 1 - y).otherwise(x)
    py = F.when(rotation == "rot180", h - 1 - y).when(rotation == "cw90", h - 1 - x).when(rotation == "ccw90", x).otherwise(y)
    clip = lambda v, n: F.least(F.greatest(v, F.lit(0)), n - 1)
    return F.struct(clip(px, w).alias("x"), clip(py, h).alias("y"))


def crop_at(anchors: DataFrame, crops: DataFrame) -> DataFrame:
    """Per anchor (item_id, ax, ay) the smallest detected crop that has it inside, its borders a little widened; of equal areas the first."""
    mx, my = (F.greatest(F.lit(4), F.floor(F.col(c) * 0.08)) for c in ("w", "h"))
    inside = F.col("ax").between(F.col("x") - mx, F.col("x") + F.col("w") + mx) & F.col("ay").between(F.col("y") - my, F.col("y") + F.col("h") + my)
    met = anchors.join(crops.filter(~F.col("label").startswith("fallback")), "item_id").filter(inside)
    return met.groupBy("item_id", "ax", "ay").agg(F.min(F.struct((F.col("w") * F.col("h")).alias("area"), "pos")).alias("m")).select("item_id", "ax", "ay", F.col("m.pos").alias("pos"), F.col("m.area").alias("area"))


def padded(x: Column, y: Column, w: Column, h: Column, image_w: Column, image_h: Column) -> Column:
    """A crop's box with its padding, inside the image."""
    p = F.greatest(F.lit(14), F.floor(F.least(w, h) * 0.25))
    x0, y0 = F.greatest(x - p, F.lit(0)), F.greatest(y - p, F.lit(0))
    return F.struct(x0.alias("x"), y0.alias("y"), (F.least(x + w + p, image_w) - x0).alias("w"), (F.least(y + h + p, image_h) - y0).alias("h"))


def catalogue_layout(w: Column, h: Column, canvas_w: int = 1200, canvas_h: int = 1500) -> Column:
    """Size and place of an object on a catalogue page, as struct w, h, x, y."""
    scale = F.least(F.lit(float(int(canvas_w * FIT_WIDTH))) / w, F.lit(float(int(canvas_h * FIT_HEIGHT))) / h, F.lit(MOST_SCALE))
    nw, nh = (F.greatest(F.lit(1), F.floor(n * scale)) for n in (w, h))
    margin = int(canvas_h * MARGIN)
    top = F.lit(int(canvas_h * CENTRE)) - F.floor(nh / 2)
    y = F.greatest(F.lit(margin), F.least(top, F.lit(canvas_h - margin) - nh))
    return F.struct(nw.alias("w"), nh.alias("h"), F.floor((F.lit(canvas_w) - nw) / 2).alias("x"), y.alias("y"))
