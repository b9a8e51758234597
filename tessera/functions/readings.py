"""Column expressions over single readings of a tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what letters are misread digits, and how much readings weigh
MISREAD, DIGITS = "OoIl|SsB", "00111558"
CONFIDENCE_SHARE, PROMINENCE_SHARE, LENGTH_BONUS = 0.68, 0.22, 0.1
STANDALONE = r"(?<![A-Za-z0-9])([0-9]{5,8})(?![A-Za-z0-9])"


def normalise_digits(text: Column) -> Column:
    """Letters that a reader takes for digits become those digits."""
    return F.translate(text, MISREAD, DIGITS)


def extent(bbox: Column, axis: int) -> Column:
    points = F.transform(bbox, lambda p: F.try_element_at(p, F.lit(axis + 1)))
    return F.array_max(points) - F.array_min(points)


def prominence(bbox: Column) -> Column:
    """0.05 to 1 by the size of the text's box; 0.5 where there is no usable box."""
    size = (extent(bbox, 1) / 60.0) * 0.65 + (extent(bbox, 0) / 260.0) * 0.35
    broken = bbox.isNull() | (F.size(bbox) == 0) | F.exists(bbox, lambda p: p.isNull() | (F.size(p) < 2))
    return F.when(broken, 0.5).otherwise(F.coalesce(F.least(F.greatest(size, F.lit(0.05)), F.lit(1.0)), F.lit(0.5)))


def source_adjustment(crop: Column, rotation: Column) -> Column:
    """A whole frame turned automatically counts less, a second look at it a little more."""
    return (
        F.when((crop == "fallback_full") & (rotation == "auto_best"), -0.06)
        .when(crop == "fallback_full_recheck", 0.015)
        .otherwise(0.0)
    )


def standalone_numbers(text: Column) -> Column:
    """Runs of five to eight digits that touch no letter or digit, after normalisation."""
    return F.regexp_extract_all(normalise_digits(F.trim(text)), F.lit(STANDALONE), F.lit(1))


def canonical_crop(crop: Column) -> Column:
    """A crop and its enhanced variant are one source."""
    return F.regexp_replace(crop, "_enhanced$", "")


def base_crop(crop: Column) -> Column:
    """The crop that an enhanced or verification pass was made of."""
    return F.regexp_replace(crop, "(_enhanced|_verification)$", "")


def valid_manual_tag(tag: Column) -> Column:
    return F.trim(tag).rlike("^[0-9]{5,8}$")


def swapped_six_nine(value: Column) -> Column:
    return F.translate(value, "69", "96")
