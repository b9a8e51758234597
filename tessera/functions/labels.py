"""Labels that reports and download pages show, and names that files get."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DUPLICATE_TAG, ERROR, FRIENDLY_STATUS, OCR_FAILED, OK


def size_label(n: Column) -> Column:
    """Bytes as B (whole), KB, MB or GB (one decimal, steps of 1024; GB is the largest unit)."""
    k = F.lit(1024.0)
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024**2, F.format_string("%.1f KB", n / k))
        .when(n < 1024**3, F.format_string("%.1f MB", n / k / k))
        .otherwise(F.format_string("%.1f GB", n / k / k / k))
    )


def elapsed_label(seconds: Column) -> Column:
    """Two decimals under a second, else one."""
    return F.when(seconds < 1, F.format_string("%.2fs", seconds)).otherwise(F.format_string("%.1fs", seconds))


def friendly_status(status: Column) -> Column:
    """The label of a status; an unknown status is its own label, null is ''."""
    known = F.create_map(*(F.lit(x) for kv in FRIENDLY_STATUS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, status), status, F.lit(""))


def badge_class(status: Column) -> Column:
    return (
        F.when(status == OK, "ok")
        .when(status == DUPLICATE_TAG, "duplicate")
        .when(status.isin(ERROR, OCR_FAILED), "error")
        .otherwise("review")
    )


def base_name(path: Column) -> Column:
    """What follows the last slash; backslashes count as slashes."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def suffix(name: Column) -> Column:
    """Lower-case suffix of a file name without its dot, '' if it has none; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def drop_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def safe_stem(name: Column) -> Column:
    """Name without its last suffix; runs of other than letters, digits, _ and - become _, outer _ go; 'image' if nothing is left.

    It also applies to a name that is prefixed already, so `REVIEW_a.b` gives `REVIEW_a`.
    """
    stem = F.regexp_replace(F.regexp_replace(drop_suffix(name), "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.when(stem == "", "image").otherwise(stem)


def numbered(stem: Column, ordinal: Column, ending: str = ".png") -> Column:
    """`stem.png` for the first, `stem_2.png` for the second of a name, and so on."""
    return F.concat(stem, F.when(ordinal > 1, F.concat(F.lit("_"), ordinal.cast("string"))).otherwise(""), F.lit(ending))


def cache_file(name: Column) -> Column:
    """Only the base name of a cached file counts; a blank one is null."""
    bare = base_name(F.trim(name))
    return F.when(bare != "", bare)


def cache_complete(mode: Column, white: Column, transparent: Column) -> Column:
    """Whether the cached files that a background mode needs are all there."""
    w, t = F.coalesce(white != "", F.lit(False)), F.coalesce(transparent != "", F.lit(False))
    return F.when(mode == "white_only", w).when(mode == "transparent_only", t).when(mode == "white_and_transparent", w & t).otherwise(False)


def preview_names(name: Column) -> Column:
    """Names of the files that wait beside a photo for a decision about its background."""
    stem = drop_suffix(name)
    kinds = {"candidate": "_candidate_white.png", "preservation": "_u2net_white.png", "white": "_ai_white.png", "transparent": "_ai_transparent.png"}
    return F.struct(*(F.concat(stem, F.lit(end)).alias(kind) for kind, end in kinds.items()))


def quantile(ascending: Column, share: float) -> Column:
    """Quantile of an ascending array of doubles, interpolated between neighbours; null of an empty one."""
    at = (F.size(ascending) - 1) * F.lit(share)
    low = F.try_element_at(ascending, (F.floor(at) + 1).cast("int"))
    return low + (at - F.floor(at)) * (F.try_element_at(ascending, (F.ceil(at) + 1).cast("int")) - low)


def turned(pixels: Column, side: Column, rotation: Column) -> Column:
    """A square raster, row by row, turned by a quarter (cw90, ccw90) or a half (rot180), else as it is."""
    at = lambda i: F.struct((F.floor(i / side)).alias("y"), (i % side).alias("x"))

    def source(i: Column) -> Column:
        y, x, last = at(i)["y"], at(i)["x"], side - 1
        return F.when(rotation == "cw90", (last - x) * side + y).when(rotation == "ccw90", x * side + last - y).when(rotation == "rot180", side * side - 1 - i).otherwise(i)

    return F.transform(F.sequence(F.lit(0), side * side - 1), lambda i: F.element_at(pixels, (source(i) + 1).cast("int")))


def blended(colour: Column, alpha: Column) -> Column:
    """Colour values over white by their opacities (0 to 255), pixel by pixel, in whole numbers."""
    return F.zip_with(colour, alpha, lambda c, a: F.floor(c * (a / 255.0) + 255.0 * (1 - a / 255.0)).cast("long"))
