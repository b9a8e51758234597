"""Array operations on masks, and their use on tables of images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of links a[i] - b[i] between nodes 0 .. n-1, the least node of each node's part: union-find over whole arrays."""
    root = np.arange(n)
    while True:
        low, new = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels 1, 2, ... of the connected parts of a mask in order of their first pixel; 0 outside.

    Runs of a row are nodes, and runs of adjacent rows that touch (or with `diagonal` meet at a corner) are linked, so a long winding part
    costs no more than another.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, first), last = np.nonzero(edge == 1), np.nonzero(edge == -1)[1] - 1
    if not len(row):
        return np.zeros((h, w), np.int64)
    # positions of runs on one line, with room between rows: of each run those of the row above that reach into it are neighbours in order
    wide, reach = w + 4, int(diagonal)
    start, stop = row * wide + first, row * wide + last
    low = np.searchsorted(stop, start - wide - reach)
    high = np.searchsorted(start, stop - wide + reach, "right")
    n = np.maximum(high - low, 0)
    b = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    root = _roots(np.repeat(np.arange(len(row)), n), b, len(row))
    label = np.unique(root, return_inverse=True)[1] + 1
    out = np.zeros((h, w), np.int64)
    out[mask] = np.repeat(label, last - first + 1)
    return out


def areas(label: np.ndarray) -> np.ndarray:
    """Pixels of each labelled part."""
    return np.bincount(label.ravel())[1:]


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask without those gaps that don't reach the border."""
    gap = components(np.pad(~mask, 1, constant_values=True), diagonal=False)
    return (gap != gap[0, 0])[1:-1, 1:-1]


# fixed values: what counts as foreground, and the least areas of parts that are kept or missed
FOREGROUND, OBJECT, SOLID = 18, 12, 220
KEPT_PART, LOST_PART, COUNTED_PART = (18, 2e-5), (18, 2e-5), (12, 1.5e-5)


def least_area(rule: tuple[int, float], shape: tuple[int, int]) -> int:
    """A rule's least area in an image: so many pixels, or that share of it if more."""
    return max(rule[0], int(shape[0] * shape[1] * rule[1]))


def keep_parts(mask: np.ndarray, rule: tuple[int, float]) -> np.ndarray:
    """The mask without its parts under a rule's area."""
    label = components(mask)
    return np.append(0, areas(label) >= least_area(rule, mask.shape))[label].astype(bool)


def lonely(alpha: np.ndarray) -> np.ndarray:
    """Where opacity stands alone: at most one of a pixel's eight neighbours has any."""
    some = np.pad(alpha > 0, 1).astype(np.int64)
    h, w = alpha.shape
    near = sum(some[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3))
    return (alpha > 0) & (near <= 2)


def clean(alpha: np.ndarray, rule: tuple[int, float] = KEPT_PART) -> np.ndarray:
    """Opacity without small parts of the foreground, and then without lonely pixels."""
    shown = alpha > FOREGROUND
    out = np.where(shown & ~keep_parts(shown, rule), 0, alpha)
    return np.where(lonely(out), 0, out)


def lost_parts(support: np.ndarray, shown: np.ndarray, rule: tuple[int, float] = LOST_PART, retained: float = 0.6, most: float = 1.0) -> int:
    """How many supported parts of some size are shown by less than the `retained` share."""
    label = components(support)
    size, seen = areas(label), np.bincount(label[support & shown], minlength=label.max() + 1)[1:]
    return int(((size >= least_area(rule, support.shape)) & (size <= most * support.size) & (seen < retained * size)).sum())


def measures(raw: np.ndarray, cleaned: np.ndarray, support: np.ndarray) -> dict[str, float]:
    """How far a cleaned opacity can be trusted, from the opacity before and the pixels that the photo's colours support."""
    before, after = raw > FOREGROUND, cleaned > FOREGROUND
    removed = before & ~after
    counted = components(raw > 24)
    return {
        "removed_foreground": removed.sum() / max(1, before.sum()), "removed_supported": (removed & support).mean(), "interior_holes": (removed & support & fill_holes(before)).mean(),
        "lost_parts": lost_parts(support & before, after), "missing_parts": lost_parts(support, before, (24, 3e-5), 0.35, 0.03),
        "foreground": (raw > OBJECT).mean(), "solid": (raw > SOLID).mean(), "soft": ((raw > OBJECT) & (raw < SOLID)).mean(), "parts": int((areas(counted) >= least_area(COUNTED_PART, raw.shape)).sum()),
    }


def on_white(colour: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """A colour channel over white by its opacity, in whole numbers."""
    a = alpha / 255.0
    return np.clip(colour * a + 255.0 * (1 - a), 0, 255).astype(np.int64)


def _square(values: list) -> np.ndarray:
    side = int(len(values) ** 0.5)
    return np.array(values[: side * side]).reshape(side, side)


def mask_measures(images: DataFrame) -> DataFrame:
    """Of each square picture (image_id, alpha and support as arrays of whole numbers): its measures before and after cleaning, and the cleaned opacity."""
    names = ("removed_foreground", "removed_supported", "interior_holes", "lost_parts", "missing_parts", "foreground", "solid", "soft", "parts")
    types = [pa.int64() if n in ("lost_parts", "missing_parts", "parts") else pa.float64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, alpha, support in zip(*(b.column(c).to_pylist() for c in ("image_id", "alpha", "support")), strict=True):
                raw = _square(alpha)
                cleaned = clean(raw)
                m = measures(raw, cleaned, _square(support) > 0)
                rows.append((i, cleaned.ravel().tolist(), *(m[n] for n in names)))
            cols = list(zip(*rows, strict=True)) or [[]] * (len(names) + 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int64()), *types), strict=True)], names=["image_id", "cleaned", *names])

    schema = "image_id long, cleaned array<long>, " + ", ".join(f"{n} {'long' if t == pa.int64() else 'double'}" for n, t in zip(names, types, strict=True))
    return images.select("image_id", "alpha", "support").mapInArrow(run, schema)


def mask_parts(images: DataFrame, level: float) -> DataFrame:
    """Of each square raster (image_id, pixels array<double>) above a level: parts, their largest area, filled holes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, pixels in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                side = int(len(pixels) ** 0.5)
                mask = np.array(pixels[: side * side], float).reshape(side, side) > level
                sizes = areas(components(mask))
                rows.append((i, len(sizes), int(sizes.max(initial=0)), int((fill_holes(mask) & ~mask).sum())))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["image_id", "parts", "largest", "holes"])

    return images.select("image_id", "pixels").mapInArrow(run, "image_id long, parts long, largest long, holes long")
