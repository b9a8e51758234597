"""Measures of pixels in tiles against numpy on whole pictures."""

import numpy as np
import pytest

from tessera.operators import pixels


def tiles_of(image, picture, step):
    h, w = picture.shape
    cut = [(image, t, s, min(step, w - s), picture[t : t + step, s : s + step].ravel().tolist()) for t in range(0, h, step) for s in range(0, w, step)]
    return cut, (image, w, h)


@pytest.mark.parametrize("step", [3, 7, 64])
def test_lines_of_tiled_pictures(spark, step):
    rng, pictures = np.random.default_rng(2), {}
    for k in range(6):
        p = np.zeros((40, 30), int)
        for y in range(2, 38 if k != 3 else 20):
            x = int(5 + 0.4 * y + (rng.integers(-1, 2) if k % 2 else 0))
            p[y, x : x + 2 + k % 3] = rng.integers(200 if k == 4 else 18, 256 if k == 4 else 150, size=2 + k % 3)
        pictures[k] = p
    pictures[6], pictures[7] = np.zeros((4, 5), int), np.full((1, 5), 100)
    rows, sizes = zip(*(tiles_of(k, p, step) for k, p in pictures.items()), strict=True)
    tiles = spark.createDataFrame([t for r in rows for t in r], "image_id long, top long, left long, width long, alpha array<long>")
    got = {r.image_id: r for r in pixels.lines(tiles, spark.createDataFrame(list(sizes), "image_id long, width long, height long")).collect()}
    assert set(got) == set(pictures) - {6}
    for k, p in pictures.items():
        if k == 6:
            continue
        ys, xs = np.nonzero(p >= 18)
        own = np.unique(ys)
        centers, extent = np.array([np.median(xs[ys == y]) for y in own]), [np.ptp(xs[ys == y]) + 1 for y in own]
        r, a = got[k], p[ys, xs]
        assert (r.occupied, r.coverage, r.width_p90, r.alpha_median) == (len(own), len(own) / p.shape[0], pytest.approx(np.quantile(extent, 0.9)), np.median(a))
        assert r.bright_share == pytest.approx(np.mean(a > 225))
        if len(own) > 1:
            slope, intercept = np.polyfit(own, centers, 1)
            off = np.quantile(np.abs(centers - slope * own - intercept), 0.9)
            assert (r.slope, r.intercept, r.residual_p90) == (pytest.approx(slope), pytest.approx(intercept), pytest.approx(off))
        assert r.is_line == (k in (0, 1, 2, 5))
    assert {(r.alpha, r.n) for r in pixels.histogram(tiles.filter("image_id = 7")).collect()} == {(100, 5)}


def flooded(lit, diagonal):
    """(first pixel, area, box) of each part, by filling one after the other."""
    out, left = [], {(int(y), int(x)) for y, x in zip(*np.nonzero(lit), strict=True)}
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    while left:
        first = min(left)
        part, todo = {first}, [first]
        while todo:
            y, x = todo.pop()
            new = {(y + a, x + b) for a, b in near} & left - part
            part |= new
            todo += new
        left -= part
        ys, xs = zip(*part, strict=True)
        out.append((*first, len(part), min(ys), min(xs), max(ys), max(xs)))
    return sorted(out)


@pytest.mark.parametrize(("step", "diagonal"), [(4, True), (7, False), (300, True)])
def test_parts_of_tiled_pictures(spark, step, diagonal):
    rng = np.random.default_rng(5)
    snake = np.zeros((21, 24), int)
    snake[::2], snake[1::4, -1], snake[3::4, 0] = 255, 255, 255
    wide = np.zeros((3, 600), int)
    wide[0, 100:400], wide[1, ::2], wide[2, 255:258] = 255, 255, 255
    pictures = {0: rng.integers(0, 40, (23, 31)), 1: snake, 2: np.full((9, 9), 200), 3: np.zeros((5, 5), int), 4: wide, 5: np.array([[255]]), 6: np.eye(12, dtype=int) * 99}
    tiles = spark.createDataFrame([t for k, p in pictures.items() for t in tiles_of(k, p, step)[0]] + [(7, 0, 0, 2, [None, 30, None, 30]), (8, 0, 0, 1, [])], "image_id long, top long, left long, width long, alpha array<long>")
    got = {}
    for r in pixels.parts(tiles, diagonal=diagonal).collect():
        got.setdefault(r.image_id, []).append(tuple(r)[1:])
    want = {k: flooded(p >= pixels.FOREGROUND, diagonal) for k, p in pictures.items() if (p >= pixels.FOREGROUND).any()} | {7: [(0, 1, 2, 0, 1, 1, 1)]}
    assert {k: sorted(v) for k, v in got.items()} == want
