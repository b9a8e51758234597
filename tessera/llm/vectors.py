"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance 2 - 2t. After a rotation their coordinates are split into
blocks of about eight; if two vectors are that near, then in at least one block their squared distance is within the
block's share of the budget. So each block is range-joined on its own, over a grid of up to five of its coordinates whose cells
are as wide as the block's radius. Pairs within a block's budget are verified exactly, and count in the first block that finds them.

A label of up to LARGE vectors is cut into parts of GROUP vectors, and each pair of parts is one task, which range-joins all
blocks: its vectors are moved once per part. A larger label is first cut for each block at measured quantiles of the block's
coordinates; a vector is at home in one leaf and visits those that its radius reaches.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, table
from .graph import components, local_roots

BLOCK = 8
AXES = 5  # coordinates of a block that make its grid
GROUP = 8192  # vectors on one side of a task's join
LARGE = 1 << 20
BROADCAST_ROWS = 100_000
SLACK = 1e-9
PAIRS = 1 << 19  # candidate pairs looked at in one go
PLACES = "array<struct<block: int, leaf: long, home: boolean>>"


def rotation(d: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]


def block_bounds(d: int) -> np.ndarray:
    return np.linspace(0, d, max(1, d // BLOCK) + 1).astype(int)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component is near 1: cosines stay as they are, and no norm over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(x.shape[1])


def _radius(share: float) -> float:
    return np.sqrt(share) * (1 + 1e-9) + 1e-12


def shares(d: int, threshold: float) -> np.ndarray:
    """Squared-distance budget of each block, in proportion to its coordinates."""
    return (2 - 2 * threshold) * np.diff(block_bounds(d)) / d + SLACK


def _places(x: np.ndarray, cuts: np.ndarray, axes: int, threshold: float) -> list[list[tuple[int, int, bool]]]:
    """Of each vector, in each block, the leaves that its radius reaches; cuts: ascending bounds of each coordinate's strips, used for the first `axes` of a block."""
    d, (y, out) = x.shape[1], (_unit(x), [[] for _ in x])
    bounds, base = block_bounds(d), cuts.shape[1] + 1
    for j, share in enumerate(shares(d, threshold)):
        r, at = _radius(share), slice(bounds[j], min(bounds[j] + axes, bounds[j + 1]))
        home, low, high = ((y[:, at, None] + s > cuts[None, at]).sum(2) for s in (0, -r, r))
        for i in range(len(x)):
            own = tuple(home[i])
            for leaf in product(*(range(a, z + 1) for a, z in zip(low[i], high[i], strict=True))):
                out[i].append((j, int(sum(s * base**k for k, s in enumerate(leaf))), leaf == own))
    return out


def _places_udf(threshold: float):
    @F.arrow_udf(PLACES)
    def run(vectors: pa.Array, cuts: pa.Array, axes: pa.Array) -> pa.Array:
        out = []
        for v, c, n in zip(vectors.to_pylist(), cuts.to_pylist(), axes.to_pylist(), strict=True):
            out.append([{"block": j, "leaf": s, "home": h} for j, s, h in _places(np.array([v], float), np.array(c), n, threshold)[0]])
        return pa.array(out, pa.list_(pa.struct([("block", pa.int32()), ("leaf", pa.int64()), ("home", pa.bool_())])))

    return run


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _rotated(vectors: pa.Array) -> pa.Array:
    return pa.array([_unit(np.array([v], float))[0] for v in vectors.to_pylist()], pa.list_(pa.float64()))


def grid_pairs(p: np.ndarray, q: np.ndarray, r: float):
    """Yields chunks (i, k) of index pairs of rows of p and q, among them all within distance r, each pair once.

    Rows lie in the cells, r wide, of a grid over the coordinates that are spread most; a row of p meets those of q in its own and in
    adjacent cells. Cells are numbered modulo 2**63; what meets by a wrapped number alone is one more pair to look at.
    """
    axes = np.argsort(-np.ptp(q, axis=0), kind="stable")[:AXES]
    low = np.minimum(p[:, axes].min(0), q[:, axes].min(0))
    a, b = (np.floor((x[:, axes] - low) / r).astype(np.int64) for x in (p, q))
    wide = np.maximum(a.max(0), b.max(0)) + 3
    step = np.append(1, np.cumprod(wide[:-1]))
    own, others = (a + 1) @ step, (b + 1) @ step
    order = np.argsort(others, kind="stable")
    others = others[order]
    around = np.unique(np.array(list(product((-1, 0, 1), repeat=len(axes)))) @ step)
    rows = max(1, (1 << 20) // len(around))
    for s in range(0, len(p), rows):
        keys = own[s : s + rows, None] + around
        first = np.searchsorted(others, keys.ravel())
        n = np.searchsorted(others, keys.ravel(), "right") - first
        of = np.repeat(np.arange(s, s + len(keys)), len(around))[n > 0]
        first, n = first[n > 0], n[n > 0]
        ends = np.cumsum(n)
        start = 0
        while start < len(n):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            m = n[start:stop]
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            yield np.repeat(of[start:stop], m), order[np.repeat(first[start:stop], m) + inner]
            start = stop


def _join_group(threshold: float):
    """Of two parts of a label, or of a leaf of one block: links of the pairs that lie across, or within if the parts are one."""

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        ids, size = t.column("rep").to_numpy(), t.column("size").to_numpy()
        home, other = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("as_home", "as_other"))
        raw = scaled(np.array(t.column("vector").to_pylist(), float).reshape(len(ids), -1))
        d = raw.shape[1]
        norm = np.linalg.norm(raw, axis=1)
        y = _unit(raw)
        bounds, share = block_bounds(d), shares(d, threshold)
        hs, os_ = np.flatnonzero(home), np.flatnonzero(other)
        itself = block < 0 and t.column("line")[0] == t.column("column")[0]
        links = np.zeros(len(ids), np.int64)
        found = [(np.zeros(0, int), np.zeros(0, int))]
        for j in range(len(share)) if block < 0 else [block]:
            if not len(hs) or not len(os_):
                break
            at = slice(bounds[j], bounds[j + 1])
            for a, b in grid_pairs(y[hs, at], y[os_, at], _radius(share[j])):
                a, b = hs[a], os_[b]
                # within one part both ways come up: one is enough, as a link counts for both ends
                good = (ids[a] < ids[b]) if itself else ids[a] != ids[b]
                a, b = a[good], b[good]
                for k in (j, *range(j)):  # within this block's budget, and in no earlier one's
                    near = ((y[a, bounds[k] : bounds[k + 1]] - y[b, bounds[k] : bounds[k + 1]]) ** 2).sum(1) <= share[k]
                    good = near if k == j else ~near
                    a, b = a[good], b[good]
                for s in range(0, len(a), 1 << 15):
                    x, z = a[s : s + (1 << 15)], b[s : s + (1 << 15)]
                    good = np.einsum("ij,ij->i", raw[x], raw[z]) / (norm[x] * norm[z]) >= threshold
                    x, z = x[good], z[good]
                    np.add.at(links, x, size[z])
                    if block < 0:
                        np.add.at(links, z, size[x])
                    found.append((x, z))
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        # local numbers follow the ids, so that the least node is the least id
        names, local = np.unique(ids, return_inverse=True)
        root = names[local_roots(local[a], local[b], len(names))][local]
        told = (links > 0) | (root != ids)
        return pa.table({"rep": ids[told], "links": links[told], "root": root[told]})

    return run


def _leaves(large: DataFrame, threshold: float, group: int) -> DataFrame:
    """Vectors of large labels at each leaf that they visit. Cuts are quartiles of as many coordinates of a block as leaves of about
    `group` vectors need, measured over all rows of a label."""
    label = ["label", "dim"]
    spread = large.select(*label, F.posexplode(_rotated("vector")).alias("axis", "y")).groupBy(*label, "axis").agg(F.percentile_approx("y", [0.25, 0.5, 0.75], 1000).alias("cuts"))
    cuts = spread.groupBy(*label).agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "cuts"))), lambda s: s["cuts"]).alias("cuts"))
    met = large.join(checkpointed(cuts), label).withColumn("axes", F.greatest(F.ceil(F.log(4.0, F.col("n") / group)), F.lit(1)).cast("int"))
    return met.withColumn("place", F.explode(_places_udf(threshold)("vector", "cuts", "axes"))).select(*label, "place.*", "rep", "size", "vector")


GRID = "array<struct<line: int, column: int, as_home: boolean, as_other: boolean>>"


def _grid(own: Column, cells: Column, home: Column, once: Column) -> Column:
    """The cells of a grid of parts that a row is sent to: along its line if at home, and down its column to be met; each pair of parts `once` or both ways."""
    every = F.sequence(F.lit(0), cells - 1)
    as_home = F.transform(every, lambda c: F.struct(own.alias("line"), c.alias("column"), F.lit(True).alias("as_home"), (c == own).alias("as_other")))
    as_home = F.filter(as_home, lambda s: ~once | (s["column"] >= own))
    met = F.transform(every, lambda c: F.struct(c.alias("line"), own.alias("column"), F.lit(False).alias("as_home"), F.lit(True).alias("as_other")))
    met = F.filter(met, lambda s: F.when(once, s["line"] < own).otherwise(~home | (s["line"] != own)))
    return F.concat(F.when(home, as_home).otherwise(F.array().cast(GRID)), met)


def near_duplicates(
    rows: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", group: int = GROUP, large: int = LARGE
) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    Compares vectors of equal labels. Null, empty or zero vectors, vectors with a null or non-finite component, and rows without a
    label or an id link with nothing; vectors of different lengths don't link either. Ids are taken to be unique. Equal vectors of one label form a class that is
    compared once; repeated rows count as further members. Vectors of any finite size, tiny or huge, are compared by direction. Parts of a
    label meet pairwise in tasks, so no task ever holds a whole label, and only sums and spanning links leave a task. An empty table gives
    an empty result. Other columns of `rows`, whatever their names, play no part.
    """
    x = rows.select(F.col(key).alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    fine = F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(
        F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0), F.lit(False)
    )
    x = x.withColumn("fine", fine)
    hashed = x.filter("fine").withColumn("k1", F.xxhash64("label", "vector")).withColumn("k2", F.xxhash64("vector", "label", F.lit(7)))
    classes = hashed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = checkpointed(classes.withColumn("dim", F.size("vector")))

    sizes = checkpointed(classes.groupBy("label", "dim").agg(F.count("*").alias("n")))
    few = sizes.count() <= BROADCAST_ROWS
    own = ["label", "dim", "rep", "size", "vector"]
    known = classes.join(F.broadcast(sizes) if few else sizes, ["label", "dim"])
    whole = known.filter(F.col("n") <= large).select(*own, F.lit(-1).alias("block"), F.lit(0).cast("long").alias("leaf"), F.lit(True).alias("home"))
    leaf = ["label", "dim", "block", "leaf"]
    placed = whole.select(*leaf, "rep", "size", "vector", "home")
    crowded = sizes.filter(F.col("n").between(group + 1, large)).select("label", "dim", F.lit(-1).alias("block"), F.lit(0).cast("long").alias("leaf"), "n")
    if not sizes.filter(F.col("n") > large).isEmpty():
        visits = checkpointed(_leaves(known.filter(F.col("n") > large).select(*own, "n"), threshold, group))
        placed = placed.unionByName(visits.select(*leaf, "rep", "size", "vector", "home"))
        crowded = crowded.unionByName(visits.groupBy(*leaf).agg(F.count("*").alias("n")).filter(F.col("n") > group))
    # leaves or labels with more vectors than a task should compare; a small table, broadcast only if it really is
    crowded = checkpointed(crowded.withColumn("cells", F.ceil(F.col("n") / group).cast("int")).drop("n"))
    cut = placed.join(F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded, leaf, "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
    part = F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int")
    cut = cut.withColumn("cell", F.explode(_grid(part, F.col("cells"), F.col("home"), F.col("block") < 0))).select(*leaf, "cell.*", "rep", "size", "vector")
    joined = cut.groupBy(*leaf, "line", "column").applyInArrow(_join_group(threshold), "rep long, links long, root long")
    joined = checkpointed(joined)

    links = joined.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(joined.filter("rep <> root"), "rep", "root")
    told = classes.select("k1", "k2", "rep", "size").join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select("k1", "k2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # each class has one row in told, so where many rows share a class, Spark splits their side of this join
    out = hashed.select("id", "k1", "k2").join(told, ["k1", "k2"]).select("id", "n_links", "component_id")
    out = out.unionByName(x.filter(~F.col("fine")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", key)


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fine AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.98
), reach(node, seen) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a
), comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN comp c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
