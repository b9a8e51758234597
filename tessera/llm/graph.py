"""Connected components of links held in a DataFrame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of links a[i] - b[i] between nodes 0 .. n-1, the least node of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _min_neighbour(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v) with the least of u and its neighbours as m, and the table of these.

    Partial minima come before the shuffle. They are stored before the join, which then meets one row per node as they are: Spark
    broadcasts them if they are small, and else splits the rows of a star's hub over tasks (adaptive skew join), as it
    couldn't if the same stage still had to sum them up.
    """
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    return pairs.join(least, "u"), least


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of a link its component's least node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the links no longer change; each round cuts
    its lineage. Self-links, repeated links and nulls are ignored.
    """
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = stored(e.distinct())
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met, first = _min_neighbour(both)
        large = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small, second = _min_neighbour(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last, e = e, stored(small.filter("u <> v").distinct())
        for done in (last, first, second):
            discard(done)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    own = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
