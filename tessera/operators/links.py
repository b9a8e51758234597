"""What hangs together: connected components of links in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, stored_at


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of the links (a, b) the least node that it is connected to, itself included.

    Every round hangs each node's greater neighbours, then its lesser ones, on its least neighbour (alternating stars), until the links
    stay as they are: a number of rounds that grows with the logarithm of the links. Minima are taken before the shuffle and stored before the
    join, so that a hub's rows can be split over tasks. Nulls, links of a node with itself and repeated links say nothing.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now, path = stored_at(links.select("a", "b").filter("a <> b").distinct())
    state, old = None, None
    for _ in range(most_rounds):
        paths = [path]

        def hung(pairs: DataFrame, further: str) -> DataFrame:
            least, at = stored_at(pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
            paths.append(at)  # noqa: B023
            return pairs.join(least, "a").filter(further).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

        large, at = stored_at(hung(both(now), "b > a"))
        paths.append(at)
        lesser = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now, path = stored_at(hung(lesser, "b < a"))
        old, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(lambda p: p not in paths)  # noqa: B023
        if state == old:
            ends = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(ends)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
