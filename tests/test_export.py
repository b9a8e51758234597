"""The search for an encoding against the choice among all sizes."""

import itertools

from pyspark.sql import functions as F

from tessera.operators import export
from tessera.sources import bridges


def test_search_asks_for_few_sizes_and_picks_the_same(spark):
    shapes = [(1, 1), (16, 9), (48, 48), (64, 20), (700, 100), (1500, 1500), (4000, 3000), (90, 96)]
    factors = [0.0, 1e-4, 0.003, 0.02, 0.1, 0.7, 4.0, 40.0]
    rows = [(k, w, h, f, add) for k, ((w, h), f, add) in enumerate(itertools.product(shapes, factors, (0, 7000, 20_000, 30_000)))]
    images = spark.createDataFrame(rows, "image long, w int, h int, f double, add long")

    def sizes(df):
        return df.withColumn("bytes", F.when(F.col("f") > 0, F.floor(F.col("f") * F.col("long_edge") * F.col("long_edge") * (F.col("quality") + 5) / 10) + F.col("add") + 1))

    got = export.search(images, sizes).toPandas().set_index("image").sort_index()
    grid = images.withColumn("long_edge", F.explode(F.concat(export.long_edges(F.col("w"), F.col("h")), F.array(*map(F.lit, export.LAST_EDGES)))))
    small = F.col("long_edge").isin(*export.LAST_EDGES)
    grid = sizes(grid.distinct().withColumn("quality", F.explode(F.concat(F.when(small, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.sequence(F.lit(10), F.lit(95))))))
    # the last edges are tried at quality 1 only, unless they are the picture's own
    grid = grid.filter(~small | (F.col("quality") == 1) | F.array_contains(export.long_edges(F.col("w"), F.col("h")), F.col("long_edge")))
    want = export.pick(grid).toPandas().set_index("image").sort_index()
    assert len(got) == len(want) == len(rows) and got["asked"].max() <= 14
    for c in ("quality", "long_edge", "bytes"):
        assert got[c].fillna(-1).astype(int).tolist() == want[c].fillna(-1).astype(int).tolist(), c


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "image long, w int, h int")
    assert export.search(none, lambda df: df.withColumn("bytes", F.lit(1))).count() == 0


def test_the_choice_among_all_sizes_sorts_nothing_and_spreads_a_small_file(spark, tmp_path):
    spark.range(50).selectExpr("id + 1 as p_partkey", "cast(id % 50 + 1 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    sizes = bridges.encodings(spark, str(tmp_path))
    plan = export.pick(sizes)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sizes.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
