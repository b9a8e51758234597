"""Readings derived from order lines, so that every branch of the decision occurs in the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per order line: the order is the item, its number the tag, the line's figures the reading's quality.

    Rows are numbered within item_id itself, so that what follows finds them partitioned by it.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"
    )
    order = Window.partitionBy("item_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    base = (F.lit(100000) + 7 * F.col("item_id")).cast("string")
    near = (F.lit(100001) + 7 * F.col("item_id")).cast("string")
    part = F.col("l_partkey")
    text = (
        F.when((part % 5 == 0) & (F.col("item_id") % 40 == 0), " ")
        .when(part % 29 == 0, "")
        .when(part % 23 == 0, "N/A")
        .when(part % 19 == 0, F.reverse(base))
        .when(part % 17 == 0, near)
        .when(part % 13 == 0, F.concat(F.lit("SKU"), part.cast("string"), F.lit("X")))
        .when(part % 11 == 0, F.translate(base, "0", "O"))
        .otherwise(base)
    )
    crop = F.element_at(
        F.array(*map(F.lit, ("tag_crop_1_strict_white", "tag_crop_1_strict_white_enhanced", "fallback_full", "fallback_full_recheck", "fallback_lower"))),
        (F.col("l_linenumber") % 5 + 1).cast("int"),
    )
    rotation = F.element_at(F.array(*map(F.lit, ("original", "cw90", "ccw90", "rot180"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    width, height, zero = 40.0 + 4.0 * F.col("l_quantity"), 10.0 + 600.0 * F.col("l_discount"), F.lit(0.0)
    bbox = F.array(F.array(zero, zero), F.array(width, zero), F.array(width, height), F.array(zero, height))
    return lines.select(
        "item_id",
        F.row_number().over(order).cast("long").alias("pos"),
        text.alias("text"),
        F.least(F.lit(1.0), 0.4 + F.col("l_quantity") / 80.0 + F.col("l_tax") / 2.0).alias("confidence"),
        bbox.alias("bbox"),
        F.when((rotation == "original") & (crop == "fallback_full"), "auto_best").otherwise(rotation).alias("source_rotation"),
        crop.alias("source_crop"),
    )
