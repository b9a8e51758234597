"""Inputs of the operators, derived from the given tables so that every rule finds rows that it applies to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.evidence import decide
from .readings import readings, table


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(readings(spark, sf_dir))


def _line_order(order: str = "l_orderkey") -> Window:
    return Window.partitionBy(order).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def _copy_mark(kind: Column) -> Column:
    """Some names already end as a renamed copy's does."""
    return F.when(kind == 1, "_2").when(kind == 2, "_3").when(kind == 3, "_2_2").when(kind == 4, "_40").otherwise("")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as photos of batches: few tags, so that many repeat, and statuses and backgrounds of every kind."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(key % 13 == 5, "REVIEW_REQUIRED").when(key % 17 == 3, "OCR_FAILED").when(key % 19 == 7, "TAG_NOT_FOUND").when(key % 101 == 9, "ERROR").otherwise("OK")
    return o.select(
        F.floor(key / 20000).alias("batch"), key.alias("item"), F.concat(F.lit("IMG "), (F.col("o_custkey") % 50).cast("string"), F.lit(".b"), _copy_mark(key % 11), F.lit(".jpg")).alias("filename"),
        F.when(status.isin("OCR_FAILED", "TAG_NOT_FOUND", "ERROR"), "").otherwise((100000 + key % 997).cast("string")).alias("tag_number"), status.alias("status"),
        F.when(key % 7 == 2, None).otherwise(key % 9 != 4).alias("background_ok"),
    )


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as report rows; file names repeat, item ids don't."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(key % 13 == 5, "REVIEW_REQUIRED").when(key % 17 == 3, "OCR_FAILED").when(key % 19 == 7, "TAG_NOT_FOUND").when(key % 23 == 1, "DUPLICATE_TAG").when(key % 101 == 9, "ERROR").otherwise("OK")
    return o.select(
        key.cast("string").alias("item_id"), F.concat(F.lit("IMG_"), F.col("o_custkey").cast("string"), F.lit(".jpg")).alias("original_filename"),
        F.when(status.isin("OCR_FAILED", "TAG_NOT_FOUND", "ERROR"), "").otherwise((100000 + key % 9973).cast("string")).alias("detected_tag_number"), status.alias("status"),
        F.when(key % 31 == 0, "ai_review").when(key % 29 == 0, "background_review").when(status == "OK", "processed_images").otherwise("review_required").alias("output_folder"),
        F.when(key % 11 == 0, None).when(key % 11 == 1, "NA").otherwise(F.col("o_orderpriority")).alias("notes"),
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by item id, by file name, and by selectors that mean nothing."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    selector = F.when(key % 3 == 0, (key * 7).cast("string")).when(key % 3 == 1, F.concat(F.lit("IMG_"), key.cast("string"), F.lit(".jpg"))).when(key % 2 == 0, " ").otherwise("nowhere")
    return c.select(selector.alias("selector"), F.create_map(F.lit("detected_tag_number"), (900000 + key).cast("string"), F.lit("status"), F.lit("OK"), F.lit("no_such_column"), F.lit("x")).alias("updates"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as members of archives, a third of them in one archive."""
    x = table(spark, sf_dir, "lineitem").withColumn("archive", F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_orderkey") % 97 + 1).cast("long"))
    pos = (F.col("l_orderkey") * 64 + F.row_number().over(_line_order())).cast("long")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    leaf = F.concat(F.lit("photo "), (part % 20).cast("string"), _copy_mark(part % 12), F.lit(".jpg"))
    name = (
        F.when(part % 41 == 0, F.concat(F.lit("../up/"), leaf)).when(part % 43 == 0, F.concat(F.lit("a/../../b/"), leaf)).when(part % 47 == 0, F.concat(F.lit("/abs/"), leaf))
        .when(part % 37 == 0, F.concat(F.lit("set\\"), leaf)).when(part % 31 == 0, F.concat(F.lit("x/./../"), leaf)).when(part % 29 == 0, "folder/").when(part % 53 == 0, " ")
        .otherwise(F.concat(F.lit("set"), (supp % 5).cast("string"), F.lit("/"), leaf))
    )
    size = F.floor(F.col("l_extendedprice") * F.when(part % 50 == 7, 2500).otherwise(20)).cast("long")
    return x.select(
        "archive", pos.alias("pos"), name.alias("name"), name.endswith("/").alias("is_dir"), F.when(supp % 61 == 0, 1).otherwise(0).alias("flag_bits"),
        size.alias("file_size"), F.floor(size / (1 + part % 260)).cast("long").alias("compress_size"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    path = F.concat(F.lit("models/"), F.col("p_partkey").cast("string"), F.lit(".bin"))
    return p.select("p_partkey", path.alias("path"), (F.col("p_size") * 1000 + F.col("p_partkey")).cast("long").alias("size"), F.sha2(F.concat(path, F.col("p_name")), 256).alias("sha256"))


def on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's files with some lost, cut, altered or added."""
    m, key = manifest(spark, sf_dir), F.col("p_partkey")
    return m.filter(key % 11 != 0).select(
        F.when(key % 19 == 0, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), (F.col("size") + (key % 13 == 0).cast("int")).alias("size"),
        F.when(key % 17 == 0, F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"),
    )


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as regions of photos of 1600 by 1200, an order being a photo."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    label = F.when(F.col("l_linenumber") == 1, "fallback_full").when(F.col("l_linenumber") == 2, "fallback_lower").when(F.col("l_linenumber") % 2 == 0, "tag_crop_1_strict_white").otherwise("tag_crop_1_soft_tag")
    x = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "item_id").select(
        "item_id", F.row_number().over(_line_order("item_id")).cast("long").alias("pos"), label.alias("label"), (part * 7 % 400).alias("x"), (supp * 5 % 300).alias("y"),
        (20 + F.col("l_quantity") * 6).cast("long").alias("w"), (20 + F.floor(F.col("l_discount") * 1500 + 0.5)).cast("long").alias("h"),
        (F.col("l_tax") * 10.0).alias("light"), (F.col("l_quantity") / 60.0).alias("saturation"), (F.col("l_discount") * 0.9).alias("dark"),
    )
    return x.withColumn("area", F.col("w") * F.col("h") * 0.85)


def crop_score(x: DataFrame) -> Column:
    from ..operators import geometry as g

    c = {n: F.col(n) for n in ("x", "y", "w", "h", "area", "light", "saturation", "dark")}
    return g.crop_score(**c, image_w=F.lit(1600.0), image_h=F.lit(1200.0), strict=F.col("label").endswith("strict_white"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as measures of masks."""
    d, t, q, part = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 64 + F.row_number().over(_line_order())).cast("long").alias("mask_id"), (d / 2.0).alias("removed_foreground"), (t / 10.0).alias("removed_supported"),
        (d / 20.0).alias("interior_holes"), (part % 30).alias("lost_parts"), (F.col("l_suppkey") % 5).alias("missing_parts"), (t / 40.0).alias("residue"), (d / 300.0).alias("residue_patch"),
        (part % 7 != 0).alias("status_ok"), (q / 52.0).alias("foreground"), (t / 8.0).alias("solid"), (d * 9.0).alias("soft"), (part % 170).alias("parts"),
        (q / 100.0).alias("coverage"), (d * 150.0).alias("gradient_median"), (d * 150.0 + t * 300.0).alias("gradient_p90"),
    )


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as small grey rasters: image_id, pixels (array of double); those without numbers are left out."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda p: p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))), F.lit(False)) & (F.size(v) > 0)
    return table(spark, sf_dir, "embeddings").filter(fine).select(F.col("vec_id").alias("image_id"), v.alias("pixels"))


def tiled(images: DataFrame) -> DataFrame:
    """Square rasters (image_id, pixels) in four tiles each: image_id, top, left, width, alpha (the tile's pixels)."""
    side = F.floor(F.sqrt(F.size("pixels").cast("double"))).cast("int")
    half = F.ceil(F.col("side") / 2).cast("int")
    corner = lambda y, x: F.struct((half * y).alias("top"), (half * x).alias("left"), (F.col("side") - half if y else half).alias("height"), (F.col("side") - half if x else half).alias("width"))
    x = images.withColumn("side", side).select("image_id", "side", "pixels", F.explode(F.array(*(corner(y, x) for y in (0, 1) for x in (0, 1)))).alias("t"))
    x = x.select("image_id", "side", "pixels", "t.*").filter("height > 0 AND width > 0")
    line = lambda y: F.slice("pixels", y * F.col("side") + F.col("left") + 1, F.col("width"))
    return x.select("image_id", "top", "left", "width", F.flatten(F.transform(F.sequence(F.col("top"), F.col("top") + F.col("height") - 1), line)).alias("alpha"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows with what reading said, what became of a prepared background, and here and there an error."""
    x, key = report(spark, sf_dir), F.col("item_id").cast("long")
    said = F.when(key % 7 == 0, None).when(key % 7 == 1, "").otherwise(F.concat(F.lit("Seen "), key % 5, F.lit(" times.")))
    return x.select(
        "item_id", "original_filename", "detected_tag_number", F.when(F.col("status") == "ERROR", "OK").otherwise(F.col("status")).alias("status"), "output_folder", said.alias("notes"),
        F.when(key % 4 == 0, "READY").when(key % 4 == 1, "REVIEW_REQUIRED").when(key % 4 == 2, "FAILED").otherwise("").alias("correction_cache_status"),
        F.when(key % 101 == 9, F.concat(F.lit("bad picture "), key)).alias("error"),
    )


def part_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pictures to be encoded: image, w, h."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), (300 + F.col("p_partkey") * 37 % 1500).alias("w"), (F.col("p_size") * 31).alias("h"))


def with_sizes(asked: DataFrame) -> DataFrame:
    """Adds bytes: how large an encoding (image, long_edge, quality) is."""
    size = F.floor(F.col("long_edge") * F.col("long_edge") * (F.col("image") % 23 + 1) * (F.col("quality") + 5) / 4000)
    return asked.withColumn("bytes", (size + F.col("image") % 40 * 600).cast("long"))


def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts' pictures at every quality and edge of the ladder; size grows with both.

    Pictures, a thousand sizes each, are spread before they are multiplied: a small file would else be one task. What groups by picture then needs no exchange.
    """
    from ..operators.export import LAST_EDGES, long_edges

    p = part_pictures(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image")
    grid = p.withColumn("long_edge", F.explode(F.concat(long_edges(F.col("w"), F.col("h")), F.array(*map(F.lit, LAST_EDGES)))))
    quality = F.when(F.col("long_edge").isin(*LAST_EDGES), F.array(F.lit(1))).otherwise(F.sequence(F.lit(10), F.lit(95)))
    grid = grid.withColumn("quality", F.explode(quality))
    return with_sizes(grid).select("image", "quality", "long_edge", "bytes")


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files and folders that are copied to one of a few destinations, a third of them to one."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.when((key % 3 != 0) & (key % 5 < 2), "result").otherwise(F.concat(F.lit("out."), (F.col("o_custkey") % 40).cast("string")))
    return o.select(
        F.when(key % 3 == 0, 0).otherwise(key % 31 + 1).alias("destination"), key.alias("item"), F.concat(name, _copy_mark(key % 13), F.when(key % 7 == 0, "").otherwise(".zip")).alias("name"),
        (key % 7 == 0).alias("is_directory"),
    )


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters as pictures: opacity, colour and supported pixels as whole numbers; image_id, alpha, colour, support."""
    whole = lambda scale, shift: F.transform("pixels", lambda p: F.least(F.greatest(F.floor(p * scale + shift), F.lit(0)), F.lit(255)).cast("long"))
    return rasters(spark, sf_dir).select("image_id", whole(900, 90).alias("alpha"), whole(-500, 128).alias("colour"), F.transform("pixels", lambda p: (p > -0.06).cast("long")).alias("support"))
