"""Every registered query of the core library, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, readings as r
from ..images.kernels import mask_measures, mask_parts
from ..operators import evidence, export, geometry, ingest, naming, pixels, planner, quarantine, report, review, safety
from ..sources import bridges
from ..sinks.versions import VersionedReport
from ..sources.readings import readings, table
from ..streaming import live
from ..tables import new_folder
from .oracle import ORACLE_SQL  # noqa: F401

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def tag_decision(spark: SparkSession, d: str) -> DataFrame:
    """Which number does each item carry, and can the reading be trusted?"""
    out = bridges.decisions(spark, d)
    return out.select("item_id", "tag_number", "confidence", "raw_text", "status", "branch", "evidence_count", "strong_evidence_count", "best_ocr_confidence", "score_margin", "best_source_rotation", "best_source_crop")


@query
def digit_normalize(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("item_id", "pos", r.normalise_digits(F.col("text")).alias("digits"))


@query
def prominence(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("item_id", "pos", r.prominence(F.col("bbox")).alias("prominence"))


@query
def candidate_extract(spark: SparkSession, d: str) -> DataFrame:
    return evidence.candidates(readings(spark, d)).select("item_id", "pos", F.col("match_no").cast("long").alias("match_no"), "value", "score")


@query
def source_evidence(spark: SparkSession, d: str) -> DataFrame:
    x = evidence.candidates(readings(spark, d)).withColumn("crop", r.canonical_crop(F.col("source_crop")))
    return x.groupBy("item_id", "value", "crop", F.col("source_rotation").alias("rotation")).agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_readings"))


@query
def consensus_rank(spark: SparkSession, d: str) -> DataFrame:
    x = evidence.ranked(evidence.consensus(evidence.candidates(readings(spark, d))))
    return x.select("item_id", "value", "score", F.col("source_count").cast("long").alias("source_count"), F.col("strong_source_count").cast("long").alias("strong_source_count"), F.col("place").cast("long").alias("place"))


@query
def reverse_conflicts(spark: SparkSession, d: str) -> DataFrame:
    values = evidence.consensus(evidence.candidates(readings(spark, d)))
    return evidence.reverse_matches(values, evidence.ranked(values, most=1))


@query
def raw_text_join(spark: SparkSession, d: str) -> DataFrame:
    return evidence.raw_texts(readings(spark, d))


@query
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.summary(bridges.decisions(spark, d).withColumn("batch", F.floor(F.col("item_id") / 5000)), "batch")


@query
def live_counters(spark: SparkSession, d: str) -> DataFrame:
    x = report.live_counters(bridges.photos(spark, d))
    return x.select("batch", "item", "n_ok", "n_duplicates", "n_errors", "n_review")


@query
def friendly_status(spark: SparkSession, d: str) -> DataFrame:
    return report.display(bridges.report(spark, d)).select("item_id", "status_label", "badge")


@query
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return report.review_queue(bridges.report(spark, d)).select("item_id", "status", "output_folder")


@query
def legacy_queue(spark: SparkSession, d: str) -> DataFrame:
    return report.legacy_queue(bridges.report(spark, d)).select("item_id", "status")


@query
def report_search(spark: SparkSession, d: str) -> DataFrame:
    return report.search(bridges.report(spark, d), "IMG_1[0-9]+|1004", status="OK").select("item_id", "original_filename", "detected_tag_number")


@query
def report_normalize(spark: SparkSession, d: str) -> DataFrame:
    return report.normalise(bridges.report(spark, d), reading=True).select("item_id", "original_filename", "detected_tag_number", "status", "output_folder", "notes", "confidence_score")


@query
def row_selector(spark: SparkSession, d: str) -> DataFrame:
    return report.matches(bridges.report(spark, d), bridges.edits(spark, d))


@query
def report_update(spark: SparkSession, d: str) -> DataFrame:
    return report.update(bridges.report(spark, d), bridges.edits(spark, d)).select("item_id", "original_filename", "detected_tag_number", "status", "output_folder")


@query
def report_versions(spark: SparkSession, d: str) -> DataFrame:
    """A report written batch by batch, one of them twice, and then edited: its newest version."""
    rows, kept = bridges.report(spark, d), VersionedReport(spark, new_folder(spark, "report"))
    for batch in (0, 1, 1, 2):
        kept.add_batch(rows.filter(F.crc32(F.col("item_id").cast("binary")) % 3 == batch), batch)
    kept.edit(bridges.edits(spark, d))
    return kept.read().select("item_id", "original_filename", "detected_tag_number", "status", "output_folder")


@query
def qa_compare(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.concat(F.when(key % 9 == 4, "NEW_").otherwise("IMG_"), F.col("o_custkey").cast("string"), F.lit(".jpg"))
    cases = table(spark, d, "orders").groupBy(name.alias("original_filename")).agg(F.max(F.when(key % 4 == 0, "-").otherwise((100000 + key % 9973).cast("string"))).alias("expected"))
    return report.qa_compare(cases, bridges.report(spark, d))


@query
def item_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.coalesce(F.regexp_extract("url", "//([^/]+)/", 1), F.lit("")).alias("batch"), F.coalesce("url", F.lit("")).alias("path"), "page_id")
    return naming.item_ids(p)


@query
def safe_stems(spark: SparkSession, d: str) -> DataFrame:
    u = F.coalesce(F.col("url"), F.lit(""))
    return table(spark, d, "pages").select("page_id", labels.safe_stem(u).alias("stem"), labels.safe_stem(F.concat(F.lit("REVIEW_"), labels.safe_stem(labels.base_name(u)))).alias("review_stem"))


@query
def format_filter(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    end = F.element_at(F.array(*map(F.lit, (".jpg", ".JPEG", ".webp", ".heic", ".zip", ".txt", "", ".tar.png"))), (key % 8 + 1).cast("int"))
    files = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("in/"), F.col("o_custkey").cast("string"), end).alias("path"))
    return ingest.sort_formats(files).select("o_orderkey", "format", "verdict")


@query
def content_dedupe(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return ingest.first_of_equal(files, "doc_id").select("doc_id", "first_key", "duplicate")


@query
def output_names(spark: SparkSession, d: str) -> DataFrame:
    return naming.output_names(bridges.photos(spark, d)).select("item", "status", "output_folder", "final_filename", "transparent_filename")


@query
def transparent_names(spark: SparkSession, d: str) -> DataFrame:
    return naming.output_names(bridges.photos(spark, d), "transparent_only").select("item", "status", "output_folder", "final_filename", "transparent_filename")


@query
def archive_totals(spark: SparkSession, d: str) -> DataFrame:
    return ingest.archive_totals(bridges.members(spark, d))


@query
def archive_cascade(spark: SparkSession, d: str) -> DataFrame:
    return ingest.archive_cascade(bridges.members(spark, d)).select("pos", "archive", "verdict", "target")


@query
def archive_renames(spark: SparkSession, d: str) -> DataFrame:
    return ingest.archive_targets(bridges.members(spark, d)).select("pos", "archive", "final", "renamed")


@query
def saved_names(spark: SparkSession, d: str) -> DataFrame:
    return naming.free_files(bridges.saved(spark, d), ["destination"], "name", "item", F.col("is_directory")).select("item", "final", "renamed")


@query
def continued_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of files and folders where others are already, customers' ones in the second half of destinations."""
    x = bridges.saved(spark, d).withColumn("name", F.when(F.col("is_directory") & (F.col("item") % 2 == 0), F.concat("name", F.lit(".zip"))).otherwise(F.col("name")))
    c = table(spark, d, "customer").select((F.col("c_custkey") % 32).alias("destination"), F.col("c_custkey").alias("key"))
    mark = F.when(F.col("key") % 3 > 0, F.concat(F.lit("_"), (F.col("key") % 7 + 2).cast("string"))).otherwise("")
    taken = c.select("destination", F.concat(F.when(F.col("key") % 2 == 0, "result").otherwise(F.concat(F.lit("out."), (F.col("key") % 40).cast("string"))), mark, F.when(F.col("key") % 5 == 0, "").otherwise(".zip")).alias("name"))
    return naming.free_files(x, ["destination"], "name", "item", F.col("is_directory"), taken.distinct()).select("item", "final", "renamed")


@query
def manifest_verify(spark: SparkSession, d: str) -> DataFrame:
    return ingest.manifest_verify(bridges.manifest(spark, d), bridges.on_disk(spark, d))


@query
def manifest_totals(spark: SparkSession, d: str) -> DataFrame:
    return ingest.manifest_totals(bridges.manifest(spark, d))


@query
def output_diff(spark: SparkSession, d: str) -> DataFrame:
    return ingest.name_difference(bridges.manifest(spark, d).select(F.col("path").alias("name")), bridges.on_disk(spark, d).select(F.col("path").alias("name")))


@query
def latest_run(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    reports = e.filter("event_type = 'purchase'").select((F.col("user_id") % 10).alias("root"), F.col("user_id").alias("run"), F.col("ts").alias("modified"))
    marks = e.filter("event_type = 'error' and value < 20").select(F.col("user_id").alias("run"))
    return ingest.latest_run(reports, marks)


@query
def stale_archives(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "zip").when(F.col("event_type") == "view", "source").when((F.col("event_type") == "error") & (F.col("value") < 10), "marker").otherwise("other")
    return ingest.stale_archives(e.select(F.col("user_id").alias("run"), kind.alias("kind"), F.col("ts").alias("modified"), F.floor("value").alias("size")))


def _job_events(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    state = F.when(t == "signup", "QUEUED").when(t.isin("view", "click"), "RUNNING").when(t == "purchase", "COMPLETED").otherwise("FAILED")
    return table(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 37).alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), state.alias("state"), F.floor("value").cast("long").alias("done"), F.lit(80).cast("long").alias("total"), F.col("props").alias("message"))


@query
def latest_job_state(spark: SparkSession, d: str) -> DataFrame:
    return review.job_states(_job_events(spark, d)).drop("started")


@query
def latest_running_job(spark: SparkSession, d: str) -> DataFrame:
    return review.latest_running(review.job_states(_job_events(spark, d))).select("job_id", "state")


@query
def crop_score(spark: SparkSession, d: str) -> DataFrame:
    x = bridges.crops(spark, d)
    fits = geometry.crop_verdict(F.col("w"), F.col("h"), F.col("area"), F.lit(1600.0 * 1200.0))
    return x.select("item_id", "pos", fits.alias("fits"), F.round(bridges.crop_score(x), 9).alias("score"))


@query
def crop_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What is read of each order's photo; a third of the orders have no regions of their own."""
    x = bridges.crops(spark, d).filter(F.col("item_id") % 3 > 0)
    x = x.withColumn("score", F.round(bridges.crop_score(x), 9))
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), (1600 + F.col("o_orderkey") % 7).alias("image_w"), (1200 + F.col("o_orderkey") % 11).alias("image_h"))
    return geometry.crop_candidates(x, images).na.fill(0, ["pos"])


@query
def crop_nms(spark: SparkSession, d: str) -> DataFrame:
    x = bridges.crops(spark, d)
    kept = geometry.distinct_crops(x.withColumn("score", F.round(bridges.crop_score(x), 9)), most=None)
    return kept.select("item_id", F.posexplode("kept").alias("nth", "c")).select("item_id", F.col("nth").cast("long").alias("nth"), "c.pos")


@query
def crop_shapes(spark: SparkSession, d: str) -> DataFrame:
    return geometry.distinct_shapes(bridges.crops(spark, d)).select("item_id", "pos", F.col("place").cast("long").alias("place"))


@query
def crop_priority(spark: SparkSession, d: str) -> DataFrame:
    return geometry.crop_priority(bridges.crops(spark, d)).select("item_id", "pos", F.col("place").cast("long").alias("place"))


@query
def rotation_plan(spark: SparkSession, d: str) -> DataFrame:
    turns = geometry.rotations(F.col("label"), F.col("w"), F.col("h"))
    return bridges.crops(spark, d).select("item_id", "pos", F.array_join(turns, ",").alias("turns"))


@query
def rotate_points(spark: SparkSession, d: str) -> DataFrame:
    x = bridges.crops(spark, d).withColumn("rotation", F.element_at(F.array(*map(F.lit, ("original", "cw90", "ccw90", "rot180"))), (F.col("pos") % 4 + 1).cast("int")))
    p = geometry.turn_back(F.col("x"), F.col("y"), F.col("rotation"), F.lit(380), F.lit(290))
    return x.select("item_id", "pos", p["x"].cast("long").alias("px"), p["y"].cast("long").alias("py"))


@query
def anchor_in_crop(spark: SparkSession, d: str) -> DataFrame:
    x = bridges.crops(spark, d)
    anchors = x.filter("pos = 1").select("item_id", (F.col("x") + 30).alias("ax"), (F.col("y") + 20).alias("ay"))
    return geometry.crop_at(anchors, x.select("item_id", "pos", "label", "x", "y", "w", "h"))


@query
def crop_padding(spark: SparkSession, d: str) -> DataFrame:
    b = geometry.padded(*map(F.col, "xywh"), F.lit(420), F.lit(320))
    return bridges.crops(spark, d).select("item_id", "pos", *(b[c].cast("long").alias(f"p{c}") for c in "xywh"))


@query
def catalogue_geometry(spark: SparkSession, d: str) -> DataFrame:
    x = bridges.crops(spark, d)
    place = geometry.catalogue_layout(F.col("w"), F.col("h"))
    return x.select("item_id", "pos", *(place[c].cast("long").alias(f"c{c}") for c in "whxy"))


@query
def attempt_budget(spark: SparkSession, d: str) -> DataFrame:
    x = readings(spark, d)
    planned = F.when(F.col("source_rotation") == "auto_best", 4).when(F.col("source_crop").startswith("fallback"), 2).otherwise(3)
    used = planner.within_budget(x.select("item_id", F.col("pos").alias("attempt_no"), planned.alias("planned")))
    return used.select("item_id", "attempt_no", F.col("used").cast("long").alias("used"))


@query
def ocr_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    return planner.replay(readings(spark, d).withColumn("checkpoint", F.floor((F.col("pos") + 1) / 2)))


@query
def live_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """The decisions of ocr_checkpoints by a stream of readings, of which a few files arrive at a time and in no order."""
    item, x = Window.partitionBy("item_id"), readings(spark, d).withColumn("checkpoint", F.floor((F.col("pos") + 1) / 2))
    x = x.withColumn("expected", F.count("*").over(Window.partitionBy("item_id", "checkpoint"))).withColumn("last", F.max("checkpoint").over(item) == F.col("checkpoint"))
    x = x.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("pos")))
    source = new_folder(spark, "readings")
    x.repartition(4, F.xxhash64("item_id", "pos")).write.parquet(source)
    stream = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 2).parquet(source)
    return live.settled(live.live_decisions(stream)).drop("notes")


@query
def safety_reasons(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.array_join(c, ",")
    return bridges.masks(spark, d).select("mask_id", one(safety.safety_reasons()).alias("reasons"), one(safety.catastrophic_reasons()).alias("catastrophic"))


@query
def alpha_validate(spark: SparkSession, d: str) -> DataFrame:
    return bridges.masks(spark, d).select("mask_id", safety.alpha_verdict(*map(F.col, ("foreground", "solid", "soft", "parts"))).alias("verdict"))


@query
def smart_route(spark: SparkSession, d: str) -> DataFrame:
    x = bridges.masks(spark, d)
    why = safety.route_reasons(F.col("status_ok"), safety.catastrophic_reasons(), *map(F.col, ("coverage", "gradient_median", "gradient_p90")))
    refine = safety.needs_refinement(F.col("status_ok"), safety.catastrophic_reasons())
    return x.select("mask_id", F.array_join(why, ",").alias("reasons"), refine.alias("needs_refinement"))


@query
def hybrid_route(spark: SparkSession, d: str) -> DataFrame:
    x, m = bridges.masks(spark, d), F.col("mask_id")
    clean = F.when(m % 5 == 0, None).otherwise(F.size(safety.safety_reasons()) == 0)
    keep = F.when(m % 7 == 0, None).otherwise(F.col("status_ok"))
    route = safety.merged_route(clean, safety.safety_reasons(), keep, safety.catastrophic_reasons(), F.col("parts") < 120)
    return x.select("mask_id", route.alias("route"))


@query
def mask_stats(spark: SparkSession, d: str) -> DataFrame:
    p = bridges.rasters(spark, d).withColumn("sorted", F.sort_array("pixels"))
    share = F.size(F.filter("pixels", lambda v: v > 0)) / F.size("pixels")
    return p.select("image_id", F.round(share, 9).alias("foreground"), F.round(labels.quantile(F.col("sorted"), 0.5), 9).alias("p50"), F.round(labels.quantile(F.col("sorted"), 0.9), 9).alias("p90"))


@query
def line_fit(spark: SparkSession, d: str) -> DataFrame:
    """The lines that pictures' foregrounds follow, every picture in two tiles."""
    x = bridges.pictures(spark, d).withColumn("width", F.floor(F.sqrt(F.size("alpha").cast("double"))))
    half = F.floor(F.size("alpha") / F.col("width") / 2)
    tile = lambda top, cells: F.struct(top.alias("top"), F.lit(0).alias("left"), cells.alias("alpha"))
    cut = (half * F.col("width")).cast("int")
    two = F.array(tile(F.lit(0).cast("long"), F.slice("alpha", F.lit(1), cut)), tile(half, F.slice("alpha", cut + 1, F.size("alpha"))))
    tiles = x.select("image_id", "width", F.explode(two).alias("t")).select("image_id", "width", "t.*")
    out = pixels.lines(tiles, x.select("image_id", "width", F.ceil(F.size("alpha") / F.col("width")).alias("height")))
    return out.select("image_id", "occupied", *((F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("coverage", "width_p90", "slope", "intercept", "residual_p90", "alpha_median", "bright_share")), "is_line")


@query
def size_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor(F.pow(F.lit(7.0), F.col("p_size") / 5.0)).cast("long")
    return table(spark, d, "part").select("p_partkey", labels.size_label(n).alias("size_label"), labels.elapsed_label((F.col("p_size") - 1) / 8.0 + 0.0312).alias("elapsed_label"))


@query
def ladder_pick(spark: SparkSession, d: str) -> DataFrame:
    return export.pick(bridges.encodings(spark, d)).na.fill(0)


@query
def ladder_search(spark: SparkSession, d: str) -> DataFrame:
    """The same choice, asking for at most fourteen sizes of each picture."""
    return export.search(bridges.part_pictures(spark, d), bridges.with_sizes).drop("asked").na.fill(0)


@query
def export_state(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    x = table(spark, d, "orders").select(
        key.alias("name"), F.when(key % 17 == 0, None).otherwise(key % 100).alias("source_modified"), F.when(key % 13 == 0, None).otherwise(key % 103).alias("target_modified"),
        F.floor("o_totalprice").cast("long").alias("bytes"), (key % 11 != 0).alias("is_jpeg"),
    )
    return export.current(x, budget=200_000).select("name", "state")


def _corrections(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("item_id").cast("long")
    x = bridges.report(spark, d).select(
        "item_id", "status", "output_folder", "original_filename", F.lit("0.5").alias("confidence_score"), F.when(key % 6 == 0, "12a45").otherwise((100000 + key).cast("string")).alias("tag"),
        (1 + (key % 29 == 0).cast("int") - (key % 31 == 0).cast("int")).alias("matches"), (key % 37 != 0).alias("has_file"),
        F.element_at(F.array(*map(F.lit, ("white_and_transparent", "white_only", "transparent_only", "none", "", "odd"))), (key % 6 + 1).cast("int")).alias("background_mode"),
        F.when(key % 4 == 0, "READY").when(key % 4 == 1, "REVIEW_REQUIRED").when(key % 4 == 2, "FAILED").otherwise("").alias("correction_cache_status"),
        F.when(key % 3 != 0, "w.png").otherwise("").alias("correction_cache_white_filename"), F.when(key % 5 != 0, "t.png").otherwise("").alias("correction_cache_transparent_filename"),
        (key % 7 != 0).alias("rerun_ok"), (key % 2).alias("taken"),
    )
    return x


@query
def correction_transition(spark: SparkSession, d: str) -> DataFrame:
    return review.correct(_corrections(spark, d)).select("item_id", "step", "new_status", "new_folder", "new_confidence", "stale")


@query
def correction_files(spark: SparkSession, d: str) -> DataFrame:
    """Which files corrections move, copy and delete, where many give the same tag and customers' files are there already."""
    key, c = F.col("item_id").cast("long"), F.col("c_custkey")
    x = _corrections(spark, d).withColumn("tag", F.when(F.length("tag") == 6, (100000 + key % 997).cast("string")).otherwise(F.col("tag")))
    x = x.withColumns({"item": key, "final_filename": F.concat(F.lit("REVIEW_"), (key % 211).cast("string"), F.lit(".b.png"))})
    names = [("processed_images", 997), ("transparent_images", 499), ("background_review", 0)]
    taken = table(spark, d, "customer").select(F.explode(F.array(*(F.struct(F.lit(f).alias("folder"), F.concat((100000 + c % n).cast("string") if n else F.concat(F.lit("BG_REVIEW_REVIEW_"), (c % 100).cast("string")), F.lit(".png")).alias("name")) for f, n in names))).alias("t")).select("t.*")
    return review.correction_actions(review.correct(x), taken.distinct())


@query
def background_transition(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("item_id").cast("long")
    x = bridges.report(spark, d).withColumn("output_folder", F.when(key % 3 == 0, "processed_images").otherwise("background_review")).select(
        "item_id", "status", "output_folder", "detected_tag_number", F.when(key % 10 == 0, "other").when(key % 2 == 0, "accept_preview").otherwise("keep_original").alias("action"),
        (1 + (key % 29 == 0).cast("int") - (key % 31 == 0).cast("int")).alias("matches"), (key % 7 != 0).alias("has_original"), (key % 11 != 0).alias("has_white"), (key % 13 != 0).alias("has_transparent"),
        F.element_at(F.array(*map(F.lit, ("white_and_transparent", "white_only", "transparent_only"))), (key % 5 % 3 + 1).cast("int")).alias("background_mode"), (F.floor(key / 2) % 2).alias("taken"),
    )
    return review.decide_background(x).select("item_id", "step", "new_status", "new_folder", "new_background", "clear_copy")


@query
def mask_components(spark: SparkSession, d: str) -> DataFrame:
    """Parts, largest part and holes of every raster."""
    return mask_parts(bridges.rasters(spark, d), 0.02)


@query
def tile_parts(spark: SparkSession, d: str) -> DataFrame:
    """Connected parts of every raster with areas and boxes, every raster in four tiles."""
    out = pixels.parts(bridges.tiled(bridges.rasters(spark, d)), lambda p: p > 0.02)
    return out.select("image_id", *(F.col(c).cast("long").alias(c) for c in ("y", "x", "area", "top", "left", "bottom", "right")))


@query
def result_notes(spark: SparkSession, d: str) -> DataFrame:
    """What the report says of every photo, those that could not be processed among them."""
    return quarantine.results(bridges.results(spark, d))


@query
def base_crops(spark: SparkSession, d: str) -> DataFrame:
    x = readings(spark, d)
    return x.groupBy(r.base_crop(F.when(F.col("pos") % 3 == 0, F.concat("source_crop", F.lit("_verification"))).otherwise(F.col("source_crop"))).alias("crop")).agg(F.count("*").alias("n"))


@query
def cache_names(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("item_id").cast("long")
    name = F.when(key % 5 == 0, " ").when(key % 5 == 1, F.concat(F.lit("sub\\"), "original_filename")).otherwise(F.concat(F.lit("a/b/"), "original_filename"))
    return bridges.report(spark, d).select("item_id", labels.cache_file(name).alias("cached"), labels.preview_names(F.col("original_filename"))["transparent"].alias("preview"))


@query
def legacy_transition(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("item_id").cast("long")
    x = bridges.report(spark, d).withColumns({
        "action": F.when(key % 3 == 0, "accept_ai").when(key % 3 == 1, "send_manual").otherwise("other"), "matches": 1 + (key % 29 == 0).cast("int"), "taken": F.floor(key / 2) % 2,
    })
    return review.decide_legacy(x).select("item_id", "step", "new_status", "new_folder")


@query
def background_queue(spark: SparkSession, d: str) -> DataFrame:
    return report.background_queue(bridges.report(spark, d)).select("item_id", "status")


@query
def job_starts(spark: SparkSession, d: str) -> DataFrame:
    """Events as starts of corrections: which job does each give, and what marks its folder?"""
    e = table(spark, d, "events").withColumn("over_seq", F.when(F.col("event_type") == "error", None).otherwise(F.col("event_id") + F.floor(F.col("value") * 40).cast("long")))
    x = review.repeated_starts(e.select((F.col("user_id") % 4).alias("root"), F.col("user_id").alias("item_id"), (F.col("event_id") * 10).alias("job_id"), F.col("event_id").alias("seq"), "over_seq"))
    return x.select("item_id", "seq", "given", review.marker(F.when(F.col("given") == F.col("seq") * 10, "COMPLETED").otherwise("RUNNING")).alias("mark"))


@query
def forget_jobs(spark: SparkSession, d: str) -> DataFrame:
    return review.forget(review.job_states(_job_events(spark, d)), table(spark, d, "events").select((F.col("user_id") * 200 + F.col("event_id") % 37).alias("job_id")))


@query
def archive_sources(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    path = F.concat(F.when(key % 5 == 0, "run/.correction_cache/").when(key % 5 == 1, "run/debug/").otherwise("run/"), key.cast("string"), F.when(key % 7 == 0, ".zip").otherwise(".png"))
    return ingest.archive_members(table(spark, d, "orders").select("o_orderkey", path.alias("path")), archive="run/14.zip")


@query
def export_totals(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    state = F.when(key % 5 == 0, "reused").when(key % 5 == 1, "skipped").otherwise("converted")
    return export.totals(table(spark, d, "orders").select(state.alias("state"), F.floor("o_totalprice").cast("long").alias("bytes")))


@query
def export_whole(spark: SparkSession, d: str) -> DataFrame:
    """Is the export of all parts current, whose files are all there but one in a hundred thousand?"""
    key = F.col("p_partkey")
    names = table(spark, d, "part").select(key.cast("string").alias("name"), F.when(key % 100_000 == 99_999, "convert").otherwise("reused").alias("state"), key.alias("target_modified"), (key + key % 2).alias("zip_modified"))
    return export.export_current(names, names.select("name"))


@query
def limited_archive(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.concat(key.cast("string"), F.when(key % 4 == 0, ".png").when(key % 4 == 1, ".JPG").otherwise(".jpg"))
    return export.within_limit(table(spark, d, "orders").select(name.alias("name"), F.floor(F.col("o_totalprice") / 8).cast("long").alias("bytes")))


@query
def downloads(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return export.downloads(table(spark, d, "customer").select(
        key.alias("run"), F.when(key % 3 != 0, key).alias("full"), F.when(key % 5 != 0, key % 4).alias("report"), (key % 7).alias("processed"), (key % 2).alias("transparent"),
        F.when(key % 11 != 0, key % 6 == 0).alias("compressed"), (key % 13 % 3).alias("debug"),
    ))


@query
def alpha_measures(spark: SparkSession, d: str) -> DataFrame:
    """Measures of pictures before and after small parts and lonely pixels are cleaned away."""
    x = mask_measures(bridges.pictures(spark, d))
    return x.select("image_id", F.array_join(F.col("cleaned").cast("array<string>"), ",").alias("cleaned"), *(F.round(c, 9).alias(c) for c in ("removed_foreground", "removed_supported", "interior_holes", "foreground", "solid", "soft")), "lost_parts", "missing_parts", "parts")


@query
def turned_rasters(spark: SparkSession, d: str) -> DataFrame:
    x = bridges.pictures(spark, d).withColumn("rotation", F.element_at(F.array(*map(F.lit, ("original", "cw90", "ccw90", "rot180"))), (F.col("image_id") % 4 + 1).cast("int")))
    side = F.floor(F.sqrt(F.size("alpha"))).cast("int")
    return x.select("image_id", F.array_join(labels.turned(F.col("alpha"), side, F.col("rotation")).cast("array<string>"), ",").alias("pixels"))


@query
def on_white(spark: SparkSession, d: str) -> DataFrame:
    return bridges.pictures(spark, d).select("image_id", F.array_join(labels.blended(F.col("colour"), F.col("alpha")).cast("array<string>"), ",").alias("pixels"))


@query
def upload_names(spark: SparkSession, d: str) -> DataFrame:
    """Where uploaded files go: by their base names, the next free one if it is taken, and what is in an archive to a folder of its own."""
    x = bridges.saved(spark, d).withColumn("name", labels.base_name(F.concat(F.lit("C:\\up/"), "name")))
    out = naming.free_files(x, ["destination"], "name", "item")
    return out.select("item", "final", "renamed", F.when(labels.suffix(F.col("final")) == "zip", labels.safe_stem(F.col("final"))).alias("unpacked_to"))


@query
def debug_crops(spark: SparkSession, d: str) -> DataFrame:
    """Files of an item's first two crops."""
    first = geometry.crop_priority(bridges.crops(spark, d)).filter("place <= 2")
    return first.select("item_id", "pos", labels.numbered(F.concat(F.col("item_id").cast("string"), F.lit("_tag_crop")), F.col("place")).alias("file"))
