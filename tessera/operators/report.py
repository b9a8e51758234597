"""The report table: its schema, single-row updates, queues, search, counters and checks against expected tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import badge_class, friendly_status
from ..schemas import DUPLICATE_TAG, ERROR, OCR_FAILED, OK, REPORT_COLUMNS, REVIEW_REQUIRED, TAG_NOT_FOUND
from .naming import running

#: fixed values: texts that count as missing in a report that is read
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def normalise(report: DataFrame, reading: bool = False) -> DataFrame:
    """The report's columns, in order and as texts: others are dropped, those that lack and nulls are ''.

    `reading`: what the MISSING texts say is '' too, as for a report read from a file.
    """

    def one(name: str) -> Column:
        if name not in report.columns:
            return F.lit("")
        c = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(c.isin(*MISSING), "").otherwise(c) if reading else c

    return report.select(*(one(c).alias(c) for c in REPORT_COLUMNS))


def matches(report: DataFrame, selectors: DataFrame) -> DataFrame:
    """Rows that each selector (column `selector`) means: those of this item_id, or without one those of this filename.

    A blank or null selector means no row. One row per match: selector, item_id, original_filename, by ('item', 'file'). Joins are merge joins: selectors may
    be as many as rows, and those of a small file would be broadcast through the driver by their size on disk.
    """
    wanted = selectors.select("selector").filter(F.trim("selector") != "").distinct()
    rows = report.select(F.col("item_id").cast("string").alias("item_id"), "original_filename")
    by_id = wanted.hint("merge").join(rows, F.col("selector") == F.col("item_id")).withColumn("by", F.lit("item"))
    rest = wanted.hint("merge").join(by_id.select("selector").distinct(), "selector", "left_anti")
    by_file = rest.hint("merge").join(rows, F.col("selector") == F.col("original_filename")).withColumn("by", F.lit("file"))
    return by_id.unionByName(by_file)


def update(report: DataFrame, edits: DataFrame) -> DataFrame:
    """The report after edits (selector, updates map<string,string>), each of which changes the one row that it means.

    An edit that means no row or several changes nothing, nor do columns that the report doesn't have. Of several edits
    of one row the one with the last selector in order counts for a column. item_id is the report's key, and unique.
    """
    met = matches(report, edits)
    lone = met.groupBy("selector").agg(F.count("*").alias("n"), F.min("item_id").alias("item_id")).filter("n = 1").drop("n")
    named = edits.hint("merge").join(lone, "selector").select("item_id", "selector", F.explode("updates").alias("name", "value")).filter(F.col("name").isin(*REPORT_COLUMNS))
    last = named.groupBy("item_id", "name").agg(F.max_by("value", "selector").alias("value"))
    changes = last.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.coalesce("value", F.lit(""))))).alias("__new"))  # at most a row's columns
    key = F.col("item_id").cast("string")
    out = report.withColumn("__key", key).hint("merge").join(changes.withColumnRenamed("item_id", "__id"), F.col("__key") == F.col("__id"), "left")
    return out.select(*(F.coalesce(F.try_element_at("__new", F.lit(c)), F.col(c).cast("string")).alias(c) if c in REPORT_COLUMNS and c != "item_id" else F.col(c) for c in report.columns))


def review_queue(report: DataFrame) -> DataFrame:
    """Rows whose tag a person must read; those that wait for a decision on their background have a queue of their own."""
    return report.filter(F.col("status").isin(REVIEW_REQUIRED, OCR_FAILED, TAG_NOT_FOUND) & (F.coalesce("output_folder", F.lit("")) != "ai_review"))


def background_queue(report: DataFrame) -> DataFrame:
    return report.filter(F.col("output_folder") == "background_review")


def legacy_queue(report: DataFrame) -> DataFrame:
    return report.filter(F.col("output_folder") == "ai_review")


def search(report: DataFrame, text: str = "", status: str | None = None, regex: bool = True) -> DataFrame:
    """Rows of a status whose file name or tag matches a text, without regard to case; a regular expression unless told otherwise."""
    out = report if status is None else report.filter(F.col("status") == status)
    if not text:
        return out

    def found(name: str) -> Column:
        c = F.lower(F.col(name))
        return F.coalesce(c.rlike(text.lower()) if regex else c.contains(text.lower()), F.lit(False))

    return out.filter(found("original_filename") | found("detected_tag_number"))


def display(report: DataFrame) -> DataFrame:
    """The report with a readable status in front and its badge behind."""
    return report.select(friendly_status(F.col("status")).alias("status_label"), *report.columns, badge_class(F.col("status")).alias("badge"))


def summary(report: DataFrame, *by: str) -> DataFrame:
    """Counts of a batch. Items without a readable tag also count as needing review; unknown statuses only in the total."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return report.groupBy(*by).agg(
        F.count("*").alias("total"), F.count("*").alias("processed"), n(OK).alias("ok"), n(REVIEW_REQUIRED, OCR_FAILED, TAG_NOT_FOUND).alias("review_required"),
        n(DUPLICATE_TAG).alias("duplicate_tags"), n(OCR_FAILED).alias("ocr_failed"), n(TAG_NOT_FOUND).alias("tag_not_found"), n(ERROR).alias("errors"),
    )


def live_counters(report: DataFrame, batch: str = "batch", order: str = "item") -> DataFrame:
    """Adds what a progress display has counted after each item: ok, duplicates, errors, review (all else)."""
    s = F.col("status")
    is_ = lambda x: F.coalesce(s == x, F.lit(False))
    sums = {"n_ok": is_(OK), "n_duplicates": is_(DUPLICATE_TAG), "n_errors": is_(ERROR), "n_review": ~(is_(OK) | is_(DUPLICATE_TAG) | is_(ERROR))}
    return running(report, [batch], order, {k: v.cast("int") for k, v in sums.items()})


def qa_compare(cases: DataFrame, report: DataFrame) -> DataFrame:
    """What went wrong in each case (original_filename, expected; '-' for none): its failure, '' if nothing did.

    Of several rows of a filename the last (by item_id) counts; the text 'nan' is a blank tag.
    """
    tag = F.trim(F.coalesce(F.col("detected_tag_number").cast("string"), F.lit("")))
    rows = report.withColumn("detected", F.when(F.lower(tag) == "nan", "").otherwise(tag))
    last = rows.groupBy("original_filename").agg(F.max_by(F.struct("detected", "status"), "item_id").alias("r"))
    met = cases.join(last, "original_filename", "left").select("original_filename", "expected", F.col("r.detected").alias("detected"), F.col("r.status").alias("status"), F.col("r").isNull().alias("none"))
    failure = (
        F.when(F.col("none"), "missing")
        .when((F.col("expected") == "-") & F.col("status").isin(OK, DUPLICATE_TAG), "wrongly accepted")
        .when((F.col("expected") != "-") & ~F.col("detected").eqNullSafe(F.col("expected")), "different tag")
        .otherwise("")
    )
    return met.select("original_filename", "expected", F.coalesce("detected", F.lit("")).alias("detected"), F.coalesce("status", F.lit("")).alias("status"), failure.alias("failure"))
