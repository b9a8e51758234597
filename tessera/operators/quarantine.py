"""Work on rows that may fail: a value or an error for each, errors as rows of the report, and what the report notes of the others."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType

from ..schemas import CACHE_FAILED, CACHE_READY, CACHE_REVIEW, DUPLICATE_TAG, ERROR, OK

# fixed values: what the report notes
FAILED = "This photo could not be processed. Please check it manually. "
UNCLEAR = "Tag number is unclear. Please review this photo."
DUPLICATE = " Duplicate tag saved safely with suffix."
WAITS = " Background removal needs review."
PREPARED = {
    CACHE_READY: " Full-quality background output is prepared for fast correction.",
    CACHE_REVIEW: " The background candidate also needs visual review after tag correction.",
    CACHE_FAILED: " Background preparation will retry after tag correction.",
}
KEPT = ("original_filename", "item_id", "status", "notes")


def guarded(rows: DataFrame, work: Callable[..., Any], columns: list[str], returns: DataType | str, into: str = "outcome") -> DataFrame:
    """Adds a struct (value, error): what work gives for a row's columns, or the text of its exception. One row's failure leaves all others, and the task, alone.

    A failure that the file's name explains should name it. Work gets nulls as None; a column `into` is replaced.
    """
    kind = DataType.fromDDL(returns) if isinstance(returns, str) else returns

    @F.udf(StructType().add("value", kind).add("error", StringType()), useArrow=True)
    def run(*values):
        try:
            return work(*values), None
        except Exception as e:
            return None, str(e) or type(e).__name__

    return rows.withColumn(into, run(*columns))


def split(rows: DataFrame, outcome: str = "outcome") -> tuple[DataFrame, DataFrame]:
    """(good rows with their `value`, bad rows with their `error`) of guarded rows that were written down; both keep the other columns."""
    bad = F.col(outcome)["error"].isNotNull()
    return rows.filter(~bad).withColumn("value", F.col(outcome)["value"]).drop(outcome), rows.filter(bad).withColumn("error", F.col(outcome)["error"]).drop(outcome)


def notes(status: str = "status", folder: str = "output_folder", said: str = "notes", prepared: str = "correction_cache_status") -> Column:
    """What a result without an error notes: what reading said, then what became of the photo. Nulls count as ''."""
    text = F.coalesce(F.col(said), F.lit(""))
    saved = F.col(status).isin(OK, DUPLICATE_TAG)
    waits = F.coalesce(F.col(folder) == "background_review", F.lit(False))
    extra = F.coalesce(*(F.when(F.col(prepared) == k, t) for k, t in PREPARED.items()), F.lit(""))
    unclear = F.concat(F.when(text == "", UNCLEAR).otherwise(text), extra)
    return F.when(waits, F.concat(text, F.lit(WAITS))).when(saved, F.concat(text, F.when(F.col(status) == DUPLICATE_TAG, DUPLICATE).otherwise(""))).otherwise(unclear)


def results(rows: DataFrame, error: str = "error") -> DataFrame:
    """The report's rows: one with an error has status ERROR, a note that gives it, and nothing else but its name and id; the others get their notes.

    Columns stay (but `error`), one row for each; rows need status, notes, output_folder and correction_cache_status.
    """
    bad, text = F.col(error).isNotNull(), notes()
    told = rows.withColumn("notes", F.when(bad, F.concat(F.lit(FAILED), F.col(error))).otherwise(text)).withColumn("status", F.when(bad, ERROR).otherwise(F.col("status")))
    empty = {c: F.when(~bad, F.col(c)) for c in rows.columns if c not in (*KEPT, error)}
    return told.withColumns(empty).drop(error)
