"""From many noisy readings of an item to one decision that says how far it can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import readings as r
from ..schemas import OCR_FAILED, OK, REVIEW_REQUIRED, TAG_NOT_FOUND

# fixed values: margins and scores of the decision
STRONG_CONFIDENCE = 0.60
BONUS_PER_SOURCE, MOST_BONUS = 0.025, 0.08
REVERSE_MARGIN, RIVAL_MARGIN = 0.08, 0.10
CORROBORATED_SCORE, SINGLE_SCORE = 0.72, 0.88
SURE_READING = 0.94


def candidates(readings: DataFrame) -> DataFrame:
    """One row per standalone number in a reading: item_id, pos, match_no, value, score, ... (first number: match_no 0)."""
    box = r.prominence(F.col("bbox"))
    found = readings.select("item_id", "pos", "confidence", "source_rotation", "source_crop", box.alias("prominence"), F.posexplode(r.standalone_numbers(F.col("text"))).alias("match_no", "value"))
    score = F.col("confidence") * r.CONFIDENCE_SHARE + F.col("prominence") * r.PROMINENCE_SHARE + F.lit(r.LENGTH_BONUS)
    return found.withColumn("score", score + r.source_adjustment(F.col("source_crop"), F.col("source_rotation")))


def _source() -> Column:
    return F.struct(r.canonical_crop(F.col("source_crop")).alias("crop"), F.col("source_rotation").alias("rotation"))


def measures() -> dict[str, Column]:
    """What the readings of one value add up to: the best one (of equal scores the one seen first), and which (strong) sources agree."""
    return {
        "best": F.max(F.struct("score", (-F.col("pos")).alias("p"), (-F.col("match_no")).alias("m"), "confidence", "source_rotation", "source_crop")),
        "first_seen": F.min(F.struct("pos", "match_no")),
        "sources": F.collect_set(_source()),
        "strong_sources": F.collect_set(F.when(F.col("confidence") >= STRONG_CONFIDENCE, _source())),
    }


def _with_bonus(of=F.col) -> Column:
    bonus = F.least(F.greatest(F.lit(0), F.size(of("strong_sources")) - 1) * BONUS_PER_SOURCE, F.lit(MOST_BONUS))
    return F.least(of("best")["score"] + bonus, F.lit(1.0))


def consensus(found: DataFrame) -> DataFrame:
    """One row per item and value: best reading, number of (strong) sources, score with the bonus for agreement.

    Partial aggregates come before the shuffle, so an item with very many readings is no burden to one task. Of equal
    scores the reading seen first is the best.
    """
    out = found.groupBy("item_id", "value").agg(*(c.alias(n) for n, c in measures().items()))
    return out.select(
        "item_id", "value", _with_bonus().alias("score"), F.size("sources").alias("source_count"), F.size("strong_sources").alias("strong_source_count"), "first_seen",
        F.col("best.confidence").alias("best_confidence"), F.col("best.source_rotation").alias("best_rotation"), F.col("best.source_crop").alias("best_crop"),
    )


def entry(of=F.col) -> Column:
    """A value of an item; entries sort from the best to the least. `of` finds a measure by its name, as a column or in a struct."""
    best = of("best")
    return F.struct(
        (-_with_bonus(of)).alias("order"), of("first_seen").alias("first_seen"), of("value").alias("value"), _with_bonus(of).alias("score"), F.size(of("sources")).alias("source_count"),
        F.size(of("strong_sources")).alias("strong"), best["confidence"].alias("best_confidence"), best["source_rotation"].alias("best_rotation"), best["source_crop"].alias("best_crop"),
    )


def numbers_of() -> Column:
    """The standalone numbers of a reading with their scores: array of (match_no, value, score)."""
    score = F.col("confidence") * r.CONFIDENCE_SHARE + r.prominence(F.col("bbox")) * r.PROMINENCE_SHARE + F.lit(r.LENGTH_BONUS) + r.source_adjustment(F.col("source_crop"), F.col("source_rotation"))
    found = F.transform(r.standalone_numbers(F.col("text")), lambda v, i: F.struct(i.alias("match_no"), v.alias("value"), score.alias("score")))
    return F.coalesce(found, F.array().cast("array<struct<match_no: int, value: string, score: double>>"))


def with_numbers(readings: DataFrame) -> DataFrame:
    """Each reading once as it is (value null) and once for each standalone number in it, with the number's score."""
    none = F.struct(F.lit(None).cast("int").alias("match_no"), F.lit(None).cast("string").alias("value"))
    found = F.transform(r.standalone_numbers(F.col("text")), lambda v, i: F.struct(i.alias("match_no"), v.alias("value")))
    x = readings.withColumn("prominence", r.prominence(F.col("bbox"))).withColumn("n", F.explode(F.concat(F.array(none), F.coalesce(found, F.array().cast("array<struct<match_no: int, value: string>>")))))
    score = F.col("confidence") * r.CONFIDENCE_SHARE + F.col("prominence") * r.PROMINENCE_SHARE + F.lit(r.LENGTH_BONUS) + r.source_adjustment(F.col("source_crop"), F.col("source_rotation"))
    return x.select("*", "n.match_no", "n.value").withColumn("score", F.when(F.col("value").isNotNull(), score)).drop("n", "bbox")


def text_of() -> Column:
    return F.when(F.col("value").isNull() & (F.trim("text") != ""), F.struct("pos", "text"))


def joined(texts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(texts), lambda x: x["text"]), " | ")


def gathered(readings: DataFrame) -> DataFrame:
    """One row per item: raw_text, and values, what its readings of each value add up to.

    The readings of a value are summed before they are moved; then an item's values, which are few, come together with its texts.
    """
    by_value = with_numbers(readings).groupBy("item_id", "value").agg(*(c.alias(n) for n, c in measures().items()), F.collect_list(text_of()).alias("texts"))
    return by_value.groupBy("item_id").agg(F.collect_list(F.when(F.col("value").isNotNull(), entry())).alias("values"), joined(F.flatten(F.collect_list("texts"))).alias("raw_text"))


def ranked(values: DataFrame, most: int | None = None) -> DataFrame:
    """Adds place: 1 for the item's best value; of equal scores the value seen first. Only the first `most` places, if given."""
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "first_seen")
    out = values.withColumn("place", F.row_number().over(w))
    return out.filter(F.col("place") <= most) if most else out


def opposite(best_value: Column, best_crop: Column, best_rotation: Column, value: Column, crop: Column, rotation: Column) -> Column:
    """Whether a value may be the best one read from the other side."""
    pair = F.array_sort(F.array(best_rotation, rotation))
    turned = (best_crop == crop) & ((pair == F.array(F.lit("ccw90"), F.lit("cw90"))) | (pair == F.array(F.lit("original"), F.lit("rot180"))))
    back = F.reverse(best_value)
    return (value != best_value) & (turned | (value == back) | (value == r.swapped_six_nine(back)))


def reverse_matches(values: DataFrame, best: DataFrame) -> DataFrame:
    """Per item the strongest value that may be its best value read upside down: item_id, reverse_value, reverse_score."""
    b = best.select("item_id", *(F.col(c).alias(f"b_{c}") for c in ("value", "best_crop", "best_rotation")))
    met = values.join(b, "item_id").filter(opposite(F.col("b_value"), F.col("b_best_crop"), F.col("b_best_rotation"), F.col("value"), F.col("best_crop"), F.col("best_rotation")))
    strongest = F.max_by(F.col("value"), F.struct("score", (-F.col("first_seen.pos")).alias("p"), (-F.col("first_seen.match_no")).alias("m")))
    return met.groupBy("item_id").agg(strongest.alias("reverse_value"), F.max("score").alias("reverse_score"))


def raw_texts(readings: DataFrame) -> DataFrame:
    """Per item its non-blank texts as they are, in order, joined by ' | '; '' if there are none."""
    rows = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("pos", "text"))))
    return readings.groupBy("item_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), " | ").alias("raw_text"))


def decide(readings: DataFrame, threshold: float = 0.45) -> DataFrame:
    """One row per item: tag_number, confidence, raw_text, status, branch, notes and what speaks for the decision.

    A single reading is never accepted, however sure, unless it is the far stronger side of a tag read from both ends.
    Items without a text fail, items without a number have no tag; their other columns are null or 0.
    """
    return settle(gathered(readings), threshold)


def settle(items: DataFrame, threshold: float = 0.45) -> DataFrame:
    """The decision about each item (item_id, raw_text, values) as decide() gives it; further columns stay in front."""
    x = items.withColumn("sorted", F.array_sort("values"))
    x = x.withColumn("a", F.try_element_at("sorted", F.lit(1))).withColumn("b", F.try_element_at("sorted", F.lit(2)))
    met = F.filter("values", lambda v: opposite(F.col("a.value"), F.col("a.best_crop"), F.col("a.best_rotation"), v["value"], v["best_crop"], v["best_rotation"]))
    strongest = F.transform(met, lambda v: F.struct(v["score"].alias("score"), (-v["first_seen"]["pos"]).alias("p"), (-v["first_seen"]["match_no"]).alias("m"), v["value"].alias("value")))
    x = x.withColumn("back", F.array_max(strongest)).select(
        *(c for c in items.columns if c not in ("values", "raw_text")), "raw_text", *(f"a.{c}" for c in ("value", "score", "source_count", "strong", "best_confidence", "best_rotation", "best_crop")),
        F.col("b.value").alias("r_value"), F.col("b.score").alias("r_score"), F.col("b.source_count").alias("r_sources"), F.col("b.best_crop").alias("r_crop"),
        F.col("b.best_rotation").alias("r_rotation"), F.col("back.value").alias("reverse_value"), F.col("back.score").alias("reverse_score"),
    )

    confidence = F.round(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)), 4)
    margin = F.when(F.col("r_score").isNull(), 1.0).otherwise(F.col("score") - F.col("r_score"))
    gap = F.col("score") - F.col("reverse_score")
    exempt = (F.col("strong") >= 2) & (F.col("r_sources") == 1) & (F.col("r_crop") == "fallback_full") & (F.col("r_rotation") == "auto_best") & (F.col("score") > F.col("r_score"))
    rival = (
        F.col("r_value").isNotNull() & ~F.col("r_value").eqNullSafe(F.col("reverse_value"))
        & (margin < RIVAL_MARGIN) & (F.col("r_score") >= CORROBORATED_SCORE) & ~exempt
    )
    resolved = F.coalesce((gap >= REVERSE_MARGIN) & (F.col("best_confidence") >= SURE_READING), F.lit(False))
    required = F.greatest(F.lit(threshold), F.when(F.col("strong") < 2, SINGLE_SCORE).otherwise(CORROBORATED_SCORE))
    branch = (
        F.when(F.col("raw_text") == "", "no_text")
        .when(F.col("value").isNull(), "no_number")
        .when(gap < REVERSE_MARGIN, "reverse_conflict")
        .when(rival, "competing")
        .when((F.col("strong") < 2) & ((confidence < required) | ~resolved), "single_source")
        .when(confidence < required, "low_score")
        .when(F.col("reverse_value").isNotNull(), "accepted_after_reverse")
        .otherwise("accepted")
    )
    x = x.withColumn("branch", branch)
    status = (
        F.when(F.col("branch") == "no_text", OCR_FAILED)
        .when(F.col("branch") == "no_number", TAG_NOT_FOUND)
        .when(F.col("branch").startswith("accepted"), OK)
        .otherwise(REVIEW_REQUIRED)
    )
    notes = (
        F.when(F.col("branch") == "no_text", "No readable text was found.")
        .when(F.col("branch") == "no_number", "No number of 5 to 8 digits was found.")
        .when(F.col("branch") == "reverse_conflict", F.format_string("Read from opposite sides as %s and as %s; please confirm.", "value", "reverse_value"))
        .when(F.col("branch") == "competing", F.format_string("%s and %s have nearly equal evidence; please confirm.", "value", "r_value"))
        .when(F.col("branch") == "single_source", F.format_string("Perhaps %s, but only one independent reading supports it; please confirm.", "value"))
        .when(F.col("branch") == "low_score", F.format_string("Perhaps %s, but the readings together are not sure enough; please confirm.", "value"))
        .otherwise(F.concat(F.format_string("%s is supported by %d independent sources.", "value", "strong"), F.coalesce(F.format_string(" Stronger than %s, its reading from the other side.", "reverse_value"), F.lit(""))))
    )
    return x.select(
        *(c for c in items.columns if c not in ("values", "raw_text")), F.coalesce("value", F.lit("")).alias("tag_number"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"), "raw_text",
        status.alias("status"), "branch", notes.alias("notes"),
        F.coalesce("source_count", F.lit(0)).alias("evidence_count"), F.coalesce("strong", F.lit(0)).alias("strong_evidence_count"),
        F.coalesce(F.round("best_confidence", 4), F.lit(0.0)).alias("best_ocr_confidence"),
        F.when(F.col("value").isNull(), 0.0).otherwise(F.round(F.greatest(margin, F.lit(0.0)), 4)).alias("score_margin"),
        F.coalesce("best_rotation", F.lit("")).alias("best_source_rotation"), F.coalesce("best_crop", F.lit("")).alias("best_source_crop"),
    )


def safe_consensus(decisions: DataFrame, threshold: float = 0.45) -> Column:
    """Whether a decision is sure enough to stop reading."""
    return (F.col("status") == OK) & (F.col("strong_evidence_count") >= 2) & (F.col("confidence") >= max(threshold, 0.78))
