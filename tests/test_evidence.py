"""Decisions on small, hand-made sets of readings."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.evidence import candidates, decide
from tessera.operators.planner import replay
from tessera.schemas import READINGS


def box(w, h):
    return [[0.0, 0.0], [float(w), 0.0], [float(w), float(h)], [0.0, float(h)]]


def rows(*items):
    return [(1, i, t, c, box(*wh) if wh else None, rot, crop) for i, (t, c, wh, rot, crop) in enumerate(items)]


TAG = (250, 70)
CASES = [
    ("code beside a tag", [("221235FLDE1ICSB000", 0.98, (80, 20), "original", "tag_crop"), ("121134", 0.88, TAG, "original", "tag_crop"), ("121134", 0.87, TAG, "rot180", "tag_crop")], 0.45, "OK", "121134", 0.9434),
    ("weak", [("121134", 0.15, (60, 15), "original", "tag_crop")], 0.7, "REVIEW_REQUIRED", "121134", 0.2555),
    ("no number", [("SUN AAR FLDE", 0.9, None, "original", "tag_crop")], 0.45, "TAG_NOT_FOUND", "", 0.0),
    ("stronger side wins", [("690221", 0.8326, (190, 55), "cw90", "fallback_full"), ("122069", 0.9804, (190, 55), "ccw90", "fallback_full")], 0.45, "OK", "122069", 0.9540),
    ("sides disagree", [("690221", 0.90, (190, 55), "cw90", "fallback_full"), ("122069", 0.86, (190, 55), "ccw90", "fallback_full")], 0.45, "REVIEW_REQUIRED", "690221", 0.8994),
    ("one reading", [("121995", 0.85, TAG, "cw90", "tag_crop_1")], 0.45, "REVIEW_REQUIRED", "121995", 0.8980),
    ("one sure reading", [("122350", 0.99, TAG, "auto_best", "fallback_full")], 0.45, "REVIEW_REQUIRED", "122350", 0.9332),
    ("two sources", [("121995", 0.65, TAG, "original", "tag_crop_1"), ("121995", 0.65, TAG, "rot180", "tag_crop_1")], 0.45, "OK", "121995", 0.7870),
    ("enhanced is no source of its own", [("121995", 0.80, TAG, "cw90", "tag_crop_1"), ("121995", 0.82, TAG, "cw90", "tag_crop_1_enhanced")], 0.45, "REVIEW_REQUIRED", "121995", 0.8776),
    ("rivals", [("121995", 0.91, TAG, "original", "tag_crop_1"), ("121985", 0.89, TAG, "cw90", "tag_crop_1")], 0.45, "REVIEW_REQUIRED", "121995", 0.9388),
    ("blank", [("  ", 0.9, TAG, "original", "tag_crop")], 0.45, "OCR_FAILED", "", 0.0),
]


@pytest.mark.parametrize("name,readings,threshold,status,tag,confidence", CASES, ids=[c[0] for c in CASES])
def test_decision(spark, name, readings, threshold, status, tag, confidence):
    got = decide(spark.createDataFrame(rows(*readings), READINGS), threshold).collect()
    assert [(r.status, r.tag_number) for r in got] == [(status, tag)]
    assert got[0].confidence == pytest.approx(confidence, abs=1e-4)


def test_numbers_in_texts(spark):
    texts = ["BOSSIS", "123456789", "x12345", "12345-1234567", "1O1l34"]
    df = spark.createDataFrame([(i, 0, t, 0.5, None, "original", "c") for i, t in enumerate(texts)], READINGS)
    got = {}
    for r in candidates(df).orderBy("item_id", "match_no").collect():
        got.setdefault(texts[r.item_id], []).append(r.value)
    assert got == {"BOSSIS": ["805515"], "12345-1234567": ["12345", "1234567"], "1O1l34": ["101134"]}


def test_equal_scores_take_the_first_seen(spark):
    got = decide(spark.createDataFrame(rows(("22222 11111", 0.9, TAG, "original", "a")), READINGS)).first()
    assert got.tag_number == "22222"


def test_replay_stops_at_the_first_safe_checkpoint(spark):
    df = spark.createDataFrame(rows(*[("121134", 0.9, TAG, r, "tag_crop_1") for r in ("original", "rot180", "cw90", "ccw90")]), READINGS)
    got = replay(df.withColumn("checkpoint", F.col("pos"))).first()
    assert (got.checkpoint, got.safe, got.tag_number) == (1, True, "121134")
