"""Actions on files: whole or not at all, whatever happens in between."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import review
from tessera.sinks import moves
from tessera.sinks.moves import FileActions

ACTION = "action string, step int, kind string, source string, target string"


def files(root):
    return {str(p.relative_to(root)): p.read_text() for p in sorted(root.rglob("*")) if p.is_file()}


def fill(root, **contents):
    for name, text in contents.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def plan(spark, root, rows):
    at = lambda p: p and str(root / p)
    return spark.createDataFrame([(a, n, k, at(s), at(t)) for a, n, k, s, t in rows], ACTION)


ROWS = [
    ("a", 1, "move", "in/a", "out/a"),
    ("b", 1, "copy", "in/b", "out/b"), ("b", 2, "copy?", "in/none", "out/none"), ("b", 3, "copy", "in/b2", "out/b2"), ("b", 4, "delete", "in/b", None), ("b", 5, "delete", "in/b2", None),
    ("c", 1, "copy", "in/c", "out/c"), ("c", 2, "move", "in/c2", "out/c2"), ("c", 3, "copy", "in/gone", "out/gone"), ("c", 4, "delete", "in/c", None),
    ("d", 1, "move", "in/d", "out/there"),
]
BEFORE = {"in__a": "A", "in__b": "B", "in__b2": "B2", "in__c": "C", "in__c2": "C2", "in__d": "D", "out__there": "T"}
AFTER = {"out/a": "A", "out/b": "B", "out/b2": "B2", "in/c": "C", "in/c2": "C2", "in/d": "D", "out/there": "T"}


def test_actions_are_done_whole_or_taken_back(spark, tmp_path):
    root, log = tmp_path / "root", FileActions(spark, str(tmp_path / "log"))
    fill(root, **BEFORE)
    for _ in range(2):  # the second time nothing is left to do
        got = {r.action: (r.outcome, r.error.split(":")[0]) for r in log.apply(plan(spark, root, ROWS), "one").collect()}
        assert got == {"a": ("done", ""), "b": ("done", ""), "c": ("taken back", "FileNotFoundError"), "d": ("taken back", "FileExistsError")}
        assert files(root) == AFTER
    assert log.recover() == [] and log.apply(plan(spark, root, []), "none").count() == 0


@pytest.mark.parametrize("steps", range(9))
def test_a_run_that_was_killed_is_finished(spark, tmp_path, steps):
    """The log is written, some steps were done, no outcome is known; then recovery."""
    root, log = tmp_path / "root", FileActions(spark, str(tmp_path / "log"))
    fill(root, **BEFORE)
    rows = plan(spark, root, ROWS)
    rows.write.parquet(str(tmp_path / "log" / "one" / "planned"))
    for r in [r for r in rows.orderBy("action", "step").collect() if r.action in "abc"][:steps]:
        if r.source != str(root / "in/gone"):
            moves._step(r.kind, r.source, r.target)
    assert log.recover() == ["one"] and log.recover() == []
    assert files(root) == AFTER


def test_what_was_not_planned_to_the_end_touches_nothing(spark, tmp_path):
    root, log = tmp_path / "root", FileActions(spark, str(tmp_path / "log"))
    fill(root, **BEFORE)
    plan(spark, root, ROWS).write.parquet(str(tmp_path / "log" / "one" / "planned"))
    os.unlink(tmp_path / "log" / "one" / "planned" / "_SUCCESS")
    assert log.recover() == [] and "in/a" in files(root)


def test_corrections_of_files(spark, tmp_path):
    root = tmp_path / "out"
    fill(root, review_required__r1="1", review_required__r2="2", review_required__r3="3", review_required__r4="4", correction_cache__w2="w", correction_cache__t2="t", correction_cache__w3="v", correction_cache__t4="u", processed_images__123456="")
    os.rename(root / "processed_images/123456", root / "processed_images/123456.png")
    rows = [
        (1, "1", "r1", "none", "", "", ""), (2, "2", "r2", "white_and_transparent", "READY", "w2", "t2"), (3, "3", "r3", "white_only", "REVIEW_REQUIRED", "w3", "lost"),
        (4, "4", "r4", "transparent_only", "READY", "", "t4"), (5, "5", "r5", "none", "", "", ""),
    ]
    df = spark.createDataFrame(rows, "item int, item_id string, final_filename string, background_mode string, correction_cache_status string, correction_cache_white_filename string, correction_cache_transparent_filename string")
    df = df.withColumns({"tag": F.lit("123456"), "matches": F.lit(1), "original_filename": F.lit("p.jpg"), "has_file": F.lit(True), "rerun_ok": F.lit(None).cast("boolean"), "taken": F.lit(1), "status": F.lit("REVIEW_REQUIRED"), "output_folder": F.lit("review_required"), "confidence_score": F.lit("0.1")})
    taken = spark.createDataFrame([("processed_images", "123456.png")], "folder string, name string")
    actions = review.correction_actions(review.correct(df), taken)
    actions = actions.withColumns({c: F.concat(F.lit(f"{root}/"), c) for c in ("source", "target")})
    got = {r.action: r.outcome for r in FileActions(spark, str(tmp_path / "log")).apply(actions, "corrections").collect()}
    assert got == {"1": "done", "2": "done", "3": "done", "4": "done", "5": "taken back"}  # r5 isn't there
    assert files(root) == {
        "processed_images/123456.png": "", "processed_images/123456_2.png": "1", "processed_images/123456_3.png": "w", "transparent_images/123456_3.png": "t", "transparent_images/123456.png": "u",
        "background_review/BG_REVIEW_r3.png": "3", "background_review/BG_REVIEW_r3_candidate_white.png": "v",
    }
