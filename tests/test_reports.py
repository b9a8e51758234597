"""Reports that many read while a few write, states of jobs, and decisions while readings arrive."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import planner, review, report
from tessera.sinks.versions import Conflict, VersionedReport
from tessera.streaming import live


def rows(spark, ids, status="OK"):
    return spark.createDataFrame([(str(i), f"f{i}.jpg", status) for i in ids], "item_id string, original_filename string, status string")


def edit(spark, *changes):
    return spark.createDataFrame([(s, {k: v}) for s, k, v in changes], "selector string, updates map<string,string>")


def state(report):
    return {r.item_id: (r.original_filename, r.status, r.notes) for r in report.collect()}


def test_batches_and_edits_of_a_report(spark, tmp_path):
    kept = VersionedReport(spark, str(tmp_path / "report"))
    assert kept.current() == 0 and kept.read().count() == 0 and kept.edit(edit(spark, ("1", "notes", "x"))) == 0
    assert kept.add_batch(rows(spark, range(3)), 0) == 1
    old = kept.read()
    assert kept.add_batch(rows(spark, range(3, 5)), 1) == 2
    assert kept.add_batch(rows(spark, range(3, 5)), 1) == 2 and kept.add_batch(rows(spark, range(3)), 0) == 2
    assert kept.add_batch(rows(spark, [9]), 0, "other") == 3
    assert kept.edit(edit(spark, ("4", "notes", "seen"), ("f1.jpg", "status", "ERROR"), ("none", "notes", "x"), ("4", "unknown", "x"))) == 4
    assert kept.edit(edit(spark, ("none", "notes", "x"))) == 4
    want = {str(i): (f"f{i}.jpg", "OK", "") for i in (0, 1, 2, 3, 4, 9)} | {"4": ("f4.jpg", "OK", "seen"), "1": ("f1.jpg", "ERROR", "")}
    assert state(kept.read()) == want
    assert len(state(old)) == 3 and len(state(kept.read(2))) == 5  # older versions stay whole
    assert kept.compact() == 5 and kept.compact() == 5 and state(kept.read()) == want
    assert len(kept.vacuum()) >= 3 and state(kept.read()) == want and kept.versions() == [5]
    assert kept.write(rows(spark, [7])) == 6 and list(state(kept.read())) == ["7"]
    assert kept.add_batch(rows(spark, range(3)), 1) == 6  # the stream's place isn't forgotten


def test_of_two_writers_one_begins_again(spark, tmp_path):
    kept = VersionedReport(spark, str(tmp_path / "report"))
    kept.add_batch(rows(spark, range(4)), 0)
    with pytest.raises(Conflict):
        kept._commit(0, {"parts": [], "batches": {}})
    assert not [n for n in os.listdir(tmp_path / "report" / "versions") if "tmp" in n and not n.endswith(".crc")]
    failed = []

    def work(i):
        try:
            VersionedReport(spark, str(tmp_path / "report")).edit(edit(spark, (str(i), "notes", f"by {i}")))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    writers = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed and kept.current() == 5
    assert {k: v[2] for k, v in state(kept.read()).items()} == {str(i): f"by {i}" for i in range(4)}


def test_a_part_that_no_version_names_is_not_seen(spark, tmp_path):
    kept = VersionedReport(spark, str(tmp_path / "report"))
    kept.add_batch(rows(spark, [1]), 0)
    lost = kept._part(rows(spark, [2]))  # a writer that failed before its version
    assert list(state(kept.read())) == ["1"] and kept.vacuum() == [lost]


def test_a_stream_writes_a_report(spark, tmp_path):
    for k in range(3):
        rows(spark, range(3 * k, 3 * k + 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = VersionedReport(spark, str(tmp_path / "report"))
    photos = spark.readStream.schema("item_id string, original_filename string, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for where in ("progress", "progress", "lost progress"):  # the last begins again from the first batch
        photos.writeStream.foreachBatch(kept.writer()).option("checkpointLocation", str(tmp_path / where)).trigger(availableNow=True).start().awaitTermination()
        assert kept.current() == 3 and sorted(state(kept.read())) == [str(i) for i in range(9)]


# --- jobs

EVENTS = "job_id string, at long, seq long, state string, done long, total long, message string"


def test_states_of_jobs(spark):
    told = [
        ("z", 0, 0, "QUEUED", None, 5, ""), ("z", 1, 1, "RUNNING", 2, 5, ""), ("z", 2, 2, "QUEUED", None, 5, ""), ("z", 3, 3, "RUNNING", 9, 5, ""),
        ("a", 4, 4, "QUEUED", None, 3, ""), ("a", 4, 5, "RUNNING", -4, 3, ""),
        ("c", 0, 6, "QUEUED", None, 7, ""), ("c", 1, 7, "RUNNING", 3, 7, ""), ("c", 2, 8, "COMPLETED", None, 7, ""), ("c", 3, 9, "QUEUED", None, 7, ""), ("c", 4, 9, "RUNNING", 1, 7, ""), ("c", 5, 9, "FAILED", 1, 7, "late"),
        ("f", 0, 6, "QUEUED", None, None, ""), ("f", 1, 7, "RUNNING", 3, None, ""), ("f", 2, 8, "FAILED", None, None, "Processing stopped: x"), ("f", 9, 8, "QUEUED", None, None, ""),
        ("q", 1, 1, "QUEUED", None, 2, ""), (None, 0, 0, "RUNNING", 1, 2, ""),
    ]
    states = review.job_states(spark.createDataFrame(random.Random(1).sample(told, len(told)), EVENTS))
    got = {r.job_id: (r.state, r.done, r.error, r.running) for r in states.collect()}
    assert got == {
        "z": ("RUNNING", 5, "", True), "a": ("RUNNING", 0, "", True), "c": ("COMPLETED", 7, "", False), "f": ("FAILED", 3, "Processing stopped: x", False),
        "q": ("QUEUED", 0, "", True), None: ("RUNNING", 1, "", True),
    }
    assert [r.job_id for r in review.latest_running(states).collect()] == ["a"]  # started last, though z has the greater name
    assert review.latest_running(states.filter("not running")).count() == 0 and review.job_states(spark.createDataFrame([], EVENTS)).count() == 0


# --- live decisions

BOX = [[0.0, 0.0], [200.0, 0.0], [200.0, 60.0], [0.0, 60.0]]
READ = "item_id string, pos long, checkpoint long, expected long, last boolean, at timestamp, text string, confidence double, bbox array<array<double>>, source_rotation string, source_crop string"


def reading(item, pos, checkpoint, expected, last, text, minute=0, confidence=0.97):
    crop = "tag_crop_1" if pos % 2 else "fallback_full"
    return (item, pos, checkpoint, expected, last, minute, text, confidence, BOX, ["original", "cw90", "ccw90"][pos % 3], crop)


def stream(spark, tmp_path, batches):
    """Decisions after each batch of readings, the query being started anew from its checkpoint every time."""
    out = []
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, READ.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds(1_700_000_000 + 60 * F.col("at")))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        out.append(live.settled(live.live_decisions(source), str(tmp_path / "progress"), str(tmp_path / "out")))
        out[-1] = {r.item_id: r for r in out[-1].collect()} if k < len(batches) - 1 else out[-1].collect()
    return out


def test_decisions_come_as_soon_as_they_are_safe(spark, tmp_path):
    one = [reading("a", 1, 1, 2, False, "123456"), reading("b", 1, 1, 1, False, "77777"), reading("c", 3, 2, 1, True, "")]
    two = [reading("a", 2, 1, 2, False, "123456"), reading("b", 2, 2, 1, True, "88888"), reading("a", 1, 1, 2, False, "999999"), reading("d", 1, 1, 2, True, "55555", 9)]
    three = [reading("a", 3, 2, 1, True, "999999"), reading("c", 1, 1, 2, False, "444444"), reading("c", 2, 1, 2, False, "444444"), reading("c", 2, 1, 2, False, "333333")]
    first, second, third, last = stream(spark, tmp_path, [one, two, three, [reading("e", 1, 1, 9, False, "1", 300)]])
    assert not first  # a's checkpoint lacks a reading, c's first one hasn't come
    assert set(second) == {"a", "b"} and (second["a"].tag_number, second["a"].safe, second["a"].checkpoint) == ("123456", True, 1)
    assert not second["b"].safe and second["b"].checkpoint == 2
    assert set(third) == {"a", "b", "c"} and third["a"].tag_number == "123456" and (third["c"].tag_number, third["c"].checkpoint) == ("444444", 1)
    told = {r.item_id: r for r in last}
    assert len(told) == len(last) and set(told) == {"a", "b", "c", "d"}  # d has waited too long, e still waits
    assert not told["d"].safe and told["d"].tag_number == "55555"


def test_live_decisions_are_those_of_the_whole(spark, tmp_path):
    rng, whole = random.Random(4), []
    for i in range(40):
        n = rng.randrange(1, 7)
        for pos in range(1, n + 1):
            whole.append(reading(f"i{i}", pos, (pos + 1) // 2, 2 if pos + pos % 2 <= n else 1, (pos + 1) // 2 == (n + 1) // 2, rng.choice(["123456", "654321", "", "x", f"{10000 + i}", f"{10000 + i}"]), confidence=rng.choice([0.5, 0.8, 0.97])))
    mixed = rng.sample(whole, len(whole))
    *_, got = stream(spark, tmp_path, [mixed[:50], mixed[50:90] + mixed[:20], mixed[90:]])
    want = planner.replay(spark.createDataFrame(whole, READ.replace("at timestamp", "at long"))).collect()
    key = lambda r: (r.item_id, r.checkpoint, r.safe, r.tag_number, r.confidence, r.status)
    assert sorted(map(key, got)) == sorted(map(key, want)) and any(r.safe for r in got) and not all(r.safe for r in got)


def test_edits_are_not_broadcast(spark):
    kept = rows(spark, range(4)).withColumn("detected_tag_number", F.lit(""))
    edits = spark.range(1).selectExpr("cast(id as string) as selector", "map('status', 'OK') as updates")
    plan = report.update(kept, edits)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_replay_brings_readings_together_once(spark):
    whole = spark.createDataFrame([reading("a", 1, 1, 1, True, "123456")], READ.replace("at timestamp", "at long"))
    plan = planner.replay(whole)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Generate" in plan


def test_a_batch_that_is_repeated_gives_the_same(spark, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, READ.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds(1_700_000_000 + 60 * F.col("at")))
    one = df([reading("a", 1, 1, 2, False, "123456"), reading("b", 1, 1, 1, True, "77777")])
    two = df([reading("a", 2, 1, 2, False, "123456"), reading("b", 1, 1, 1, True, "88888")])
    decisions, state, out = live.live_decisions(one), str(tmp_path / "state"), str(tmp_path / "out")
    told = []
    for number, batch in enumerate([one, two]):
        for _ in range(2):
            decisions.step(batch, number, state, out)
            told.append(sorted(map(tuple, spark.read.parquet(out).select("item_id", "checkpoint", "safe", "tag_number").collect())))
    assert told[0] == told[1] == [("b", 1, False, "77777")] and told[2] == told[3] == [("a", 1, True, "123456"), *told[0]]
