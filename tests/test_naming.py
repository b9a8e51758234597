"""Free names against giving them one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import naming


def one_by_one(rows, used=()):
    """(place, order, stem[, ending]) in order of their turns -> number of each."""
    used, out = set(used), {}
    for place, order, stem, *ending in sorted(rows, key=lambda r: r[1]):
        end, n = ending[0] if ending else "", 1
        while (place, (stem if n == 1 else f"{stem}_{n}") + end) in used:
            n += 1
        used.add((place, (stem if n == 1 else f"{stem}_{n}") + end))
        out[place, order] = n
    return out


@pytest.mark.parametrize("seed", range(2))
def test_numbers_are_those_that_are_free(spark, seed):
    rng = random.Random(seed)
    ends = ["", "", "", "_2", "_3", "_2_2", "_2_3", "_7", "_40", "_02", "_1", "_2_2_2", "_3_2"]
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(["x", "x", "y", "x_y"]) + rng.choice(ends)) for i in range(600)]
    df = spark.createDataFrame(rows, "place string, at long, stem string")
    got = {(r.place, r.at): r.number for r in naming.free_numbers(df, ["place"], "stem", "at").collect()}
    assert got == one_by_one(rows)


@pytest.mark.parametrize("seed", range(2))
def test_names_that_are_taken_already(spark, seed):
    rng = random.Random(seed)
    ends = ["", "", "", "_2", "_3", "_4", "_2_2", "_5", "_6", "_7", "_3_2"]
    make = lambda: rng.choice(["x", "x", "y"]) + rng.choice(ends)
    rows, taken = [(rng.choice(["a", "b", None]), i, make()) for i in range(80)], {(rng.choice(["a", "b", None]), make()) for _ in range(25)}
    df, old = spark.createDataFrame(rows, "place string, at long, stem string"), spark.createDataFrame(sorted(taken, key=str), "place string, name string")
    got = {(r.place, r.at): r.number for r in naming.free_numbers(df, ["place"], "stem", "at", old).collect()}
    assert got == one_by_one(rows, taken)


def test_alternating_claims_of_one_family(spark):
    rows = [("p", i, "IMG" if i % 2 == 0 else f"IMG_{i // 2 + 2}") for i in range(400)]
    df = spark.createDataFrame(rows, "place string, at long, stem string")
    got = {(r.place, r.at): r.number for r in naming.free_numbers(df, ["place"], "stem", "at").collect()}
    assert got == one_by_one(rows)


def test_numbered_photos_claim_nothing_from_each_other(spark):
    df = spark.range(20_000).select(F.lit("p").alias("place"), F.col("id").alias("at"), F.when(F.col("id") == 0, "IMG").otherwise(F.concat(F.lit("IMG_"), F.col("id").cast("string"))).alias("stem"))
    got = naming.free_numbers(df, ["place"], "stem", "at")
    assert got.filter("number = 1").count() == got.count() == 20_000
    entities = df.select(F.struct("place").alias("__at"), F.col("stem").alias("__stem"), F.lit("").alias("__ending"), F.col("stem").alias("name"), F.col("at").alias("first"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("base"), F.lit(0).alias("most_base"))
    kids = naming._parents(entities)
    assert kids.count() == 19_998 and naming._reached(kids, entities.withColumn("own", F.col("name")).drop("name", "first")).count() == 0


@pytest.mark.parametrize("seed", range(1))
def test_batches_one_after_the_other_are_named_like_one(spark, seed, tmp_path):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), i, rng.choice(["x", "y.tar"]) + rng.choice(["", "", "_2", "_3", "_2_2"]), rng.choice([".jpg", ".jpg", ""])) for i in range(150)]
    want, got = one_by_one(rows), {}
    df = spark.createDataFrame([(p, i, s + e, e == "") for p, i, s, e in rows], "place string, at long, name string, folder boolean")
    for batch, (low, high) in enumerate([(0, 60), (60, 61), (61, 150)]):
        part = df.filter(F.col("at").between(low, high - 1))
        for again in range(2):  # the second time as after a failure
            done = naming.name_batch(part, ["place"], "name", "at", str(tmp_path / "names"), batch, F.col("folder")).collect()
            assert again == 0 or {(r.place, r.at): r.final for r in done} == {k: v for k, v in got.items() if low <= k[1] < high}
            got |= {(r.place, r.at): r.final for r in done}
    name = lambda s, e, n: s + (f"_{n}" if n > 1 else "") + e
    assert got == {(p, i): name(s, e, want[p, i]) for p, i, s, e in rows}
    assert spark.read.parquet(str(tmp_path / "names")).count() == len(rows) == len({(p, f) for (p, _), f in got.items()})


def test_files_and_folders(spark):
    rows = [(0, "a.jpg", False), (1, "a.jpg", False), (2, "a_2.jpg", False), (3, "a.jpg", True), (4, "a.jpg", True), (5, "d/a.jpg", False), (6, "", False)]
    df = spark.createDataFrame([(1, *r) for r in rows], "place long, at long, name string, folder boolean")
    got = {r.at: (r.final, r.renamed) for r in naming.free_files(df, ["place"], "name", "at", df["folder"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "a.jpg", 1: "a_2.jpg", 2: "a_2_2.jpg", 3: "a.jpg_2", 4: "a.jpg_3", 5: "d/a.jpg", 6: ""}
    assert naming.free_files(df.limit(0), ["place"], "name", "at").count() == 0


def test_item_ids_of_one_large_batch(spark):
    paths = [f"f{i % 7}/{i}.jpg" for i in range(300)] + ["f1/x.jpg"] * 2
    df = spark.createDataFrame([("b", p, i) for i, p in enumerate(paths)] + [(None, "z", 999)], "batch string, path string, n long")
    got = {r.n: r.item_id for r in naming.item_ids(df).collect()}
    want = sorted(range(len(paths)), key=lambda i: (paths[i].split("/"), i))
    assert [got[i] for i in want] == [f"item_{k + 1:06d}" for k in range(len(paths))] and got[999] == "item_000001"


def test_running_sums_move_rows_once(spark):
    rows = [(None if i % 5 == 0 else i % 3, i * 7 % 400, i % 4 - 1, f"r{i}") for i in range(300) if i % 11]
    rows = list({(k, o): (k, o, v, w) for k, o, v, w in rows}.values())
    df = spark.createDataFrame(rows, "k int, o long, v int, w string")
    got = naming.running(df, ["k"], "o", {"s": F.col("v"), "n": F.lit(1)}, block=16)
    assert got.columns == ["k", "o", "v", "w", "s", "n"]
    want = {(k, o, v, w): (sum(r[2] for r in rows if r[0] == k and r[1] <= o), sum(r[0] == k and r[1] <= o for r in rows)) for k, o, v, w in rows}
    assert {tuple(r)[:4]: (r.s, r.n) for r in got.collect()} == want and got.count() == len(rows)
    # what blocks before add up to comes as rows of the same window, not by a join that moves all rows again
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
