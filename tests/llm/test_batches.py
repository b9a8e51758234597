"""The stages of the pipeline hold few long rows at a time, and what they return doesn't depend on it."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, mixing

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture
def batches(spark):
    """The session with Spark's own batches, and afterwards as it was."""
    before = {name: spark.conf.get(name, None) for name in common.BATCHES}
    for name in common.BATCHES:
        spark.conf.unset(name)
    yield spark
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "longest": [max(len(t.as_py()) for t in b.column(0))], "bytes": [b.nbytes]})


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_a_stage_bounds_its_batches_by_bytes(batches, name, stage):
    docs = batches.read.parquet(f"{DATA}/documents.parquet")
    stage(batches, docs.limit(20), str(DATA))
    long = batches.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), F.when(F.col("id") == 1500, 1_000_000).otherwise(1000)).alias("text"))
    got = long.mapInArrow(sizes, "rows long, longest long, bytes long").collect()
    assert sum(r.rows for r in got) == 3000 and max(r.longest for r in got) == 5_000_000
    assert all(r.bytes - r.longest < (2 << 20) + 100_000 for r in got)  # a batch ends with the row that fills it
    assert batches.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "512"


def test_smaller_batches_of_the_user_stay(batches):
    batches.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    batches.conf.set("spark.sql.parquet.columnarReaderBatchSize", "100")
    common.small_batches(batches)
    assert [batches.conf.get(name) for name in common.BATCHES] == ["1m", "100"]


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_the_pipeline_returns_the_same_whatever_the_batches(batches, monkeypatch):
    def run():
        return sorted(map(str, corpus_pipeline.run(batches, str(DATA)).collect()))

    with monkeypatch.context() as m:
        m.setattr(common, "BATCHES", {})
        whole = run()
    batches.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2k")
    batches.conf.set("spark.sql.parquet.columnarReaderBatchSize", "3")
    assert run() == whole and whole


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_op7_mixing_bounds_its_batches(batches):
    mixing.op7_mixing(batches, str(DATA))
    rows = batches.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    got = rows.mapInArrow(sizes, "rows long, longest long, bytes long").collect()
    assert sum(r.rows for r in got) == 3000 and all(r.bytes < (2 << 20) + 100_000 for r in got)
