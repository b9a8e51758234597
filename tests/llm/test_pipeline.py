"""The pipeline end to end on the smallest tables, and the SQL of those operators that have one."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import corpus_pipeline  # noqa: E402
from tessera.llm import registry  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def test_every_stage_keeps_the_columns_and_no_new_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(DATA)).cache()
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and left <= ids and left, name
        ids = left
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA))
    assert {r.doc_id for r in out.collect()} == ids
    assert corpus_pipeline.run(spark, str(DATA)).count() == len(ids)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    want = con.execute(registry.ORACLE_SQL[name])
    order = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in order]
    got = registry.QUERIES[name](spark, str(DATA)).collect()
    assert sorted(str([r[c] for c in order]) for r in got) == sorted(str([r[i] for i in at]) for r in want.fetchall())
