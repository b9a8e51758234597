"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import encode_documents
from tessera.llm.common import discard, shared_folder
from tessera.llm.language import keep_known_languages
from tessera.llm.minhash import keep_one_of_each
from tessera.llm.mixing import keep_mixture
from tessera.llm.quality import keep_good

STAGES = [
    ("quality", keep_good),
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each),
    ("mixing", keep_mixture),
    ("bpe", encode_documents),
]

#: SQL can express none of the stages; tests/llm compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What lies between them is kept in the folder that the executors share, until the next stage has read it."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        if last is not None:
            discard(last)
        docs = last = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
