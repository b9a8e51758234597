"""Small shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = np.full(256, 32, dtype=np.uint8)
"""Byte table: ASCII letters in lower case, bytes of other alphabets as they are, all else a space."""
for _b in range(128, 256):
    LETTERS[_b] = _b
for _b in range(26):
    LETTERS[65 + _b] = LETTERS[97 + _b] = 97 + _b


#: Settings of a session that bound what a task holds of long rows at a time: bytes of a batch that goes to Python, rows of a batch that Parquet's
#: reader makes. Spark's own, 64 MB and 4 096 rows, make arrays of tens of MB of texts, which a worker keeps and for which the JVM's heap is let grow.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's batches to BATCHES; what is lower already stays. No row is cut: a batch ends with the row that fills it.

    A frame is worked out when its rows are asked for, which is after the operator that made it has returned, so this holds for
    the session from now on.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in BATCHES.items():
        if size(spark.conf.get(name, str(most + 1))) > most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have, beginning with `name`; names that differ in case alone count as equal."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's text modulo n; a null id counts as the text ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def keep_share(share: Column | float, *cols: Column, seed: int = 17) -> Column:
    """True for a pseudo-random share of rows, fixed by the columns' values and the seed."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * share


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one that the context was given.

    Only on one machine (tests, a laptop) is a folder of its own made where neither is set; elsewhere that is an error, as executors would each
    write to a disk that the others don't see.
    """
    sc = spark.sparkContext
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if given := sc.getCheckpointDir():
        return given
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    sc, shared = df.sparkSession.sparkContext, shared_folder(df.sparkSession)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder; for loops of joins.

    A checkpoint keeps the size that its plan was estimated to have, and joins multiply estimates, so after some rounds of a
    loop the estimate alone would be megabytes of digits. A table that is read again has the size of its files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that stored() wrote and that is no longer read."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, start offsets and end) of an Arrow string array; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        width = np.int32
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) for arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
