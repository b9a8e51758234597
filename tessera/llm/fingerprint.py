"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (its lines). Each paragraph is hashed to a wide vector, and the fingerprint
is the sum of the vectors, each lane modulo a power of two; so the order of paragraphs doesn't matter, and a paragraph
is inserted or deleted by adding or subtracting its vector. Four lanes modulo 2**64 come from a cryptographic hash of
the whole paragraph and decide equality. 256 lanes modulo 2**32 are sums of +1/-1 vectors of the paragraph's distinct pairs
of adjacent words; their inner products estimate how alike two texts are (Alon, Matias and Szegedy, 1996), with a standard
deviation of up to 1 / sqrt(256), about 0.06, for unlike texts and less the more alike they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_share, mix64, table

EXACT, SKETCH = 4, 256
SLICE = 1 << 15


def _pair_hashes(paragraph: str) -> np.ndarray:
    """The distinct 64-bit hashes of a paragraph's pairs of adjacent words, the first word's predecessor being its start."""
    words = paragraph.split()
    h = np.fromiter(map(crc32, map(str.encode, words)), np.uint64, len(words))
    return np.unique(h | np.append(np.uint64(0), h[:-1]) << np.uint64(32))


def _signs(h: np.ndarray) -> np.ndarray:
    """Sum over the hashes of their vectors of SKETCH lanes, each +1 or -1."""
    total = np.zeros(SKETCH, np.int64)
    for k in range(0, len(h), SLICE):
        part = h[k : k + SLICE]
        wide = np.empty((len(part), SKETCH // 64), np.uint64)
        for j in range(SKETCH // 64):
            wide[:, j] = mix64(part + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        ones = np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.int64)
        total += 2 * ones - len(part)
    return total


def hash_multiset(paragraphs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(exact lanes modulo 2**64, sketch lanes modulo 2**32) of a multiset of paragraphs; both may be added and subtracted."""
    exact = np.zeros(EXACT, np.uint64)
    digests = b"".join(hashlib.blake2b(p.encode(), digest_size=8 * EXACT).digest() for p in paragraphs)
    if digests:
        exact = np.frombuffer(digests, "<u8").reshape(-1, EXACT).sum(0, dtype=np.uint64)
    pairs = [_pair_hashes(p) for p in paragraphs]
    signs = _signs(np.concatenate(pairs)) if pairs else np.zeros(SKETCH, np.int64)
    return exact, signs.astype(np.uint32)


def to_text(print_: tuple[np.ndarray, np.ndarray]) -> str:
    return print_[0].astype("<u8").tobytes().hex() + print_[1].astype("<u4").tobytes().hex()


def from_text(s: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(s)
    return np.frombuffer(raw[: 8 * EXACT], "<u8").copy(), np.frombuffer(raw[8 * EXACT :], "<u4").copy()


def fingerprint_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of a whole text; null counts as ''."""
    return hash_multiset((text or "").split("\n"))


def add(a, b):
    """Fingerprint of the union of two multisets of paragraphs."""
    return a[0] + b[0], a[1] + b[1]


def subtract(a, b):
    """Fingerprint of a multiset after its part b is deleted."""
    return a[0] - b[0], a[1] - b[1]


def likeness(a, b) -> float:
    """1 for equal fingerprints, else the estimated 2<x,y> / (|x|**2 + |y|**2) of the word-pair counts, within 0 and 1."""
    if (a[0] == b[0]).all():
        return 1.0
    x, y = a[1].view(np.int32).astype(float), b[1].view(np.int32).astype(float)
    both = x @ x + y @ y
    return float(min(max(2 * (x @ y) / both, 0.0), 1.0)) if both else 0.0


def fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each whole text as a hexadecimal string `into`. Null texts count as ''.

    Equal texts, and texts whose lines are equal but for their order, get equal fingerprints. All rows and other
    columns stay; a column `into` is replaced.
    """

    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([to_text(fingerprint_of(x.as_py())) for x in rows], pa.string())

    return docs.withColumn(into, run(F.coalesce(F.col(text), F.lit(""))))


def _position(x: Column, bounds: list) -> Column:
    """How many of the ascending bounds lie below x, by binary search."""
    if not bounds:
        return F.lit(0)
    known = F.array(*bounds)
    low = F.lit(0)
    # after these steps low is the number of bounds that are less than x
    return F.aggregate(
        F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length())))), low,
        lambda at, step: F.when((at + step <= len(bounds)) & (F.element_at(known, F.least(at + step, F.lit(len(bounds)))) < x), at + step).otherwise(at),
    )


PER_BLOCK = 20


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in blocks of consecutive keys: (block, key, tie, text, borrowed), sorted within partitions.

    Each block ends with a borrowed copy of the first row of the next block (the last block: of the very first), so
    that every row's successor in ascending order of keys lies right behind it. Keys may be of any type that has an order; null keys come
    first; of equal keys the order is that of a hash of the text, so that many rows of one key fall into many blocks (but rows equal in key
    and text lie in one). Block bounds come from a sample of about PER_BLOCK (key, hash) pairs for each block and change nothing but the
    size of blocks; one row per block is broadcast.
    """
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    place = F.struct("key", "tie")
    many = rows.count()
    drawn = rows.filter(keep_share(min(1.0, PER_BLOCK * n / max(many, 1)), F.col("key").cast("string"), F.col("tie"))).select("key", "tie").distinct()
    drawn = drawn.orderBy(F.col("key").asc_nulls_first(), "tie").collect()
    key_type = docs.schema[key].dataType
    bounds = [drawn[len(drawn) * i // n] for i in range(1, n)] if len(drawn) > 1 else []
    bounds = [F.struct(F.lit(r["key"]).cast(key_type).alias("key"), F.lit(r["tie"]).cast("long").alias("tie")) for r in dict.fromkeys(bounds)]
    rows = rows.withColumn("block", _position(place, bounds))
    firsts = rows.groupBy("block").agg(F.min(place).alias("first")).collect()  # at most n rows
    blocks = sorted(r["block"] for r in firsts)
    before = dict(zip(blocks, [blocks[-1], *blocks[:-1]] if blocks else [], strict=True))
    lent = spark.createDataFrame([(r["block"], r["first"]["key"], r["first"]["tie"], before[r["block"]]) for r in firsts], T.StructType([
        T.StructField("b", T.IntegerType()), T.StructField("k", key_type), T.StructField("t", T.LongType()), T.StructField("to_block", T.IntegerType())]))
    cond = (F.col("block") == F.col("b")) & F.col("key").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t"))
    extra = rows.join(F.broadcast(lent), cond).groupBy("to_block").agg(F.min_by(F.struct("key", "tie", "text"), F.col("text")).alias("r"))
    extra = extra.select("r.key", "r.text", "r.tie", F.col("to_block").alias("block"), F.lit(True).alias("borrowed"))
    every = rows.withColumn("borrowed", F.lit(False)).unionByName(extra)
    return every.repartitionById(n, F.pmod("block", F.lit(n))).sortWithinPartitions("block", "borrowed", F.col("key").asc_nulls_first(), "tie", "text")


EDITED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit(text: str, after: str, own=None):
    """(edited text, its fingerprint): the last quarter of a text is replaced by as much of the beginning of the next.

    Lines before the edit stay, so their vectors do: the old tail's are subtracted, the new tail's added.
    """
    cut = len(text) - len(text) // 4
    edited = text[:cut] + after[: len(text) // 4]
    start = text.rfind("\n", 0, cut) + 1
    own = own or fingerprint_of(text)
    return edited, add(subtract(own, fingerprint_of(text[start:])), fingerprint_of(edited[start:]))


def compare_with_edit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, in which the next document's beginning replaces the last quarter.

    One row per input row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts count as ''. Keys may be of any type that has an order, null or repeated (see with_next). An empty table gives an empty result; a
    single document is its own successor. Other columns, whatever their names, play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # (block, key, text, fingerprint) of the row whose successor comes next

        def finish(this, text_next, print_next):
            _, k, t, p = this
            edited, q = edit(t, text_next, p)
            return k, len(t), hashlib.sha256(edited.encode()).hexdigest(), to_text(p), to_text(q), likeness(p, q), likeness(p, print_next)

        for b in batches:
            out = []
            for block, k, t, borrowed in zip(*(b.column(c).to_pylist() for c in ("block", "key", "text", "borrowed")), strict=True):
                p = fingerprint_of(t)
                if before is not None and before[0] == block:
                    out.append(finish(before, t, p))
                before = None if borrowed else (block, k, t, p)
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = [b.schema.field("key").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", *(x.split()[0] for x in EDITED.split(", "))])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType)]).simpleString()[len("struct<") : -1].replace(":", " ", 1)
    return with_next(docs, key, text).mapInArrow(run, f"{schema}, {EDITED}").withColumnRenamed("key", key)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edit(table(spark, sf_dir, "documents").select("doc_id", "text"))
