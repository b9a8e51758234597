"""Near-duplicate documents by improved consistent weighted sampling.

A text is its shingles of five words, weighted by TF-IDF; every sign of a script that is written without blanks is a word.
Ioffe's consistent weighted sampling (2010) draws from each text samples that two texts share with the probability of their
weighted Jaccard similarity; three samples make a band. Texts that share a band are candidates, and their weighted Jaccard
similarity is then computed from the texts.

Document frequencies are counted over all documents in a sketch of fixed width, whose load per bucket is a share of the corpus.
A shingle's idf is the log of the share of documents that have it, on the scale from 0 (in all) to 1 (as rare as the sketch can
tell); both ends are shares, so from about a thousand documents on, weights don't change with the size of the corpus. The weight is
(1 + ln tf) * (damp + (1 - damp) * idf). With damp = 0 it is plain TF-IDF, under which a group of near copies that makes up much of a
corpus loses its own links: what its members share is then common and weighs little, and what differs is rare and weighs much.
The README has the figures.

In a band's bucket every text is first compared with the bucket's heads, of which there are up to three. Only where
this leaves a bucket in several components are its other pairs looked at: in cells of bounded size inside tasks, once in their first
common band. Weights summed by hash into LANES lanes bound a pair's similarity from above; pairs that the bound doesn't exclude are
verified there. What leaves a task are links that join components; no list of a bucket's pairs is ever made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, mix64, sha256_hex, small_batches, stored, table
from .graph import components

WORDS = 5
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
SKETCH_BITS = 18
HEADS = 3
GROUP = 512
BROADCAST_ROWS = 100_000
LANES = 512
#: Part of a shingle's weight that doesn't depend on how common it is.
DAMP = 0.75
#: Signs of scripts written without blanks (Thai, Lao, Burmese, Khmer, kana, Han): fixed values, Unicode blocks.
_SIGN = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALTS = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _STEP)
_UNIT = (np.arange(65536) + 0.5) / 65536
_LOG = -np.log(_UNIT)


def _gamma2_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, whose distribution function is 1 - (1 + x) exp(-x)."""
    x = np.full(65536, 1.5)
    for _ in range(60):
        step = (1 - (1 + x) * np.exp(-x) - _UNIT) / (x * np.exp(-x) + 1e-300)
        x = np.clip(x - np.clip(step, -1, 1), 1e-6, 40)
    return x


_GAMMA2 = _gamma2_quantiles()


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 64-bit hashes of the text's shingles, how often each occurs); a text of under five words is one shingle."""
    if not text.isascii() and _SIGN.search(text):
        text = _SIGN.sub(r" \g<0> ", text)
    words = text.lower().encode().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = np.fromiter(map(crc32, words), np.uint64, len(words))
    n = min(WORDS, len(w))
    h = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        h = h * _STEP + w[k : len(w) - n + 1 + k]
    return np.unique(mix64(h + np.uint64(n)), return_counts=True)


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sample(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """SAMPLES hashes of consistent weighted samples (shingle, level) of a weighted set that isn't empty."""
    best, name = np.full(SAMPLES, np.inf), np.zeros(SAMPLES, np.uint64)
    log_w = np.log(weight)
    for k in range(0, len(h), 1024):
        x = mix64(h[k : k + 1024, None] ^ _SALTS)
        u = x.view(np.uint16).reshape(*x.shape, 4)
        r = _GAMMA2[u[..., 0]]
        beta = _UNIT[u[..., 1]]
        level = np.floor(log_w[k : k + 1024, None] / r + beta)
        a = np.log(_LOG[u[..., 2]] + _LOG[u[..., 3]]) - r * (level - beta) - r
        at = a.argmin(0)
        cols = np.arange(SAMPLES)
        low = a[at, cols]
        better = low < best
        best = np.where(better, low, best)
        name = np.where(better, mix64(x[at, cols] + level[at, cols].astype(np.int64).view(np.uint64) * _STEP), name)
    return name


def bands(name: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of samples."""
    rows = name.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix64(key * _STEP + rows[:, j])
    return key.view(np.int64)


def weights(tf: np.ndarray, h: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) * idf[bucket_of(h)]


def inverse_frequencies(counts: np.ndarray, n_docs: int, damp: float = DAMP) -> np.ndarray:
    """damp + (1 - damp) * idf of each bucket of the sketch.

    The rarest share that a bucket can show is its load of other shingles, and never under one document.
    """
    share = np.clip(counts, 1, n_docs) / max(n_docs, 1)
    rarest = min(max(counts.sum() / len(counts), 1.0) / max(n_docs, 1), 1.0)
    idf = np.log(share) / np.log(rarest) if rarest < 1 else np.ones(len(counts))
    return damp + (1 - damp) * np.minimum(idf, 1.0)


def frequency_sketch(docs: DataFrame, text: str = "text", damp: float = DAMP) -> np.ndarray:
    """Inverse document frequencies by bucket, counted over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << SKETCH_BITS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                n += 1
                if s := t.as_py():
                    total += np.bincount(bucket_of(shingles(s)[0]), minlength=len(total)) if len(s) > 1 << 20 else 0
                    if len(s) <= 1 << 20:
                        np.add.at(total, bucket_of(shingles(s)[0]), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    got = docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts, n_docs = np.zeros(1 << SKETCH_BITS, np.int64), 0
    for b, n in zip(got["bucket"].to_numpy(), got["n"].to_numpy(), strict=True):
        if b < 0:
            n_docs = int(n)
        else:
            counts[b] = n
    return inverse_frequencies(counts, n_docs, damp).astype(np.float32)


def weighted_jaccard(a: str, b: str, idf: np.ndarray) -> float:
    return _similarity(_weighed(a, idf), _weighed(b, idf))


def _weighed(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, tf = shingles(text)
    return h, weights(tf, h, idf)


def _similarity(a, b) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _bands_udf(idf: np.ndarray):
    @F.arrow_udf("array<long>")
    def run(texts: pa.Array) -> pa.Array:
        """The keys of each text's bands; none of a text without a word."""
        weighed = (_weighed(t.as_py() or "", idf) for t in texts)
        return pa.array([bands(sample(h, w)) if len(h) else [] for h, w in weighed], pa.list_(pa.int64()))

    return run


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some ids; the ids are broadcast only if they're few."""
    ids = checkpointed(ids)
    return checkpointed(docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id", "left_semi").select("id", "text"))


def _verified(docs: DataFrame, pairs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Those pairs (a, b) of ids whose texts are similar enough. Only texts in some pair are moved, each head's last."""

    @F.arrow_udf(T.DoubleType())
    def similarity(x: pa.Array, y: pa.Array) -> pa.Array:
        out, known, last = [], None, None
        for s, t in zip(x, y, strict=True):
            s, t = s.as_py(), t.as_py()
            if t != last:
                known, last = _weighed(t, idf), t
            out.append(_similarity(_weighed(s, idf), known))
        return pa.array(out, pa.float64())

    texts = _texts(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return both.withColumn("s", similarity("x", "y")).filter(F.col("s") >= threshold).select("a", "b")


def _shares(rows: list[tuple[np.ndarray, np.ndarray]], i: int, others: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the i-th weighted set with each of the others."""
    h, w = rows[i]
    sizes = np.array([len(rows[j][0]) for j in others])
    flat, weight = np.concatenate([rows[j][0] for j in others]), np.concatenate([rows[j][1] for j in others])
    at = np.minimum(np.searchsorted(h, flat), len(h) - 1)
    both = np.bincount(np.repeat(np.arange(len(others)), sizes), np.where(h[at] == flat, np.minimum(w[at], weight), 0), len(others))
    return both / (w.sum() + np.array([rows[j][1].sum() for j in others]) - both)


def lanes(row: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A weighted set's weights summed by hash; of two such sums the lesser bounds what their sets share in a lane."""
    return np.bincount((row[0] & np.uint64(LANES - 1)).astype(np.int64), row[1], LANES)


def _cell_links(idf: np.ndarray, threshold: float):
    """Of a bucket's cell: links enough to join those components that similar pairs of the cell join."""

    def run(t: pa.Table) -> pa.Table:
        ids, comp = t.column("id").to_numpy(), t.column("component").to_numpy()
        line, column = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("in_line", "in_column"))
        keys = np.array(t.column("bands").to_pylist(), np.int64).reshape(len(ids), -1)
        own = int(np.flatnonzero(keys[0] == t.column("band")[0].as_py())[0])
        comp, out = comp.copy(), []
        rows: list = [None] * len(ids)
        sums = np.zeros((len(ids), LANES))
        texts = t.column("text")

        def known(i: int):
            if rows[i] is None:
                rows[i] = _weighed(texts[int(i)].as_py(), idf)
                sums[i] = lanes(rows[i])
            return rows[i]

        for i in np.flatnonzero(line):
            # a pair is looked at in its first common band only
            maybe = column & (comp != comp[i]) & (ids > ids[i]) & ~(keys[:, :own] == keys[i, :own]).any(1)
            maybe = np.flatnonzero(maybe)
            if not len(maybe):
                continue
            for j in (i, *maybe):
                known(j)
            most = np.minimum(sums[maybe], sums[i]).sum(1)
            maybe = maybe[most >= (threshold - 1e-6) * (sums[maybe].sum(1) + sums[i].sum() - most)]
            if not len(maybe):
                continue
            for j in maybe[_shares(rows, i, maybe) >= threshold]:
                if comp[j] != comp[i]:
                    out.append((ids[i], ids[j]))
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"a": np.array([x for x, _ in out], np.int64), "b": np.array([y for _, y in out], np.int64)})

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", group: int = GROUP, damp: float = DAMP) -> DataFrame:
    """One row per input row: key, copy_of (least id of the same text), class_id (least id of the near-duplicate class), kept.

    A class is connected by links of similarity >= threshold; equal texts are collapsed first and belong to one class, null
    texts count as ''. Texts without a word link only with equal texts. Ids are taken to be unique; rows of one id count as one
    document and share its class. Rows with a null id are kept and have null classes. An empty table gives an empty result. Other
    columns, whatever their names, play no part.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    idf = frequency_sketch(rows, damp=damp)
    marked = rows.filter(F.col("id").isNotNull()).select("id", sha256_hex(F.col("text")).alias("sha"), _bands_udf(idf)("text").alias("bands"))
    marked = checkpointed(marked)
    reps = checkpointed(marked.groupBy("sha").agg(F.min("id").alias("id"), F.first("bands").alias("bands")))

    members = reps.select("id", F.explode("bands").alias("band"))
    drawn = [F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(1, HEADS)]
    # heads are stored before they are met, so that Spark can split the rows of a large bucket over tasks
    heads = stored(members.groupBy("band").agg(F.array_distinct(F.array(F.min("id"), *drawn)).alias("heads"), F.count("*").alias("n")).filter("n > 1"))
    held = checkpointed(members.join(heads, "band"))
    first = held.select(F.col("id").alias("x"), F.explode("heads").alias("y")).filter("x <> y")
    first = checkpointed(first.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    links = checkpointed(_verified(rows, first, idf, threshold))
    comps = components(links).withColumnRenamed("node", "id")

    # buckets that the heads' links leave in several components
    placed = held.filter(F.col("n") > 2).join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    still_open = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"))
    still_open = still_open.filter("low <> high").withColumn("cells", F.ceil(F.col("m") / group).cast("int")).select("band", "cells")
    waiting = checkpointed(placed.join(still_open, "band").select("band", "cells", "id", "component"))
    if not waiting.isEmpty():
        texts = _texts(rows, waiting.select("id").distinct())
        own = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")
        every = F.sequence(F.lit(0), F.col("cells") - 1)
        grid = F.concat(
            F.transform(every, lambda c: F.struct(own.alias("line"), c.alias("col"), F.lit(True).alias("in_line"), (c == own).alias("in_column"))),
            F.filter(F.transform(every, lambda c: F.struct(c.alias("line"), own.alias("col"), F.lit(False).alias("in_line"), F.lit(True).alias("in_column"))), lambda s: s["line"] != own),
        )
        cells = waiting.join(reps.select("id", "bands"), "id").join(texts, "id").withColumn("cell", F.explode(grid))
        cells = cells.select("band", "cell.*", "id", "component", "bands", "text")
        more = checkpointed(cells.groupBy("band", "line", "col").applyInArrow(_cell_links(idf, threshold), "a long, b long").distinct())
        if not more.isEmpty():
            comps = components(links.unionByName(more)).withColumnRenamed("node", "id")

    told = reps.select("sha", F.col("id").alias("copy_of")).join(comps.withColumnRenamed("id", "copy_of"), "copy_of", "left")
    told = told.select("sha", "copy_of", F.coalesce("component", "copy_of").alias("class_id"))
    out = marked.select("id", "sha").join(told, "sha").drop("sha")
    none = docs.filter(F.col(key).isNull()).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("copy_of"), F.lit(None).cast("long").alias("class_id"))
    out = out.unionByName(none)
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("class_id"))).withColumnRenamed("id", key)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near-duplicates the document of the least id stays, once; columns stay as they are."""
    small_batches(spark)
    told = checkpointed(near_duplicates(docs).filter(F.col("doc_id").isNotNull()))
    gone = told.filter(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti")
    if not told.groupBy("doc_id").count().filter("count > 1").isEmpty():
        kept = kept.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).unionByName(kept.filter(F.col("doc_id").isNull()))
    return kept.select(*docs.columns)
