"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits. One binary classifier per bit sees hashed byte n-grams of the
lower-cased letters of the whole text and says on which side of the bit the text lies; decoding picks the language
whose codeword has the least loss, each bit weighing as much as it was right on rows held back from the fit.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LETTERS, checkpointed, flat_bytes, fold, keep_share, small_batches, table, unused

ORDERS = (2, 3, 4)
BITS = 15
SLICE = 1 << 18
#: Languages with fewer rows lend none to weighing the bits.
FEW_ROWS = 40

SCHEMA = "lang_pred string, score double, ambiguous boolean"


def _features(seg: np.ndarray, n: int, slot: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each of the first len(seg) - n + 1 bytes."""
    m = len(seg) - n + 1
    h = seg[:m].astype(np.uint32)
    for k in range(1, n):
        h *= np.uint32(0x01000193)
        h ^= seg[k : k + m]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BITS)).astype(np.int32) + (slot << BITS)


def _grams(data: np.ndarray, offsets: np.ndarray):
    """Yields (rows with n-grams, start of each one's run, buckets) over bounded slices; no n-gram crosses a text."""
    letters = LETTERS[data]
    for start in range(0, len(data), SLICE):
        stop = min(start + SLICE, len(data))
        for slot, n in enumerate(ORDERS):
            seg = letters[start : min(stop + n - 1, len(data))]
            if len(seg) < n:
                continue
            f = _features(seg, n, slot)
            first = int(np.searchsorted(offsets, start, "right")) - 1
            last = int(np.searchsorted(offsets, start + len(f) - 1, "right")) - 1
            rows = np.arange(first, last + 1)
            lo = np.maximum(offsets[rows] - start, 0)
            hi = np.minimum(offsets[rows + 1] - n + 1 - start, len(f))
            good = hi > lo
            if good.any():
                yield rows[good], lo[good], hi[good], f


def bit_sums(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of its n-grams' weight rows, and the number of n-grams."""
    n = len(offsets) - 1
    sums, count = np.zeros((n, weights.shape[1])), np.zeros(n)
    for rows, lo, hi, f in _grams(data, offsets):
        edges = np.empty(2 * len(lo), np.int64)
        edges[0::2], edges[1::2] = lo, hi
        got = weights[f]
        if edges[-1] == len(f):
            edges = edges[:-1]
        sums[rows] += np.add.reduceat(got, edges, axis=0)[0::2]
        count[rows] += hi - lo
    return sums, count


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of +1/-1: the exhaustive code up to five languages, else random rows as far apart as found."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 5:
        cols = [c for c in product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(cols).T.astype(float)
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, gap = None, -1
    for _ in range(200):
        c = rng.choice((-1.0, 1.0), size=(k, length))
        apart = ((length - c @ c.T) / 2 + np.eye(k) * length).min()
        if apart > gap and (abs(c.sum(0)) < k).all():
            best, gap = c, apart
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray

    @classmethod
    def of(cls, langs: list[str], counts: np.ndarray) -> Model:
        """From counts[i, f], how often language i has n-gram bucket f: each bit weighs a bucket by the log ratio of its frequency on both sides."""
        p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        code = codewords(len(langs))
        side = lambda rows: np.log((rows.mean(0) if len(rows) else 0 * p[0]) + 1e-6)
        return cls(langs, code, np.stack([side(p[bit > 0]) - side(p[bit < 0]) for bit in code.T], axis=1).astype(np.float32), np.ones(code.shape[1]))

    def decode(self, sums: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, its share of the likelihood, whether the two nearest codewords are close)."""
        f = sums / np.maximum(count, 1)[:, None]
        evidence = f * np.sqrt(np.maximum(count, 1))[:, None]
        loss = np.log1p(np.exp(-np.clip(evidence[:, None, :] * self.code[None], -50, 50))) @ self.bit_weight
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        top = np.sort(p, axis=1)
        close = (top[:, -1] - top[:, -2] < 0.2) if p.shape[1] > 1 else np.zeros(len(p), bool)
        return best, p[np.arange(len(p)), best], close


def _udf(model: Model):
    @F.arrow_udf(SCHEMA)
    def identify(texts: pa.Array) -> pa.Array:
        data, offsets = flat_bytes(texts)
        best, score, close = model.decode(*bit_sums(data, offsets, model.weights))
        return pa.StructArray.from_arrays(
            [pa.array([model.langs[i] for i in best], pa.string()), pa.array(score), pa.array(close)],
            names=["lang_pred", "score", "ambiguous"],
        )

    return identify


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 1500, most_langs: int = 200) -> Model:
    """Learn from the rows that `train` marks; about `per_lang` rows of each language bound the sample.

    Rows with a null language, or whose text is null or has no letter, teach nothing, and a language without a row that teaches is no class.
    Of more than `most_langs` languages those with the most rows are learned (of equal ones the first by name), as the rest of a column with
    so many values is dirt. A quarter of a language's rows weigh the bits, but of languages with few rows all are learned from. With no
    teaching row the model knows only 'und'. Repeated rows count as often as they are there; null ids are one id to the sampling.
    """
    rows = docs.filter(train & F.col(lang).isNotNull() & F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not n:
        return Model(["und"], np.ones((1, 1)), np.zeros((len(ORDERS) << BITS, 1), np.float32), np.ones(1))
    langs = sorted(n)
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, per_lang / v), v >= FEW_ROWS) for k, v in n.items()], "lang string, share double, many boolean")
    drawn = rows.join(F.broadcast(shares), "lang").filter(keep_share(F.col("share"), F.col("key")))  # at most most_langs rows are broadcast
    sample = checkpointed(drawn.select("text", "lang", (F.col("many") & keep_share(0.25, F.col("key"), seed=18)).alias("check")))

    size = len(ORDERS) << BITS

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            data, offsets = flat_bytes(b.column(0))
            names = b.column(1).to_pylist()
            for rows, lo, hi, f in _grams(data, offsets):
                for r, a, z in zip(rows, lo, hi, strict=True):
                    c = total.setdefault(names[r], np.zeros(size, np.int64))
                    c += np.bincount(f[a:z], minlength=size) if z - a > size >> 4 else 0
                    if z - a <= size >> 4:
                        np.add.at(c, f[a:z], 1)
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "f", "n"])

    got = sample.filter(~F.col("check")).select("text", "lang").mapInArrow(count, "lang string, f int, n long").groupBy("lang", "f").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(got["lang"]))
    counts = np.zeros((len(langs), size))
    at = {name: i for i, name in enumerate(langs)}
    counts[[at[x] for x in got["lang"]], got["f"].to_numpy()] = got["n"].to_numpy()
    if not langs:
        return Model(["und"], np.ones((1, 1)), np.zeros((size, 1), np.float32), np.ones(1))
    model = Model.of(langs, counts)

    def held_back(batches):
        for b in batches:
            at = {name: i for i, name in enumerate(model.langs)}
            known = [i for i, x in enumerate(b.column(1).to_pylist()) if x in at]
            sums, _ = bit_sums(*flat_bytes(b.column(0)), model.weights)
            right = (sums[known] > 0) == (model.code[[at[b.column(1)[i].as_py()] for i in known]] > 0)
            yield pa.RecordBatch.from_arrays([pa.array([len(right)], pa.int64()), pa.array([right.sum(0).tolist()], pa.list_(pa.int64()))], names=["n", "right"])

    seen = sample.filter("check").select("text", "lang").mapInArrow(held_back, "n long, right array<long>").collect()
    if total := sum(r["n"] for r in seen):
        acc = np.clip(sum(np.array(r["right"]) for r in seen) / total, 0.5, 0.999)
        model.bit_weight = np.log(acc / (1 - acc)) + 1e-3
        model.bit_weight /= model.bit_weight.mean()
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """Adds a struct (lang_pred, score, ambiguous) named `into`.

    A text that is null or has no letter gets `und`, score 0 and ambiguous true. Every other text, of any length,
    gets a learned language. Rows, their order of columns and all other columns stay; a column `into` is replaced.
    """
    said = _udf(model)(F.coalesce(F.col(text), F.lit("")))
    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    return docs.withColumn(into, said).withColumn(into, F.when(F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}"), F.col(into)).otherwise(none))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = fit(docs, ~held_out)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "language.lang_pred", "language.score", "language.ambiguous")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops documents without a recognisable language, and corrects `lang` of the rest.

    The model is learned from the rows that the stage gets and that carry a language. A document goes if its text is
    null or has no letter; a near tie between languages alone is no reason to drop a clean document. Repeated rows stay or go
    together; an empty table stays empty.
    """
    small_batches(spark)
    model, told = fit(docs, F.lit(True)), unused(docs, "language")
    got = identify(docs, model, into=told)
    return got.filter(F.col(told)["lang_pred"] != "und").withColumn("lang", F.col(told)["lang_pred"]).drop(told)
