"""Quality classification from positive and unlabelled documents.

Trusted positives and unlabelled web text train a small network that minimises the non-negative unbiased risk
(Kiryo et al., 2017): prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)). The class prior is itself estimated from
positives and unlabelled rows alone, as the least ratio of their tail masses (Blanchard et al., 2010).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_bytes, fold, keep_share, small_batches, table, unused

CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "shout", "bar", "symbol", "high")
_KIND = np.full(256, CLASSES.index("symbol"), np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, CLASSES.index("high")
for _chars, _name in ((" \t\r\x0b\x0c", "space"), ("\n", "newline"), (".:;", "stop"), (",'\"-()", "comma"), ("!?", "shout"), ("|", "bar")):
    for _c in _chars:
        _KIND[ord(_c)] = CLASSES.index(_name)
N_FEATURES = len(CLASSES) + 8


def features(texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each whole text: shares of character classes, repetition, shape."""
    data, offsets = flat_bytes(texts)
    n, k = len(offsets) - 1, len(CLASSES)
    counts = np.zeros(n * k)
    for start in range(0, len(data), 1 << 20):
        seg = _KIND[data[start : start + (1 << 20)]]
        row = np.searchsorted(offsets, np.arange(start, start + len(seg), dtype=np.int64), "right") - 1 if n < 2 else np.repeat(
            np.arange(n), np.diff(np.clip(offsets, start, start + len(seg)))
        )
        counts += np.bincount(row * k + seg, minlength=n * k)
    counts = counts.reshape(n, k)
    size = np.maximum(offsets[1:] - offsets[:-1], 1).astype(float)
    out = np.zeros((n, N_FEATURES))
    out[:, :k] = np.sqrt(counts / size[:, None])
    out[:, k] = np.log1p(size)
    for i, t in enumerate(texts.to_pylist()):
        if not t:
            continue
        words, lines = t.split(), t.split("\n")
        if words:
            m = len(words)
            out[i, k + 1] = len(set(words)) / m
            out[i, k + 2] = np.log(len(set(words)) + 1) / np.log(m + 1)
            out[i, k + 3] = sum(map(str.__eq__, words, words[1:])) / m
            out[i, k + 4] = np.log(size[i] / m)
        out[i, k + 5] = 1 - len(set(lines)) / len(lines)
        out[i, k + 6] = np.log1p(size[i] / len(lines))
        out[i, k + 7] = len(zlib.compress(memoryview(data[offsets[i] : offsets[i + 1]]), 1)) / size[i]
    return out


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    params: list[np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_forward(self.params, np.clip((x - self.mean) / self.spread, -8, 8))[0])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(p, x):
    h = np.tanh(x @ p[0] + p[1])
    return h @ p[2] + p[3], h


def _backward(p, x, h, dz):
    """Gradients of sum(dz * output)."""
    dh = np.outer(dz, p[2]) * (1 - h * h)
    return [x.T @ dh, dh.sum(0), h.T @ dz, np.array(dz.sum())]


def _adam(params, grads_at, steps, rate=0.01, decay=1e-4):
    m, v = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    for t in range(1, steps + 1):
        for i, g in enumerate(grads_at(params, t)):
            g = g + decay * params[i]
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return params


def _start(d, rng, hidden=24):
    return [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(0.0)]


def class_prior(pos: np.ndarray, unl: np.ndarray, least: float = 0.5) -> float:
    """Share of positives among the unlabelled: least ratio of the masses of U and P above a threshold.

    Scores are those of a classifier of P against U. Thresholds that keep under `least` of P are too noisy to count.
    The least of noisy ratios lies a little low, which is the safe side: too high a prior would leave no room for the
    rarest kind of bad text.
    """
    pos, unl = np.sort(pos), np.sort(unl)
    t = np.quantile(pos, np.linspace(0, 1 - least, 200))
    p = 1 - np.searchsorted(pos, t, "left") / len(pos)
    u = 1 - np.searchsorted(unl, t, "left") / len(unl)
    return float(np.clip((u / p).min(), 0.02, 0.98))


def train(pos: np.ndarray, unl: np.ndarray, steps: int = 800, seed: int = 3) -> Model:
    """Non-negative PU training on two bounded samples of feature rows."""
    rng = np.random.default_rng(seed)
    both = np.vstack([pos, unl])
    mean, spread = both.mean(0), both.std(0) + 1e-3
    pos, unl = np.clip((pos - mean) / spread, -8, 8), np.clip((unl - mean) / spread, -8, 8)

    def pick(rows, size=1024):
        return rows[rng.integers(0, len(rows), size)]

    def p_against_u(params, _):
        total = None
        for rows, y in ((pick(pos[::2]), 1), (pick(unl[::2]), 0)):
            z, h = _forward(params, rows)
            g = _backward(params, rows, h, (_sigmoid(z) - y) / len(rows))
            total = g if total is None else [a + b for a, b in zip(total, g, strict=True)]
        return total

    naive = _adam(_start(pos.shape[1], rng), p_against_u, steps, decay=1e-2)
    seen = slice(1, None, 2) if min(len(pos), len(unl)) > 1 else slice(None)  # the half that it was not trained on
    prior = class_prior(_forward(naive, pos[seen])[0], _forward(naive, unl[seen])[0])

    def nn_risk(params, _):
        xp, xu = pick(pos), pick(unl)
        (zp, hp), (zu, hu) = _forward(params, xp), _forward(params, xu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_pos = _backward(params, xp, hp, prior * (_sigmoid(zp) - 1) / len(xp))
        g_u = _backward(params, xu, hu, _sigmoid(zu) / len(xu))
        g_p = _backward(params, xp, hp, prior * _sigmoid(zp) / len(xp))
        g_neg = [a - b for a, b in zip(g_u, g_p, strict=True)]
        if negative < 0:
            return [-g for g in g_neg]
        return [a + b for a, b in zip(g_pos, g_neg, strict=True)]

    return Model(mean, spread, _adam(_start(pos.shape[1], rng), nn_risk, 2 * steps), prior)


def fit(docs: DataFrame, labels: DataFrame, trusted: Column, text: str = "text", key: str = "doc_id", max_pos: int = 6000, max_unl: int = 9000) -> Model:
    """Fit on about `max_pos` trusted positives (rows of `labels` that are 1 in quality, in the rows that `trusted`
    marks) and `max_unl` unlabelled documents of the same rows. Without any positive, every text counts as good. Labels without an id
    teach nothing, of repeated labels one positive is enough, and documents that share an id share its label."""
    good = labels.filter((F.col("quality") == 1) & trusted & F.col(key).isNotNull())
    n_good, n_docs = good.count(), docs.count()
    if not n_good or not n_docs:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), [np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.array(4.0)], 1.0)
    chosen = good.filter(keep_share(min(1.0, max_pos / n_good), F.col(key))).select(F.col(key).alias("__key"), F.lit(True).alias("pos")).dropDuplicates(["__key"])
    rows = docs.filter(trusted).select(F.col(key).alias("__key"), F.col(text).alias("__text"), keep_share(min(1.0, max_unl / n_docs), F.col(key), seed=29).alias("unl"))
    rows = rows.join(F.broadcast(chosen), "__key", "left").filter("pos or unl")  # at most about max_pos short rows are broadcast
    got = rows.select(F.coalesce("pos", F.lit(False)).alias("pos"), "unl", _features_udf(F.coalesce("__text", F.lit(""))).alias("x")).toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, N_FEATURES)
    pos, unl = x[got["pos"].to_numpy(bool)], x[got["unl"].to_numpy(bool)]
    if not len(pos) or not len(unl):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), [np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.array(4.0)], 1.0)
    return train(pos, unl)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features_udf(texts: pa.Array) -> pa.Array:
    return pa.array(list(features(texts)), pa.list_(pa.float64()))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the quality, 0 to 1, of each whole text as `into` (a column of that name is replaced).

    Null and empty texts score 0, equal texts alike. Rows and all other columns stay.
    """

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts)))

    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(into, rate(t)).withColumn(into, F.when(F.length(t) > 0, F.col(into)).otherwise(0.0))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    rows = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops the documents that score below 0.5; all columns and the other rows stay. Null and empty texts go; repeated rows
    stay or go together; an empty table stays empty."""
    small_batches(spark)
    model, told = fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1), unused(docs, "quality")
    return score(docs, model, into=told).filter(F.col(told) >= 0.5).drop(told)
