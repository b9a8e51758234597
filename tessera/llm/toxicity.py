"""Toxicity scores that see through disguised spelling.

A word that may be disguised (leetspeak, letters set apart, letters repeated) is a lattice of the characters that
each of its marks may stand for. Viterbi search finds the likeliest restored word: the cost of each substitution plus
the cost of the letters under a character trigram model of all texts, labelled or not. Words, as written and as restored,
are scored by their prefixes' evidence for the label, learned with confidence bounds; a logistic model over the worst
words makes the text's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fold, keep_share, table

#: What a mark may stand for: fixed values, the usual look-alikes.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h",
}
APART = " .-_·*~,/'"
EDGE = ".,;:!?\"'()[]{}«»“”‘’…<>=/\\-_~^`|&%#+*$@¡¿·"
_APART_WORD = re.compile(r"[^\W_](?:[.\-_·*~,/]+[^\W_]){3,}")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_LETTER = re.compile(r"[^\W\d_]")
PREFIX = range(3, 8)
CACHE = 400_000
SMOOTH = 0.05
#: The share that one word has of a text, counted for a feature beside what clean texts show.
ONE_WORD = 1 / 200


@dataclass
class CharModel:
    """Character trigrams; '^' is before a word's first letter and '$' after its last."""

    trigrams: dict[str, float] = field(default_factory=dict)
    bigrams: dict[str, float] = field(default_factory=dict)
    letters: int = 30

    known: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, trigrams: dict[str, float]) -> CharModel:
        bigrams: dict[str, float] = {}
        for g, n in trigrams.items():
            bigrams[g[:2]] = bigrams.get(g[:2], 0.0) + n
        return cls(trigrams, bigrams, len({g[2] for g in trigrams}) or 30)

    def cost(self, a: str, b: str, c: str) -> float:
        """Minus the log of the probability of c after a and b."""
        key = a + b + c
        if (got := self.known.get(key)) is None:
            if len(self.known) > CACHE:
                self.known.clear()
            got = math.log((self.bigrams.get(a + b, 0.0) + SMOOTH * self.letters) / (self.trigrams.get(key, 0.0) + SMOOTH))
            self.known[key] = got
        return got

    @cached_property
    def lead(self) -> float:
        """No state of a lattice that is dearer than another by more than this can win: two letters on, both go on at the same costs."""
        return 2 * math.log((max(self.bigrams.values(), default=0.0) + SMOOTH * self.letters) / SMOOTH)


def _options(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of n equal characters may stand for, each with its cost."""
    out = []
    if c in LEET:
        for x in LEET[c]:
            out += [(x, 0.7)] if n == 1 else [(x * 2, 0.7), (x, 0.9)]
    if c in APART:
        out.append(("", 0.3))
    elif not _LETTER.match(c):
        out.append(("", 9.0 if c.isdigit() else 3.0))
    elif n == 1:
        out.append((c, 0.0))
    elif n == 2:
        out += [(c * 2, 0.0), (c, 1.5)]
    else:
        out += [(c, 0.5), (c * 2, 0.7)]
    return out


def restore(word: str, chars: CharModel) -> str:
    """The likeliest word behind the marks, in lower case: the exact best path of the lattice, whose states are the last two letters."""
    best: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", "^"): (0.0, None)}
    for c, run in groupby(word.lower()):
        n = sum(1 for _ in run)
        options = _options(c, n)
        most = min(cost for cost, _ in best.values()) + chars.lead
        after: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in best.items():
            if cost > most:
                continue
            for emit, price in options:
                x, y, total = a, b, cost + price
                for e in emit:
                    total += chars.cost(x, y, e)
                    x, y = y, e
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (path, emit) if emit else path)
        best = after
    path = min(((cost + chars.cost(a, b, "$"), a, b) for (a, b), (cost, _) in best.items()))
    path, out = best[path[1:]][1], []
    while path:
        path, emit = path
        out.append(emit)
    return "".join(reversed(out))


def plain(word: str, chars: CharModel) -> str:
    """A lower-case word without its edges, restored if it may be disguised."""
    core = word.strip(EDGE)
    if not disguised(word):
        return core
    return restore(word[0] + core if word[0] in "$@€" else core, chars)


def disguised(word: str) -> bool:
    """Whether the lattice of a lower-case word has more than the path that is written."""
    core = word.strip(EDGE)
    if word[:1] in "$@€" and core:
        core = word[:1] + core
    if not _LETTER.search(core):
        return False
    return any(c in core for c in LEET) or bool(_TRIPLE.search(core)) or bool(_APART_WORD.fullmatch(core))


def spelled_apart(words: list[str]) -> list[str]:
    """Runs of four or more one-character words, each joined to one word."""
    out = []
    if len(words) < 4:
        return out
    one = np.fromiter(map(len, words), np.int64, len(words)) == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], one, [False]]).astype(np.int8)))
    for a, z in zip(edges[::2], edges[1::2], strict=True):
        if z - a >= 4:
            out.append("".join(words[a:z]))
    return out


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in PREFIX if len(word) >= k)]


class Words(dict):
    """What `of` makes of each word, worked out at its first look-up."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        if len(self) > CACHE:
            self.clear()
        self[word] = got = self.of(word)
        return got


@dataclass
class Model:
    weights: dict[str, float]
    chars: CharModel
    coef: np.ndarray

    def weight(self, word: str) -> float:
        """Weight of a word as restored."""
        return max((self.weights.get(f, 0.0) for f in features(plain(word, self.chars))), default=0.0)

    def weight_inside(self, letters: str) -> float:
        """Greatest weight of a word that begins somewhere in these letters, which were written apart."""
        word, longest = restore(letters, self.chars), self.longest
        ends = (self.weights.get("=" + word[i:], 0.0) for i in range(max(0, len(word) - longest), len(word)))
        starts = (self.weights.get("^" + word[i : i + k], 0.0) for i in range(len(word)) for k in PREFIX if i + k <= len(word))
        return max((*ends, *starts), default=0.0)

    @cached_property
    def longest(self) -> int:
        return max((len(f) - 1 for f in self.weights if f[0] == "="), default=0)

    def evidence(self, text: str, words: Words) -> tuple[float, float, float]:
        """(weight of the worst word, log of the weights' sum, log of their sum per thousand words) of a text."""
        tokens = text.lower().split()
        w = np.fromiter(map(words.__getitem__, tokens), float, len(tokens))
        w = np.append(w, [self.weight_inside(run) for run in spelled_apart(tokens)])
        heavy = w[w > 0]
        if not len(heavy):
            return 0.0, 0.0, 0.0
        return float(heavy.max()), float(np.log1p(heavy.sum())), float(np.log1p(1000 * heavy.sum() / len(w)))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(evidence)), evidence]) @ self.coef
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _words(tokens: Counter) -> Counter:
    out: Counter = Counter()
    for t, n in tokens.items():
        if (w := t.strip(EDGE)) and _LETTER.search(w):
            out[w] += n
    return out


def _counts(rows: DataFrame, what) -> DataFrame:
    """By name, in how many texts `what` finds it (n), and the sum of what it says of them (total)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, total = Counter(), Counter()
            for t in b.column(0):
                found = what(t.as_py())
                n.update(found.keys())
                total.update(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([float(total[k]) for k in n], pa.float64())], names=["name", "n", "total"]
            )

    return rows.select("text").mapInArrow(run, "name string, n long, total double").groupBy("name").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def _text_features(chars: CharModel) -> Callable:
    restored = Words(lambda w: plain(w, chars))

    def of(text: str) -> dict[str, float]:
        """Share of a text's words that have each feature, as restored."""
        out: Counter = Counter()
        m = 0
        for t, n in Counter(text.lower().split()).items():
            if _LETTER.search(w := restored[t]):
                m += n
                for f in features(w):
                    out[f] += n
        return {f: n / m for f, n in out.items()}

    return of


def _trigrams(rows: DataFrame) -> DataFrame:
    """How often (total) each trigram (name) comes up in the words of all texts.

    Words of scripts from U+0590 on are left out: what marks stand for is Latin, and trigrams of scripts of thousands of signs have no bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, total = Counter(), Counter()
            for t in b.column(0):
                tokens.update(t.as_py().lower().split())
            for w, n in _words(tokens).items():
                if w.isalpha() and max(w) < "\u0590":
                    s = "^^" + w + "$"
                    for i in range(len(s) - 2):
                        total[s[i : i + 3]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["name", "total"])

    return rows.select("text").filter(F.col("text").isNotNull()).mapInArrow(run, "name string, total long").groupBy("name").agg(F.sum("total").alias("total"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 40) -> np.ndarray:
    a = np.column_stack([np.ones(len(x)), x])
    coef = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ coef, -30, 30)))
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge * len(a) * np.diag([0] + [0.01] * x.shape[1]) + 1e-6 * np.eye(a.shape[1])
        g = a.T @ (p - y) + ridge * len(a) * 0.01 * np.append(0, coef[1:])
        coef = coef - np.linalg.solve(h, g)
    return coef


def fit(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", key: str = "doc_id", most_rows: int = 24_000) -> Model:
    """Learn from about `most_rows` labelled rows that `train` marks; a third of them calibrates the final score.

    The trigrams that restore disguised words need no label and are counted over all rows of docs. Every feature that enough toxic rows have
    is weighed; only most_rows bounds how many there are. Labels without an id teach nothing, of repeated labels the greatest counts, and
    documents that share an id share its label. Without a toxic row among them, every text scores 0.
    """
    known = labels.filter(train & F.col("toxic").isNotNull() & F.col(key).isNotNull())
    n = known.count()
    chosen = known.filter(keep_share(min(1.0, most_rows / max(n, 1)), F.col(key), seed=51)).groupBy(F.col(key).alias("__key")).agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(chosen), "__key")  # about most_rows short rows
    rows = checkpointed(rows.filter(F.col("text").isNotNull()).withColumn("check", keep_share(1 / 3, F.col("__key"), seed=52)).drop("__key"))
    learn = rows.filter("not check")
    total = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    if not pos:
        return Model({}, CharModel(), np.array([-20.0, 0, 0, 0]))

    chars = CharModel.of({r["name"]: float(r["total"]) for r in _trigrams(docs.select(F.col(text).alias("text"))).orderBy("name").collect()})
    found, least = _text_features(chars), max(3, min(8, pos // 40))
    p = {r["name"]: (r["n"], r["total"]) for r in _counts(learn.filter("toxic = 1"), found).filter(F.col("n") >= least).collect()}
    seen = _counts(learn.filter("toxic = 0"), lambda t: {f: x for f, x in found(t).items() if f in p})
    q = {r["name"]: (r["n"], r["total"]) for r in seen.collect()}
    weights = {}
    for f, (a, in_pos) in sorted(p.items()):
        # mean shares of words, so that a long clean text that has a word by chance says little; bounded by the numbers of texts
        b, in_neg = q.get(f, (0, 0.0))
        low = math.log(in_pos / pos) - 1.5 / math.sqrt(a + 0.5) - math.log((in_neg * (1 + 1.5 / math.sqrt(b + 0.25)) + ONE_WORD) / (neg + 1))
        if low > 1:
            weights[f] = low
    model = Model(weights, chars, np.zeros(4))
    got = rows.filter("check").select("toxic", _evidence_udf(model)(F.col("text")).alias("x")).toPandas()
    y = got["toxic"].to_numpy(float)
    model.coef = fit_logistic(np.array(got["x"].tolist()).reshape(-1, 3), y) if 0 < y.sum() < len(y) else np.array([-3.0, 2.0, 0.0, 0.0])
    return model


def _evidence_udf(model: Model):
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        words = Words(model.weight)
        return pa.array([model.evidence(t.as_py() or "", words) for t in texts], pa.list_(pa.float64()))

    return run


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the toxicity, 0 to 1, of each whole text as `into` (a column of that name is replaced).

    Null texts count as empty; a text without any weighty word gets the least score. Rows, repeated ones too, and other columns stay. Of a word
    of any length the exact best restoration is found, in time in proportion to its length.
    """
    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Words(model.weight)
        for texts in batches:
            x = np.array([model.evidence(t.as_py() or "", words) for t in texts]).reshape(-1, 3)
            yield pa.array(model.score(x))

    return docs.withColumn(into, rate(F.coalesce(F.col(text), F.lit(""))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    rows = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
