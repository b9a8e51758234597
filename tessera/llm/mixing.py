"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked, one margin after the other, until each margin has its
target shares: given ones, or the measured ones tempered by a power. Every cell so gets a factor; a document's probability to be
kept is proportional to its cell's factor, at most 1, and scaled so that the expected tokens are the wanted part of all. Whether it
is kept depends on a hash of its id alone.

The table of documents has no topic, so topics are learned: clusters (spherical k-means) of the texts' TF-IDF weighted words, less
what is common to their language. Word frequencies are counted and clusters are fitted over all rows; a bounded sample says where the clusters begin.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, discard, flat_bytes, keep_share, mix64, small_batches, stored, table, unused

MARGINS = ("source", "lang", "topic")
TOPICS = 8
BITS = 18
BUCKETS = 1 << BITS
#: What the bits above a bucket say of so many words of it or more.
MANY = (1 << 32 - BITS) - 1
SLICE = 1 << 18
#: Weights are summed in whole numbers of 1 / UNIT; sums of topics are sent in blocks of so many buckets.
UNIT, BLOCK = 1 << 20, 1 << 12
#: Rounds of the topics end when the texts' likeness to their centres grows by less than this share.
GAIN = 5e-3
#: Topic of a text without a word.
NO_TOPIC = -1
#: Above so many cells the raking runs on DataFrames instead of on the driver; both end by the same rule.
DRIVER_CELLS = 200_000
#: Raking ends when every margin's shares are within the tolerance before their turn, or after so many rounds; the same wherever it runs.
ROUNDS, TOLERANCE = 200, 1e-9
#: Halvings of the range in which the scale of the probabilities lies, wherever they run; double precision has no more to tell.
HALVINGS = 60
NOTHING_LEFT = "the given shares leave no share to any value that the documents have"


#: Bytes of texts as words see them: ASCII letters in lower case, ASCII white space 0, all else as it is.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[65:91] += 32
_SEEN[[0, 9, 10, 11, 12, 13, 32]] = 0
_PLACE = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of all words of some texts, the text's number and the word's bucket, in bounded slices that end between words.

    A word's hash is the sum of its bytes, each times a number for its place (64 numbers, used again and again).
    """
    at, n = 0, len(data)
    while at < n:
        stop = min(at + SLICE, n)
        if stop < n:
            limit = int(offsets[np.searchsorted(offsets, stop)])  # a text's begin ends a word too
            while stop < limit and not (gap := np.flatnonzero(_SEEN[data[stop : stop + 4096]] == 0)).size:
                stop = min(stop + 4096, limit)
            stop = min(stop + int(gap[0]), limit) if stop < limit else stop
        seg = _SEEN.take(data[at:stop])
        inside = seg != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        first[begins] = inside[begins]
        last, inner = inside.copy(), inside & ~first
        last[:-1] &= ~inner[1:]
        begin = np.flatnonzero(first)
        if len(begin):
            h = _word_hashes(seg, begin, np.flatnonzero(last) + 1 - begin)
            yield np.searchsorted(offsets, at + begin, "right") - 1, (mix64(h) >> np.uint64(64 - BITS)).astype(np.int64)
        at = stop


def _word_hashes(seg: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum of each word's bytes times their places' numbers: place by place, for all words that are that long at once; bytes beyond the 64th of a word together."""
    top = len(_PLACE)
    order = np.argsort((top + 1 - np.minimum(size, top + 1)).astype(np.uint8), kind="stable")  # longest first
    spot, h = begin[order], np.zeros(len(begin), np.uint64)
    longer = len(begin) - np.cumsum(np.bincount(np.minimum(size, top + 1), minlength=top + 2))  # words of more than i bytes
    for i in range(top):
        if not (k := int(longer[i])):
            break
        h[:k] += seg.take(spot[:k]) * _PLACE[i]
        spot[:k] += 1
    if k := int(longer[top]):
        rest = size[order[:k]] - top
        starts = np.cumsum(rest) - rest
        place = np.arange(int(rest.sum())) - np.repeat(starts, rest)
        h[:k] += np.add.reduceat(seg[np.repeat(spot[:k], rest) + place] * _PLACE[place % top], starts)
    out = np.empty_like(h)
    out[order] = h
    return out


def word_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, how many words) for each text and bucket that some of its words have, in order."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for text, bucket in word_buckets(data, offsets):
        k, n = np.unique(text << BITS | bucket, return_counts=True)
        keys.append(k)
        counts.append(n)
    k, n = np.concatenate(keys), np.concatenate(counts)
    if len(keys) > 2:
        k, at = np.unique(k, return_inverse=True)
        n = np.bincount(at, n, len(k)).astype(np.int64)
    return k >> BITS, k & (BUCKETS - 1), n


def runs_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, offsets) of runs of texts of about SLICE bytes together; a longer text is a run of its own."""
    data, offsets = flat_bytes(texts)
    a, m = 0, len(offsets) - 1
    while a < m:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        z = min(z, m)
        yield a, z, data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
        a = z


def _weighed(text: np.ndarray, bucket: np.ndarray, n: np.ndarray, idf: np.ndarray, texts: int) -> np.ndarray:
    """TF-IDF weights, those of a text of length 1 together."""
    w = (1 + np.log(n)) * idf[bucket]
    return w / np.maximum(np.sqrt(np.bincount(text, w * w, texts)), 1e-300)[text]


@dataclass
class Topics:
    idf: np.ndarray
    means: dict[str | None, np.ndarray]
    """What to take off for a language: each centre's product with the language's mean; None: the mean of all."""
    centres: np.ndarray
    """A row each; in memory the numbers of a bucket lie together."""

    def of(self, data: np.ndarray, offsets: np.ndarray, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(topic, number of words) of each text. The topic is the centre nearest in direction to the text's words less its language's mean, of
        equally near ones the first; -1 of a text without a word."""
        m = len(langs)
        text, bucket, n = word_counts(data, offsets)
        w = _weighed(text, bucket, n, self.idf, m)
        near, first = np.zeros((m, len(self.centres))), np.flatnonzero(np.diff(text, prepend=-1))
        if len(first):
            near[text[first]] = np.add.reduceat(np.ascontiguousarray(self.centres.T).take(bucket, axis=0) * w[:, None], first, axis=0)
        near -= np.stack([self.means.get(la, self.means[None]) for la in langs]).reshape(m, -1)
        words = np.bincount(text, n, m).astype(np.int64)
        return np.where(words > 0, near.argmax(1), NO_TOPIC), words


def counted(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Words of all texts that have any: place, other (two hashes of the text), lang, cells (little-endian 32-bit integers: bucket, and in the bits above it
    how many words of it, at most MANY), more (64-bit integers: of cells that say MANY how many, in order), copies. Rows equal in text and language are one row,
    with copies saying how many they were."""
    known = docs.select(F.xxhash64(text).alias("place"), F.xxhash64(F.lit(7), text).alias("other"), F.col(lang).alias("lang"), F.col(text).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, offsets in runs_of(b.column(3)):
                text, bucket, n = word_counts(data, offsets)
                many, ends = n >= MANY, np.arange(z - a + 1)
                lists = [(text, (bucket | np.minimum(n, MANY) << BITS).astype("<u4")), (text[many], n[many].astype("<i8"))]
                lists = [pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((np.searchsorted(of, ends) * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for of, x in lists]
                yield pa.RecordBatch.from_arrays([*(b.column(i)[a:z] for i in range(3)), *lists], names=["place", "other", "lang", "cells", "more"])

    rows = known.filter(F.length(F.trim("text")) > 0).mapInArrow(read, "place long, other long, lang string, cells binary, more binary")
    return rows.filter(F.length("cells") > 0).groupBy("place", "other", "lang").agg(F.first("cells").alias("cells"), F.first("more").alias("more"), F.count("*").alias("copies"))


def numbers_of(lists: pa.Array, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many each list has) of a column of counted()."""
    data, offsets = flat_bytes(lists)
    width = np.dtype(kind).itemsize
    return data.view(kind), np.diff(offsets) // width


def taken_apart(cells: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, how many words, what is left of more) of some cells of counted(), more beginning with what belongs to the first of them."""
    bucket, n = (cells & (BUCKETS - 1)).astype(np.int64), cells >> BITS
    if len(more) and (many := n == MANY).any():
        n = n.astype(np.int64)
        n[many], more = np.split(more, [int(many.sum())])
    return bucket, n, more


def frequencies(words: DataFrame, n: int) -> np.ndarray:
    """Inverse frequency of each word bucket: log of all n texts over those that have it. Counted over all rows of counted()."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS)
        for b in batches:
            cells, sizes = numbers_of(b.column(0))
            copies, ends, a = b.column(1).to_numpy(), np.append(0, np.cumsum(sizes)), 0
            while a < len(sizes):
                z = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
                total += np.bincount(cells[ends[a] : ends[z]] & (BUCKETS - 1), np.repeat(copies[a:z], sizes[a:z]), BUCKETS)
                a = z
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], names=["bucket", "n"])

    got = words.select("cells", "copies").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    known = np.zeros(BUCKETS)
    known[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return np.log((n + 1.0) / (known + 1.0)).astype(np.float32)


class Means:
    """Mean rows of languages, sparse, as languages and buckets in order; language 0 is none, whose mean is that of all rows."""

    def __init__(self, lang: np.ndarray, bucket: np.ndarray, mean: np.ndarray, sizes: np.ndarray, whole: np.ndarray):
        self.mean_lang, self.mean_bucket, self.mean, self.sizes, self.whole = lang, bucket, mean, sizes, whole

    def off(self, centres: np.ndarray) -> np.ndarray:
        """Each centre's product with each language's mean: (languages, centres)."""
        out = np.stack([np.bincount(self.mean_lang, c[self.mean_bucket] * self.mean, len(self.sizes)) for c in centres], axis=1)
        out[0] = centres @ self.whole
        return out

    def times(self, share: np.ndarray) -> np.ndarray:
        """Sum of the means, each times its language's share."""
        own = self.mean_lang > 0
        return share[0] * self.whole + np.bincount(self.mean_bucket[own], (self.mean * share[self.mean_lang])[own], BUCKETS)


class Sample(Means):
    """Weighed texts as sparse rows, each less its language's mean (that of all, where no language is given) and of length 1. Nothing here is rows x buckets."""

    def __init__(self, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, langs: np.ndarray):
        """langs: number of each row's language, 0 for none."""
        self.n, self.row, self.bucket, self.weight, self.langs = len(langs), row, bucket, weight, langs
        sizes, lang = np.bincount(langs), langs[row]
        # means as sparse rows too; that of all comes first, as the mean of rows without a language
        keys, self.at = np.unique(lang << BITS | bucket, return_inverse=True)
        mean = np.bincount(self.at, weight, len(keys)) / np.maximum(sizes, 1)[keys >> BITS]
        super().__init__(keys >> BITS, keys & (BUCKETS - 1), mean, sizes, np.bincount(bucket, weight, BUCKETS) / self.n)
        mine = np.where(lang == 0, self.whole[bucket], self.mean[self.at])
        squares = np.bincount(self.mean_lang, self.mean**2, len(self.sizes))
        squares[0] = self.whole @ self.whole
        square = np.bincount(row, weight * (weight - 2 * mine), self.n) + squares[langs]
        self.length = np.sqrt(np.maximum(square, 1e-18))

    def near(self, centres: np.ndarray) -> np.ndarray:
        """Product of each row with each centre."""
        x = np.stack([np.bincount(self.row, c[self.bucket] * self.weight, self.n) for c in centres], axis=1)
        return (x - self.off(centres)[self.langs]) / self.length[:, None]

    def total(self, chosen: np.ndarray) -> np.ndarray:
        """Sum of the chosen rows."""
        part = chosen / self.length
        out = np.bincount(self.bucket, self.weight * part[self.row], BUCKETS)
        return out - self.times(np.bincount(self.langs, part, len(self.sizes)))


def _first_centres(words: DataFrame, idf: np.ndarray, topics: int, share: float, rounds: int) -> np.ndarray:
    """Where the rounds over all rows begin: clusters of a share of the texts, chosen by their hash."""
    rows = words.filter(keep_share(share, F.col("place"), F.col("other"), seed=31)).select("lang", "place", "other", "cells", "more").toArrow()
    if not rows.num_rows:  # a share of few rows may have none
        rows = words.orderBy("place", "other", "lang").limit(topics).select("lang", "place", "other", "cells", "more").toArrow()
    rows = rows.sort_by([(c, "ascending") for c in ("lang", "place", "other")]).combine_chunks()
    (cells, sizes), (more, _) = numbers_of(rows["cells"].combine_chunks()), numbers_of(rows["more"].combine_chunks(), "<i8")
    bucket, times, _ = taken_apart(cells, more)
    row = np.repeat(np.arange(len(sizes)), sizes)
    number = {la: i + 1 for i, la in enumerate(sorted(set(rows["lang"].to_pylist()) - {None, ""}))}
    y = Sample(row, bucket, _weighed(row, bucket, times, idf, len(sizes)), np.array([number.get(la, 0) for la in rows["lang"].to_pylist()]))
    # far from those before, the farthest being the most alone
    one = lambda k: y.total(np.arange(y.n) == k)
    centres, closest = [one(0)], np.full(y.n, -np.inf)
    while len(centres) < min(topics, y.n):
        closest = np.maximum(closest, y.near(centres[-1][None])[:, 0])
        centres.append(one(closest.argmin()))
    centres = np.stack(centres)
    for _ in range(rounds):
        near = y.near(centres).argmax(1)
        centres = np.stack([y.total(near == k) if (near == k).any() else c for k, c in enumerate(centres)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


#: 1 + ln of small numbers of words.
_TIMES = (1 + np.log(np.maximum(np.arange(1 << 12), 1))).astype(np.float32)


def _weighed_rows(batches: Iterator[pa.RecordBatch], idf: np.ndarray, number: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(language's number of each text, first place of each text, text, bucket, weight) of runs of rows (lang, cells, more) of counted(). Weights have length 1 together."""
    for b in batches:
        langs = np.array([number.get(la, 0) for la in b.column(0).to_pylist()], np.int64)
        (cells, sizes), (more, _) = numbers_of(b.column(1)), numbers_of(b.column(2), "<i8")
        ends, a = np.append(0, np.cumsum(sizes)), 0
        while a < len(langs):
            z = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1)
            bucket, n, more = taken_apart(cells[ends[a] : ends[z]], more)
            first, w = ends[a:z] - ends[a], _TIMES.take(n, mode="clip")
            if n.max() >= len(_TIMES):
                w = (1 + np.log(n)).astype(np.float32)
            w *= idf.take(bucket)
            length = np.maximum(np.sqrt(np.add.reduceat(w * w, first, dtype=np.float64)), 1e-300)
            text = np.repeat(np.arange(z - a), sizes[a:z])
            yield langs[a:z], first, text, bucket, w / length[text]
            a = z


def language_means(words: DataFrame, idf: np.ndarray, number: dict[str, int]) -> Means:
    """Mean rows over all rows of counted(). The driver gets a number for each language and each bucket that its texts have."""
    most = 16  # languages that a task sums up at a time

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for la, x in sums.items():
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(at + (la << BITS + 1)), pa.array(x[at])], names=["key", "sum"])
            sums.clear()

        for langs, _, text, bucket, weight in _weighed_rows(batches, idf, number):
            whole = np.rint(weight * UNIT).astype(np.int64)
            for la in np.unique(langs).tolist():
                x, mine = sums.setdefault(la, np.zeros(BUCKETS + 1, np.int64)), langs == la
                np.add.at(x, bucket[mine[text]], whole[mine[text]])
                x[BUCKETS] += mine.sum()
                if len(sums) >= most:
                    yield from told()
        yield from told()

    got = words.select("lang", "cells", "more").mapInArrow(add, "key long, sum long").groupBy("key").agg(F.sum("sum").alias("sum")).toArrow()
    key, total = got["key"].to_numpy(), got["sum"].to_numpy()
    order = np.argsort(key)
    key, total = key[order], total[order]
    lang, bucket = key >> BITS + 1, key & (2 * BUCKETS - 1)
    rows, cells = bucket == BUCKETS, bucket < BUCKETS
    sizes = np.zeros(len(number) + 1, np.int64)
    sizes[lang[rows]] = total[rows]
    lang, bucket, total = lang[cells], bucket[cells], total[cells] / UNIT
    return Means(lang, bucket, total / sizes[lang], sizes, np.bincount(bucket, total, BUCKETS) / sizes.sum())


def topic_sums(words: DataFrame, idf: np.ndarray, number: dict[str, int], centres: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """One round over all rows of counted(): (sums of the rows of each topic, how many rows of each language each topic has, likeness of all rows to
    their centres). Sums are of whole numbers (UNIT), so that they are the same whatever the tasks are; tasks send them in blocks of buckets."""
    k, table = len(centres), np.ascontiguousarray(centres.T.astype(np.float32))

    def short(x: np.ndarray) -> np.ndarray:
        return x.astype("<i4" if np.abs(x).max() < 1 << 31 else "<i8")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows, like = np.zeros(k << BITS, np.int64), np.zeros(off.shape, np.int64), 0
        for langs, first, text, bucket, weight in _weighed_rows(batches, idf, number):
            near = table.take(bucket, axis=0)
            near *= weight.astype(np.float32)[:, None]
            near = np.add.reduceat(near, first, axis=0) - off[langs]
            topic = near.argmax(1)
            like += int(np.rint(near.max(1) * UNIT).sum())
            np.add.at(rows, (langs, topic), 1)
            np.add.at(sums, topic[text] << BITS | bucket, np.rint(weight * UNIT).astype(np.int64))
        blocks = [*np.split(sums.reshape(k, BUCKETS), BUCKETS // BLOCK, axis=1), rows, np.array([like])]
        for i, x in enumerate(map(short, blocks)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "width": pa.array([x.itemsize], pa.int32()), "sums": pa.array([x.tobytes()], pa.binary())})

    def together(group: pa.Table) -> pa.Table:
        total = np.zeros(1, "<i8")
        for x, w in zip(group["sums"], group["width"].to_pylist(), strict=True):
            total = total + np.frombuffer(x.as_buffer(), f"<i{w}")
        total = short(total)
        return pa.table({"block": group["block"][:1], "width": pa.array([total.itemsize], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    form = "block int, width int, sums binary"
    got = words.select("lang", "cells", "more").mapInArrow(add, form).groupBy("block").applyInArrow(together, form).toArrow().sort_by("block")
    blocks = [np.frombuffer(x.as_buffer(), f"<i{w}") for x, w in zip(got["sums"], got["width"].to_pylist(), strict=True)]
    return np.concatenate([x.reshape(k, BLOCK) for x in blocks[:-2]], axis=1) / UNIT, blocks[-2].reshape(off.shape), int(blocks[-1][0])


def fit_topics(docs: DataFrame, topics: int = TOPICS, text: str = "text", lang: str = "lang", most_rows: int = 4000, rounds: int = 20) -> Topics:
    """Learn topics from all texts; rows equal in text and language count once.

    Rounds over all rows move the centres until the rows' likeness to them grows by less than GAIN, or after so many rounds. About `most_rows` texts say only
    where the centres begin. Null texts and texts without a word teach nothing; with none that teaches, all have topic 0. A language that none of the texts has
    is compared with the mean of all.
    """
    words = stored(counted(docs, text, lang))
    idf, n = frequencies(words, docs.count()), words.count()
    if not n:
        return Topics(idf, {None: np.zeros(1)}, np.zeros((1, BUCKETS), np.float32))
    centres = _first_centres(words, idf, topics, min(1.0, most_rows / n), rounds)
    number = {r["lang"]: i + 1 for i, r in enumerate(words.select("lang").filter("lang <> ''").distinct().orderBy("lang").collect())}
    # a task sends sums of all buckets however little it reads, so tasks are larger here
    wide = words.coalesce(max(words.sparkSession.sparkContext.defaultParallelism, words.rdd.getNumPartitions() // 8))
    means, before = language_means(wide, idf, number), -np.inf
    for _ in range(rounds):
        sums, rows, like = topic_sums(wide, idf, number, centres, means.off(centres))
        if like - before < GAIN * abs(like):
            break
        before = like
        moved = np.stack([x - means.times(rows[:, k]) if rows[:, k].any() else centres[k] for k, x in enumerate(sums)])
        centres = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-9)
    discard(words)
    centres = np.asfortranarray(centres, np.float32)
    off = means.off(centres)
    return Topics(idf, {None: off[0]} | {la: off[i] for la, i in number.items()}, centres)


def _told_udf(topics: Topics):
    @F.arrow_udf("topic int, n_tokens long")
    def tell(texts: pa.Array, langs: pa.Array) -> pa.Array:
        said, names = [(np.zeros(0, np.int64),) * 2], langs.to_pylist()
        said += [topics.of(data, offsets, names[a:z]) for a, z, data, offsets in runs_of(texts)]
        topic, words = (np.concatenate(x) for x in zip(*said, strict=True))
        return pa.StructArray.from_arrays([pa.array(topic.astype(np.int32)), pa.array(np.maximum(words, 1))], names=["topic", "n_tokens"])

    return tell


def target_shares(shares: np.ndarray, values: list, power: float, given: dict | None) -> np.ndarray:
    """Wanted shares of a margin's values: the measured ones raised to a power (1: as they are, 0: all equal), summing to 1.

    Where shares are given for some values, the others divide what is left in proportion to that, and get nothing if nothing is left.
    """
    raised = np.where(shares > 0, np.maximum(shares, 1e-300) ** power, 0.0)
    if not given:
        return raised / raised.sum()
    fixed = np.array([given.get(v, np.nan) for v in values], float)
    free = np.isnan(fixed)
    out = np.where(free, raised, 0.0)
    out *= max(0.0, 1 - np.nansum(fixed)) / (out.sum() or 1.0)
    out = np.where(free, out, fixed)
    if not out.sum() > 0:
        raise ValueError(NOTHING_LEFT)
    return out / out.sum()


def unsettled(rounds: int, off: float) -> None:
    warnings.warn(f"raking stopped after {rounds} rounds with a margin {off:.3g} off its target", stacklevel=3)


def rake(weights: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Factor of each cell. codes[m][c] is cell c's value in margin m, targets[m] the wanted shares of the values.

    Values that no cell has cannot get a share; the other targets of their margin are scaled up.
    """
    w = weights / weights.sum()
    fitted = w.copy()
    targets = [t * (np.bincount(c, w, len(t)) > 0) for c, t in zip(codes, targets, strict=True)]
    targets = [t / t.sum() for t in targets]
    for _ in range(rounds):
        off = 0.0
        for c, t in zip(codes, targets, strict=True):
            now = np.bincount(c, fitted, len(t))
            off = max(off, np.abs(now - t).max())
            fitted = fitted * np.divide(t, now, out=np.zeros(len(t)), where=now > 0)[c]
        if off < tolerance:
            break
    else:
        unsettled(rounds, off)
    return np.divide(fitted, w, out=np.zeros(len(w)), where=w > 0)


def calibrate(weights: np.ndarray, factors: np.ndarray, part: float) -> np.ndarray:
    """Probability of each cell: factor times one scale, at most 1, so that the expected weight is `part` of all.

    Cells that reach 1 are full, and the scale of the others makes up for them.
    """
    low, high = 0.0, 1.0
    wanted = part * weights.sum()

    def kept(scale):
        return (weights * np.minimum(1, scale * factors)).sum()

    while kept(high) < wanted and high < 1e12:
        high *= 2
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        low, high = (mid, high) if kept(mid) < wanted else (low, mid)
    return np.minimum(1, high * factors)


def rake_frame(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same raking, with the same end, for more cells than a driver should hold: cells (margins, weight) -> cells with column `factor`.

    Each frame of targets has its margin's value and `share`.
    """
    whole = float(cells.agg(F.sum("weight")).first()[0])
    out, last = cells.withColumn("fitted", F.col("weight") / F.lit(whole)), None
    for _ in range(rounds):
        out = out.withColumn("off", F.lit(0.0))
        for name, wanted in targets.items():
            now = out.groupBy(name).agg(F.sum("fitted").alias("now"))
            ratio = now.join(wanted, now[name].eqNullSafe(wanted[name])).select(
                now[name].alias("value"), F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(0.0).alias("ratio"), F.abs(F.col("now") - F.col("share")).alias("now_off")
            )
            out = out.join(ratio, out[name].eqNullSafe(F.col("value")))
            out = out.withColumn("fitted", F.col("fitted") * F.col("ratio")).withColumn("off", F.greatest("off", "now_off")).drop("value", "ratio", "now_off")
        out = stored(out)
        off = out.agg(F.max("off")).first()[0]
        if last is not None:
            discard(last)
        last = out
        if off < tolerance:
            break
    else:
        unsettled(rounds, off)
    return out.withColumn("factor", F.col("fitted") * F.lit(whole) / F.col("weight")).drop("fitted", "off")


def probabilities(cells: DataFrame, power: dict[str, float], part: float, targets: dict[str, dict] | None = None) -> DataFrame:
    """cells (margins, weight) -> cells with `probability`; targets gives shares of values by margin, the rest is tempered by `power`."""
    spark = cells.sparkSession
    cells, given = checkpointed(cells), targets or {}
    schema = cells.select(*MARGINS).schema
    if cells.count() <= DRIVER_CELLS:
        rows = cells.collect()
        w = np.array([r["weight"] for r in rows], float)
        if not len(w):
            return cells.withColumn("probability", F.lit(1.0))
        codes, wanted = [], []
        for m in MARGINS:
            values = sorted({r[m] for r in rows}, key=lambda v: (v is not None, v))
            at = {v: i for i, v in enumerate(values)}
            c = np.array([at[r[m]] for r in rows])
            codes.append(c)
            wanted.append(target_shares(np.bincount(c, w) / w.sum(), values, power[m], given.get(m)))
        p = calibrate(w, rake(w, codes, wanted), part)
        data = [(*(r[m] for m in MARGINS), float(x)) for r, x in zip(rows, p, strict=True)]
        return spark.createDataFrame(data, schema.add("probability", "double"))
    frames = {}
    for m in MARGINS:
        raised = cells.groupBy(m).agg(F.pow(F.sum("weight"), F.lit(power[m])).alias("r"))
        said = spark.createDataFrame(list((given.get(m) or {}).items()), schema[m].dataType.simpleString().join(("value ", ", given double")))
        met = raised.join(said, raised[m].eqNullSafe(said["value"]), "left")
        sums = met.agg(F.sum(F.when(F.col("given").isNull(), F.col("r"))).alias("free"), F.coalesce(F.sum("given"), F.lit(0.0)).alias("fixed")).first()
        left = max(0.0, 1 - sums["fixed"]) / (sums["free"] or 1.0)
        whole = sums["fixed"] + left * (sums["free"] or 0.0)
        if not whole > 0:
            raise ValueError(NOTHING_LEFT)
        frames[m] = met.select(raised[m], (F.coalesce("given", F.col("r") * left) / whole).alias("share"))
    raked = stored(rake_frame(cells, frames))
    wanted = part * raked.agg(F.sum("weight")).first()[0]

    def kept(scale: float) -> float:
        return raked.agg(F.sum(F.col("weight") * F.least(F.lit(1.0), F.col("factor") * scale))).first()[0]

    low, high = 0.0, 1.0
    while kept(high) < wanted and high < 1e12:
        high *= 2
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        low, high = (mid, high) if kept(mid) < wanted else (low, mid)
    return raked.select(*MARGINS, F.least(F.lit(1.0), F.col("factor") * high).alias("probability"))


#: Production targets: sources and topics evened out by half, languages a little.
POWER = {"source": 0.5, "lang": 0.7, "topic": 0.5}
PART = 0.75


def mix(
    docs: DataFrame, power: dict[str, float] | None = None, part: float = PART, targets: dict[str, dict] | None = None, seed: int = 41,
    key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", into: str = "mixture", topics: Topics | None = None, keep_text: bool = True,
) -> DataFrame:
    """Adds a struct (topic, n_tokens, probability, sampled) as `into` to every row; other columns stay as they are.

    targets: wanted shares of tokens, such as {"source": {"web": 0.5, "books": 0.3}}; values and margins without one keep their measured
    shares, tempered by `power`. Null sources and languages are values of their own, null texts count as empty, and an empty text weighs
    one token and has topic -1. Rows of one id, and rows with a null id, share their fate if they share a cell; the draw is by id, so
    there are no ties. An empty table gives an empty result. A column `into` is replaced; no other name clashes. Without keep_text the result has no
    texts, and what they say is stored, so that their words are not counted twice.
    """
    topics = topics or fit_topics(docs, text=text, lang=lang)
    own, cell, p = (unused(docs, n) for n in ("own", "cell", "p"))
    rows = docs.withColumn(own, _told_udf(topics)(F.coalesce(F.col(text), F.lit("")), F.col(lang)))
    rows = rows.withColumn(own, F.struct(F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(own)["topic"].alias("topic"), F.col(own)["n_tokens"].alias("n_tokens")))
    if not keep_text:
        rows = stored(rows.drop(text))
    cells = rows.groupBy(*(F.col(own)[m].alias(m) for m in MARGINS)).agg(F.sum(F.col(own)["n_tokens"]).alias("weight"))
    said = checkpointed(probabilities(cells, POWER | (power or {}), part, targets)).select(F.struct(*MARGINS).alias(cell), F.col("probability").alias(p))
    small = said.count() <= DRIVER_CELLS
    out = rows.join(F.broadcast(said) if small else said, F.struct(*(F.col(own)[m].alias(m) for m in MARGINS)).eqNullSafe(F.col(cell)), "left")
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    told = F.struct(F.col(own)["topic"].alias("topic"), F.col(own)["n_tokens"].alias("n_tokens"), F.col(p).alias("probability"), (draw < F.col(p)).alias("sampled"))
    return out.withColumn(into, told).drop(own, cell, p)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return mix(docs, keep_text=False).select("doc_id", "source", "lang", "mixture.*")


def keep_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents sampled to the target mixture, with their own columns.

    A row stays by its id and cell alone: repeated rows stay or go together, nulls are values of their own. An empty table stays empty.
    """
    small_batches(spark)
    told = unused(docs, "mixture")
    return mix(docs, into=told).filter(F.col(told)["sampled"]).drop(told)
