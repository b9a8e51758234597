"""Byte-level BPE encoding and decoding with a given vocabulary, by batched numpy merge rounds.

Texts are split into words by the vocabulary's pattern. The symbols of all words that a worker has not met yet lie in
one flat array; in each round every word merges its pair of lowest rank, and ranks are found by binary search over
the sorted pair keys (left id << 32 | right id). Encoded words are kept in a flat store, from which a batch's ids are
gathered. A round takes time in proportion to a word's length, so words of over LONG bytes, which would take very many, have their
merges drawn from a heap instead.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, unused

#: The split pattern and the byte alphabet of public byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

STORE_WORDS = 200_000
NEVER = np.int64(1 << 40)
LONG = 1000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + size."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Vocabulary:
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    byte_id: np.ndarray
    token_bytes: np.ndarray
    token_start: np.ndarray
    added: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        texts = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        whole = [texts.get(i, b"") for i in range(max(texts) + 1)]
        start = np.concatenate([[0], np.cumsum([len(t) for t in whole])]).astype(np.int64)
        byte_id = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            byte_id[b] = vocab[c]
        return cls(keys[order], order.astype(np.int64), merged[order], byte_id, np.frombuffer(b"".join(whole), np.uint8), start, added)

    @cached_property
    def rank_of(self) -> dict[int, tuple[int, int]]:
        """(rank, merged id) of each pair key."""
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one long word: always the leftmost pair of the lowest rank merges, found by a heap over a linked list of symbols."""
        sym = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(sym)
        before, after, rank = list(range(-1, n - 1)), list(range(1, n + 1)), self.rank_of
        heap = [(r[0], i, k) for i in range(n - 1) if (r := rank.get(k := sym[i] << 32 | sym[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, key = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n or sym[i] << 32 | sym[j] != key:
                continue  # one of the two has been merged since
            sym[i], sym[j], after[i] = rank[key][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := rank.get(k := sym[a] << 32 | sym[after[a]])):
                    heapq.heappush(heap, (r[0], a, k))
        return [s for s in sym if s >= 0]

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each word's ids)."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [sym[:0]], [word[:0]]
        while len(sym):
            pair = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = (self.keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.ranks[at], NEVER), NEVER)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            run = np.diff(np.append(first, len(sym)))
            over = np.repeat(low == NEVER, run)
            done_sym.append(sym[over])
            done_word.append(word[over])
            take = (rank == np.repeat(low, run)) & ~over
            spots = np.flatnonzero(take)
            if not len(spots):
                break
            # of overlapping occurrences (aaa) the first, third, ... count
            chain = np.append(True, np.diff(spots) != 1)
            nth = np.arange(len(spots)) - np.maximum.accumulate(np.where(chain, np.arange(len(spots)), 0))
            spots = spots[nth % 2 == 0]
            sym = sym.copy()
            sym[spots] = self.merged[at[spots]]
            keep = ~over
            keep[spots + 1] = False
            sym, word = sym[keep], word[keep]
        ids, of = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(of, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(of, minlength=len(words))

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of some ids; ids that the vocabulary doesn't have stand for nothing."""
        known = (ids >= 0) & (ids < len(self.token_start) - 1)
        ids = ids if known.all() else ids[known]
        start = self.token_start[ids]
        return self.token_bytes[_ragged(start, self.token_start[ids.astype(np.int64) + 1] - start)]


class Index(dict):
    """Numbers words in the order of their first look-up, and lists those that are new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes batches of texts; remembers the words that it has met, up to STORE_WORDS of them."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.words = regex.compile(PATTERN).findall
        self.added = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(vocab.added, key=len, reverse=True)) + ")") if vocab.added else None
        self.clear()

    def clear(self):
        self.index = Index()
        self.store, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pieces(self, text: str) -> list[str]:
        if self.added is None or not any(a in text for a in self.vocab.added):
            return self.words(text)
        out = []
        for k, part in enumerate(self.added.split(text)):
            out += ["\0added:" + part] if k % 2 else self.words(part)
        return out

    def _learn(self, new: list[str]) -> None:
        words = [w.encode() for w in new]
        apart = {i: [self.vocab.added[w[7:]]] for i, w in enumerate(new) if w.startswith("\0added:") and w[7:] in self.vocab.added}
        apart |= {i: self.vocab.merge_long(w) for i, w in enumerate(words) if len(w) > LONG and i not in apart}
        ids, size = self.vocab.merge_words([b"" if i in apart else w for i, w in enumerate(words)])
        if apart:
            where = np.array(list(apart))
            where.sort()
            own = [np.array(apart[i], np.uint32) for i in where.tolist()]
            at = np.repeat(np.cumsum(size)[where], [len(x) for x in own])
            ids = np.insert(ids, at, np.concatenate(own)).astype(np.uint32)
            size[where] = [len(x) for x in own]
        self.start = np.append(self.start, len(self.store) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.store = np.append(self.store, ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, start of each text's ids and the end)."""
        if len(self.index) > STORE_WORDS:
            self.clear()
        look_up, at, count = self.index.__getitem__, [], []
        for t in texts:
            pieces = self._pieces(t)
            count.append(len(pieces))
            at.append(np.fromiter(map(look_up, pieces), np.int64, len(pieces)))
        if self.index.new:
            self._learn(self.index.new)
            self.index.new = []
        flat = np.concatenate(at) if at else np.zeros(0, np.int64)
        size = self.size[flat]
        ids = self.store[_ragged(self.start[flat], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)]).astype(np.int64)]
        return ids, ends


def _groups(texts: pa.Array, size: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about so many bytes; a longer text is a run of its own. Only one run at a time is held as Python strings."""
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a, m = 0, len(ends)
    while a < m:
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield texts[a:z].to_pylist()
        a = z


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary.load(path))
    return _ENCODERS[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds the ids of each whole text, as array<int>, in column `into` (one of that name is replaced). Null texts give an empty array. Rows,
    repeated ones too, and all other columns stay."""
    path = path or vocabulary_path()

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        enc, out, ends = encoder(path), [], [np.zeros(1, np.int64)]
        for rows in _groups(texts):
            ids, e = enc.encode(rows)
            out.append(ids)
            ends.append(e[1:] + ends[-1][-1])
        flat = np.concatenate(out) if out else np.zeros(0, np.uint32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(flat.astype(np.int32)))

    return docs.withColumn(into, run(F.coalesce(F.col(text), F.lit(""))))


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids as `into`; bytes that are not UTF-8 become U+FFFD. Null arrays give ''; nulls in an array and
    ids that the vocabulary doesn't have stand for nothing. Rows, repeated ones too, and all other columns stay."""
    path = path or vocabulary_path()

    @F.arrow_udf("string")
    def run(lists: pa.Array) -> pa.Array:
        vocab = encoder(path).vocab
        return pa.array([vocab.decode_bytes(np.array([i for i in x or () if i is not None], np.int64)).tobytes().decode("utf-8", "replace") for x in lists.to_pylist()], pa.string())

    return rows.withColumn(into, run(F.col(ids)))


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text", into: str = "bpe") -> DataFrame:
    """Adds a struct (n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to.

    Encodes and decodes inside one task, so that ids of long texts never cross a boundary. Null texts count as empty. Rows, repeated ones
    too, and all other columns stay.
    """
    path = path or vocabulary_path()

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pa.Array) -> pa.Array:
        enc = encoder(path)
        n, ids_sha, text_sha = [], [], []
        for rows in _groups(texts):
            ids, ends = enc.encode(rows)
            for s, e in zip(ends, ends[1:], strict=False):
                own = ids[s:e]
                n.append(int(e - s))
                ids_sha.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                got = enc.vocab.decode_bytes(own).tobytes().decode("utf-8", "replace")
                text_sha.append(hashlib.sha256(got.encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn(into, run(F.coalesce(F.col(text), F.lit(""))))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "bpe.*")


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: every document that is left, with its number of tokens and the digests of its ids. Null texts count as empty."""
    small_batches(spark)
    told = unused(docs, "bpe")
    return round_trip(docs, into=told).select("doc_id", "lang", "source", f"{told}.*")
