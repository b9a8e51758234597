"""Best-fit packing of tokenized documents into sequences, planned over a histogram of lengths.

Documents longer than a sequence are cut; what is packed are pieces of 1 to `size` tokens. The plan is made over counts: best-fit decreasing treats
all pieces of one length together, and all open sequences with the same room together, so its size depends on the number of lengths and not on that of
documents. An entry of the plan says that the pieces of a length with ranks from .. to lie, `each` to a sequence, in consecutive sequences from a
certain place on. Pieces then take their slots by joining on length and rank, the rank being counted over blocks of rows, so that no task gets all
pieces of a common length.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_alphabet, vocabulary_path
from .common import stored, table

SIZE = 2048
END_ID = 0

# --- ids

#: Fixed value: the split pattern of the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters for which composing, lower case and letter classes are the same in all versions of Unicode.
PLAIN = "\\t-\\r -ɏЀ-џ‐-‧€ぁ-ゖァ-ヺ一-龥가-힣"
STORE_WORDS = 500_000
LONG_WORD = 100
SLICE = 1 << 20


class Ids:
    """Ids of whole texts as the tokenizer of a vocabulary file gives them; remembers words, up to STORE_WORDS of them.

    The vocabulary's own pattern splits texts into words that are encoded one by one, so a text's ids are those of its words, which the library's model gives
    once each. Texts with an added token, or with a character outside PLAIN, go to the library whole. Both are done in slices that end with white space, over which
    no word reaches.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = [regex.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.odd = regex.compile("|".join([f"[^{PLAIN}]", *added])).search
        self.words = regex.compile(PATTERN).findall
        self.model = self.library.model.tokenize
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.space = regex.compile(r"[\t-\r ]").search
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        signs = word if word.isascii() and word.isalnum() else "".join([self.alphabet[b] for b in word.encode()])
        return np.array([t.id for t in self.model(signs)], "<u4").tobytes()

    def _slices(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SLICE:
            gap = self.space(text, start + SLICE)
            if not gap:
                break
            yield text[start : gap.end()]
            start = gap.end()
        yield text[start:] if start else text

    def _slice(self, text: str) -> bytes:
        if self.odd(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.words(unicodedata.normalize("NFC", text).lower())
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > STORE_WORDS:
            known.clear()
            new = list(dict.fromkeys(words))
        known.update((w, self._word(w)) for w in new)
        found = b"".join([known[w] for w in words])
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._slice, self._slices(text)))


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """This worker's encoder for a vocabulary file."""
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(key, piece, start, length, ids_crc32, ids): each text's ids and the end id, cut into pieces of `size` tokens; the last may be shorter.

    Null texts count as empty: one piece that holds the end id alone. Repeated rows give pieces of their own. `ids` is left out where only digests are asked for.
    """
    path = path or vocabulary_path("word_bpe_49k.json")
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType)])
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), *([("ids", "array<int>")] if with_ids else [])):
        schema = schema.add(name, T.ArrayType(T.IntegerType()) if name == "ids" else kind)
    end, step = np.array([end_id], "<u4").tobytes(), 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ids_of(path)
        for b in batches:
            of, no, parts = [], [], []

            def batch():
                cols = [b.column("key").take(pa.array(of, pa.int64())), pa.array(no, pa.int32()), pa.array([n * size for n in no], pa.int64())]
                cols += [pa.array([len(p) // 4 for p in parts], pa.int64()), pa.array([crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32())))
                return pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

            for i, t in enumerate(b.column("text")):
                ids = enc.encode(t.as_py()) + end
                for n, at in enumerate(range(0, len(ids), step)):
                    of.append(i)
                    no.append(n)
                    parts.append(ids[at : at + step])
                if len(parts) > 4096:
                    yield batch()
                    of, no, parts = [], [], []
            yield batch()

    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(run, schema)


# --- the plan

PLAN = "length long, from long, to long, sequence long, each long, offset long"


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: (length, from rank, to rank, first sequence, pieces each, offset in the sequence).

    Open sequences are runs of consecutive numbers with equal room. The fullest run that can take a piece takes as many as fit into each of its sequences, which
    is what best fit does piece by piece: a sequence that has just taken one is the fullest of all that have room. A run is filled whole or split in three at most,
    and a run that is filled whole is left with less than half its room, so at most about eleven times as many entries as lengths and splits come out,
    however many pieces there are.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room: runs (first sequence, sequences)
    known: list[int] = []  # rooms that have runs, ascending
    out, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(known, room)
            rooms[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(known, length)
            if at < len(known):
                room = known[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], known[at]
            else:
                room, first, n = size, opened, -(-left // (size // length))
                opened += n
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, size - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if full < n and left:  # fewer than `each` are left: one more sequence takes them
                out.append((length, rank, rank + left, first + full, left, size - room))
                put(room - left * length, first + full, 1)
                full, left = full + 1, 0
            put(room, first + full, n - full)
    return out


def ranked(cut: DataFrame, block_rows: int = 1 << 16) -> DataFrame:
    """Adds `rank`, counted from 0 within each length, to stored pieces that have a unique `row`.

    Rows are ranked within blocks of consecutive row numbers, and add the rows of their length in earlier blocks, whose counts alone meet by length.
    """
    blocks = cut.withColumn("block", F.floor(F.col("row") / block_rows))
    counts = blocks.groupBy("length", "block").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "block", F.coalesce(earlier, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "block").orderBy("row")) - 1
    return blocks.withColumn("own", own).join(counts, ["length", "block"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "block")


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a `length` from 1 to `size`, with as few sequences as best-fit decreasing needs.

    Sequences have no gaps: their pieces' offsets follow on each other from 0. All rows and other columns stay (names `row`, `rank`, `block` excepted). The pieces are stored once.
    Only the histogram, of at most `size` lengths, comes to the driver, and only the plan over it is broadcast.
    """
    spark = cut.sparkSession
    cut = stored(cut.withColumn("row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, size), PLAN)
    rows = ranked(cut)
    met = rows.join(F.broadcast(slots), (rows["length"] == slots["length"]) & (rows["rank"] >= slots["from"]) & (rows["rank"] < slots["to"])).drop(slots["length"])
    nth = F.col("rank") - F.col("from")
    return met.select(
        *(c for c in cut.columns if c != "row"), (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("offset") + nth % F.col("each") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, tokens, ids, starts): the packed sequences, where pieces carry `ids`; a sequence holds at most `size` tokens, which bounds its group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), parts.alias("parts")).select(
        "sequence_id", "tokens", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("starts"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)
    return pack(cut).withColumnRenamed("key", "doc_id")
