"""Fill-in-the-middle: texts cut at two line boundaries and put into prefix-suffix-middle or suffix-prefix-middle order.

Where a text may be cut (at the starts of its lines) and whether it may be cut at all (not if it holds one of the marks) is told by one
automaton over bytes. A chunk of a text is summed up, without knowing what comes before it, by a function from the automaton's state at
its start to its state at its end and to the number of lines begun. Such functions compose associatively (Hillis and Steele, 1986; Ladner
and Fischer, 1980), so the chunks of a giant text are scanned by many tasks; composing their small functions gives every chunk its entry
state and the lines before it, and only the chunks in which a cut falls are searched for it. Texts of one chunk go through the same scan, within
their row. Giant texts cross the network in chunks and are hashed as streams, so that no task holds one whole once it is cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import flat_bytes, sha256_hex, stored, table

#: The marks before the parts of a text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = re.compile(rb"<[PSM]>")
PLACE = {b"<P>": 0, b"<M>": 1, b"<S>": 2}
"""Where in the text the part behind a mark belongs."""

CHUNK = 1 << 15
"""Bytes of a chunk."""

# --- the automaton: 4 states of a mark (none, <, <letter, found) times 2 of a line (at its start, within it)

FOUND, STATES = 3, 8
OTHER, NEWLINE, OPEN, LETTER, CLOSE = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[ord("\n")], CLASS[ord("<")], CLASS[ord(">")] = NEWLINE, OPEN, CLOSE
CLASS[[ord(c) for c in "PSM"]] = LETTER


def _after(state: int, kind: int) -> int:
    mark = state >> 1
    if mark != FOUND:
        mark = 1 if kind == OPEN else 2 if kind == LETTER and mark == 1 else FOUND if kind == CLOSE and mark == 2 else 0
    return mark << 1 | (kind != NEWLINE)


STEP = np.array([[_after(s, k) for s in range(STATES)] for k in range(5)], np.int64)
BEGUN = np.array([1 - (s & 1) for s in range(STATES)], np.int64)


def compose(first, second):
    """The function of two neighbouring chunks: (end states, lines begun) for each start state. Works on stacks of functions, too."""
    (to, begun), (to2, begun2) = first, second
    return np.take_along_axis(to2, to, -1), begun + np.take_along_axis(begun2, to, -1)


def scan(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end state, lines begun) of a chunk for each of the states in which it may be entered.

    A run of bytes that are neither line ends nor parts of marks acts like one such byte; what is left is composed in pairs.
    """
    kinds = CLASS[data]
    if len(kinds) > 1:
        kinds = kinds[np.append(True, (kinds[1:] != OTHER) | (kinds[:-1] != OTHER))]
    to, begun = STEP[kinds], np.broadcast_to(BEGUN, (len(kinds), STATES))
    while len(to) > 1:
        even = len(to) & ~1
        rest = to[even:], begun[even:]
        to, begun = compose((to[:even:2], begun[:even:2]), (to[1:even:2], begun[1:even:2]))
        if len(rest[0]):
            to, begun = np.concatenate([to, rest[0]]), np.concatenate([begun, rest[1]])
    return (to[0], begun[0]) if len(to) else (np.arange(STATES), np.zeros(STATES, np.int64))


def line_start(data: np.ndarray, entry: int, rank: int) -> int:
    """Offset in a chunk at which its rank-th line (from 0) begins, the chunk being entered in the given state."""
    at_once = 1 - (entry & 1)
    if rank < at_once:
        return 0
    return int(np.flatnonzero(data == 10)[rank - at_once]) + 1


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def choose(n: int, found: bool, h: tuple[int, int, int, int], share: int, spm: int) -> tuple[str, int, int]:
    """(form, first cut, second cut), the cuts as numbers of lines before them."""
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if n == 0 or found or h[2] % 100 >= share:
        return "plain", n, n
    return ("spm" if h[3] % 100 < spm else "psm"), low, high


ORDER = {"plain": (0,), "psm": (0, 2, 1), "spm": (2, 0, 1)}
"""The order in which the parts (0 prefix, 1 middle, 2 suffix) are written."""
BEFORE = (PREFIX.encode(), MIDDLE.encode(), SUFFIX.encode())


def _drawn(key: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _field(name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind)])


def short_outputs(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, share: int = 100, spm: int = 50, chunk: int = CHUNK) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of the texts of at most one chunk. A narrow plan: texts stay in their rows."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *_drawn(key, seed)).filter(F.octet_length("text") <= chunk)
    schema = _field("key", docs.schema[key].dataType).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = flat_bytes(b.column("text"))
            out = []
            for i, h in enumerate(zip(*(b.column(f"h{k}").to_pylist() for k in range(1, 5)), strict=True)):
                own = data[ends[i] : ends[i + 1]]
                to, begun = scan(own)
                n = int(begun[0])
                form, *cuts = choose(n, to[0] >> 1 == FOUND, h, share, spm)
                low, high = (len(own) if c == n else line_start(own, 0, c) for c in cuts)
                parts = own[:low], own[low:high], own[high:]
                if form == "plain":
                    out.append((n, form, None, None, own.tobytes()))
                else:
                    whole = b"".join(BEFORE[p] + parts[p].tobytes() for p in ORDER[form])
                    out.append((n, form, code_points(parts[0]), code_points(parts[1]), whole))
            n, form, prefix, middle, whole = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(whole, pa.binary()).cast(pa.string())],
                names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


# --- giant texts

H = T.ArrayType(T.LongType())


def _chunks(chunk: int, names: list[str]):
    """The chunks of whole texts; a text's key and hashes go with its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column("text")):
                data = text.as_buffer()
                for no, at in enumerate(range(0, data.size, chunk)):
                    piece = data.slice(at, min(chunk, data.size - at)).to_pybytes()
                    told = [b.column(c).slice(i, 1) if no == 0 else pa.nulls(1, b.column(c).type) for c in ("key", "h")]
                    yield pa.RecordBatch.from_arrays([b.column("row").slice(i, 1), pa.array([no], pa.int32()), *told, pa.array([piece], pa.binary())], names=names)

    return run


def _scan_chunks(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(np.frombuffer(d.as_buffer(), np.uint8)) for d in b.column("data")]
            kind = pa.list_(pa.int64())
            ends, begun = pa.array([f[0].tolist() for f in found], kind), pa.array([f[1].tolist() for f in found], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, ends, begun], names=names)

    return run


PLAN = "n long, form string, entries array<struct<no int, entry int, before long, low long, high long>>"


def _resolve(share: int, spm: int):
    """From a text's chunk functions, in order: its lines, its form, and for each chunk the entry state, the lines before it, and the rank within it
    of the line at which each part ends (-1: the cut is not in this chunk but before it, a rank past its lines: behind it)."""

    @F.arrow_udf(PLAN)
    def run(functions: pa.Array, h: pa.Array) -> pa.Array:
        out = []
        for chunks, drawn in zip(functions.to_pylist(), h.to_pylist(), strict=True):
            state, before, entries = 0, 0, []
            for c in chunks:
                entries.append([c["no"], state, before])
                state, before = c["ends"][state], before + c["begun"][state]
            form, low, high = choose(before, state >> 1 == FOUND, tuple(drawn), share, spm)
            # a cut behind the last line is a rank that no chunk has
            places = [(no, s, b, low - b if low >= b else -1, high - b if high >= b else -1) for no, s, b in entries]
            out.append({"n": before, "form": form, "entries": [dict(zip(("no", "entry", "before", "low", "high"), p, strict=True)) for p in places]})
        return pa.array(out, pa.struct([("n", pa.int64()), ("form", pa.string()), ("entries", pa.list_(pa.struct(
            [("no", pa.int32()), ("entry", pa.int32()), ("before", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])))]))

    return run


CUT = T.StructType().add("row", "long").add("form", "string").add("part", "integer").add("turn", "integer").add("no", "integer").add("chars", "long").add("data", "binary")


def _cut_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks as pieces of parts, with the part's turn in the output."""
    for b in batches:
        for r, d in zip(b.select(["row", "no", "form", "entry", "begun", "low", "high"]).to_pylist(), b.column("data"), strict=True):
            data = np.frombuffer(d.as_buffer(), np.uint8)
            if r["form"] == "plain":
                cuts = [len(data), len(data)]
            else:
                own = r["begun"][r["entry"]]
                cuts = [0 if c < 0 else len(data) if c >= own else line_start(data, r["entry"], c) for c in (r["low"], r["high"])]
            bounds = [0, *cuts, len(data)]
            rows = [(p, data[bounds[p] : bounds[p + 1]]) for p in ORDER[r["form"]] if bounds[p] < bounds[p + 1]]
            yield pa.RecordBatch.from_pydict({
                "row": [r["row"]] * len(rows), "form": [r["form"]] * len(rows), "part": [p for p, _ in rows], "turn": [ORDER[r["form"]].index(p) for p, _ in rows],
                "no": [r["no"]] * len(rows), "chars": [code_points(x) for _, x in rows], "data": [x.tobytes() for _, x in rows],
            }, schema=pa.schema([("row", pa.int64()), ("form", pa.string()), ("part", pa.int32()), ("turn", pa.int32()), ("no", pa.int32()), ("chars", pa.int64()), ("data", pa.binary())]))


def long_outputs(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, share: int = 100, spm: int = 50, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(plans, pieces) of the texts of more than one chunk.

    plans: row, key, n, form; one row per text, `row` being a number of its own. pieces: row, form, part (0 prefix, 1 middle, 2 suffix), turn, no,
    chars, data; a text's output is its pieces' data in the order of (turn, no). Runs a job: chunks and their functions are stored once.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *_drawn(key, seed)).filter(F.octet_length("text") > chunk)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "key", F.array("h1", "h2", "h3", "h4").alias("h"), "text")
    piece = T.StructType().add("row", "long").add("no", "integer").add("key", docs.schema[key].dataType).add("h", H).add("data", "binary")
    pieces = rows.mapInArrow(_chunks(chunk, piece.fieldNames()), piece)
    scanned = T.StructType(list(piece.fields)).add("ends", H).add("begun", H)
    pieces = stored(pieces.repartition("row", "no").mapInArrow(_scan_chunks(scanned.fieldNames()), scanned))
    # a string holds at most 2 GB, so a text has at most 65 536 chunks, of which only the functions meet here
    functions = F.sort_array(F.collect_list(F.struct("no", "ends", "begun"))).alias("functions")
    plans = pieces.groupBy("row").agg(functions, F.first("key", ignorenulls=True).alias("key"), F.first("h", ignorenulls=True).alias("h"))
    plans = plans.select("row", "key", _resolve(share, spm)("functions", "h").alias("plan"))
    plans = stored(plans.select("row", "key", "plan.*"))
    places = plans.select("row", "form", F.explode("entries").alias("e")).select("row", "form", "e.*")
    cut = pieces.join(places, ["row", "no"]).select("row", "no", "form", "entry", "begun", "low", "high", "data").mapInArrow(_cut_chunks, CUT)
    marks = plans.filter("form <> 'plain'").select("row", "form", F.explode(F.array(*(F.lit(p) for p in range(3)))).alias("part"))
    turn, mark = F.lit(None), F.lit(None)
    for p in range(3):
        own = F.when(F.col("form") == "psm", ORDER["psm"].index(p)).otherwise(ORDER["spm"].index(p))
        turn, mark = F.when(F.col("part") == p, own).otherwise(turn), F.when(F.col("part") == p, F.lit(BEFORE[p])).otherwise(mark)
    marks = marks.select("row", "form", "part", turn.cast("int").alias("turn"), F.lit(-1).alias("no"), F.lit(0).cast("long").alias("chars"), mark.alias("data"))
    return plans.select("row", "key", "n", "form"), cut.unionByName(marks)


PARSED = T.StructType().add("row", "long").add("place", "integer").add("no", "long").add("prefix_chars", "long").add("middle_chars", "long").add("output_sha256", "string").add("data", "binary")
_PARSED = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("no", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("data", pa.binary())])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """(whether the row of this id is the first, row) of rows that lie together by `row`."""
    last = None
    for b in batches:
        for i in range(b.num_rows):
            r = {c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names)}
            yield r["row"] != last, r
            last = r["row"]


def _parse_outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outputs as streams: hashed, and taken apart at the marks that the bytes show. Gives for each text one row with its digest (place -1) and the
    parts' bytes under the place where they belong in the text."""
    sha = row = None
    held, place, no, chars = b"", 0, 0, [0, 0, 0]

    def piece(data):
        return pa.RecordBatch.from_pylist([{"row": row, "place": place, "no": no, "data": data}], schema=_PARSED)

    def last():
        if held:
            yield piece(held)
        told = {"row": row, "place": -1, "no": 0, "prefix_chars": chars[0], "middle_chars": chars[1], "output_sha256": sha.hexdigest()}
        yield pa.RecordBatch.from_pylist([told], schema=_PARSED)

    for new, r in _groups(batches):
        if new:
            if sha:
                yield from last()
            sha, row, held, place, no, chars = hashlib.sha256(), r["row"], b"", 0, 0, [0, 0, 0]
        sha.update(r["data"])
        chars[r["part"]] += r["chars"]
        held += r["data"]
        while r["form"] != "plain" and (m := MARK.search(held)):
            if m.start():
                yield piece(held[: m.start()])
                no += 1
            held, place = held[m.end() :], PLACE[m.group()]
        # what may be the beginning of a mark waits for the next piece
        keep = 0 if r["form"] == "plain" else min(2, len(held))
        if len(held) > keep:
            yield piece(held[: len(held) - keep])
            held, no = held[len(held) - keep :], no + 1
    if sha:
        yield from last()


REBUILT = T.StructType().add("row", "long").add("prefix_chars", "long").add("middle_chars", "long").add("output_sha256", "string").add("restored_sha256", "string")


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    told = sha = None
    kinds = pa.schema(list(_PARSED)[:1] + list(_PARSED)[3:6] + [pa.field("restored_sha256", pa.string())])

    def last():
        return pa.RecordBatch.from_pylist([{k: told[k] for k in kinds.names if k in told} | {"restored_sha256": sha.hexdigest()}], schema=kinds)

    for new, r in _groups(batches):
        if new:
            if sha:
                yield last()
            told, sha = r, hashlib.sha256()
        else:
            sha.update(r["data"])
    if sha:
        yield last()


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, share: int = 100, spm: int = 50, chunk: int = CHUNK) -> DataFrame:
    """One row per row of `docs`: key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256.

    n is the number of lines; form is plain (no change), psm or spm. The cuts are drawn from the SHA-256 of seed, colon and key. Texts that are empty or
    hold a mark stay plain, as do those not drawn in `share` of 100; of the others `spm` of 100 become spm. The restored text is taken apart from the output alone. Null texts
    count as empty; a null key draws as the key ''. Rows that are equal in key or text are each treated alone. Other columns play no part.
    """
    options = {"key": key, "text": text, "seed": seed, "share": share, "spm": spm, "chunk": chunk}
    short = short_outputs(docs, **options)
    parts = F.when(F.col("form") == "plain", F.col("output")).otherwise(F.when(F.col("form") == "psm", _joined(1, 3, 2)).otherwise(_joined(2, 3, 1)))
    short = short.select("key", "n", "form", "prefix_chars", "middle_chars", sha256_hex(F.col("output")).alias("output_sha256"), sha256_hex(parts).alias("restored_sha256"))
    plans, pieces = long_outputs(docs, **options)
    parsed = pieces.repartition("row").sortWithinPartitions("row", "turn", "no").mapInArrow(_parse_outputs, PARSED)
    rebuilt = parsed.repartition("row").sortWithinPartitions("row", "place", "no").mapInArrow(_rebuild, REBUILT)
    told = plans.join(rebuilt, "row")
    chars = [F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix_chars", "middle_chars")]
    return short.unionByName(told.select("key", "n", "form", *chars, "output_sha256", "restored_sha256")).withColumnRenamed("key", key)


def _joined(*places: int) -> Column:
    """The parts of an output, split at its three marks, put together in the given order of positions."""
    parts = F.split("output", "<[PSM]>")
    return F.concat(*(F.get(parts, F.lit(p)) for p in places))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines FROM documents
), drawn AS (
  SELECT *, len(lines) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (len(lines) + 1) AS a, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (len(lines) + 1) AS b,
    CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS d, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM h
), parts AS (
  SELECT doc_id, text, n, CASE WHEN plain THEN 'plain' WHEN d < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(lines[1:least(a, b)], '') AS p, array_to_string(lines[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(lines[greatest(a, b) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
