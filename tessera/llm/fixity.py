"""WARC fixity audit with Merkle trees over offset ranges.

The records of a WARC file are hashed one by one. A leaf of the file's tree covers a fixed range of offsets and hashes the
offsets and hashes of the records that begin there; a node above covers FAN ranges of the level below and hashes their
hashes in order. Two replicas of a file are equal if their roots are; where roots differ, only children of
mismatching nodes are compared, level by level, down to the records that differ.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import opened
from .common import checkpointed, table

LEAF_BYTES = 1 << 16
FAN = 16

RECORDS = "warc_file string, record_offset long, record_id string, payload binary"


def _whole(f, size: int) -> bytes:
    """Up to `size` bytes, less where the file ends or its compression breaks off."""
    parts, left = [], size
    try:
        while left > 0 and (part := f.read(min(left, 1 << 20))):
            parts.append(part)
            left -= len(part)
    except (EOFError, zlib.error, OSError):
        pass
    return b"".join(parts)


def _line(f) -> bytes:
    try:
        return f.readline(1 << 16)
    except (EOFError, zlib.error, OSError):
        return b""


def warc_records(f) -> Iterator[tuple[int, str | None, bytes]]:
    """(offset, id, whole record) of each record of an uncompressed stream, one at a time."""
    at, line = 0, _line(f)
    while line:
        if not line.startswith(b"WARC/"):
            at, line = at + len(line), _line(f)
            continue
        head, line = [line], _line(f)
        while line.strip(b"\r\n"):
            head.append(line)
            line = _line(f)
        text = b"".join(head) + line
        size = re.search(rb"(?im)^content-length:\s*(\d+)", text)
        name = re.search(rb"(?im)^warc-record-id:\s*(.*?)\r?$", text)
        payload = text + _whole(f, int(size[1]) if size else 0)
        yield at, name[1].decode("utf-8", "replace") if name else None, payload
        at, line = at + len(payload), _line(f)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (plain or gzip): warc_file, record_offset, record_id, payload (the whole record).

    Offsets are those in the uncompressed file. A file is one task's work, as compressed files can't be entered in their middle, but is read
    record by record. Lines between records are skipped, and with them files without any record; a record without a length is its head alone, one
    without an id has a null id, and of a file that breaks off, in a record or in its compression, what can be read is kept. Empty files give no row.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for b in batches:
            for name in b.column(0).to_pylist():
                with opened(name) as raw:
                    packed = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    rows, held = [], 0
                    for record in warc_records(io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw)):
                        rows.append((name, *record))
                        held += len(record[2])
                        if held > 1 << 24:
                            yield _batch(rows, names)
                            rows, held = [], 0
                    yield _batch(rows, names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").mapInArrow(split, RECORDS)


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=names)


def _hash_of(*parts: str) -> Column:
    """Hash over a group's rows in order of their parts."""
    rows = F.array_sort(F.collect_list(F.struct(*parts)))
    return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", *(r[p].cast("string") for p in parts))), "\n"), 256)


def leaves(records: DataFrame) -> DataFrame:
    """(warc_file, record_offset, record_id, hash): one row per place. A null file is '', a null offset -1, a null payload ''."""
    rows = records.select(
        F.coalesce("warc_file", F.lit("")).alias("warc_file"), F.coalesce("record_offset", F.lit(-1)).cast("long").alias("record_offset"),
        F.col("record_id").cast("string").alias("record_id"), F.sha2(F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary")), 256).alias("hash"),
    )
    # more than one record at one place is a fault of the index; together they count as one
    return rows.groupBy("warc_file", "record_offset").agg(F.min("record_id").alias("record_id"), F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.sum(F.xxhash64("hash").cast("decimal(38,0)")).alias("all")).select(
        "warc_file", "record_offset", "record_id", F.when(F.col("n") == 1, F.col("low")).otherwise(F.sha2(F.concat_ws(":", "n", "low", "high", F.col("all").cast("string")), 256)).alias("hash")
    )


def levels(places: DataFrame, height: int) -> list[DataFrame]:
    """Nodes (warc_file, range, hash) of each level, from the leaves up to the level of which a file has one."""
    level = places.groupBy("warc_file", F.floor(F.col("record_offset") / LEAF_BYTES).alias("range")).agg(_hash_of("record_offset", "hash").alias("hash"))
    out = [checkpointed(level)]
    for _ in range(height):
        up = out[-1].groupBy("warc_file", F.floor(F.col("range") / FAN).alias("up")).agg(_hash_of("range", "hash").alias("hash"))
        out.append(checkpointed(up.withColumnRenamed("up", "range")))
    return out


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Places where two replicas differ: warc_file, record_offset, record_id, kind (altered, missing, extra).

    Both frames have warc_file, record_offset, record_id and payload; `missing` is a record that only `left` has, `extra` one that only
    `right` has. Equal replicas, and empty tables on both sides, give an empty result.
    """
    a, b = checkpointed(leaves(left)), checkpointed(leaves(right))
    far = a.select("record_offset").unionByName(b.select("record_offset")).agg(F.max("record_offset")).first()[0] or 0
    height, reach = 0, LEAF_BYTES
    while reach <= far:
        height, reach = height + 1, reach * FAN
    trees = list(zip(levels(a, height), levels(b, height), strict=True))
    differing = None
    for x, y in reversed(trees):
        if differing is not None:
            x, y = (t.withColumn("up", F.floor(F.col("range") / FAN)).join(differing, ["warc_file", "up"], "left_semi") for t in (x, y))
        both = x.select("warc_file", "range", F.col("hash").alias("h")).join(y.select("warc_file", "range", F.col("hash").alias("g")), ["warc_file", "range"], "full")
        differing = both.filter(~F.col("h").eqNullSafe(F.col("g"))).select("warc_file", F.col("range").alias("up"))
    down = [t.withColumn("up", F.floor(F.col("record_offset") / LEAF_BYTES)).join(differing, ["warc_file", "up"], "left_semi").drop("up") for t in (a, b)]
    p = down[0].select("warc_file", "record_offset", F.col("record_id").alias("p_id"), F.col("hash").alias("p"))
    q = down[1].select("warc_file", "record_offset", F.col("record_id").alias("q_id"), F.col("hash").alias("q"))
    kind = F.when(F.col("q").isNull(), "missing").when(F.col("p").isNull(), "extra").otherwise("altered")
    found = p.join(q, ["warc_file", "record_offset"], "full").filter(~F.col("p").eqNullSafe(F.col("q")))
    return found.select("warc_file", "record_offset", F.coalesce("p_id", "q_id").alias("record_id"), kind.alias("kind"))


PAGES_PER_FILE = 1000


def page_records(pages: DataFrame) -> DataFrame:
    """Pages as WARC records, PAGES_PER_FILE ids to a file, one behind the other in order of page_id (and url)."""
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.coalesce(F.concat(F.lit("part-"), F.floor(F.col("page_id") / PAGES_PER_FILE).cast("string")), F.concat(F.lit("none-"), F.substring(F.sha2(body, 256), 1, 3))).alias("warc_file"),
        "page_id", "url", F.concat(head, body, F.lit("\r\n\r\n")).alias("payload"),
    )


def place(records: DataFrame) -> DataFrame:
    """Adds each record's offset in its file. Only lengths go through the window, a file's records at a time; page_records gives a file at most
    PAGES_PER_FILE ids, and pages without an id are dealt to files of their own by their hash."""
    w = Window.partitionBy("warc_file").orderBy("page_id", "url", "own").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("record_offset", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))


def op3_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages' WARC files in which some records are altered, cut short or lost, by a fixed rule."""
    records = page_records(table(spark, sf_dir, "pages"))
    i = F.col("page_id")
    damaged = F.when(i % 97 == 13, F.concat(F.col("payload"), F.lit(" "))).when(i % 103 == 5, F.substring("payload", 1, 40)).otherwise(F.col("payload"))
    # the payloads are hashed where they are read; what is moved is their hashes
    seen = records.select("warc_file", "page_id", "url", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("own"), F.sha2(damaged, 256).alias("other"))
    placed = checkpointed(place(seen)).withColumn("record_id", F.col("page_id").cast("string"))
    left = placed.withColumn("payload", F.col("own"))
    right = placed.filter(F.coalesce(i % 101 != 7, F.lit(True))).withColumn("payload", F.col("other"))
    return audit(left, right).select("warc_file", "record_offset", F.col("record_id").cast("long").alias("page_id"), "kind")


ORACLE = """
WITH r AS (
  SELECT 'part-' || CAST(CAST(floor(page_id / 1000.0) AS BIGINT) AS VARCHAR) AS warc_file, page_id, url,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
      || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS payload
  FROM pages
), placed AS (
  SELECT *, CAST(coalesce(sum(strlen(payload)) OVER (PARTITION BY warc_file ORDER BY page_id, url
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset FROM r
), replica AS (
  SELECT *, CASE WHEN page_id % 101 = 7 THEN NULL WHEN page_id % 97 = 13 THEN payload || ' ' WHEN page_id % 103 = 5 THEN substr(payload, 1, 40)
    ELSE payload END AS other FROM placed
)
SELECT warc_file, record_offset, page_id, CASE WHEN other IS NULL THEN 'missing' ELSE 'altered' END AS kind
FROM replica WHERE other IS NULL OR sha256(other) <> sha256(payload)
"""
