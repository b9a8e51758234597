"""Prefix trie of conversations by distributed MSD radix partitioning.

A turn becomes a fixed-width id: 16 bytes that stand for its role and text (`turn_dictionary` gives them back) and 4 bytes with the text's size, so that
a conversation is a string over a large alphabet and texts cross no shuffle. Conversations start in one bucket, the root's. A bucket that is too large for a task is
split by its members' next ids, several turns at a time, and its node is kept with partial counts; the parts are split on until all are small. Each small
bucket is then finished in one task: its ids are encoded once more as small integers, multikey quicksort (Bentley and Sedgewick, 1997) parts its members by the turn at
the current depth into those less than, equal to and greater than a pivot, and every group of equals is a node that the recursion emits. What the nodes of
large buckets need from below is summed up over the roots of the small ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

WIDTH = 20
"""Bytes of a turn's id."""
LOCAL = 1 << 12
"""Members and remaining turns that a bucket may have to be finished in one task."""
FEW = 16
"""Members up to which a bucket is finished in one task however long they are."""
STRIDE = 8
"""Turns by which a round splits."""
BLOCK = 1 << 16
"""Conversation ids of a block, in which ids are joined to text before those of a node meet."""

EMPTY = hashlib.sha256(b"").hexdigest()


def _turn_id(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256 over role and text, as hexadecimal digits; the role's length parts the two."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)


def turn_dictionary(conversations: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """(turn_id, role, text): what the turn ids of nodes stand for. Null roles and texts are empty."""
    both = conversations.select(F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return both.select(F.unhex(_turn_id(F.col("role"), F.col("text"))).alias("turn_id"), "role", "text").dropDuplicates(["turn_id"])


def rebuilt(conversations: DataFrame, family: int = 5, shared: int = 9) -> DataFrame:
    """(conv_id, flat): each conversation's turn ids in one binary string, its first h turns being those of the conversation conv_id - conv_id % family.

    h is the unsigned crc32 of the decimal conv_id modulo `shared`. Turns are ordered by `turn`, null first; of equal turns the order is that of their ids. Null roles and texts
    are empty. Rows without a conv_id belong to no conversation. A family of conversations shares one exchange, of ids alone.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turn = F.concat(_turn_id(role, text), F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn.alias("id"))
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).repartition("base")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda t: t["id"])
    whole = rows.groupBy("base", "conv_id").agg(F.unhex(F.array_join(turns, "")).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.substring("own", 1, (shared - 1) * WIDTH))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared * WIDTH).cast("int")
    flat = F.concat(F.coalesce(F.substr(head, F.lit(1), h), F.unhex(F.lit(""))), F.substr("own", h + 1, F.octet_length("own")))
    return whole.select("conv_id", flat.alias("flat"))


def _to(depth: Column | int, flat: str = "flat") -> Column:
    """The path of a conversation's first turns."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.substr(F.col(flat), F.lit(1), (depth * WIDTH).cast("int"))


def _depth(path: str) -> Column:
    return (F.octet_length(path) / WIDTH).cast("int")


def _split(conversations: DataFrame, local: int, few: int, stride: int) -> tuple[DataFrame | None, DataFrame, DataFrame | None]:
    """(large nodes, members of small buckets, conversations that end at large nodes).

    large: path, n_convs, rest (turns beyond the node), conv_id (smallest member). members: path (the bucket's), above (smallest member of its parent), conv_id, flat. ended: path, conv_id.
    A round counts the members of `stride` levels at once, with partial counts before the shuffle, and needs only those nodes again that are large, at most one for `local`
    turns of a level. There are as many rounds as the deepest large node has times `stride` turns.
    """
    rows, k = conversations.withColumn("n", _depth("flat")).withColumn("above", F.lit(None).cast("long")), 0
    nodes, members, ended = [], [], []
    while True:
        paths = rows.withColumn("d", F.explode(F.sequence(F.lit(k + (k > 0)), F.least("n", F.lit(k + stride))))).withColumn("path", _to(F.col("d")))
        counts = paths.groupBy("path").agg(F.count("*").alias("n_convs"), F.sum(F.col("n") - F.col("d")).alias("rest"), F.min("conv_id").alias("first"))
        large = stored(counts.filter((F.col("n_convs") > few) & (F.col("n_convs") + F.col("rest") > local)))
        if k == 0 and large.isEmpty():
            return None, conversations.select(_to(0).alias("path"), F.lit(None).cast("long").alias("above"), "conv_id", "flat"), None
        nodes.append(large)
        # a table as small as its files show is broadcast by Spark; else the rows of a large node are split over tasks (adaptive skew join)
        met = paths.join(large.select("path", "first"), "path", "left").groupBy("conv_id")
        found = F.when(F.col("first").isNotNull(), F.col("d"))
        met = met.agg(F.coalesce(F.max(found), F.lit(k)).alias("d"), F.coalesce(F.max_by("first", found), F.first("above")).alias("above"), F.first("n").alias("n"), F.first("flat").alias("flat"))
        met = stored(met)
        ended.append(met.filter("n = d").select(F.col("flat").alias("path"), "conv_id"))
        members.append(met.filter((F.col("n") > F.col("d")) & (F.col("d") < k + stride)).select(_to(F.col("d") + 1).alias("path"), "above", "conv_id", "flat"))
        k += stride
        rows = met.filter((F.col("n") > F.col("d")) & (F.col("d") == k)).select("conv_id", "flat", "n", "above")
        if rows.isEmpty():
            return tuple(reduce(DataFrame.unionByName, x) for x in (nodes, members, ended))


NODE = (
    T.StructType().add("conv_id", "long").add("depth", "long").add("parent_conv_id", "long").add("n_convs", "long").add("n_children", "long").add("n_leaves", "long")
    .add("saved_tokens", "long").add("ends_sha256", "string").add("turn_id", "binary").add("bucket", "binary")
)
_NODE = pa.schema([(n, pa.int64()) for n in NODE.fieldNames()[:7]] + [("ends_sha256", pa.string()), ("turn_id", pa.binary()), ("bucket", pa.binary())])


def _digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else EMPTY


def sort_bucket(path: bytes, above: int | None, ids: list[int], flats: list[bytes]) -> list[tuple]:
    """The nodes (as in NODE) of a bucket whose members, ascending in ids, share the given path. The first is the bucket's root."""
    start = len(path) // WIDTH
    names: dict[bytes, int] = {}
    turns = [[names.setdefault(f[at : at + WIDTH], len(names)) for at in range(start * WIDTH, len(f), WIDTH)] for f in flats]
    turn_of = list(names)
    first, depth, parent, size, count, ends, last = [], [], [], [], [], [], []
    # to do: (members that share `at` turns beyond the path, at, node above them, whether they are a node or still to be parted)
    todo = [(list(range(len(ids))), 0, -1, True)]
    while todo:
        rows, at, up, equal = todo.pop()
        if equal:
            record = turn_of[turns[rows[0]][at - 1]] if at else path[-WIDTH:]
            first.append(ids[rows[0]])
            depth.append(start + at)
            parent.append(up)
            count.append(len(rows))
            size.append(int.from_bytes(record[16:], "big"))
            last.append(record[:16] or None)
            over = [r for r in rows if len(turns[r]) == at]
            ends.append(_digest([ids[r] for r in over]))
            up = len(first) - 1
            if len(over) < len(rows):
                todo.append(([r for r in rows if len(turns[r]) > at] if over else rows, at, up, False))
        else:
            pivot = turns[rows[len(rows) // 2]][at]
            same = [r for r in rows if turns[r][at] == pivot]
            if len(same) < len(rows):
                for part in ([r for r in rows if turns[r][at] < pivot], [r for r in rows if turns[r][at] > pivot]):
                    if part:
                        todo.append((part, at, up, False))
            todo.append((same, at + 1, up, True))
    n = len(first)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saved[i] += (count[i] - 1) * size[i]
        if (p := parent[i]) >= 0:
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    return [
        (first[i], depth[i], first[parent[i]] if parent[i] >= 0 else above, count[i], children[i], leaves[i], saved[i], ends[i], last[i], None if i else path) for i in range(n)
    ]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small buckets, whose members lie together, one after the other."""
    out: list[tuple] = []
    path, above, ids, flats = None, None, [], []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _NODE, strict=True)], schema=_NODE)

    for b in batches:
        for p, a, c, f in zip(*(b.column(x).to_pylist() for x in ("path", "above", "conv_id", "flat")), strict=True):
            if p != path:
                if ids:
                    out += sort_bucket(path, above, ids, flats)
                path, above, ids, flats = p, a, [], []
                if len(out) > 1 << 14:
                    yield batch()
                    out = []
            ids.append(c)
            flats.append(f)
    if ids:
        out += sort_bucket(path, above, ids, flats)
    if out:
        yield batch()


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for the blocks of each node, which lie together in order."""
    path = sha = None
    for b in batches:
        told = []
        for p, ids in zip(b.column("path").to_pylist(), b.column("ids"), strict=True):
            if p != path:
                if sha:
                    told.append((path, sha.hexdigest()))
                path, sha = p, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.as_py().encode())
        yield pa.RecordBatch.from_pydict({"path": [p for p, _ in told], "ends": [s for _, s in told]}, schema=pa.schema([("path", pa.binary()), ("ends", pa.string())]))
    if sha:
        yield pa.RecordBatch.from_pydict({"path": [path], "ends": [sha.hexdigest()]}, schema=pa.schema([("path", pa.binary()), ("ends", pa.string())]))


def trie(conversations: DataFrame, local: int = LOCAL, few: int = FEW, stride: int = STRIDE) -> DataFrame:
    """One row per node of the trie over (conv_id, flat): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, turn_id (of the node's last turn; null at the root). No conversations, no nodes; conversations without turns end at the root.

    Conversations are stored once, and so are the nodes of small buckets. A conversation's ids lie in one row. Only the ids that end at one node are hashed by one
    task, as the digest asks for; they come as joined blocks.
    """
    conversations = stored(conversations)
    large, members, ended = _split(conversations, local, few, stride)
    nodes = members.repartition("path").sortWithinPartitions("path", "conv_id").mapInArrow(_finish, NODE)
    if large is None:
        return nodes.drop("bucket")
    nodes = stored(nodes)

    d = _depth("path")
    parts = nodes.filter("bucket is not null").select(F.col("bucket").alias("path"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(1).alias("own"))
    size = F.conv(F.hex(F.substr("path", F.greatest(F.octet_length("path") - 3, F.lit(1)), F.lit(4))), 16, 10).cast("long")
    own = large.select("path", F.when(F.col("rest") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.when(d > 0, (F.col("n_convs") - 1) * size).otherwise(0).alias("saved"), F.lit(0).alias("own"))
    # every part is told to all nodes above it (small buckets: not to their own root, which isn't large)
    told = parts.unionByName(own).withColumn("d", d).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("d") - F.col("own"))))
    told = told.select(_to(F.col("to"), "path").alias("path"), "leaves", "saved", (F.col("to") == F.col("d") - 1).cast("long").alias("child"))
    sums = told.groupBy("path").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum("child").alias("n_children"))

    ids = ended.groupBy("path", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    ends = ids.repartition("path").sortWithinPartitions("path", "block").select("path", "ids").mapInArrow(_hash_blocks, "path binary, ends string")
    parents = large.select(F.col("path").alias("up"), F.col("first").alias("parent_conv_id"))
    upper = large.select("path", "n_convs", "first", F.when(d > 0, _to(d - 1, "path")).alias("up")).join(parents, "up", "left").join(sums, "path").join(ends, "path", "left")
    upper = upper.select(
        F.col("first").alias("conv_id"), d.cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
        F.when(d > 0, F.substr("path", F.octet_length("path") - (WIDTH - 1), F.lit(16))).alias("turn_id"))
    return nodes.drop("bucket").unionByName(upper)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations"))).drop("turn_id")


ORACLE = """
WITH o AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, turns, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: CAST([ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] AS BIGINT[])))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 9 AS h FROM o
), r AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id - a.conv_id % 5
), p AS (
  SELECT conv_id, len(turns) AS n, unnest(generate_series(0, len(turns))) AS d, turns FROM r
), nodes AS (
  SELECT turns[1:d] AS path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sum(n - d) = 0 AS leaf, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends
  FROM p GROUP BY 1, 2
), up AS (
  SELECT path, d, leaf, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(path[d].t) ELSE 0 END AS saved, unnest(generate_series(0, d)) AS a FROM nodes
), sums AS (
  SELECT path[1:a] AS path, a AS d, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens, count(*) FILTER (a = d - 1) AS n_children FROM up GROUP BY path[1:a], a
)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path AND s.d = n.d LEFT JOIN nodes q ON n.d > 0 AND q.d = n.d - 1 AND q.path = n.path[1:n.d - 1]
"""
