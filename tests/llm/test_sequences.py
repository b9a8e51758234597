"""Packing, the conversation trie and fill-in-the-middle against plain versions, with odd rows."""

import bisect
import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fim, packing, trie

WORDS = "the of and to a in is it you that he was for on are with as I his they be at one have this".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# --- 11 packing

MIXED = ["", " \n\t", "It's 42 o'clock, WE'LL see!!", "Été à Ÿ ǅ ſ", "İstanbul ΣΊΣΥΦΟΣ", "été", "<|endoftext|> x <|startoftext|>", "a\x1cb\x85c d", "漢字かな カナ 한국어",
         "한", "x" * 300 + " y", "\U0001f600 ok ‍", "١٢٣ ½ ²", "don't 'S 'ſ 'll'll"]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_ids_are_those_of_the_library(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 40)
    rng, lib, own = random.Random(1), library(), packing.Ids(packing.vocabulary_path("word_bpe_49k.json"))
    texts = MIXED + ["".join(rng.choice(["a", "É", "ß", "'s", "'", " ", "\n", "7", "-", "ж", "Ж", "“", "中", "가", "Œ", "%", "\x1d", "ͅ"]) for _ in range(rng.randrange(200))) for _ in range(400)]
    for t in texts + texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def plain_best_fit(lengths, size):
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, length)
        n += k == len(rooms)
        room = rooms.pop(k) if k < len(rooms) else size
        if room > length:
            bisect.insort(rooms, room - length)
    return n


@pytest.mark.parametrize("size", [1, 7, 64, 2048])
def test_the_plan_is_that_of_best_fit_piece_by_piece(size):
    for seed in range(20):
        rng = random.Random(seed)
        lengths = [rng.randint(1, size) if seed % 2 else min(size, int(rng.expovariate(4 / size)) + 1) for _ in range(rng.randrange(400))]
        counts = defaultdict(int)
        for n in lengths:
            counts[n] += 1
        rows, used = packing.plan(counts, size), defaultdict(list)
        for length, low, high, first, each, offset in rows:
            for rank in range(low, high):
                used[first + (rank - low) // each].append((offset + (rank - low) % each * length, length))
        assert len(used) == plain_best_fit(lengths, size)
        assert sum(map(len, used.values())) == len(lengths)
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size


def test_a_plan_grows_with_lengths_not_with_pieces():
    few, many = ({n: k * (n % 17 + 1) for n in range(1, 2049)} for k in (1, 10_000_000))
    assert len(packing.plan(many)) < 4 * len(packing.plan(few)) < 200_000


def test_packing_of_documents(spark):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate([None, *MIXED, *(prose(rng, rng.randrange(1, 90)) for _ in range(150))])]
    rows += [(7, "same"), (7, "same"), (None, "no id"), (900, prose(rng, 400))] + [(1000 + i, "copies of one text") for i in range(300)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, length string")
    cut = packing.pieces(docs, size=50)
    packed = packing.pack(cut, 50)
    assert packed.columns == ["key", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    got, lib, want = packed.collect(), library(), []
    for key, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(str(key), n, at, ids[at : at + 50]) for n, at in enumerate(range(0, len(ids), 50))]
    assert sorted((str(r.key), r.piece, r.start, r.ids) for r in got) == sorted(want)
    assert all(r.length == len(r.ids) and r.ids_crc32 == crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    whole = packing.sequences(packed).collect()
    assert len(whole) == plain_best_fit([len(w[3]) for w in want], 50)
    parts = defaultdict(list)
    for r in got:
        parts[r.sequence_id].append((r.offset, r.ids))
    for s in whole:
        own = sorted(parts[s.sequence_id])
        assert s.starts == [o for o, _ in own] and s.ids == sum((i for _, i in own), []) and s.tokens == len(s.ids) <= 50
        assert s.starts == np.cumsum([0, *(len(i) for _, i in own)])[:-1].tolist()


def test_ranks_over_many_blocks(spark):
    rows = spark.range(1000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 7 + 1).cast("long").alias("length"))
    got = defaultdict(list)
    for r in packing.ranked(rows, block_rows=16).collect():
        got[r.length].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 1000


# --- 12 conversation trie


def plain_trie(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    talks = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in talks.items()}
    members = defaultdict(list)
    for c, own in talks.items():
        h = crc32(str(c).encode()) % 9
        turns = tuple(talks.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append((c, len(turns)))
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        below, todo = [], [p]
        while todo:
            q = todo.pop()
            below.append(q)
            todo += children[q]
        ends = ",".join(str(c) for c, n in sorted(m) if n == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        parent = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in m), len(p), parent, len(m), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talks():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", None, "bot"]), rng.choice(["a", "b", "", None, "é", "long " * 20])) for c in range(60) for t in range(rng.randrange(1, 8))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 190) for t in range(30)]  # a large group of equal conversations
    rows += [(c, 5 - t if t else None, "user", "hello" if not t else f"{c} {t}") for c in range(200, 260) for t in range(3)]
    rows += [(1001, 0, "user", "cut away"), (70_000, 0, "a", "bc"), (70_005, 0, "ab", "c"), (None, 0, "user", "no id"), (300, 0, "user", "twice"), (300, 0, "user", "twice")]
    return rows


@pytest.mark.parametrize(("local", "few", "stride"), [(1 << 12, 16, 8), (300, 16, 4), (10, 2, 3), (1, 1, 1)])
def test_trie_is_that_of_plain_loops(spark, local, few, stride):
    rows = talks()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, path string")
    nodes = trie.trie(trie.rebuilt(df), local, few, stride).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r[:8])
    assert sorted(map(key, nodes)) == sorted(map(key, plain_trie(rows)))
    told = {r.turn_id: (r.role, r.text) for r in trie.turn_dictionary(df).collect()}
    assert {told[r.turn_id] for r in nodes if r.depth} <= {(r[2] or "", r[3] or "") for r in rows}
    assert [r for r in nodes if r.turn_id is None] == [r for r in nodes if r.depth == 0] and len([r for r in nodes if r.depth == 0]) == 1


def test_turnless_conversations_end_at_the_root(spark):
    cut = next(c for c in range(1, 100) if c % 5 and crc32(str(c).encode()) % 9 > 0)  # its base is absent, its only turn is left out
    [root] = trie.trie(trie.rebuilt(spark.createDataFrame([(cut, 0, "user", "x")], "conv_id long, turn long, role string, text string"))).collect()
    assert tuple(root)[:8] == (cut, 0, None, 1, 0, 1, 0, hashlib.sha256(str(cut).encode()).hexdigest())


# --- 13 fill-in-the-middle

TEXTS = ["", "one", "one\n", "\n", "\n\n\n", "a\nbb\n\nccc", "é\nü\n漢字\nz", "x <P", "x <P> y\nz", "a\n<S", "<<M>", "<M", "S>\n<S\n>", "<P\n>\nq", "<<<\n<<P<S<M\nP>S>M>\n", "\r\nq\r\n", None]


def plain_fim(key, text, seed=7, share=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n, sha = len(lines), lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, form, len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("chunk", [1, 3, 16, 1 << 15])
def test_fill_in_the_middle_is_that_of_plain_strings(spark, chunk):
    rng = random.Random(chunk)
    texts = TEXTS + ["".join(rng.choice(["<", "P", "S", "M", ">", "\n", "é", "ab", "<P", "漢"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    rows = [*enumerate(texts), (3, "twice\nthe same\nrow\n"), (3, "twice\nthe same\nrow\n"), (None, "no\nid\nhere\n")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, row string, key string")
    for share, spm in ((100, 50), (60, 30)):
        got = fim.digests(docs, share=share, spm=spm, chunk=chunk).collect()
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((k, *plain_fim(k, t, 7, share, spm))) for k, t in rows)
        assert all(r.output_sha256 != r.restored_sha256 for r in got if r.form != "plain")


def test_outputs_of_giant_texts(spark):
    text = "".join(f"line {i} \n" for i in range(500))
    plans, pieces = fim.long_outputs(spark.createDataFrame([("k", text)], "doc_id string, text string"), chunk=64)
    whole = b"".join(r.data for r in pieces.orderBy("turn", "no").collect()).decode()
    assert plans.first().n == 500 and hashlib.sha256(whole.encode()).hexdigest() == plain_fim("k", text)[4]


def test_chunk_functions_compose_like_the_automaton():
    rng = random.Random(2)
    for _ in range(200):
        data = np.frombuffer("".join(rng.choice("<PSM>\nab") for _ in range(rng.randrange(40))).encode(), np.uint8)
        at = rng.randrange(len(data) + 1)
        whole, parts = fim.scan(data), fim.compose(fim.scan(data[:at]), fim.scan(data[at:]))
        for s in range(fim.STATES):
            state, begun = s, 0
            for b in data:
                begun, state = begun + fim.BEGUN[state], fim.STEP[fim.CLASS[b], state]
            assert (whole[0][s], whole[1][s]) == (parts[0][s], parts[1][s]) == (state, begun)
