"""Every registered operator on a small folder of tables with odd rows, on empty tables, and against plain versions or held-out labels."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprint, html_text, language, minhash, mixing, quality, toxicity, vectors
from tessera.llm.registry import QUERIES

from .test_operators import LONG, ODD, PAGE, docs, prose

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}
COLUMNS = {
    "op1_quality": {"doc_id", "held_out", "score", "predicted"},
    "op2_vectors": {"vec_id", "n_links", "component_id", "kept"},
    "op4_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5_fingerprint": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op6_minhash": {"doc_id", "copy_of", "class_id", "kept"},
    "op7_mixing": {"doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled"},
    "op8_language_id": {"doc_id", "held_out", "lang_pred", "score", "ambiguous"},
    "op9_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op10_html_text": {"page_id", "url", "text", "n_chars"},
    "op13_fim": {"doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"},
}
HELD_OUT = {"op1_quality": (3, 1), "op8_language_id": (4, 2), "op9_toxicity": (5, 0)}
FOREIGN = "das haus und der garten mit dem fenster waren nicht dort am abend"


def write(spark, folder, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    texts = [*ODD, *(f"{prose(i, 40)}. {'you idiot ' * (i % 4 == 0)}It was so, {prose(i + 1, 20)}." if i % 3 else f"{FOREIGN} {prose(i, 6)} {FOREIGN}" for i in range(80))]
    rows = [(i, t, None if i == 12 else "de" if (t or "").startswith(FOREIGN) else "en", None if i == 13 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "a text without an id, here it is", "en", "s1", 30)]
    labels = [(i, int(i % 5 > 0), int("idiot" in (t or ""))) for i, t in enumerate(texts)] + [(None, 1, 1), (5000, 0, 1), (21, None, None), (22, 1, 0)]
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", PAGE), (4, "u", PAGE), (None, "x", "<p>" + LONG)]
    vecs = [(i, [float(x) for x in rng.normal(size=16)], i % 2) for i in range(40)]
    vecs += [(100 + i, vecs[i][1], vecs[i][2]) for i in range(5)] + [(200, None, 1), (201, vecs[0][1], None), (202, [0.0] * 16, 0)]
    return write(spark, tmp_path_factory.mktemp("tiny"), {"documents": rows, "labels": labels, "pages": pages, "embeddings": vecs})


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_keep_their_contracts(spark, tiny, name):
    got = QUERIES[name](spark, tiny)
    assert set(got.columns) == COLUMNS[name]
    source = {"op2_vectors": "embeddings", "op10_html_text": "pages"}.get(name, "documents")
    rows = got.collect()
    key = got.columns[0]
    assert Counter(r[key] for r in rows) == Counter(r[0] for r in spark.read.parquet(f"{tiny}/{source}.parquet").collect())
    for r in rows:
        if name in HELD_OUT:
            n, rest = HELD_OUT[name]
            assert r.held_out == (crc32(str("" if r.doc_id is None else r.doc_id).encode()) % n == rest) and 0 <= r.score <= 1
        if "predicted" in COLUMNS[name]:
            assert r.predicted == int(r.score >= 0.5)
    if name in ("op4_bpe", "op6_minhash"):
        assert len({tuple(r)[1:3] for r in rows if r.doc_id == 20}) == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_of_empty_tables_are_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_empty_tables_and_with_clashing_columns(spark, tiny, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert pipeline.run(spark, empty).count() == 0
    rows = spark.read.parquet(f"{tiny}/documents.parquet")
    for c in ("__quality", "quality", "language", "mixture", "bpe", "own", "cell", "p", "topic", "score", "sha", "band"):
        rows = rows.withColumn(c, F.lit("x"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, rows, tiny)
        assert out.columns == rows.columns and out.filter("cell <> 'x'").count() == 0, name
    assert pipeline.STAGES[-1][1](spark, rows, tiny).count() == rows.count()


# --- held-out labels of the given tables

GIVEN = Path("/root/testdata/sf0.01")
given = pytest.mark.skipif(not GIVEN.exists(), reason="needs the test tables")


@given
def test_held_out_quality_and_language(spark):
    labels = spark.read.parquet(f"{GIVEN}/labels.parquet").filter("quality is not null")
    got = QUERIES["op1_quality"](spark, str(GIVEN)).filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) >= 0.95
    langs = spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op8_language_id"](spark, str(GIVEN)).filter("held_out and lang_pred <> 'und'").join(langs, "doc_id").select("lang_pred", "lang").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) >= 0.99


# --- 5 fingerprints

@pytest.mark.parametrize("kind", ["string", "long"])
def test_successors_by_keys_of_any_type(spark, kind):
    keys = [f"k{i // 2:03d}" if kind == "string" else i // 2 for i in range(40)] + [None] * 7
    rows = [(k, f"{prose(i, 30)}\n{prose(i + 1, 20)}" if i % 5 else None) for i, k in enumerate(keys)]
    rows += [rows[3], rows[3]]
    got = fingerprint.compare_with_edit(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in rows)
    # whichever order equal keys come in, the row after the last of a key has the next key
    texts, order = defaultdict(set), sorted({k for k, _ in rows}, key=lambda k: (k is not None, k))
    for k, t in rows:
        texts[k].add(t or "")
    made = {(k, hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest()) for a, k in enumerate(order) for t in texts[k] for u in texts[k] | texts[order[(a + 1) % len(order)]]}
    assert {(r.doc_id, r.edited_sha256) for r in got} <= made


def test_edits_change_only_the_lines_that_they_touch():
    rng = random.Random(3)
    for _ in range(200):
        t, u = ("".join(rng.choice("ab \n") for _ in range(rng.randrange(60))) for _ in range(2))
        edited, q = fingerprint.edit(t, u)
        assert edited == t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        assert all((x == y).all() for x, y in zip(q, fingerprint.fingerprint_of(edited), strict=True))


# --- 4 BPE

def test_decoding_leaves_out_what_no_token_is(spark):
    rows = spark.createDataFrame([(1, [5, None, 10**8, -3, 6]), (2, None), (3, [])], "doc_id long, ids array<int>")
    vocab = bpe.Vocabulary.load(bpe.vocabulary_path())
    got = {r.doc_id: r.decoded for r in bpe.decode(rows).collect()}
    assert got == {1: vocab.decode_bytes(np.array([5, 6])).tobytes().decode(), 2: "", 3: ""}


def test_long_words_have_the_ids_of_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    lib, enc = tokenizers.Tokenizer.from_file(bpe.vocabulary_path()), bpe.Encoder(bpe.Vocabulary.load(bpe.vocabulary_path()))
    rng = random.Random(2)
    for n in (bpe.LONG, bpe.LONG + 1, 20_000):
        text = "so " + "".join(rng.choice("etaoinshrdlu") for _ in range(n)) + " <|endoftext|>" + "é" * n + "a" * n
        assert enc.encode([text, "x"])[0].tolist() == lib.encode(text, add_special_tokens=False).ids + lib.encode("x", add_special_tokens=False).ids


# --- 6 MinHash

def test_scripts_without_blanks_have_shingles(spark):
    rng = random.Random(5)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(420))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs(spark, [text, text[:200] + "好" + text[200:], text[::-1]])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_weights_do_not_change_with_the_size_of_the_corpus():
    share = np.random.default_rng(1).uniform(0.001, 0.4, 1 << minhash.SKETCH_BITS)
    a, b = (minhash.inverse_frequencies((share * n).astype(np.int64), n) for n in (10**5, 10**9))
    assert np.abs(a - b).max() < 2e-3
    assert minhash.inverse_frequencies(np.array([3, 0, 1]), 3).tolist()[0] == minhash.DAMP and np.isfinite(minhash.inverse_frequencies(np.zeros(4, int), 0)).all()


def test_lanes_bound_the_similarity():
    rng = np.random.default_rng(2)
    for _ in range(100):
        h = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
        a, b = ((np.sort(rng.choice(h, 200, replace=False)), rng.uniform(0.8, 3, 200)) for _ in range(2))
        x, y = minhash.lanes(a), minhash.lanes(b)
        most = np.minimum(x, y).sum()
        assert most / (x.sum() + y.sum() - most) >= minhash._similarity(a, b) - 1e-9


# --- 7 mixing

def test_sparse_sample_equals_dense_rows():
    rng, n = np.random.default_rng(4), 40
    langs = rng.integers(0, 4, n)
    dense = np.zeros((n, mixing.BUCKETS))
    at = rng.integers(0, mixing.BUCKETS, 300)
    for i in range(n):
        dense[i, rng.choice(at, 12)] = rng.random(12)
    row, bucket = np.nonzero(dense)
    y = mixing.Sample(row, bucket, dense[row, bucket], langs)
    means = np.stack([dense.mean(0), *(dense[langs == la].mean(0) for la in (1, 2, 3))])
    want = dense - means[langs]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    centres = rng.normal(size=(3, mixing.BUCKETS))
    assert np.allclose(y.near(centres), want @ centres.T) and np.allclose(y.off(centres), means @ centres.T)
    chosen = rng.random(n) < 0.4
    assert np.allclose(y.total(chosen), want[chosen].sum(0))


def test_shares_that_leave_nothing_are_an_error_on_both_paths(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "x", 0, 5), ("b", "y", 1, 7)], "source string, lang string, topic int, weight long")
    for most in (mixing.DRIVER_CELLS, 0):
        monkeypatch.setattr(mixing, "DRIVER_CELLS", most)
        with pytest.raises(ValueError, match="leave no share"):
            mixing.probabilities(cells, mixing.POWER, 0.5, {"source": {"a": 0.0, "b": 0.0}})


def test_any_number_of_languages_has_its_own_mean(spark):
    rows = [(i, f"{'abcdefgh'[i % 8]}{i % 3}word thing{i % 5} of {prose(i, 6)}", f"l{i % 300}") for i in range(900)]
    topics = mixing.fit_topics(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(topics.means) == 301 and len(topics.centres) == mixing.TOPICS


def plain_bucket(word):
    h = sum(b * int(mixing._PLACE[i % 64]) for i, b in enumerate(word.encode())) % 2**64
    return int(minhash.mix64(np.array([h], np.uint64))[0]) >> 64 - mixing.BITS


def test_words_are_cut_as_split_does(monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 50)
    rng = random.Random(3)
    texts = ["", "  ", "one", *("".join(rng.choice("aB c\nÄ\t") for _ in range(rng.randrange(200))) for _ in range(60)), "x" * 9000, "y z"]
    raw = [t.encode() for t in texts]
    text, bucket, n = mixing.word_counts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = Counter((i, plain_bucket("".join(c.lower() if c.isascii() else c for c in w))) for i, t in enumerate(texts) for w in t.split())
    assert dict(zip(zip(text.tolist(), bucket.tolist(), strict=True), n.tolist(), strict=True)) == want


def test_words_move_as_one_number_each_however_often_they_come(spark):
    texts = ["one two two " + "three " * (mixing.MANY - 1), "four " * mixing.MANY + "five", "six " * (mixing.MANY + 7) + "four " * 70_000 + "one", "seven", "y" * 200 + " Z" + "y" * 64 + " z" + "y" * 63]
    rows = mixing.counted(spark.createDataFrame([(t, "en") for t in [*texts, texts[0]]], "text string, lang string")).toArrow().combine_chunks()
    assert rows.num_rows == 5 and sorted(rows["copies"].to_pylist()) == [1, 1, 1, 1, 2]
    got = []
    for r in rows.to_pylist():
        bucket, n, left = mixing.taken_apart(np.frombuffer(r["cells"], "<u4"), np.frombuffer(r["more"], "<i8"))
        assert not len(left) and len(r["cells"]) == 4 * len(bucket)
        got.append(dict(zip(bucket.tolist(), n.tolist(), strict=True)))
    want = [dict(Counter(plain_bucket(w.lower()) for w in t.split())) for t in texts]
    assert sorted(map(sorted, (x.items() for x in got))) == sorted(map(sorted, (x.items() for x in want)))
    # the counts beyond the cells' bits reach the right rows, wherever a run of rows ends
    idf = np.ones(mixing.BUCKETS, np.float32)
    batch = rows.select(["lang", "cells", "more"]).to_batches()[0]
    for size in (1, 1 << 18):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(mixing, "SLICE", size)
            told = [(i, b, w) for _, _, text, bucket, weight in mixing._weighed_rows([batch], idf, {"en": 1}) for i, b, w in zip(text.tolist(), bucket.tolist(), weight.tolist(), strict=True)]
        plain = [(b, 1 + math.log(k)) for x in got for b, k in x.items()]
        lengths = [math.sqrt(sum((1 + math.log(k)) ** 2 for k in x.values())) for x in got for _ in x]
        assert [b for _, b, _ in told] == [b for b, _ in plain] and [w for *_, w in told] == pytest.approx([w / n for (_, w), n in zip(plain, lengths, strict=True)], rel=1e-5)


def plain_mix(rows, topics, power, part, targets):
    """(doc_id -> probability) by raking cell by cell in plain loops."""
    cell, tokens = {}, {}
    weight = defaultdict(float)
    for i, t, lang, source in rows:
        words = (t or "").lower().split()
        topic = -1
        if words:
            n = Counter(plain_bucket(w) for w in words)
            w = {b: (1 + math.log(k)) * topics.idf[b] for b, k in n.items()}
            length = math.sqrt(sum(x * x for x in w.values()))
            near = [sum(c[b] * x for b, x in w.items()) / length - m for c, m in zip(topics.centres, topics.means.get(lang, topics.means[None]), strict=True)]
            topic = near.index(max(near))
        cell[i], tokens[i] = (source, lang, topic), max(1, len(words))
        weight[cell[i]] += tokens[i]
    whole, wanted = sum(weight.values()), []
    for m, name in enumerate(mixing.MARGINS):
        share = defaultdict(float)
        for c, w in weight.items():
            share[c[m]] += w / whole
        given_ = targets.get(name, {})
        free = {v: s ** power[name] for v, s in share.items() if v not in given_}
        left = max(0, 1 - sum(given_[v] for v in share if v in given_))
        t = {v: given_[v] if v in given_ else left * free[v] / sum(free.values()) for v in share}
        wanted.append({v: x / sum(t.values()) for v, x in t.items()})
    fitted = {c: w / whole for c, w in weight.items()}
    for _ in range(500):
        for m in range(3):
            now = defaultdict(float)
            for c, f in fitted.items():
                now[c[m]] += f
            fitted = {c: f * wanted[m][c[m]] / now[c[m]] if now[c[m]] else 0 for c, f in fitted.items()}
    factor = {c: fitted[c] * whole / weight[c] for c in fitted}
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        kept = sum(w * min(1, mid * factor[c]) for c, w in weight.items())
        low, high = (mid, high) if kept < part * whole else (low, mid)
    return {i: (cell[i], tokens[i], min(1, high * factor[cell[i]])) for i in cell}


@pytest.mark.parametrize("targets", [{}, {"source": {"web": 0.5, "news": 0.3}, "lang": {"de": 0.4, "en": 0.6}}])
def test_mixture_equals_plain_raking(spark, targets):
    rng = random.Random(7)
    rows = [(i, None if i == 5 else prose(i, rng.randrange(20, 90)), rng.choice(["en", "de"]), rng.choice(["web", "web", "book", "news", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    topics = mixing.fit_topics(df, topics=3)
    want = plain_mix(rows, topics, mixing.POWER, 0.5, targets)
    for r in mixing.mix(df, part=0.5, targets=targets, topics=topics).collect():
        cell, n, p = want[r.doc_id]
        assert (r.mixture.topic, r.mixture.n_tokens) == (cell[2], n) and r.mixture.probability == pytest.approx(p, abs=1e-5)


def test_topics_are_groups_of_words(spark):
    themes = [["ship", "harbour", "sail", "anchor", "tide"], ["flour", "oven", "dough", "yeast", "crust"], ["verse", "rhyme", "stanza", "metre", "sonnet"]]
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(themes[i % 3] if rng.random() < 0.4 else ["the", "a", "of", "and", "was"]) for _ in range(60)), "en" if i % 2 else "de") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    got = {r.doc_id: r.mixture.topic for r in mixing.mix(df, topics=mixing.fit_topics(df, topics=3)).collect()}
    assert sum(max(Counter(got[i] for i in range(240) if i % 3 == k).values()) for k in range(3)) >= 0.95 * 240 and len(set(got.values())) == 3


def test_topics_are_fitted_on_all_texts(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"{'xyz'[i % 3]}{rng.randrange(12)}" if rng.random() < 0.5 else f"w{rng.randrange(30)}" for _ in range(40)), "rare" if i % 150 == 7 else ["en", "de", None][i % 3]) for i in range(600)]
    rows += [rows[4], rows[4], (601, None, "en"), (602, " \n ", "de")]
    topics = mixing.fit_topics(spark.createDataFrame(rows, "doc_id long, text string, lang string"), topics=3, most_rows=30)
    texts = sorted({(t, la or "") for _, t, la in rows if t and t.strip()})
    dense = np.zeros((len(texts), mixing.BUCKETS))
    for i, (t, _) in enumerate(texts):
        for b, n in Counter(map(plain_bucket, t.split())).items():
            dense[i, b] = (1 + math.log(n)) * topics.idf[b]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    langs = np.array([la for _, la in texts])
    means = {la: dense[langs == la].mean(0) for la in ("en", "de", "rare")} | {"": dense.mean(0)}
    assert set(topics.means) == {None, "en", "de", "rare"}
    for la, m in means.items():
        assert np.allclose(topics.means[la or None], topics.centres @ m, atol=1e-4)
    # another round over all texts changes little
    y = dense - np.stack([means[la] for la in langs])
    near = (y @ topics.centres.T).argmax(1)
    moved = np.stack([y[near == k].sum(0) for k in range(3)])
    moved /= np.linalg.norm(moved, axis=1, keepdims=True)
    assert (moved * topics.centres).sum(1).min() > 0.99


def test_a_result_without_texts_is_the_same(spark):
    rows = [(i, None if i == 5 else prose(i, 9), "en" if i % 2 else None, "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one, two = (mixing.mix(df, keep_text=k).select("doc_id", "lang", "source", "mixture.*").orderBy("doc_id").collect() for k in (True, False))
    assert one == two


# --- 8 language

def test_language_sums_and_decoding_equal_plain_loops(spark):
    texts = ["Das Haus, und 12 Gärten!", "a", "", "the house and the garden", "ñandú, señor"]
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(len(language.ORDERS) << language.BITS, 3)).astype(np.float32)
    raw = [t.encode() for t in texts]
    sums, count = language.bit_sums(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), weights)
    for i, t in enumerate(raw):
        letters = [b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in t]
        total, n = np.zeros(3), 0
        for slot, order in enumerate(language.ORDERS):
            for k in range(len(letters) - order + 1):
                h = letters[k]
                for b in letters[k + 1 : k + order]:
                    h = h * 0x01000193 % 2**32 ^ b
                total += weights[(h * 0x9E3779B1 % 2**32 >> 32 - language.BITS) + (slot << language.BITS)]
                n += 1
        assert count[i] == n and sums[i] == pytest.approx(total, abs=1e-4)
    code = language.codewords(4)
    model = language.Model(list("abcd"), code, weights, rng.uniform(0.5, 2, code.shape[1]))
    evidence = rng.normal(size=(20, code.shape[1])) * 5
    best, score, _ = model.decode(evidence * np.sqrt(10), np.full(20, 10.0))
    for i in range(20):
        loss = [sum(w * math.log1p(math.exp(-e * c)) for w, e, c in zip(model.bit_weight, evidence[i], row, strict=True)) for row in code]
        p = [math.exp(min(loss) - x) for x in loss]
        assert best[i] == int(np.argmin(loss)) and score[i] == pytest.approx(max(p) / sum(p), rel=1e-6)


def test_few_rows_and_languages_without_text(spark):
    rows = [(1, "the house and the garden", "en"), (2, "there was a window in the house", "en"), (3, "das haus und der garten", "de"), (4, "dort war ein fenster in dem haus", "de"), (5, None, "xx"), (6, "123", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True))
    assert model.langs == ["de", "en"]
    got = {r.doc_id: r.language.lang_pred for r in language.identify(df, model).collect()}
    assert got == {1: "en", 2: "en", 3: "de", 4: "de", 5: "und", 6: "und"}
    none = language.fit(df.filter("doc_id > 4"), F.lit(True))
    assert [r.language.lang_pred for r in language.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), none).collect()] == ["und"]
    many = spark.createDataFrame([(i, f"{FOREIGN} {i}", f"l{i % 30:02d}") for i in range(90)], df.schema)
    assert language.fit(many, F.lit(True), most_langs=7).langs == [f"l{i:02d}" for i in range(7)]


# --- 9 toxicity

LETTERS = {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5", "t": "7"}


def disguise(word, k):
    if k == 0:
        return "".join(LETTERS.get(c, c) for c in word)
    if k == 1:
        return ".".join(word)
    if k == 2:
        return "".join(c * 3 if c in "aeiou" else c for c in word)
    return "*".join(LETTERS.get(c, c) for c in word)


def test_disguised_words_count_as_what_they_are(spark, monkeypatch):
    mean = ["idiot", "stupid", "moron", "pathetic"]
    rows = [(i, f"{prose(i, 40)} {'you ' + mean[i % 4] + ' one' if i % 3 == 0 else 'you kind one'} {prose(i + 1, 40)}") for i in range(360)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int"), F.lit(True))

    def caught():
        texts = [f"{prose(900 + i, 40)} you {disguise(mean[i % 4], i // 4 % 4)} one {prose(950 + i, 40)}" for i in range(48)]
        return np.mean([s >= 0.5 for s in model.score(np.array([model.evidence(t, toxicity.Words(model.weight)) for t in texts]))])

    assert caught() >= 0.9
    clean = [f"{prose(800 + i, 40)} you kind one {prose(850 + i, 40)} in 2024, at 12:30, 4 of 5." for i in range(40)]
    assert np.mean([s >= 0.5 for s in model.score(np.array([model.evidence(t, toxicity.Words(model.weight)) for t in clean]))]) <= 0.05
    monkeypatch.setattr(toxicity, "disguised", lambda word: False)
    assert caught() <= 0.3


def test_viterbi_finds_the_best_of_all_paths():
    counts = Counter()
    for w in ["idiot", "stupid", "solid", "bold", "toil"] * 20:
        counts.update(("^^" + w + "$")[i : i + 3] for i in range(len(w) + 1))
    chars = toxicity.CharModel.of({k: float(v) for k, v in counts.items()})

    def cost(text):
        s = "^^" + text + "$"
        return sum(chars.cost(*s[i : i + 3]) for i in range(len(s) - 2))

    for word in ("1d10t", "$0l1d", "b-0.1d", "t*0*1*l", "5tup!!d", "s@@o", "6_6_6_b", "111|||111"):
        runs = [(c, len(list(g))) for c, g in itertools.groupby(word)]
        paths = ((sum(p for _, p in way) + cost("".join(e for e, _ in way)), "".join(e for e, _ in way)) for way in itertools.product(*(toxicity._options(c, n) for c, n in runs)))
        best = min(paths)[0]
        got = toxicity.restore(word, chars)
        ways = [sum(p for _, p in way) for way in itertools.product(*(toxicity._options(c, n) for c, n in runs)) if "".join(e for e, _ in way) == got]
        assert min(ways) + cost(got) == pytest.approx(best)


# --- 10 HTML

def plain_scores(blocks):
    """The scores in plain loops."""
    groups = {}
    for p, _, text, link in blocks:
        groups.setdefault(p, []).append((text, link))
    ratios = [(sum(len(t) for t, _ in g) / len(g), sum(sum(t.count(c) for c in ".,;:!?…。，、؟") for t, _ in g) / len(g)) for g in groups.values()]

    def smooth(k):
        x = [r[k] for r in ratios]
        return x if len(x) < 3 else [0.2 * x[max(i - 1, 0)] + 0.6 * x[i] + 0.2 * x[min(i + 1, len(x) - 1)] for i in range(len(x))]

    out = {}
    for p, t, c in zip(groups, smooth(0), smooth(1), strict=True):
        n, linked = sum(len(t) for t, _ in groups[p]), sum(x for _, x in groups[p])
        out[p] = math.sqrt(t * (1 + c) * (1 - linked / n) ** 2 * math.log1p(n))
    return out


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the test tables")
def test_path_scores_of_given_pages():
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"])["html"].to_pylist():
        found = html_text.Page(page or "").blocks
        assert not found or html_text.path_scores(found) == pytest.approx(plain_scores(found))


STORY = [f"The {prose(i, 30)}. It was so, they said, {prose(i + 50, 20)}." for i in range(5)]


@pytest.mark.parametrize("around", ["<div><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "<section class='x12'>{}</section>", "<div id=q><div id=r><div>{}</div></div></div>"])
def test_pages_without_telling_names(around):
    links = "<ul>" + "".join(f"<li><a href='/{k}'>Page {k}</a></li>" for k in range(12)) + "</ul>"
    page = f"<html><body>{links}{around.format('<h2>A head</h2>' + ''.join(f'<p>{p}</p>' for p in STORY))}<p><small><a href='/i'>Imprint</a></small></p></body></html>"
    assert html_text.main_text(page).split("\n") == ["A head", *STORY]


ASIDE = "<p>Buy this now, it is good, and cheap, they say. Or that, or a third one, which is new, and larger.</p>" * 8
SHORT = "<p>One thing was so.</p>"


@pytest.mark.parametrize("page", [
    f"<article><p>One thing was so.</p></article><aside>{ASIDE}</aside>",
    f"<article>{SHORT}</article><section class='comments'>{ASIDE}</section>",
    f"<div class='cookie-banner'>{ASIDE}</div><article>{SHORT}</article>",
    f"<div>{SHORT}</div><div role='dialog'>{ASIDE}</div>",
    f"<main>{SHORT}<div class='comment byuser odd'>{ASIDE}</div></main>",
    f"<div class='article'>{SHORT}<div class='comment'><p>So I think, too.</p></div></div>",
    f"<div class='article'>{SHORT}<ul class='share links'><li>Tell them.</li></ul></div>",
    f"<article>{SHORT}<article class='comment' id='c7'>{ASIDE}</article></article>",
    f"<div class='nav-wrapper'><header><p>A site.</p></header><div>{SHORT}</div></div>",
    f"<header><h1>A site</h1></header><article><header><p class='byline'>By one.</p></header>{SHORT}<footer><p>Filed.</p></footer></article>",
])
def test_what_is_beside_the_text_goes_however_long(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == "One thing was so."


@pytest.mark.parametrize("inner", ["<section class='related work-section'><h2>Work</h2><p>{}</p></section>", "<div class='notice-of-results'>{}</div>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>",
                                   "<table><tr><td>{}</td></tr></table>", "<div><p>{}</p></div>", "<figure><figcaption>{}</figcaption></figure>"])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div><div>{}</div></div>", "<div id='x'>{}</div>"])
def test_short_blocks_inside_the_text_stay(inner, around):
    short = "It was shown, in short, that all of it holds."
    story = [f"<p>{p}</p>" for p in STORY]
    page = around.format("".join(story[:2]) + inner.format(short) + "".join(story[2:]))
    got = html_text.main_text(f"<nav><a href='/'>Home</a></nav><div><p><a href='/x'>Other</a></p></div>{page}<div><p><a href='/i'>Imprint</a></p></div>").split("\n")
    assert [t for t in got if t != "Work"] == [*STORY[:2], short, *STORY[2:]]


def test_ratios_select_where_nothing_is_marked(monkeypatch):
    """Pages without telling names or elements: text is found by its ratios, and with all paths alike it isn't."""
    links = "".join(f"<li><a href='/{k}'>Page {k}, and more of it</a></li>" for k in range(20))
    crumbs = "".join(f"<span>Part {k}</span><div>Box {k}</div>" for k in range(30))
    pages = []
    for around in ("<div><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "<section>{}</section>"):
        body = around.format("".join(f"<p>{p}</p>" for p in STORY))
        pages += [f"<body><ul>{links}</ul>{body}</body>", f"<body><div>{crumbs}</div>{body}<div>{crumbs}</div></body>", f"<body>{body}<table><tr><td><ul>{links}</ul></td></tr></table></body>"]
    assert [html_text.main_text(p).split("\n") for p in pages] == [STORY] * len(pages)
    monkeypatch.setattr(html_text, "path_scores", lambda blocks: {p: 1.0 for p, *_ in blocks})
    assert sum(html_text.main_text(p).split("\n") != STORY for p in pages) * 3 >= len(pages)


def test_open_elements_lose_no_text():
    for broken in ("<svg>", "<select><option>", "<object data='x'>", "<textarea>", "<title>", "<iframe src=x>", "<a href='x>", "<!-- note -->", "<noscript>"):
        page = f"<body><div><p>{STORY[0]}</p>{broken}" + "".join(f"<p>{p}</p>" for p in STORY[1:]) + "</div></body>"
        got = html_text.main_text(page).split("\n")
        assert [t for t in got if t in STORY][-3:] == STORY[2:], broken
    assert "A sum x+y is." in html_text.main_text("<p>A sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> is.</p>")


@pytest.mark.parametrize("piece", ["<script x='", "<div>", "<!--", "<", "<p a=\"'>", "<p>x<svg>", "<li>a<textarea>", "<h1>", "</div><div a='>'", "<h1><p>", "<li><div>", "<div class=ad>", "<article><p>a", "<header>"])
def test_hostile_pages_take_little_time(piece):
    import time

    page, began = piece * (1_000_000 // len(piece)), time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 10  # a second or two on a quiet machine; quadratic work would take hours


# --- all: repeated rows and clashing columns

def test_operators_leave_other_columns_alone(spark):
    df = docs(spark, [*ODD, *(prose(i) for i in range(30))])
    df = df.unionByName(df.limit(3)).withColumns({c: F.lit("x") for c in ("own", "cell", "p", "ids", "mixture", "unl", "pos", "__key", "toxic", "quality", "check")})
    labels = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(38)] + [(3, 1, 1), (None, 1, 1)], TABLES["labels"])
    made = {
        "a1": quality.score(df, quality.fit(df, labels, F.lit(True)), into="a1"), "a4": bpe.encode(df, into="a4"), "a5": fingerprint.fingerprint(df, into="a5"), "a7": mixing.mix(df, into="a7"),
        "a8": language.identify(df, language.fit(df, F.lit(True)), into="a8"), "a9": toxicity.score(df, toxicity.fit(df, labels, F.lit(True)), into="a9"),
    }
    for into, out in made.items():
        assert out.columns == [*df.columns, into]
        assert Counter(r.doc_id for r in out.filter("own = 'x' and cell = 'x' and id = 7").collect()) == Counter(r.doc_id for r in df.collect())
    assert minhash.near_duplicates(df).count() == df.count() == fingerprint.compare_with_edit(df).count()
    assert vectors.near_duplicates(spark.createDataFrame([(1, [1.0], 1, 2), (1, [1.0], 1, 2)], "vec_id long, embedding array<double>, label int, id int")).count() == 2
