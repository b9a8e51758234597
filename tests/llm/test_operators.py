"""The training-data operators on small, hand-made tables: edge cases, and brute force where SQL can't say it."""

import gzip
import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprint, fixity, html_text, language, minhash, mixing, quality, toxicity, vectors
from tessera.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, bands string, id long"
WORDS = ["river", "stone", "window", "garden", "letter", "market", "winter", "morning", "paper", "silver", "bridge", "candle"]
LONG = "Many long words follow here. " * 20_000


def docs(spark, texts, lang="en"):
    rows = [(i, t, lang, "web", None if t is None else len(t), "x", "y", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


ODD = [None, "", " ", "a", "same text twice over here now", "same text twice over here now", "日本語 🙂 é", LONG]


# --- 1 quality

def test_quality_learns_from_positives_and_keeps_rows(spark):
    good = [f"The {prose(i, 40)}. It was {prose(i + 1, 30)}." for i in range(120)]
    bad = [("BUY NOW!!! " * 30) + str(i) for i in range(60)]
    df = docs(spark, [*good, *bad, *ODD])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)] + [(None, 1, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, F.lit(True))
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert len(got) == df.count() and all(0 <= s <= 1 for s in got.values())
    assert got[180] == 0 and got[181] == 0
    assert np.mean([got[i] for i in range(120)]) > np.mean([got[i] for i in range(120, 180)]) + 0.3


def test_quality_without_labels_or_rows(spark):
    df, none = docs(spark, ["a b c"]), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(df, quality.fit(df, none, F.lit(True))).count() == 1
    assert quality.score(df.limit(0), quality.fit(df.limit(0), none, F.lit(True))).count() == 0


def test_class_prior_is_between_bounds():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    assert abs(quality.class_prior(pos, np.concatenate([pos[:1200], neg[:2800]])) - 0.3) < 0.1


# --- 2 embeddings

def brute_vectors(rows, t=0.98):
    fine = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {i: set() for i, _, _ in rows}
    for (i, a, x), (j, b, y) in itertools.combinations(fine, 2):
        if x == y and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= t:
            near[i].add(j)
            near[j].add(i)
    root = {i: i for i in near}
    for _ in near:
        root = {i: min([root[i], *(root[j] for j in near[i])]) for i in near}
    return {i: (len(near[i]), root[i]) for i in near}


ODD_VECTORS = [(202, [0.0] * 16), (203, [1.0, None] * 8), (204, [float("nan")] * 16), (205, [float("inf")] * 16), (210, [1e200] * 16), (211, [2e200] * 16), (212, [1e-200] * 16), (213, [5e-324] * 16)]


@pytest.mark.parametrize("group, large", [(8192, 1 << 20), (20, 1 << 20), (20, 60)])
def test_vectors_equal_brute_force(spark, group, large):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=16) * (0.02 + 0.03 * (i % 5))], "a" if i % 3 else "b") for i in range(150)]
    rows += [(200, None, "a"), (201, [], "a"), *((i, v, "a") for i, v in ODD_VECTORS), (206, rows[0][1], None), (207, rows[0][1], rows[0][2]), (208, [2 * x for x in rows[0][1]], rows[0][2])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label string, id string, n long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, group=group, large=large).collect()}
    assert got == brute_vectors([(i, v if i < 210 else [1.0] * 16, lab) for i, v, lab in rows])


def test_grid_meets_all_that_are_near_and_few_others():
    rng = np.random.default_rng(1)
    p, q, r = rng.normal(size=(300, 8)) / 8, rng.normal(size=(200, 8)) / 8, 0.07
    q[:50] = p[:50] + rng.normal(size=(50, 8)) * r / 4
    met = [pair for a, b in vectors.grid_pairs(p, q, r) for pair in zip(a.tolist(), b.tolist(), strict=True)]
    near = {(i, k) for i, k in itertools.product(range(300), range(200)) if ((p[i] - q[k]) ** 2).sum() <= r * r}
    assert near and near <= set(met) and len(met) == len(set(met)) < 0.05 * 300 * 200


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label string")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


# --- 3 fixity

def test_fixity_finds_what_differs(spark):
    rows = [("a.warc", i * 50_000, f"r{i}", f"payload {i}".encode()) for i in range(60)]
    bad = [r if r[2] != "r7" else (*r[:3], b"other") for r in rows if r[2] != "r31"] + [("b.warc", 0, "new", b"x")]
    a, b = (spark.createDataFrame(x, fixity.RECORDS) for x in (rows, bad))
    got = {(r.record_id, r.kind) for r in fixity.audit(a, b).collect()}
    assert got == {("r7", "altered"), ("r31", "missing"), ("new", "extra")}
    assert fixity.audit(a, a).count() == 0
    assert fixity.audit(a.limit(0), a.limit(0)).count() == 0


def test_fixity_reads_warc_files(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Record-ID: <u:1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    two = one + one.replace(b"u:1", b"u:2")
    files = {"x.warc": two, "x.warc.gz": gzip.compress(one) + gzip.compress(one.replace(b"u:1", b"u:2")), "late.warc": b"noise\n" + one, "empty.warc": b"", "none.warc": b"nothing\nhere"}
    files |= {"cut.warc": two[:-8], "cut.warc.gz": gzip.compress(two * 3000)[:-20], "bare.warc": b"WARC/1.0\r\nX: 1\r\n\r\n" + one, "nohead.warc": b"WARC/1.0\r\nX: 1"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {}
    for r in fixity.read_warc(spark, str(tmp_path)).orderBy("record_offset").collect():
        got.setdefault(r.warc_file.rsplit("/", 1)[1], []).append((r.record_id, r.record_offset, bytes(r.payload)))
    whole = one[:-4]
    assert got["x.warc"] == got["x.warc.gz"] == [("<u:1>", 0, whole), ("<u:2>", len(one), whole.replace(b"u:1", b"u:2"))]
    assert got["late.warc"] == [("<u:1>", 6, whole)] and not {"empty.warc", "none.warc"} & set(got)
    assert got["cut.warc"][1][2] == whole.replace(b"u:1", b"u:2")[:-4] and len(got["cut.warc.gz"]) > 1000
    assert [r[0] for r in got["bare.warc"]] == [None, "<u:1>"] and got["nohead.warc"] == [(None, 0, b"WARC/1.0\r\nX: 1")]


# --- 4 BPE

def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    lib.no_truncation(), lib.no_padding()
    texts = [*ODD, "aaaaaaaaaaaaa  \n\n\t x", "<|endoftext|> tail", "it's I'll 12345 3.14", "ﬁ‍👩‍👩‍👧 �", "x" * 5000, *(prose(i) for i in range(20))]
    df = docs(spark, texts)
    got = {r.doc_id: r.bpe for r in bpe.round_trip(df).collect()}
    back = {r.doc_id: (r.ids, r.decoded) for r in bpe.decode(bpe.encode(df)).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert back[i] == (ids, text)
        assert tuple(got[i]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# --- 5 fingerprints

def test_fingerprints_add_and_subtract():
    whole, part, rest = (fingerprint.fingerprint_of(t) for t in ("a b\nc d e\nf", "c d e", "f\na b"))
    for x, y in zip(fingerprint.add(part, rest), whole, strict=True):
        assert (x == y).all()
    for x, y in zip(fingerprint.subtract(whole, part), rest, strict=True):
        assert (x == y).all()
    assert (fingerprint.from_text(fingerprint.to_text(whole))[1] == whole[1]).all()


def test_fingerprints_of_edits_equal_brute_force(spark):
    texts = [*ODD, *(prose(i) for i in range(30))]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in fingerprint.compare_with_edit(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        p, q = fingerprint.fingerprint_of(t), fingerprint.fingerprint_of(edited)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.to_text(p), fingerprint.to_text(q))
        assert r.near_edited == pytest.approx(fingerprint.likeness(p, q)) and r.near_next == pytest.approx(fingerprint.likeness(p, fingerprint.fingerprint_of(after)))
    assert got[4].fingerprint == got[5].fingerprint
    assert fingerprint.compare_with_edit(df.limit(0)).count() == 0


# --- 6 MinHash

def near_copies():
    texts = [*ODD]
    for base in range(6):
        words = prose(100 + base, 200).split()
        texts.append(" ".join(words))
        for k in range(6):
            copy = list(words)
            copy[k * 20 : k * 20 + 1] = ["changed"]
            texts.append(" ".join(copy))
    return texts + [prose(500 + i, 200) for i in range(20)]


@pytest.mark.parametrize("group", [512, 3])
def test_minhash_equals_brute_force(spark, group):
    texts = near_copies()
    df = docs(spark, texts)
    idf = minhash.frequency_sketch(df.select("text"))
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, j in itertools.combinations(range(len(texts)), 2):
        x, y = texts[i] or "", texts[j] or ""
        if x == y or minhash.weighted_jaccard(x, y, idf) >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, group=group).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_one_of_each_stays_with_its_columns(spark):
    df = docs(spark, near_copies())
    kept = minhash.keep_one_of_each(spark, df, "")
    assert kept.columns == df.columns
    assert kept.filter("doc_id in (4, 5)").count() == 1
    assert minhash.keep_one_of_each(spark, df.limit(0), "").count() == 0


# --- 7 mixing

def test_raking_meets_its_margins():
    rng = np.random.default_rng(2)
    w = rng.uniform(1, 9, 24)
    codes, targets = [np.arange(24) % 4, np.arange(24) // 4 % 3], [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.25, 0.25])]
    f = w * mixing.rake(w, codes, targets)
    for c, t in zip(codes, targets, strict=True):
        assert np.bincount(c, f) / f.sum() == pytest.approx(t)
    p = mixing.calibrate(w, mixing.rake(w, codes, targets), 0.6)
    assert (p <= 1).all() and (p * w).sum() == pytest.approx(0.6 * w.sum())


def test_mixing_gives_every_row_a_probability(spark):
    df = docs(spark, [*ODD, *(prose(i) for i in range(200))]).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "web").when(F.col("doc_id") % 3 == 1, "book"))
    got = mixing.mix(df).collect()
    assert len(got) == df.count() and all(0 <= r.mixture.probability <= 1 for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_raking_on_frames_equals_raking_on_the_driver(spark, monkeypatch):
    cells = spark.createDataFrame([(s, la, t, 10 + 7 * i) for i, (s, la, t) in enumerate(itertools.product(["a", "b", None], ["x", "y"], [0, 1, 2]))], "source string, lang string, topic int, weight long")
    one = {tuple(r)[:3]: r.probability for r in mixing.probabilities(cells, mixing.POWER, 0.5).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 3)
    two = {tuple(r)[:3]: r.probability for r in mixing.probabilities(cells, mixing.POWER, 0.5).collect()}
    assert one.keys() == two.keys() and all(two[k] == pytest.approx(one[k], abs=1e-5) for k in one)


def test_slow_raking_on_frames_goes_on_to_the_tolerance(spark):
    cells = {("a", "x"): 900, ("a", "y"): 90, ("b", "x"): 1, ("b", "y"): 700}
    shares = {"source": {"a": 0.4, "b": 0.6}, "lang": {"x": 0.5, "y": 0.5}}
    df = spark.createDataFrame([(*k, w) for k, w in cells.items()], "source string, lang string, weight long")
    targets = {m: spark.createDataFrame(list(t.items()), f"{m} string, share double") for m, t in shares.items()}
    got = mixing.rake_frame(df, targets).collect()
    whole = sum(r.weight * r.factor for r in got)
    for m, t in shares.items():
        for value, share in t.items():
            assert sum(r.weight * r.factor for r in got if r[m] == value) / whole == pytest.approx(share, abs=1e-8)
    codes = [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    one = mixing.rake(np.array(list(cells.values()), float), codes, [np.array(list(t.values())) for t in shares.values()])
    assert {(r.source, r.lang): r.factor for r in got} == pytest.approx(dict(zip(cells, one)), abs=1e-7)
    with pytest.warns(UserWarning, match="after 2 rounds"):
        mixing.rake_frame(df, targets, rounds=2)


# --- 8 language

def test_language_codes_and_predictions(spark):
    samples = {"en": "the house and the garden with the window were there", "de": "das haus und der garten mit dem fenster waren nicht dort", "fr": "la maison et le jardin avec les fenêtres étaient là"}
    rows = [(i * 10 + k, f"{t} {prose(i * 10 + k, 5)} {t}", la, 1) for i, (la, t) in enumerate(samples.items()) for k in range(10)]
    rows += [(900, None, "en", 1), (901, "", None, 1), (902, "1234 !!", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")
    model = language.fit(df, F.lit(True))
    got = {r.doc_id: r.language for r in language.identify(df, model).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:-3])
    assert [tuple(got[k]) for k in (900, 901, 902)] == [("und", 0.0, True)] * 3
    assert language.identify(df.limit(0), model).count() == 0
    assert language.fit(df.limit(0), F.lit(True)).langs == ["und"]


def test_codewords_are_apart():
    for k in (3, 5, 9):
        c = language.codewords(k)
        assert min((a != b).sum() for a, b in itertools.combinations(c, 2)) >= (2 if k == 3 else 4)


# --- 9 toxicity

def test_disguises_are_restored():
    counts = Counter()
    for w in ["idiot", "stupid", "house", "garden"] * 30:
        s = "^^" + w + "$"
        counts.update(s[i : i + 3] for i in range(len(s) - 2))
    chars = toxicity.CharModel.of({k: float(v) for k, v in counts.items()})
    for word in ("1d10t", "i.d.i.o.t", "iiidiooot", "$tup1d"):
        assert toxicity.restore(word, chars) in ("idiot", "stupid")
    assert toxicity.spelled_apart("you i d i o t there".split()) == ["idiot"]


def test_toxicity_scores_whole_texts(spark):
    mean = ["idiot", "stupid", "scum"]
    rows = [(i, f"{prose(i, 30)} {'you ' + mean[i % 3] if i % 3 == 0 or i % 4 == 0 else ''} {prose(i + 1, 30)}", "s") for i in range(240)]
    toxic = [(i, 1, int(i % 3 == 0 or i % 4 == 0)) for i in range(240)]
    df = spark.createDataFrame([*rows, (900, None, "s"), (901, "", "s"), (902, LONG + " 1d10t idiot", "s")], "doc_id long, text string, score string")
    model = toxicity.fit(df, spark.createDataFrame(toxic, "doc_id long, quality int, toxic int"), F.lit(True))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert len(got) == 243 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(t) for i, _, t in toxic]) > 0.95
    none = toxicity.fit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert toxicity.score(df, none).filter("score < 0.01").count() == 243


def test_letters_are_counted_over_all_texts(spark):
    labelled = [f"{prose(i, 20)} {'you idiot' if i % 3 == 0 else ''} {prose(i + 1, 20)}" for i in range(90)]
    others = [f"Вечером на реке, {w}! été «garçon» 1d10t" for w in ("тихо", "холодно", "туман")] * 5
    texts = [*labelled, *others, None, ""]
    model = toxicity.fit(docs(spark, texts), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int"), F.lit(True))
    want, two = Counter(), Counter()
    for t in texts:
        for w in (t or "").lower().split():
            if (w := w.strip(toxicity.EDGE)).isalpha():
                s = "^^" + w + "$"
                want.update(s[i : i + 3] for i in range(len(s) - 2))
                two.update(s[i : i + 2] for i in range(len(s) - 2))
    assert model.chars.trigrams == want and model.chars.bigrams == two
    assert toxicity.restore("х0л0дн0".replace("0", "о" * 3), model.chars) == "холодно"


# --- 10 HTML

PAGE = """<html><head><title>T</title><style>x</style></head><body><nav><a href="/">Home</a></nav><div class="sidebar"><p>Related, links.</p></div>
<article><h1>Head &amp; line</h1><p>First   paragraph,
with <b>bold</b> text.</p><p>Second &lt;one&gt;.</p></article><div class="comments"><p>A comment, here.</p></div><footer><p>Footer.</p></footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nFirst paragraph, with bold text.\nSecond <one>."
    bare = PAGE.replace("article>", "div>")
    assert html_text.main_text(bare) == html_text.main_text(PAGE)
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html></html>") == ""
    assert html_text.main_text("<p>unclosed <b>text").startswith("unclosed text")


def test_ratios_decide_and_marks_only_weigh():
    story = [f"The {prose(i, 30)}. It was so, they said, {prose(i + 50, 20)}." for i in range(4)]
    body = "".join(f"<p>{p}</p>" for p in story)
    teaser = "<article><h2>Next</h2><p>A short one, to read later.</p></article>"
    footer = "<footer><p>Imprint, and terms of use.</p></footer>"
    for wrapper in ('<div class="story-share">', '<div id="page-banner">', "<aside>", '<section role="search">'):
        got = html_text.main_text(f"{teaser}{wrapper}{body}</{wrapper[1:].split()[0].strip('>')}>{footer}").split("\n")
        # a doubtful name doesn't keep a text out, but an element or a role says what is beside the article
        assert [t for t in got if t in story] == (story if wrapper.startswith("<div") else []) and "Imprint, and terms of use." not in got
    links = "<ul>" + "".join(f'<li><a href="/{w}">{w} and more</a></li>' for w in WORDS) + "</ul>"
    assert html_text.main_text(f"<article><h1>Head</h1>{body}{links}</article>{footer}").split("\n") == ["Head", *story]
    assert html_text.main_text(f"<article><header><h1>Head</h1></header>{body}<ul><li>One thing.</li><li>Other, too.</li></ul></article>").split("\n") == ["Head", *story, "One thing.", "Other, too."]


def test_pages_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None), (3, "u", "<p>" + LONG, "")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[2] == "" and len(got[3]) == len(LONG.strip())
