"""Operators against brute force, exact round trips, held-out accuracy, and the defined edge cases."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, decontaminate, html_extract, langid, license_scan, line_dedup, near_dedup, substring_dedup, topk, toxicity
from corpusmill.llm.common import shingles
from corpusmill.llm.queries import ORACLES, QUERIES
from oracle import agree

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EDGE = [
    (1, None), (2, ""), (3, " \n \n"), (None, "All rights reserved. " + "alpha beta gamma delta " * 20), (5, "é" * 3000), (6, "x " * 4000),
    (6, "x " * 4000), (7, "one line\nOne line \nother"), (8, "日本 語 😀")
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "extra", 1) for i, t in EDGE], "doc_id long, text string, _ld_h string, n int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    agree(spark, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf, name):
    table = "pages" if name.startswith("op4") else "documents"
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_decontaminate_edges(spark, edge, nothing):
    items = spark.createDataFrame(
        [(1, "alpha beta gamma delta alpha beta gamma delta alpha beta gamma"), (2, "One LINE"), (2, None), (None, "x x"), (9, "")],
        "item_id long, text string"
    )
    got = decontaminate.find(edge, items).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["items"] == ["1"] and by[None]["n_hit"] == 79
    assert by[7]["items"] == ["2"] and by[7]["n_hit"] == 4 and by[7]["spans"][0]["at"] == 0
    assert by[1]["n_words"] == 0 and by[1]["n_hit"] == 0
    assert by[6]["n_hit"] == 4000 and by[6]["items"] == []
    assert decontaminate.find(nothing, items).count() == 0
    assert {r["n_hit"] for r in decontaminate.find(edge, items.limit(0)).collect()} == {0}


def test_winnowing_finds_every_shared_window(spark):
    rng = random.Random(1)
    vocab = ["a", "b", "c"]
    docs = [(i, " ".join(rng.choices(vocab, k=60))) for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=12))) for i in range(60)] + [(100, docs[0][1]), (101, "a b a")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find(d, b).collect()}
    assert got == {r["doc_id"]: r for r in decontaminate.find(d, b, broadcast_windows=0).collect()}
    for i, t in docs:
        w, hit, ids = t.split(), set(), set()
        for k, s in items:
            v = s.split()
            n = min(10, len(v))
            wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wins:
                    hit.update(range(j, j + n))
                    ids.add(str(k))
        assert got[i]["n_hit"] == len(hit) and got[i]["items"] == sorted(ids)


def test_decontaminate_many_short_items(spark):
    """Items of one to three words that start at almost every word do not hide the longer span that covers them."""
    w = [f"w{i}" for i in range(30)]
    items = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(3, 8)] + [" ".join(w[2:12]), w[11], w[20]]
    frame = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.find(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string"), frame).first()
    assert [tuple(x) for x in got["spans"]] == [(2, 12), (20, 21)] and got["n_hit"] == 11


def test_line_dedup_edges(spark, edge, nothing):
    many = spark.createDataFrame([(i, f"Common\n own {i}\n common \n") for i in range(12)] + [(None, None), (50, "common")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in line_dedup.drop_lines(many).collect()}
    assert out[3]["text"] == " own 3\n" and out[3]["_ld_dropped"] == 2 and out[3]["_ld_lines"] == 4
    assert out[None]["text"] is None and out[None]["_ld_lines"] == 1
    assert out[50]["text"] == ""
    kept = line_dedup.drop_lines(edge.withColumn("_ld_lines", F.lit("mine")))
    assert kept.count() == len(EDGE) and {(r["_ld_h"], r["_ld_lines"]) for r in kept.collect()} == {("extra", "mine")}
    assert kept.where("doc_id = 7").first()["_ld_lines_"] == 3
    assert line_dedup.drop_lines(nothing).count() == 0
    bits = line_dedup.line_bitmaps(many).where("_ld_id = 3").first()
    assert line_dedup.kept_flags(bits["keep"], 4).tolist() == [False, True, False, True]


def test_line_dedup_hot_key(spark):
    """A line of every document is cut over partitions and still counted whole."""
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot\nmine "), F.col("id").cast("string")).alias("text")).repartition(8)
    out = line_dedup.drop_lines(df, min_docs=5000).agg(F.sum("_ld_dropped").alias("d"), F.max("text").alias("t")).first()
    assert out["d"] == 5000 and out["t"].startswith("mine")
    assert line_dedup.drop_lines(df, min_docs=5001).agg(F.sum("_ld_dropped")).first()[0] == 0


def test_substring_dedup_brute_force(spark, edge, nothing):
    rng = random.Random(2)
    shared = [f"s{i}" for i in range(60)]
    docs = []
    for i in range(60):
        w = [rng.choice("abcd") for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            w[10:10] = shared[rng.randint(0, 10) :]
        docs.append((i, " ".join(w)))
    docs += [(100, "x " * 200), (101, None), (102, docs[0][1]), (102, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = Counter()
    for _, t in docs:
        w = (t or "").split()
        seen.update(tuple(w[j : j + 35]) for j in range(len(w) - 34))
    want = []
    for i, t in docs:
        w = (t or "").split()
        gone = {p for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for p in range(j, j + 35)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    for options in ({}, {"hot": 3}, {"filter_bits": 6}):
        got = [tuple(r) for r in substring_dedup.drop_repeats(df, texts=False, **options).collect()]
        assert sorted(got) == sorted(want)
    assert substring_dedup.drop_repeats(edge).count() == len(EDGE)
    assert substring_dedup.drop_repeats(nothing).count() == 0


def near_pairs(texts, threshold=0.8):
    """All pairs (i, j) of texts that the exact weighted similarity links, with the weights of these texts as a table."""
    d, h, _ = near_dedup._distinct(*reversed(shingles(texts)))
    s = near_dedup.Sampler(np.bincount((h >> np.uint64(45)).astype(int), minlength=1 << 19), len(texts), 0.1, 88)
    near = s.all_similarities(texts) >= threshold - 1e-9
    return s, [(i, j) for i, j in np.argwhere(np.triu(near, 1)).tolist()]


def smallest_of_class(n, pairs):
    """For each of n things the smallest one of its class."""
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]


def test_near_dedup_brute_force(spark, edge, nothing):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(120)] for _ in range(12)]
    docs = []
    for i in range(240):
        w = list(base[i % 12])
        for _ in range(rng.choice([0, 1, 2, 6])):
            w[rng.randrange(120)] = f"n{rng.randint(0, 9999)}"
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "tiny text")]
    got = {r["id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    texts = [(t or "").encode() for _, t in docs]
    s, pairs = near_pairs(texts)
    some = rng.sample(pairs, 200) + [(a, b) for a in range(0, 240, 7) for b in range(a + 1, 240, 31)]
    x, y = [texts[a] for a, _ in some], [texts[b] for _, b in some]
    assert np.allclose(s.similarity(x, y), s.all_similarities(texts)[tuple(zip(*some, strict=True))])
    root = smallest_of_class(240, [p for p in pairs if p[1] < 240])
    assert all(got[i] == root[i] for i in range(240))
    assert got[500] == got[501] == 500 and got[502] == 502
    classes = near_dedup.near_classes(edge).collect()
    assert len(classes) == len(EDGE)
    assert near_dedup.near_classes(nothing).count() == 0
    assert near_dedup.representatives(edge).count() == len({t or "" for _, t in EDGE} - {" \n \n"}) + 1


def test_samples_estimate_the_similarity():
    """Samples agree as often as the exact weighted similarity says: no bias, and the spread of independent draws."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.choice([2, 5, 10, 20])):
            w[rng.randrange(300)] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(w + rng.choices(base, k=rng.choice([0, 60]))).encode())
    s, _ = near_pairs(texts)
    sim, (_, _, names) = s.all_similarities(texts), s.signatures(texts)
    x, y = np.triu_indices(60, 1)
    share = (names[x] == names[y]).mean(1)
    z = (share - sim[x, y]) / np.sqrt(sim[x, y] * (1 - sim[x, y]) / s.samples)
    assert abs(z.mean()) < 0.5 and 0.7 < z.std() < 1.3
    # a second set of samples, so that one lucky draw does not hide a bias
    s.turn = s.turn * np.uint64(0x9E3779B97F4A7C15)
    again = s.signatures(texts)[2]
    assert abs(((again[x] == again[y]).mean(1) - sim[x, y]).mean()) < 0.03


def test_near_dedup_large_buckets(spark):
    """More members than a bucket's pairs are listed for: still one class, and the outsider stays out."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(200):
        w = list(base)
        w[rng.randrange(150)] = f"n{i}"
        docs.append((i, " ".join(w)))
    docs.append((999, " ".join(f"z{i}" for i in range(150))))
    got = {r["id"]: r["class_id"] for r in near_dedup.near_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert Counter(got.values()) == {0: 200, 999: 1}


def test_near_dedup_one_template(spark, monkeypatch):
    """A large group of texts on one template, below 0.8 to each other but for close pairs: classes are those of brute force, in one block and in many."""
    rng = random.Random(6)
    word = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
    template, docs = word(244), []
    for i in range(400):
        shared = word(14)
        docs += [(2 * i, " ".join(template + shared + word(26))), (2 * i + 1, " ".join(template + shared + word(26)))]
    texts = [t.encode() for _, t in docs]
    s, linked = near_pairs(texts)
    some = [(" ".join(rng.choices("abc", k=rng.randrange(60)))).encode() for _ in range(40)] + texts[:20]
    x, y = np.triu_indices(60, 1)
    assert np.allclose(s.all_similarities(some, 3, 7)[x, y], s.similarity([some[i] for i in x], [some[i] for i in y]))
    assert set(linked) == {(2 * i, 2 * i + 1) for i in range(400)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (512, 60):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {r["id"]: r["class_id"] for r in near_dedup.near_classes(frame).collect()}
        assert got == {i: i // 2 * 2 for i, _ in docs}


def test_bpe_equals_the_library(spark, sf, edge, nothing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.tokenizer_path())
    codec = bpe.Codec(bpe.Vocabulary.read().spec, cache=500)
    rng = random.Random(5)
    parts = ["the", "ing", "'ll", "É", "ΑΣ", "ǅ", "½", "٣", "漢字", "😀", "!!!", "<|endoftext|>", "<|start", "\x85", "\xa0", "é", "\n", "K", "ﬁ", "a" * 70] + list("abc XYZ.,0")
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(800)] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    ids, shown = codec.encode(texts)
    for t, i, s in zip(texts, ids, shown, strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert i == " ".join(map(str, want))
        assert s == lib.decode(want, skip_special_tokens=False)
    out = bpe.encode(edge).select("doc_id", "_bpe.*").collect()
    assert len(out) == len(EDGE) and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert bpe.encode(nothing).count() == 0
    assert bpe.encode(edge.withColumnRenamed("n", "_bpe")).select("_bpe", "_bpe_.n_tokens").count() == len(EDGE)
    assert bpe.decode(lib.encode("some words", add_special_tokens=False).ids, bpe.Vocabulary.read()) == lib.decode(
        lib.encode("some words", add_special_tokens=False).ids, skip_special_tokens=False
    )


def test_bpe_all_planes():
    """Every code point, between letters, digits and marks; three combining marks whose order changed between versions of Unicode are left out."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.tokenizer_path())
    codec = bpe.Vocabulary.read().codec
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and c not in (0x1DF6, 0x1E4EC, 0x1E4ED)]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)}!{chr(c)}é{chr(c)}\u0301 " for c in points[i : i + 50]) for i in range(0, len(points), 50)]
    for i in range(0, len(texts), 2000):
        want = lib.encode_batch(texts[i : i + 2000], add_special_tokens=False)
        assert codec.encode(texts[i : i + 2000])[0] == [" ".join(map(str, w.ids)) for w in want]


def test_bpe_long_word():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.tokenizer_path())
    word = "".join(random.Random(3).choices("abcdefg", k=5000))
    assert bpe.Vocabulary.read().codec.encode([word])[0] == [" ".join(map(str, lib.encode(word, add_special_tokens=False).ids))]


def test_language_id(spark, sf, edge, nothing):
    got = QUERIES["op6_language_id"](spark, sf.replace("0.001", "0.01")).join(
        spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    model = langid.train([("en", "the cat and the hat " * 30), ("fr", "le chat et la souris " * 30)])
    out = {r["doc_id"]: r["_lang"] for r in langid.identify(edge, model).collect()}
    assert out[1]["pred"] == out[2]["pred"] == out[3]["pred"] == "und" and out[1]["score"] == 0
    assert 0 <= out[6]["score"] <= 1 and out[6]["pred"] in ("en", "fr")
    assert langid.identify(edge, {}).where("_lang.pred <> 'und'").count() == 0
    assert langid.identify(nothing, model).count() == 0 and langid.fit(nothing) == {}
    assert langid.classify(["½²", "① ٣", "Ⅷ", "_", "ñ", "字"], model)[0][:4] == ["und"] * 4
    assert "und" not in langid.classify(["ñ", "字"], model)[0]
    clash = langid.identify(edge.withColumnRenamed("n", "_lang"), model).where("doc_id = 1").first()
    assert clash["_lang"] == 1 and clash["_lang_"]["pred"] == "und"


def test_context_tree_is_a_distribution():
    tree = langid.ContextTree([b"abracadabra, abracadabra. the cat sat on the mat" * 5], 3)
    cost = tree.cost.reshape(tree.states, -1)[:, : tree.symbols]
    total = np.exp(-cost.astype(float)).sum(1)
    assert (total < 1.0001).all() and total[0] > 0.9


def test_toxicity_held_out(spark, edge, nothing):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op2_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in scored)
    assert hit / sum(r["toxic"] for r in scored) > 0.8
    assert hit / sum(r["predicted"] for r in scored) > 0.85
    rows = [(1, f"you are an idiot number {i} of the kind we know") for i in range(60)] + [(0, f"we are in a house number {i} of the kind we know") for i in range(60)]
    m = toxicity.Machine(rows)
    clean, plain, spelled, doubled = toxicity.score(["we know the house", "what an idiot", "what an i.d.i.o.t", "what an idiiot"], m)
    assert clean < 0.5 < min(plain, spelled) and doubled > clean
    out = toxicity.rate(edge, m).collect()
    assert len(out) == len(EDGE) and all(0 <= r["_tox"] <= 1 for r in out)
    assert toxicity.rate(nothing, toxicity.Machine([])).count() == 0
    assert {r["_tox"] for r in toxicity.rate(edge.withColumnRenamed("n", "_tox"), m).collect()} == {1}
    assert toxicity.score(["we are in a house id iot number of the kind"], m)[0] > 0.5
    assert toxicity.split_words("We are in a house, id i-ot number.", m.common) == {"idiot"}
    assert toxicity.split_words("we are in a house id. Iot number", m.common) == toxicity.split_words(None, m.common) == set()


def test_toxicity_machines_do_not_share_margins():
    """A machine built where a freed one lay keeps its own answers."""
    rows = lambda bad: [(1, f"you are an {bad} number {i} of the kind we know") for i in range(60)] + [
        (0, f"we are in a house number {i} of the kind we know") for i in range(60)
    ]
    first = toxicity.Machine(rows("idiot"))
    assert toxicity.score(["what idiot"], first)[0] > 0.5
    del first
    for _ in range(3):
        other = toxicity.Machine(rows("blockhead"))
        assert toxicity.score(["what idiot"], other)[0] < 0.5 < toxicity.score(["what blockhead"], other)[0]
        del other


def test_support_vector_solver():
    """The Newton steps reach the minimum that plain gradient descent on the same objective reaches."""
    rng = np.random.default_rng(4)
    x = np.c_[rng.normal(size=(80, 5)), np.ones(80)]
    y = np.sign(x[:, 0] + 0.5 * rng.normal(size=80))
    weight = np.where(y > 0, 2.0, 1.0)

    def value(w):
        return 0.5 * (w[:-1] ** 2).sum() + 0.5e-6 * w[-1] ** 2 + 0.5 * (weight * np.maximum(1 - y * (x @ w), 0) ** 2).sum()

    w = np.zeros(6)
    for _ in range(20_000):
        slack = np.maximum(1 - y * (x @ w), 0)
        w -= 2e-3 * (np.r_[w[:-1], 1e-6 * w[-1]] - x.T @ (weight * slack * y))
    assert abs(value(toxicity.solve(x, y, weight)) - value(w)) < 1e-6


def test_kernel_against_definition():
    words = ["idiot", "idxiot", "abc"]
    a = toxicity.Alphabet(words)
    k = toxicity.kernel(words, a, toxicity.Table(words, a))

    def phi(w):
        s, out = "^" + w + "$", Counter()
        for i in range(len(s)):
            for b in range(2, toxicity.REACH + 1):
                for j in range(1, b):
                    if i + b < len(s):
                        out[s[i], s[i + j], s[i + b]] += toxicity.DECAY ** (b + 1)
        n = sum(toxicity.DECAY ** (2 * b + 2) * (len(s) - b) * (b - 1) for b in range(2, toxicity.REACH + 1) if len(s) > b) ** 0.5
        return {t: v / n for t, v in out.items()}

    for i, x in enumerate(words):
        for j, y in enumerate(words):
            p, q = phi(x), phi(y)
            assert abs(k[i, j] - sum(v * q.get(t, 0) for t, v in p.items())) < 1e-4


def test_html():
    m = html_extract.default_model()
    page = '<html><head><title>T</title><script>x="<p>no</p>"</script></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy now.</div><article><h1>Head &amp; line</h1><p><b>First   words here.<br><p>Second one.</p><!-- c --></article><form>Name<input></form><footer>&copy; x</footer>'
    text = html_extract.extract([page, None, "", "plain &lt;text&gt;"], m)
    assert text[0] == "Head & line\nFirst words here.\nSecond one."
    assert text[1] == text[2] == ""
    hold = html_extract.labelled_pages(60, seed=77)
    p = m.marginals([q for q, _ in hold]) > 0.5
    y = np.array([v for _, ys in hold for v in ys])
    t = np.array([x is not None and not x.isspace() for q, _ in hold for x in q.text])
    assert (p == y)[t].mean() > 0.85
    for junk in ("<", "<<<p", "</p></div>", "<p", '<a href="', "<script>", "<!--", "&#0;&bad;"):
        html_extract.extract([junk], m)


_BODY = "<p>Body text stands here, plain and long.</p>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><h1>T</h1>{_BODY}</article><form action=x><p>Give us your mail please.</p><input></form>", "T\nBody text stands here, plain and long."),
        (
            f'<body><div class="gdpr-consent"><p>We use cookies to make this better. Accept all.</p></div><article>{_BODY}</article></body>',
            "Body text stands here, plain and long."
        ),
        (f'<article><h1>T</h1>{_BODY}</article><div id="disqus_thread"><p>I do not agree with this at all.</p></div>', "T\nBody text stands here, plain and long."),
        (f"<div><div id=rail><p>Other things that you may like to read now.</p></div><article>{_BODY}</article></div>", "Body text stands here, plain and long."),
        (
            f'<article>{_BODY}<a href="/x"><p>A linked paragraph of the article itself.</p></a></article>',
            "Body text stands here, plain and long.\nA linked paragraph of the article itself."
        ),
        ("<p>Only a paragraph.</p>", "Only a paragraph."),
        ("<h1>Head</h1><p>One here.</p><p>Two here.</p>", "Head\nOne here.\nTwo here."),
        (f"<form id=frame><div class=nav><ul><li><a href=x>Home</a></li></ul></div><article><h1>T</h1>{_BODY}</article></form>", "T\nBody text stands here, plain and long."),
        (
            f"<nav><ul><li><a href=a>A</a></li></ul></nav><main>{_BODY}<ul><li>Item one.</li><li>Item two.</li></ul></main><footer>&copy; 2020</footer>",
            "Body text stands here, plain and long.\nItem one.\nItem two."
        ),
    ],
)
def test_html_kinds(page, want):
    assert html_extract.extract([page], html_extract.default_model()) == [want]


def test_html_table(spark):
    """Nulls, repeated rows, clashing columns and empty tables; blocks of held-out pages; nesting and unclosed tags in time."""
    import time

    rows = [(1, "u", None, 1), (2, None, "", 2), (3, "u", "<p>Only a paragraph.</p>", 3), (3, "u", "<p>Only a paragraph.</p>", 3), (None, "u", "<script>x</script>", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _main int")
    out = html_extract.extract_text(df).collect()
    assert sorted((r["_main"], r["_main_"]) for r in out) == [(1, ""), (2, ""), (3, "Only a paragraph."), (3, "Only a paragraph."), (4, "")]
    assert html_extract.extract_text(df.limit(0)).count() == 0
    m, hold = html_extract.default_model(), html_extract.labelled_pages(100, seed=78)
    p, base, right, wrong, missed = m.marginals([q for q, _ in hold]) > 0.5, 0, 0, 0, 0
    for page, label in hold:
        n = len(page.tag)
        got, want = (Counter(html_extract.render(page, np.array(y, bool)).split("\n")) for y in (p[base : base + n], label))
        right, wrong, missed, base = right + (got & want).total(), wrong + (got - want).total(), missed + (want - got).total(), base + n
    assert right / (right + wrong) > 0.96 and right / (right + missed) > 0.95
    began = time.time()
    html_extract.extract(["<div>" * 20_000 + "x", '<a "' * 20_000, "<p>" * 20_000, "<li><b>" * 20_000], m)
    assert time.time() - began < 20


def test_marginals_against_enumeration():
    m = html_extract.default_model()
    page = html_extract.Page("<div class=content><p>Some words here.<a href=x>link</a></p></div>")
    parent, _, tag, _, feats = html_extract.evidence([page])
    kind = html_extract.moving(parent, tag)
    own = m.temper * sum(t.T[f] for t, f in zip(m.seen, feats, strict=True))
    own[:, 1] += np.clip([sum(m.word.get(w, 0) for w in ws) for ws in page.words], -8, 8)
    n, total = len(parent), np.zeros((len(parent), 2))
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        s = sum(own[i, y[i]] + (m.move[kind[i], y[parent[i]], y[i]] if parent[i] >= 0 else (0.0, -50.0)[y[i]]) for i in range(n))
        for i in range(n):
            total[i, y[i]] += np.exp(s)
    assert np.allclose(m.marginals([page]), total[:, 1] / total.sum(1), atol=1e-6)


def _licence_matches(w, frequencies, most=6):
    """Labels and score by trying every place of every template."""
    labels, best = set(), 0.0
    for label, text, phrase in license_scan.TEMPLATES:
        t, key = WORD.findall(lower(text)), phrase.split()
        first = {x: t.index(x) for x in t}
        looked = sorted((x for x in first if x in w), key=lambda x: (frequencies.get(x, 0), first[x]))[:most]
        key_at = next(i for i in range(len(t)) if t[i : i + len(key)] == key)
        for o in range(-len(t), len(w) if looked else -len(t)):
            votes = sum(0 <= o + first[x] < len(w) and w[o + first[x]] == x for x in looked)
            if votes and 2 * votes >= len(looked) and o + key_at >= 0 and w[o + key_at : o + key_at + len(key)] == key:
                labels.add(label)
                best = max(best, votes / len(looked))
    return labels, best


def test_license_brute_force(spark, sf, edge, nothing):
    rng = random.Random(9)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for i in range(60):  # cut, edited and mixed licence texts
        parts = []
        for _ in range(rng.randint(1, 3)):
            t = rng.choice(license_scan.TEMPLATES)[1].split()
            a = rng.randint(0, len(t) // 3)
            t = t[a : rng.randint(a + 1, len(t))]
            for _ in range(rng.choice([0, 0, 1, 4])):
                t[rng.randrange(len(t))] = rng.choice(["x", "license", "software"])
            parts.append(" ".join(t))
        texts[10_000 + i] = "\n".join(parts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    words = {i: WORD.findall(lower(t)) for i, t in texts.items()}
    frequencies = Counter(x for w in words.values() for x in set(w))
    found = 0
    for r in license_scan.scan(df).select("doc_id", "_lic.*").collect():
        w = words[r["doc_id"]]
        at, labels = [], set()
        for p, label in license_scan.BASE:
            v = p.split()
            hits = [i for i in range(len(w) - len(v) + 1) if w[i : i + len(v)] == v]
            at += hits
            labels |= {label} if hits else set()
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted(labels))
        more, share = _licence_matches(w, frequencies)
        found += bool(more)
        assert r["labels"] == ",".join(sorted(labels | more))
        assert r["score"] == (1.0 if labels else share)
    assert found >= 30
    more = spark.createDataFrame(
        [(1, "cc by cc by x cc by"), (2, "Licensed under the Apache License, Version 2.0."), (3, "the apache flew over the license"), (4, None)],
        "doc_id long, text string"
    )
    got = {r["doc_id"]: r["_lic"] for r in license_scan.scan(more).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (3, 0, 5)
    assert got[2]["labels"] == "apache-2.0" and got[2]["score"] == 1.0 and got[3]["labels"] == "" and got[4]["n_words"] == 0
    assert license_scan.scan(edge).count() == len(EDGE) and license_scan.scan(nothing).count() == 0
    clash = license_scan.scan(more.withColumn("_lic", F.lit(7)).withColumn("words", F.lit("mine"))).first()
    assert clash["_lic"] == 7 and clash["words"] == "mine" and clash["_lic_"]["n_base"] == 3


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (50, [0.5, 0.5]), (50, [0.5, 0.5]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (7, None), (8, [1.0, None]), (9, [nan, 1.0]),
        (10, [inf, 1.0]), (100, [0.0]), (None, [1.0, 1.0])
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("q"))
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got[0]) == [(1, 2, 65536), (2, 3, 65536), (3, 50, 32768)]
    assert sorted(got[50])[0] == (1, 0, 32768) and len(got[100]) == 3
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    # two query rows of one id compete for its ranks, whatever the blocks
    twice = spark.createDataFrame([(50, [256, 0]), (50, [0, 256]), (1, [256, 0]), (2, [0, 512]), (3, [])], "vec_id long, q array<long>")
    for block in (1, 4096):
        out = topk.top_k(twice, twice.where("vec_id = 50"), 2, query_block=block, block_rows=1 if block == 1 else 1024, broadcast_bytes=block - 1).orderBy("rank").collect()
        assert [tuple(r) for r in out] == [(50, 1, 2, 131072), (50, 2, 1, 65536)]
    few = {(r["query_id"], r["rank"]): r["vec_id"] for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 3, query_block=1).collect()}
    assert few == {(q, k): v for q, rows in got.items() for k, v, _ in rows}


def _kept_by_brute_force(docs, items):
    """What the first four stages keep of (doc_id, text) rows, by plain loops."""
    docs = [(i, t) for i, t in docs if any(unicodedata.category(c).startswith("L") for c in t or "")]
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, t in docs for k in {key(x) for x in t.split("\n")} if k)
    docs = [(i, "\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < 10)) for i, t in docs]
    names, first = {}, {}
    for i, t in docs:
        first.setdefault(t, i)
        names.setdefault(t, len(names))
    texts = list(names)
    _, pairs = near_pairs([t.encode() for t in texts])
    order = sorted(range(len(texts)), key=lambda k: first[texts[k]])
    place = {k: n for n, k in enumerate(order)}
    root = smallest_of_class(len(texts), [(place[a], place[b]) for a, b in pairs])
    docs = [(first[texts[k]], texts[k]) for k in order if root[place[k]] == place[k]]
    windows = set()
    for t in items:
        w = WORD.findall(lower(t))
        windows |= {tuple(w[j : j + 10]) for j in range(len(w) - min(10, len(w)) + 1)} if w else set()
    sizes = {len(x) for x in windows}
    clean = []
    for i, t in docs:
        w = WORD.findall(lower(t))
        if not any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1)):
            clean.append((i, t))
    return dict(clean)


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = _kept_by_brute_force([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()], [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    out = {r["doc_id"]: r for r in P.run(spark, sf).collect()}
    assert set(out) == set(kept) and 100 < len(kept) < docs.count()
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    for i, t in kept.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert out[i]["ids"] == ids and out[i]["n_tokens"] == len(ids) and out[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)


def test_pipeline_stage_edges(spark, sf):
    """Each stage over nulls, empty, blank and very long texts, ties, repeated rows, clashing columns, and an empty table."""
    import corpus_pipeline as P

    prose = "the cat and the hat went to the market of the old town and came back with a dog and some more of the same "
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \n\t", None), (None, prose + "one", "en"), (5, prose * 3000, "en"),
        (6, prose + "two of them here", "en"), (6, prose + "two of them here", "en"), (7, "½²", "en"), (8, "die Katze und der Hut " * 9, "de"),
        (9, "die Katze und der Hut " * 9, "de")
    ]
    extra = {"row": 1, "key": 2, "id": 3, "h": 4, "_lang": 5, "_bpe": 6, "_ld_lines": 7, "node": 8, "label": 9}
    df = spark.createDataFrame([(i, t, y, "s", len(t or "")) for i, t, y in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumns({k: F.lit(v) for k, v in extra.items()})
    want = {
        "language_id": [5, 6, 6, 8, 9, None], "line_dedup": [1, 2, 3, 5, 6, 6, 7, 8, 9, None], "decontaminate": [1, 2, 3, 5, 6, 6, 7, 8, 9, None],
        "bpe": [1, 2, 3, 5, 6, 6, 7, 8, 9, None]
    }
    for name, stage in P.STAGES:
        out = stage(spark, df, sf)
        got = out.collect()
        ids = sorted((r["doc_id"] for r in got), key=lambda i: (i is None, i))
        if name == "near_dedup":  # of 1 and 2, of 6 and 6, and of 8 and 9 one each; blank texts and one of numerals are equal to none
            assert ids[:3] == [1, 3, 5] and ids.count(6) <= 1 and 7 in ids and 8 in ids and 9 not in ids
        else:
            assert ids == want[name]
        if name != "bpe":
            assert out.columns == df.columns and all(r[k] == v for r in got for k, v in extra.items())
        assert stage(spark, df.limit(0), sf).count() == 0
