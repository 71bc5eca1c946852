import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import chunk, clean, encode, perturb, split
from corpusmill.operators import idmap, pipeline, tokenizers

PARTS = [f"hello! world{i}!" for i in range(5)]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("r")).first()["r"]


def arr(xs):
    return F.array(*map(F.lit, xs))


def test_cleaners(spark):
    assert one(spark, clean.drop_blanks(F.lit("a b　c d"))) == "abcd"
    assert one(spark, clean.collapse_blanks(F.lit("  a \t b  café  noir "))) == "a b cafénoir"
    assert one(spark, clean.collapse_blanks(F.lit("café  noir"), strict=False)) == "café noir"
    assert one(spark, clean.drop_short(F.lit("abc"), 4)) == ""
    assert one(spark, clean.keep_patterns(F.lit("a1b22"), "[0-9]+")) == "122"
    assert one(spark, clean.strip_accents(F.lit("çà et là"))) == "ca et la"
    assert one(spark, clean.over(clean.lower, arr(["A", "B"]))) == ["a", "b"]
    assert clean.number_in_english("1234") == "one thousand, two hundred and thirty-four"
    assert clean.number_in_chinese("10203") == "一万零二百零三"
    assert clean.number_in_chinese("12") == "十二"


def test_split(spark):
    assert one(spark, split.to_paragraphs(F.lit("a\nb"), keep_sep=True)) == ["a\n", "b\n"]
    assert one(spark, split.to_segment(F.lit("hello, [MASK]world!"), special=("[MASK]",))) == ["hello", ",", "[MASK]", "world", "!"]
    assert one(spark, split.join_mixed(arr(["你", "好", "a", "b", "中"]))) == "你好 a b 中"
    assert one(spark, split.word_pieces(arr(["unaffable", "xyz"]), {"un", "##aff", "##able"})) == ["un", "##aff", "##able", "xyz"]
    spans = F.array(
        *[
            F.struct(F.lit(w).alias("word"), F.lit(a).alias("start"), F.lit(b).alias("end")) for w, a,
            b in (("ab@@", 0.0, 1.0), ("cd", 1.0, 2.0), ("x", 2.0, 3.0), ("y", 3.0, 4.0))
        ]
    )
    assert [tuple(r) for r in one(spark, split.merge_continued(spans))][0] == ("abcd", 0.0, 2.0)
    assert [tuple(r) for r in one(spark, split.merge_single_letters(spans))][-1] == ("XY", 2.0, 4.0)


def test_chunk_goldens(spark):
    text = "".join(PARTS)
    assert one(spark, chunk.fixed(F.lit(text), 30)) == ["hello! world0!hello! world1!he", "llo! world2!hello! world3!hell", "o! world4!"]
    assert one(spark, chunk.fixed(F.lit("abcdef"), 3))[-1] == ""
    assert chunk.retain(text, 30) == ["hello! world0!hello! world1!", "hello! world2!hello! world3!", "hello! world4!"]
    assert chunk.retain_all(PARTS, 25) == ["hello! world0!hello!", " world1!hello! world2!", "hello! world3!hello!", " world4!"]
    assert chunk.retain_all(["abc", "def", "ghi", "jk", "lmn"], 5) == ["abcde", "fghij", "klmn"]
    assert one(spark, chunk.greedy_overlapped(arr(PARTS), 30, 5)) == ["hello! world0!hello! world1!", "hello! world1!hello! world2!", "hello! world3!hello! world4!"]
    assert one(spark, chunk.greedy(arr(PARTS), 30)) == ["hello! world0!hello! world1!", "hello! world2!hello! world3!", "hello! world4!"]
    with pytest.raises(Exception, match="30 characters"):
        one(spark, chunk.greedy(arr(["x" * 30]), 30))
    words = [w for i in range(5) for w in (f"hello{i}", "!", f"world{i}", "!")]
    assert chunk.retain_tokens(words, 7)[0] == ["hello0", "!", "world0", "!", "hello1", "!"]
    seg = [f"hello{i}! world{i}!" for i in range(5)]
    assert one(spark, chunk.head(arr(seg), 30)) == "hello0! world0!hello1! world1!"
    assert one(spark, chunk.tail(arr(seg), 30)) == "hello3! world3!hello4! world4!"
    assert one(spark, chunk.two_pieces(arr(seg), 30)) == "hello0! world0!hello4! world4!"
    assert one(spark, chunk.three_pieces(arr(seg), 50, (0.3, 0.3, 0.3))) == "hello0! world0!hello2! world2!hello4! world4!"
    ten = [f"hello{i}! world{i}!" for i in range(10)]
    assert one(spark, chunk.k_heads(arr(ten), 75)) == "".join(ten[::2])
    assert one(spark, chunk.middle(arr(seg), 1000)) == "".join(seg)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab.!,;\n ", max_size=80), st.integers(2, 20))
def test_chunkers_lose_nothing(text, size):
    assert "".join(chunk.retain(text, size)) == text
    assert all(0 < len(c) <= size for c in chunk.retain(text, size))
    assert "".join(chunk.even_pieces(text, 3, True)) == text


def test_encode(spark):
    vocab = {"[UNK]": 0, "a": 1, "b": 2}
    ids = one(spark, encode.encode_words(arr(["a", "z", "b"]), vocab))
    assert ids == [1, 0, 2]
    assert one(spark, encode.decode_ids(arr([1, 2]), vocab)) == ["a", "b"]
    assert one(spark, encode.segment_numbers(arr(["a", "[SEP]", "b", "[SEP]", "c"]), most=1)) == [0, 0, 1, 1, 1]
    assert one(spark, encode.one_hot_back(encode.one_hot(arr([2, 0]), 3))) == [2, 0]
    assert one(spark, encode.add_end_mark(F.lit("你好"))) == "你好。"
    assert one(spark, encode.joint(F.array(arr(["a"]), arr(["b"])), "|", False)) == ["a", "|", "b"]
    coder = encode.BytePairs({"l": 0, "o": 1, "w": 2, "lo": 3, "low": 4}, {("l", "o"): 0, ("lo", "w"): 1})
    assert coder.pieces("lowlo") == ["low", "lo"]
    assert coder.decode(coder.encode(["low"])) == "low"


def test_perturbation_is_seeded(spark):
    vocab = {w: i for i, w in enumerate("abcdefgh")}
    df = spark.range(200).select("id", arr(list("abcdefgh")).alias("w"))
    mask = lambda d: {
        r["id"]: (r["m"]["tokens"], r["m"]["tags"]) for r in d.select(
            "id", perturb.random_mask(F.col("w"), F.col("id"), vocab, 5, 0.3).alias("m")
        ).collect()
    }
    a, b = mask(df), mask(df.repartition(7))
    assert a == b
    share = sum(t != perturb.SKIP for _, tags in a.values() for t in tags) / 1600
    assert 0.25 < share < 0.35
    gone = df.select(perturb.random_delete(F.col("w"), F.col("id"), vocab, 5, 0.3).alias("m")).collect()
    assert all(len(r["m"]["tokens"]) == len(r["m"]["tags"]) for r in gone)


def test_id_maps(spark):
    df = spark.createDataFrame([(1, ["ab", "", "cde"])], "k int, p array<string>")
    assert [tuple(r) for r in idmap.char_table(df, "k", "p").orderBy("acid").collect()] == [(1, 0, 0, 0), (1, 1, 0, 1), (1, 2, 2, 0), (1, 3, 2, 1), (1, 4, 2, 2)]
    assert tuple(one(spark, idmap.locate(arr(["ab", "", "cde"]), F.lit(2)))) == (2, 0)
    assert one(spark, idmap.locate(arr(["ab"]), F.lit(2))) is None
    assert one(spark, idmap.article_offset(arr(["ab", "", "cde"]), F.lit(2), F.lit(1))) == 3


def test_prompt_weights():
    assert tokenizers.prompt_weights("normal text") == [("normal text", 1.0)]
    assert tokenizers.prompt_weights("an (important) word") == [("an ", 1.0), ("important", 1.1), (" word", 1.0)]
    assert tokenizers.prompt_weights("(unbalanced") == [("unbalanced", 1.1)]
    assert tokenizers.prompt_weights(r"\(literal\]") == [("(literal]", 1.0)]
    assert tokenizers.prompt_weights("(a:0.5)") == [("a", 0.5)]
    assert tokenizers.prompt_weights("") == [("", 1.0)]
    assert tokenizers.prompt_weights("(unnecessary)(parens)") == [("unnecessaryparens", 1.1)]
    nested = tokenizers.prompt_weights("a (((house:1.3)) [on] a (hill:0.5), sun, (((sky))).")
    assert [(t, round(w, 6)) for t, w in nested] == [
        ("a ", 1.0), ("house", 1.573), (" ", 1.1), ("on", 1.0), (" a ", 1.1), ("hill", 0.55), (", sun, ", 1.1), ("sky", 1.4641), (".", 1.1)
    ]
    assert tokenizers.prompt_weights("a BREAK b") == [("a", 1.0), ("BREAK", -1.0), ("b", 1.0)]
    assert [t for t, _ in tokenizers.prompt_weights("(a [b) c]")] == ["a ", "b", " c"]
    assert tokenizers.prompt_weights("a) b] :1.5) c") == [("a) b] :1.5) c", 1.0)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!,;\n", max_size=60), st.integers(1, 6))
def test_even_pieces_drift(text, k):
    """Pieces hold the units between stops in order, and none but the last could take the next unit without passing the mean."""
    pieces = chunk.even_pieces(text, k, True)
    assert "".join(pieces) == text
    assert all(p == "" or p[-1] in ".!,;" for p in pieces[:-1])
    assert sum(len(p) for p in chunk.even_pieces(text, k)) <= len(text)


def test_long_numbers():
    assert clean.number_in_english("1" * 5000).startswith("one one")
    assert clean.number_in_chinese("0" * 5000) == "零" and clean.number_in_english("0" * 5000) == "zero"
    assert clean.number_in_english("0" * 30 + "12") == "twelve" and clean.number_in_chinese("9" * 6000)[:2] == "九九"


def test_generate_drops_empty_records(spark):
    df = spark.createDataFrame([("a", ["x"]), ("", []), (None, None), ("", ["y"])], "t string, l array<string>")
    assert pipeline.generate(df).count() == 2
    assert pipeline.generate(df, parse=lambda d: d.select("t")).count() == 1
    assert pipeline.generate(df, max_size=1).count() == 1


def test_split_sets_keeps_null_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), (None,), ("c",)], "k string")
    out = pipeline.split_sets(df, "k", (0.5, 1.0))
    assert out.count() == 5 and out.where("k is null").select("split").distinct().count() == 1
    assert out.select("k", "split").distinct().where("split = 'train'").count() == 2


def test_split_sets_and_streams(spark):
    df = spark.range(100).select(F.concat_ws("_", (F.col("id") % 10).cast("string"), F.col("id").cast("string")).alias("k"))
    out = pipeline.split_sets(df, "k", group=pipeline.stem).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"train": 80, "test": 20}
    again = pipeline.split_sets(df.repartition(7), "k", group=pipeline.stem)
    assert again.exceptAll(pipeline.split_sets(df, "k", group=pipeline.stem)).count() == 0
    stream = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="stream"):
        encode.align(stream.select(F.array(F.col("value")).alias("x")), "x", padding=0)
    clean.lower(F.col("value"))


def test_stateless_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("A b",), ("C",)], "text string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("text string").parquet(str(tmp_path / "in")).select(clean.lower(F.col("text")).alias("t"))
    q = s.writeStream.format("memory").queryName("lowered").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["t"] for r in spark.sql("SELECT t FROM lowered").collect()) == ["a b", "c"]


def test_segment_numbers_of_whole_texts(spark, sf):
    from corpusmill.plans.registry import QUERIES

    def brute(words, sep, start=0, most=None):
        out, n = [], start
        for w in words:
            out.append(n if most is None else min(n, most))
            n += w == sep
        return out

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r["numbers"] for r in QUERIES["segment_numbers"](spark, sf).collect()}
    assert max(map(len, texts.values())) > 10_000  # far beyond 100 characters
    assert got == {i: brute(t, ".") for i, t in texts.items()}
    for words in (["a"], ["."], [".", "."], ["a", ".", "b", None, ".", "c"]):
        assert one(spark, encode.segment_numbers(arr(words), ".", 2, 3)) == brute(words, ".", 2, 3)
    assert one(spark, encode.segment_numbers(F.array().cast("array<string>"), ".")) == []
    assert one(spark, encode.segment_numbers(F.lit(None).cast("array<string>"), ".")) is None


@pytest.mark.parametrize("name", ["encode_words", "truncate_head_tail", "truncate_two", "word_ids", "word_counts", "join_article"])
def test_texts_without_words(spark, tmp_path, name):
    """Null, empty and blank texts give what they give in the SQL, which has no row for them where it goes by words."""
    from oracle import agree

    from corpusmill.plans import registry

    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, "a b a"), (5, "w" * 129), (6, "b " + "w" * 127), (7, " ".join(["abcde"] * 60)), (8, "x" * 64 + " " + "y" * 64)]
    spark.createDataFrame(rows, "doc_id bigint, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    agree(spark, str(tmp_path), registry.QUERIES[name], registry.ORACLES[name])


def test_batches_are_never_python_objects_as_a_whole(spark):
    """Rows come in slices of a batch, nulls and nested lists as they are, whatever the slice."""
    import pyarrow as pa

    from corpusmill.functions import rows

    a = pa.array([["ab", None, "c"], None, [], ["é", "漢"] * 3, ["x"]])
    assert rows._objects(a) == a.to_pylist() and rows._objects(a.slice(2, 2)) == a.slice(2, 2).to_pylist()
    nested = pa.array([[["a"], None, []], None, [["b", "c"]]])
    assert rows._objects(nested) == nested.to_pylist() and rows._objects(nested.slice(1)) == nested.slice(1).to_pylist()
    many = pa.array([["word"] * 1000] * 2000)
    sizes = [len(s[0]) for s in rows._slices((many, pa.array(range(2000))))]
    assert sum(sizes) == 2000 and max(sizes) * many.nbytes / 2000 < 2 * rows.SLICE
    d = spark.createDataFrame([(1, None), (2, []), (3, ["a", "b"])], "k int, w array<string>")
    got = {r["k"]: r for r in d.select("k", perturb.random_mask(F.col("w"), F.col("k"), {"a": 0, "b": 1, "[MASK]": 2}, 1, 1.0).alias("m"), chunk.token_retention(F.col("w"), 1).alias("t")).collect()}
    assert got[1]["m"]["tokens"] is None and got[1]["t"] is None and got[2]["t"] == [] and got[3]["t"] == [["a"], ["b"]] and got[3]["m"]["tags"] == [0, 1]


def _first_that_fit(words, size):
    out = ""
    for w in words:
        if len(out) + len(w) > size:
            break
        out += w
    return out


def _k_heads(words, size, k):
    if len("".join(words)) <= size:
        return "".join(words)
    mean, pieces = len("".join(words)) // k, [[]]
    for w in words:
        if sum(map(len, pieces[-1])) >= mean:
            pieces.append([])
        pieces[-1].append(w)
    return "".join(_first_that_fit(p, size // k) for p in pieces if sum(map(len, p)) >= mean)


def _middle(words, size):
    n, mid, taken = len(words), len(words) // 2, []
    for i in (j for d in range(mid + 1) for j in (mid + d, mid - 1 - d)):
        if not 0 <= i < n or sum(len(words[j]) for j in taken) + len(words[i]) > size:
            break
        taken.append(i)
    return "".join(words[i] for i in sorted(taken))


def test_truncation_by_brute_force(spark):
    """Empty items, items too long and whole fits; and the plan holds no list that grows with the piece."""
    import random

    rng = random.Random(3)
    segments = [[], [""], ["", ""], ["abc"] * 40, ["", "x"] * 60] + [["y" * rng.choice((0, 1, 1, 2, 3, 9, 30)) + str(i % 10) * rng.randint(0, 1) for i in range(rng.randint(1, 90))] for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(segments)), "k int, w array<string>")
    w = F.col("w")
    cut = d.select("k", chunk.head(w, 20).alias("head"), chunk.tail(w, 20).alias("tail"), chunk.middle(w, 20).alias("middle"), chunk.k_heads(w, 25, 5).alias("heads"))
    for r in cut.collect():
        s = segments[r["k"]]
        back = _first_that_fit([x[::-1] for x in reversed(s)], 20)[::-1]
        assert (r["head"], r["tail"], r["middle"], r["heads"]) == (_first_that_fit(s, 20), back, _middle(s, 20), _k_heads(s, 25, 5))
    plan = d.select(chunk.k_heads(w, 25, 5))._jdf.queryExecution().executedPlan().toString()
    assert "array(" not in plan


def test_word_ids_do_not_sort_all_words(spark):
    """The order of first sight, rows without a place first, by aggregates that need no sorted input."""
    rows = [(3, ["b", "a", "b", "c"]), (1, ["d", "a", "d"]), (2, []), (None, ["e", "c"]), (4, None), (5, ["f", None, "a"])]
    d = spark.createDataFrame(rows, "k int, w array<string>")
    got = encode.word_ids(d, "w", "k")
    assert [r["word"] for r in got.orderBy("id").collect()] == ["e", "c", "d", "a", "b", "f", None] and sorted(r["id"] for r in got.collect()) == list(range(7))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
