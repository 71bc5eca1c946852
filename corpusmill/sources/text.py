"""Text sources: every reader gives a DataFrame with a ``split`` column; fields are cut at tabs, without quoting.

``_line_no`` counts a file's lines from 0.  It needs whole files in order, so
``numbered_lines`` reads a file in one task; ``lines`` keeps files splittable
and gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.pipeline import union_splits


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files: ``value``, ``_file``."""
    return spark.read.text(path).withColumn("_file", F.col("_metadata.file_path"))


def numbered_lines(spark: SparkSession, path: str, skip: int = 0, strip: bool = True) -> DataFrame:
    """Lines with their numbers from 0 behind ``skip`` header lines: ``value``, ``_line_no``, ``_file``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("_file"))
    text = F.regexp_replace(F.col("value"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "") if strip else F.col("value")
    rows = whole.select("_file", F.posexplode(F.split(text, r"\r?\n", -1)).alias("_n", "value"))
    return rows.where(F.col("_n") >= skip).select("value", (F.col("_n") - skip).alias("_line_no"), "_file")


def fields(df: DataFrame, names: list[str | None], sep: str = "\t", limit: int = -1) -> DataFrame:
    """Columns of tab-separated values; None skips one; short rows give nulls."""
    cut = df.withColumn("_f", F.split("value", sep, limit))
    return cut.select(*[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names) if n], *[c for c in df.columns if c != "value"])


def label_index(c: Column, labels: list[str], strict: bool = True) -> Column:
    """The number of a label; an unknown one is an error, or null if not ``strict``."""
    at = F.array_position(F.array(*map(F.lit, labels)), c) - 1
    bad = F.raise_error(F.concat(F.lit("unknown label: "), c)).cast("int") if strict else F.lit(None).cast("int")
    return F.when(c.isNull(), None).when(at >= 0, at.cast("int")).otherwise(bad)


NLI = ["entailment", "neutral", "contradiction"]
BINARY = ["entailment", "not_entailment"]


def _glue(spark, root: str, splits, build) -> DataFrame:
    return union_splits({s: build(s, f"{root}/{s}.tsv") for s in splits})


def cola(spark, root: str, splits=("train", "dev", "test")) -> DataFrame:
    """Acceptability: ``_id``, ``_class``, ``flag``, ``text``; only the test file has a header."""

    def one(s, path):
        if s == "test":
            return fields(numbered_lines(spark, path, 1), [None, "text"], limit=2).select(F.col("_line_no").alias("_id"), "text")
        return fields(numbered_lines(spark, path), [None, "_class", "flag", "text"], limit=4).select(F.col("_line_no").alias("_id"), F.col("_class").cast("int"), "flag", "text")

    return _glue(spark, root, splits, one)


def sst2(spark, root: str, splits=("train", "dev", "test")) -> DataFrame:
    """Sentiment: text and class; test has an index instead."""

    def one(s, path):
        n = ["_x", "text"] if s == "test" else ["text", "_class"]
        out = fields(numbered_lines(spark, path, 1), n).withColumnRenamed("_line_no", "_id").withColumn("text", F.trim("text"))
        return out.select("_id", "text") if s == "test" else out.select("_id", F.col("_class").cast("int"), "text")

    return _glue(spark, root, splits, one)


def pairs(
    spark, root: str, names: list[str | None], labels: list[str] | None = None, splits=("train", "dev", "test"), id_col: str = "index",
    class_col: str | None = "label", files: str = "{root}/{split}.tsv", id_as=None
) -> DataFrame:
    """Text pairs: ``_id``, ``_class`` (null where a file has none), ``texts``. names: the columns of a labelled file, with ``a`` and ``b`` the texts."""

    def one(s):
        path = files.format(root=root, split=s)
        d = fields(numbered_lines(spark, path, 1), names)
        label = F.col(class_col) if class_col in d.columns else F.lit(None).cast("string")
        cls = label_index(F.trim(label), labels) if labels else label.cast("int")
        return d.select(F.col(id_col).alias("_id") if id_as is None else id_as.alias("_id"), cls.alias("_class"), F.array("a", "b").alias("texts"))

    return union_splits({s: one(s) for s in splits})


def qnli(spark, root, splits=("train", "dev", "test")):
    """Question and sentence."""
    return pairs(spark, root, ["index", "a", "b", "label"], BINARY, splits)


def rte(spark, root, splits=("train", "dev", "test")):
    """Entailment pairs."""
    return pairs(spark, root, ["index", "a", "b", "label"], BINARY, splits)


def wnli(spark, root, splits=("train", "dev", "test")):
    """Coreference pairs with integer labels."""
    return pairs(spark, root, ["index", "a", "b", "label"], None, splits)


def mrpc(spark, root, splits=("train", "test")):
    """Paraphrases: the id is the pair of sentence ids."""
    return pairs(spark, root, ["label", "id1", "id2", "a", "b"], None, splits, files="{root}/msr_paraphrase_{split}.txt", id_as=F.struct("id1", "id2"))


def qqp(spark, root, splits=("train", "dev", "test")):
    """Question pairs; test files have three columns."""
    parts = {s: pairs(spark, root, ["index", "a", "b"] if s == "test" else ["index", None, None, "a", "b", "label"], None, (s,)).drop("split") for s in splits}
    return union_splits(parts)


def stsb(spark, root, splits=("train", "dev", "test")) -> DataFrame:
    """Scored pairs: ``_id``, ``genre``, ``score``, ``texts``."""

    def one(s, path):
        d = fields(numbered_lines(spark, path, 1), ["index", "genre", None, None, None, None, None, "a", "b", "score"])
        return d.select(F.col("index").alias("_id"), "genre", F.col("score").cast("double"), F.array("a", "b").alias("texts"))

    return _glue(spark, root, splits, one)


def mnli(spark, root: str, splits=("train", "dev", "test"), task: str = "full") -> DataFrame:
    """Inference pairs with parses; ``task`` matched, mismatched, or full, which is both."""
    base = ["index", "prompt", "pair", "genre", "b1", "b2", "p1", "p2", "a", "b"]

    def one(path, n_labels):
        d = fields(numbered_lines(spark, path, 1), base + [f"l{i}" for i in range(n_labels)])
        cols = [
            F.struct(F.col("index"), F.col("prompt").alias("prompt_id"), F.col("pair").alias("pair_id")).alias("_id"), "genre",
            F.array("a", "b").alias("texts"), F.array("p1", "p2").alias("texts_parse"), F.array("b1", "b2").alias("texts_binary_parse")
        ]
        if n_labels:
            cols.append(label_index(F.col(f"l{n_labels - 1}"), NLI).alias("_class"))
            cols.append(F.array(*[label_index(F.col(f"l{i}"), NLI) for i in range(n_labels - 1)]).alias("aux_class"))
        return d.select(*cols)

    def part(s):
        kinds = [""] if s == "train" else [f"_{k}" for k in ("matched", "mismatched") if task in ("full", k)]
        return reduce(lambda a, b: a.unionByName(b), [one(f"{root}/{s}{k}.tsv", {"train": 2, "dev": 6, "test": 0}[s]) for k in kinds])

    return union_splits({s: part(s) for s in splits})


def simple_text(spark, path: str, labelled: bool = True) -> DataFrame:
    """``class<tab>text`` lines, or text alone."""
    d = numbered_lines(spark, path).withColumnRenamed("_line_no", "_id")
    if not labelled:
        return d.select("_id", F.col("value").alias("text"))
    return fields(d, ["_class", "text"], limit=2).select("_id", "_class", "text")


def simple_pairs(spark, path: str) -> DataFrame:
    """Lines of texts between tabs: ``_id``, ``texts``."""
    return numbered_lines(spark, path).select(F.col("_line_no").alias("_id"), F.split("value", "\t", -1).alias("texts"))


def json_array(spark, path: str, schema: str) -> DataFrame:
    """The elements of JSON arrays in files, with their places: ``_id``, ``e``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<{schema}>")).alias("_id", "e"))


def alpaca(spark, path: str) -> DataFrame:
    """Instruction records: ``classes`` (keys in order) and ``texts``."""
    return json_array(spark, path, "map<string,string>").select("_id", F.map_keys("e").alias("classes"), F.map_values("e").alias("texts"))


def sharegpt(spark, path: str) -> DataFrame:
    """Conversations: ``classes`` (speakers), ``texts``, ``tools``; a system text comes first. Records without tools give null."""
    d = json_array(spark, path, "struct<conversations:array<struct<`from`:string,value:string>>,system:string,tools:string>")
    turns = F.concat(
        F.when(
            F.col("e.system").isNotNull() & (F.col("e.system") != ""),
            F.array(F.struct(F.lit("system").alias("from"), F.col("e.system").alias("value")))
        ).otherwise(F.array().cast("array<struct<`from`:string,value:string>>")),
        F.col("e.conversations")
    )
    return d.select("_id", F.transform(turns, lambda t: t["from"]).alias("classes"), F.transform(turns, lambda t: t["value"]).alias("texts"), F.col("e.tools").alias("tools"))


def _jsonl(spark, path: str, schema: str) -> DataFrame:
    return numbered_lines(spark, path).where(F.col("value") != "").select(F.col("_line_no").alias("_id"), F.from_json("value", schema).alias("e"))


def chat(spark, path: str, key: str = "messages") -> DataFrame:
    """JSON lines with messages: ``_id``, ``messages``."""
    return _jsonl(spark, path, f"struct<`{key}`:array<struct<role:string,content:string>>>").select("_id", F.col(f"e.{key}").alias("messages"))


def preference(spark, path: str, chosen: str = "chosen", rejected: str = "rejected", schema: str = "string") -> DataFrame:
    """JSON lines with a chosen and a rejected answer."""
    return _jsonl(spark, path, f"struct<`{chosen}`:{schema},`{rejected}`:{schema}>").select("_id", F.col(f"e.{chosen}").alias("chosen"), F.col(f"e.{rejected}").alias("rejected"))


def extraction(spark, path: str) -> DataFrame:
    """Document extraction JSON lines: ``image`` bytes, ``bbox``, ``content``, ``result_list``, ``prompt``."""
    s = "struct<image:string,bbox:array<array<double>>,content:string,result_list:array<struct<text:string,start:int,end:int>>,prompt:string>"
    return _jsonl(spark, path, s).select("_id", F.unbase64("e.image").alias("image"), "e.bbox", "e.content", "e.result_list", "e.prompt")


_MISTAKES = "array<struct<location:int,wrong:string,correction:string>>"


def csc_train(spark, path: str) -> DataFrame:
    """Spelling-error essays in SGML: passages left-joined with the mistakes that name their ids."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<ESSAY.*?</ESSAY>"), F.lit(0))).alias("essay"))
    title = F.regexp_extract("essay", r'<ESSAY title="([^"]*)"', 1)
    passages = whole.select(title.alias("title"), F.explode(F.regexp_extract_all("essay", F.lit(r"(?s)<PASSAGE[^>]*>.*?</PASSAGE>"), F.lit(0))).alias("p"), "essay")
    passages = passages.select(F.regexp_extract("p", r'id="([^"]*)"', 1).alias("_id"), "title", F.regexp_replace("p", r"(?s)^<PASSAGE[^>]*>\s*|\s*</PASSAGE>$", "").alias("text"))
    m = whole.select(F.explode(F.regexp_extract_all("essay", F.lit(r"(?s)<MISTAKE.*?</MISTAKE>"), F.lit(0))).alias("m"))
    g = lambda p: F.regexp_extract("m", p, 1)
    m = m.select(
        g(r'id="([^"]*)"').alias("_id"),
        F.struct(
            g(r'location="(\d+)"').cast("int").alias("location"), g(r"(?s)<WRONG>\s*(.*?)\s*</WRONG>").alias("wrong"),
            g(r"(?s)<CORRECTION>\s*(.*?)\s*</CORRECTION>").alias("correction")
        ).alias("x")
    )
    return passages.join(
        m.groupBy("_id").agg(F.array_sort(F.collect_list("x")).alias("mistakes")), "_id", "left"
    ).withColumn("mistakes", F.coalesce("mistakes", F.array().cast(_MISTAKES)))


def csc_test(spark, inputs: str, truth: str) -> DataFrame:
    """Spelling-error tests: texts with ids joined by id with truth lines ``id, place, right, ...``; 0 means none."""
    t = lines(spark, inputs).select(F.regexp_extract("value", r"id=([^)]*)\)", 1).alias("_id"), F.regexp_replace("value", r"^\([^)]*\)\s*", "").alias("text"))
    f = F.split("value", r",\s*", -1)
    x = lines(spark, truth).select(F.get(f, F.lit(0)).alias("_id"), f.alias("f"))
    n = F.floor((F.size("f") - 1) / 2).cast("int")
    got = F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(F.get("f", 1 + i * 2).cast("int").alias("location"), F.get("f", 2 + i * 2).alias("correction"))
        )
    ).otherwise(F.array().cast("array<struct<location:int,correction:string>>"))
    return t.join(x.select("_id", got.alias("m")), "_id", "left").select(
        "_id", "text",
        F.transform(
            F.coalesce("m", F.array().cast("array<struct<location:int,correction:string>>")),
            lambda m: F.struct(
                m["location"].alias("location"), F.substring(F.col("text"), m["location"], F.lit(1)).alias("wrong"),
                m["correction"].alias("correction")
            )
        ).alias("mistakes")
    )


def numbered_elements(spark, path: str, tag: str) -> DataFrame:
    """The elements of a tag without attributes in files, with their places in their files: ``_id``, ``s``.  Files stay splittable.

    A record ends where an element opens, so it holds what follows the opening
    before it; a file's first record is what stands before all elements.  The
    records of each split are counted, in a table of one row a split, and
    numbered from the count of those before it.  An element that is not closed
    before the next one opens is left out, but keeps its number.
    """
    d = spark.read.option("lineSep", f"<{tag}>").text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from")
    ).withColumn("_n", F.monotonically_increasing_id())  # one by one within a split, as its records follow each other in one partition
    part = W.partitionBy("_file").orderBy("_from").rowsBetween(W.unboundedPreceding, -1)
    splits = d.groupBy("_file", "_from").agg(F.min("_n").alias("_first"), F.count("*").alias("_count"))
    splits = splits.select("_file", "_from", (F.coalesce(F.sum("_count").over(part), F.lit(0)) - F.col("_first") - 1).alias("_add"))
    found = d.join(F.broadcast(splits), ["_file", "_from"]).select((F.col("_n") + F.col("_add")).cast("int").alias("_id"), "value")
    body = F.substring_index("value", f"</{tag}>", 1)
    return found.where((F.col("_id") >= 0) & F.contains("value", F.lit(f"</{tag}>"))).select("_id", F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>")).alias("s"))


def csc_sentences(spark, path: str) -> DataFrame:
    """Sentence-level SGML: text and mistakes."""
    s = numbered_elements(spark, path, "SENTENCE")
    pick = lambda tag: F.xpath("s", F.lit(f"//{tag}/text()"))
    z = F.arrays_zip(pick("LOCATION").alias("l"), pick("WRONG").alias("w"), pick("CORRECTION").alias("c"))
    return s.select(
        "_id", F.xpath_string("s", F.lit("//TEXT")).alias("text"),
        F.transform(z, lambda x: F.struct(x["l"].cast("int").alias("location"), x["w"].alias("wrong"), x["c"].alias("correction"))).alias("mistakes")
    )


MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
