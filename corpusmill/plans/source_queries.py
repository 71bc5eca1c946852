"""Queries of sources and sinks: each writes a file of one format from a standard table, by the sink where there is one, and reads it back."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import boxes as B
from ..operators import image, pipeline, tokenizers
from ..sources import annotations as A
from ..sources import formats, media
from ..sources import sinks as S
from ..sources import text as X
from .registry import query


@functools.cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="corpusmill-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file:" + path


def scratch(spark, name: str) -> str:
    """A new folder's path below the shared folder of the session, or of this process where the session has none."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or _own_folder()}/{name}-{uuid.uuid4().hex}"


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _headed(df: DataFrame, line: Column, header: str | None) -> DataFrame:
    out = df.select("k", line.alias("line"))
    return out if header is None else out.unionByName(df.sparkSession.sql("SELECT CAST(-1 AS BIGINT) AS k").withColumn("line", F.lit(header)))


def put(df: DataFrame, line: Column, path: str, header: str | None = None) -> None:
    """Lines in the order of ``k`` as one file, behind a header."""
    S.one_file(_headed(df, line, header), F.col("line"), "k", path)


def put_parts(df: DataFrame, line: Column, path: str, header: str | None = None) -> None:
    """Lines and a header as a folder of part files, for readers that go by no order: written side by side, by no task more than it reads."""
    S.text_lines(_headed(df, line, header), F.col("line"), path)


def put_each(df: DataFrame, name: Column, content: Column, path: str) -> None:
    """A file for each row."""
    S.save_binary(df.select(name.alias("_file"), content.cast("binary").alias("_content")), local(path), "_file", "_content")


_SPLITS = ("train", "dev", "test")
_PART = """p AS (SELECT p_partkey AS k, p_name AS a, p_type AS b, p_brand AS g, CAST(p_size AS BIGINT) AS n, ['train', 'dev',
  'test'][p_partkey % 3 + 1] AS s, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) - 1 AS i, row_number() OVER (ORDER BY p_partkey) - 1 AS j
FROM part) """


def part(spark, sf) -> DataFrame:
    """Parts as texts a and b, a group g, a number n and a split s."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    split = F.element_at(F.array(*map(F.lit, _SPLITS)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select(
        F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), F.col("p_type").alias("b"), F.col("p_brand").alias("g"),
        F.col("p_size").cast("long").alias("n"), split.alias("s")
    )


def _tabs(*cells) -> Column:
    return F.concat_ws("\t", *[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in cells])


def _write_splits(spark, sf, name: str, files: dict[str, tuple[Column, str | None]]) -> str:
    """A file for each split of the parts: its lines and its header; the name of a split may have a pattern behind '='."""
    root, d = scratch(spark, name), part(spark, sf)
    for s, (line, header) in files.items():
        s, _, file = s.partition("=")
        put(d.where(F.col("s") == s), line, f"{root}/{file or s + '.tsv'}", header)
    return root


def _two(d: DataFrame, *more) -> DataFrame:
    return d.select("split", *more, F.coalesce(F.col("_class").cast("long"), F.lit(-1)).alias("_class"), F.get("texts", F.lit(0)).alias("a"), F.get("texts", F.lit(1)).alias("b"))


@query(
    "source_cola",
    f"WITH {_PART} SELECT s AS split, i AS _id, CASE WHEN s <> 'test' THEN n % 2 ELSE -1 END AS _class, CASE WHEN s <> 'test' THEN g END AS flag, a AS text FROM p"
)
def source_cola(spark, sf):
    line = _tabs("k", F.col("n") % 2, "g", "a")
    root = _write_splits(spark, sf, "cola", {"train": (line, None), "dev": (line, None), "test": (_tabs("k", "a"), "index\tsentence")})
    return X.cola(spark, root).select("split", F.col("_id").cast("long").alias("_id"), F.coalesce(F.col("_class").cast("long"), F.lit(-1)).alias("_class"), "flag", "text")


@query("source_sst2", f"WITH {_PART} SELECT s AS split, i AS _id, CASE WHEN s <> 'test' THEN n % 2 ELSE -1 END AS _class, a AS text FROM p")
def source_sst2(spark, sf):
    line = _tabs("a", F.col("n") % 2)
    root = _write_splits(spark, sf, "sst2", {"train": (line, "sentence\tlabel"), "dev": (line, "sentence\tlabel"), "test": (_tabs("k", "a"), "index\tsentence")})
    return X.sst2(spark, root).select("split", F.col("_id").cast("long").alias("_id"), F.coalesce(F.col("_class").cast("long"), F.lit(-1)).alias("_class"), "text")


def _nli(name: str, read, words: bool):
    header = "index\tone\ttwo\tlabel"

    @query(f"source_{name}", f"WITH {_PART} SELECT s AS split, CAST(k AS VARCHAR) AS _id, CASE WHEN s <> 'test' THEN n % 2 ELSE -1 END AS _class, a, b FROM p")
    def run(spark, sf):
        label = F.element_at(F.array(*map(F.lit, X.BINARY)), (F.col("n") % 2 + 1).cast("int")) if words else F.col("n") % 2
        line = _tabs("k", "a", "b", label)
        return _two(read(spark, _write_splits(spark, sf, name, {"train": (line, header), "dev": (line, header), "test": (_tabs("k", "a", "b"), "index\tone\ttwo")})), "_id")

    return run


def _register_nli() -> None:
    for name, read, words in (("qnli", X.qnli, True), ("rte", X.rte, True), ("wnli", X.wnli, False)):
        _nli(name, read, words)


@query("source_mrpc", f"WITH {_PART} SELECT s AS split, CAST(k AS VARCHAR) AS id1, CAST(n AS VARCHAR) AS id2, n % 2 AS _class, a, b FROM p WHERE s <> 'dev'")
def source_mrpc(spark, sf):
    line = _tabs(F.col("n") % 2, "k", "n", "a", "b")
    root = _write_splits(spark, sf, "mrpc", {f"{s}=msr_paraphrase_{s}.txt": (line, "Quality\t#1 ID\t#2 ID\t#1 String\t#2 String") for s in ("train", "test")})
    return _two(X.mrpc(spark, root), F.col("_id.id1").alias("id1"), F.col("_id.id2").alias("id2"))


@query("source_qqp", f"WITH {_PART} SELECT s AS split, CAST(k AS VARCHAR) AS _id, CASE WHEN s <> 'test' THEN n % 2 ELSE -1 END AS _class, a, b FROM p")
def source_qqp(spark, sf):
    line, header = _tabs("k", "n", "n", "a", "b", F.col("n") % 2), "id\tqid1\tqid2\tquestion1\tquestion2\tis_duplicate"
    return _two(X.qqp(spark, _write_splits(spark, sf, "qqp", {"train": (line, header), "dev": (line, header), "test": (_tabs("k", "a", "b"), "id\tquestion1\tquestion2")})), "_id")


@query("source_stsb", f"WITH {_PART} SELECT s AS split, CAST(k AS VARCHAR) AS _id, g AS genre, CASE WHEN s <> 'test' THEN n / 10.0 END AS score, a, b FROM p")
def source_stsb(spark, sf):
    cells = ["k", "g", *[F.lit("x")] * 5, "a", "b"]
    line, header = _tabs(*cells, F.col("n") / 10), "index\tgenre\tfile\tyear\told\ts1\ts2\tone\ttwo\tscore"
    d = X.stsb(spark, _write_splits(spark, sf, "stsb", {"train": (line, header), "dev": (line, header), "test": (_tabs(*cells), header)}))
    return d.select("split", "_id", "genre", "score", F.get("texts", F.lit(0)).alias("a"), F.get("texts", F.lit(1)).alias("b"))


@query(
    "source_mnli",
    f"""WITH {_PART} SELECT s AS split, CAST(k AS VARCHAR) AS _id, g AS genre, CASE WHEN s <> 'test' THEN n % 3 ELSE -1 END AS _class,
  CASE s WHEN 'train' THEN 1 WHEN 'dev' THEN 5 ELSE -1 END AS votes, a, b
FROM p"""
)
def source_mnli(spark, sf):
    word = F.element_at(F.array(*map(F.lit, X.NLI)), (F.col("n") % 3 + 1).cast("int"))
    cells = ["k", "k", "k", "g", *[F.lit("()")] * 4, "a", "b"]
    header = "\t".join(["h"] * 10)
    d = part(spark, sf)
    root = _write_splits(spark, sf, "mnli", {"train": (_tabs(*cells, word, word), header)})
    for s, line in (("dev", _tabs(*cells, *[word] * 6)), ("test", _tabs(*cells))):
        for i, kind in enumerate(("matched", "mismatched")):
            put(d.where((F.col("s") == s) & (F.col("n") % 2 == i)), line, f"{root}/{s}_{kind}.tsv", header)
    return _two(X.mnli(spark, root), F.col("_id.index").alias("_id"), "genre", F.coalesce(F.size("aux_class"), F.lit(-1)).cast("int").alias("votes"))


@query("source_simple_text", f"WITH {_PART} SELECT j AS _id, g AS _class, a AS text FROM p")
def source_simple_text(spark, sf):
    put(part(spark, sf), S.tsv("g", "a"), root := scratch(spark, "simple"))
    return X.simple_text(spark, root).select(F.col("_id").cast("long").alias("_id"), "_class", "text")


@query("source_simple_pairs", f"WITH {_PART} SELECT j AS _id, a, b FROM p")
def source_simple_pairs(spark, sf):
    put(part(spark, sf), S.tsv("a", "b"), root := scratch(spark, "pairs"))
    return X.simple_pairs(spark, root).select(F.col("_id").cast("long").alias("_id"), F.get("texts", F.lit(0)).alias("a"), F.get("texts", F.lit(1)).alias("b"))


@query("source_alpaca", f"WITH {_PART} SELECT j AS _id, 'instruction,output' AS classes, a || '|' || b AS texts FROM p")
def source_alpaca(spark, sf):
    d = part(spark, sf).select("k", F.array(F.lit("instruction"), F.lit("output")).alias("classes"), F.array("a", "b").alias("texts"))
    S.as_one_array(d, S.alpaca(), "k", root := scratch(spark, "alpaca"))
    return X.alpaca(spark, root).select(F.col("_id").cast("long").alias("_id"), F.array_join("classes", ",").alias("classes"), F.array_join("texts", "|").alias("texts"))


_TALK = """t AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS _id, string_agg(role, ',' ORDER BY turn) AS classes,
  string_agg(text, '|' ORDER BY turn) AS texts FROM conversations
GROUP BY conv_id) """


def _talks(spark, sf) -> DataFrame:
    return tokenizers.conversations(spark.read.parquet(f"{sf}/conversations.parquet")).withColumnRenamed("conv_id", "k")


def _spoken(d: DataFrame, classes: Column, texts: Column) -> DataFrame:
    return d.select(F.col("_id").cast("long").alias("_id"), F.array_join(classes, ",").alias("classes"), F.array_join(texts, "|").alias("texts"))


@query("source_chat", f"WITH {_TALK} SELECT _id, classes, texts FROM t")
def source_chat(spark, sf):
    put(_talks(spark, sf), S.messages(), root := scratch(spark, "chat"))
    return _spoken(X.chat(spark, root), F.transform("messages", lambda m: m["role"]), F.transform("messages", lambda m: m["content"]))


@query("source_sharegpt", f"WITH {_TALK} SELECT _id, classes, texts FROM t")
def source_sharegpt(spark, sf):
    d = _talks(spark, sf).select(
        "k", F.transform("messages", lambda m: m["role"]).alias("classes"), F.transform("messages", lambda m: m["content"]).alias("texts"),
        F.lit("[]").alias("tools")
    )
    S.as_one_array(d, S.sharegpt(), "k", root := scratch(spark, "sharegpt"))
    return _spoken(X.sharegpt(spark, root).where("tools = '[]'"), F.col("classes"), F.col("texts"))


@query("sink_chat", f"WITH {_TALK} SELECT _id, classes, texts FROM t")
def sink_chat(spark, sf):
    """Speakers and texts written as messages."""
    d = _talks(spark, sf).select("k", F.transform("messages", lambda m: m["role"]).alias("classes"), F.transform("messages", lambda m: m["content"]).alias("texts"))
    put(d, S.chat(), root := scratch(spark, "chat"))
    return _spoken(X.chat(spark, root), F.transform("messages", lambda m: m["role"]), F.transform("messages", lambda m: m["content"]))


@query("source_preference", f"WITH {_PART} SELECT j AS _id, a AS chosen, b AS rejected FROM p")
def source_preference(spark, sf):
    put(part(spark, sf), S.preference("a", "b"), root := scratch(spark, "preference"))
    return X.preference(spark, root).select(F.col("_id").cast("long").alias("_id"), "chosen", "rejected")


@query("source_extraction", f"WITH {_PART} SELECT j AS _id, a AS image, b AS content, g AS prompt, substring(b, 1, 5) AS found FROM p")
def source_extraction(spark, sf):
    row = F.to_json(
        F.struct(
            F.base64(F.col("a").cast("binary")).alias("image"), F.array(F.array(F.lit(0.0), F.lit(1.0))).alias("bbox"), F.col("b").alias("content"),
            F.array(F.struct(F.substring("b", 1, 5).alias("text"), F.lit(0).alias("start"), F.lit(5).alias("end"))).alias("result_list"),
            F.col("g").alias("prompt")
        )
    )
    put(part(spark, sf), row, root := scratch(spark, "extraction"))
    return X.extraction(spark, root).select(
        F.col("_id").cast("long").alias("_id"), F.col("image").cast("string").alias("image"), "content", "prompt",
        F.get("result_list", F.lit(0))["text"].alias("found")
    )


@query(
    "source_csc_train",
    f"WITH {_PART} SELECT CAST(k AS VARCHAR) AS _id, g AS title, a AS text, CASE WHEN n % 2 = 1 THEN n ELSE -1 END AS location, CASE WHEN n % 2 = 1 THEN b END AS correction FROM p"
)
def source_csc_train(spark, sf):
    mistake = F.when(
        F.col("n") % 2 == 1,
        F.format_string('<MISTAKE id="%d" location="%d"><WRONG>%s</WRONG><CORRECTION>%s</CORRECTION></MISTAKE>', "k", "n", "a", "b")
    ).otherwise("")
    put(
        part(spark, sf),
        F.concat(F.format_string('<ESSAY title="%s"><TEXT><PASSAGE id="%d">%s</PASSAGE></TEXT>', "g", "k", "a"), mistake, F.lit("</ESSAY>")),
        root := scratch(spark, "sgml")
    )
    m = F.get("mistakes", F.lit(0))
    return X.csc_train(spark, root).select("_id", "title", "text", F.coalesce(m["location"].cast("long"), F.lit(-1)).alias("location"), m["correction"].alias("correction"))


@query(
    "source_csc_test",
    f"""WITH {_PART} SELECT CAST(k AS VARCHAR) AS _id, a AS text, CASE WHEN n % 2 = 1 THEN 3 ELSE -1 END AS location, CASE WHEN n % 2 = 1 THEN substring(a,
  3, 1) END AS wrong, CASE WHEN n % 2 = 1 THEN 'x' END AS correction
FROM p"""
)
def source_csc_test(spark, sf):
    d, root = part(spark, sf), scratch(spark, "csc")
    put(d, F.format_string("(id=%d) %s", "k", "a"), f"{root}/in")
    put(d, F.when(F.col("n") % 2 == 1, F.format_string("%d, 3, x", "k")).otherwise(F.format_string("%d, 0", "k")), f"{root}/truth")
    m = F.get("mistakes", F.lit(0))
    return X.csc_test(spark, f"{root}/in", f"{root}/truth").select(
        "_id", "text", F.coalesce(m["location"].cast("int"), F.lit(-1)).alias("location"), m["wrong"].alias("wrong"),
        m["correction"].alias("correction")
    )


@query("source_csc_sentences", f"WITH {_PART} SELECT j AS _id, a AS text, n AS location, b AS correction FROM p")
def source_csc_sentences(spark, sf):
    put(
        part(spark, sf),
        F.format_string(
            "<SENTENCE><TEXT>%s</TEXT><MISTAKE><LOCATION>%d</LOCATION><WRONG>%s</WRONG><CORRECTION>%s</CORRECTION></MISTAKE></SENTENCE>", "a", "n",
            "g", "b"
        ),
        root := scratch(spark, "sentences")
    )
    m = F.get("mistakes", F.lit(0))
    return X.csc_sentences(spark, root).select(F.col("_id").cast("long").alias("_id"), "text", m["location"].cast("long").alias("location"), m["correction"].alias("correction"))


# Boxes: two on a 640 x 480 image for each nation, and lines of them for each supplier.
_NATION = """o AS (SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey AS VARCHAR) AS _id, n_name AS name, CAST(n_nationkey * 8 + 1 AS DOUBLE) AS x1,
  CAST(n_nationkey * 4 + 2 AS DOUBLE) AS y1, CAST(n_nationkey * 8 + 65 AS DOUBLE) AS x2, CAST(n_nationkey * 4 + 34 AS DOUBLE) AS y2,
  CAST(n_regionkey AS BIGINT) AS c FROM nation) """
_SUM = "_id, 2 AS boxes, 2 * x1 + 10 AS x1, 2 * y1 AS y1, 2 * x2 + 10 AS x2, 2 * y2 AS y2"


def nation(spark, sf) -> DataFrame:
    """Nations as images with two boxes each, the second ten pixels right of the first."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    k = F.col("n_nationkey").cast("double")
    d = n.select(
        F.col("n_nationkey").cast("long").alias("k"), F.col("n_nationkey").cast("string").alias("_id"), F.col("n_name").alias("name"),
        B.box(k * 8 + 1, k * 4 + 2, k * 8 + 65, k * 4 + 34).alias("b"), F.col("n_regionkey").cast("int").alias("c")
    )
    return d.withColumn(
        "bboxes", F.concat(F.array("b"), B.shift(F.array("b"), F.lit(10.0), F.lit(0.0)))
    ).withColumn("classes", F.array("c", "c")).withColumn("width", F.lit(640)).withColumn("height", F.lit(480)).withColumn("text", F.array("name", "name"))


def _sums(d: DataFrame, *more, digits: int = 3) -> DataFrame:
    """How many boxes there are, and the sums of their coordinates."""
    total = lambda k: F.round(F.aggregate("bboxes", F.lit(0.0), lambda a, b: a + b[k]), digits).alias(k)
    return d.select("_id", F.size("bboxes").cast("int").alias("boxes"), *map(total, ("x1", "y1", "x2", "y2")), *more)


def _class() -> Column:
    return F.get("classes", F.lit(0)).cast("long").alias("c")


@query("source_coco", f"WITH {_NATION} SELECT {_SUM}, c, name FROM o")
def source_coco(spark, sf):
    d = nation(spark, sf)
    images = d.agg(F.array_sort(F.collect_list(F.struct(F.col("k").alias("id"), F.col("name").alias("file_name"), "width", "height"))).alias("images"))
    one = d.select("k", "c", F.explode("bboxes").alias("b")).select(
        F.struct(
            F.col("k").alias("image_id"), F.col("c").alias("category_id"),
            F.array(F.col("b.x1"), F.col("b.y1"), F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")).alias("bbox")
        ).alias("a")
    )
    doc = images.crossJoin(F.broadcast(one.agg(F.collect_list("a").alias("annotations"))))  # one row each
    S.text_lines(doc, F.to_json(F.struct("images", "annotations")), root := scratch(spark, "coco"))
    return _sums(A.coco(spark, root).withColumn("_id", F.col("_id").cast("string")), _class(), F.col("file").alias("name"))


@query("source_voc", f"WITH {_NATION} SELECT {_SUM}, name, 640 AS width FROM o")
def source_voc(spark, sf):
    thing = lambda b: F.format_string(
        "<object><name>%s</name><difficult>0</difficult><bndbox><xmin>%.0f</xmin><ymin>%.0f</ymin><xmax>%.0f</xmax><ymax>%.0f</ymax></bndbox></object>",
        F.col("name"), b["x1"], b["y1"], b["x2"], b["y2"]
    )
    page = F.concat(
        F.lit("<annotation><size><width>640</width><height>480</height><depth>3</depth></size>"), F.array_join(F.transform("bboxes", thing), ""),
        F.lit("</annotation>")
    )
    put_each(nation(spark, sf), F.concat("_id", F.lit(".xml")), page, root := scratch(spark, "voc"))
    return _sums(A.voc(spark, root), F.get("classes", F.lit(0)).alias("name"), F.get("size", F.lit(0)).alias("width"))


@query("source_yolo", f"WITH {_NATION} SELECT {_SUM}, c FROM o")
def source_yolo(spark, sf):
    put_each(nation(spark, sf), F.concat("_id", F.lit(".txt")), S.yolo(), root := scratch(spark, "yolo"))
    return _sums(A.yolo(spark, root, 640.0, 480.0), _class(), digits=1)


@query("source_yolo_full", f"WITH {_NATION} SELECT {_SUM}, c, 640.0::DOUBLE AS width FROM o")
def source_yolo_full(spark, sf):
    put_each(nation(spark, sf), F.concat("_id", F.lit(".txt")), S.yolo_full(width="width", height="height"), root := scratch(spark, "yolo"))
    return _sums(A.yolo_full(spark, root), _class(), "width")


def _corners(b: Column) -> Column:
    return F.array(*[F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])


@query("source_ocr_detection", f"WITH {_NATION} SELECT {_SUM}, name || ',' || name AS text FROM o")
def source_ocr_detection(spark, sf):
    d = nation(spark, sf).withColumn("path", F.format_string("images/%s.jpg", "_id")).withColumn("segmentations", F.transform("bboxes", _corners))
    put(d, S.ocr_detection(), root := scratch(spark, "ocr"))
    return _sums(A.ocr_detection(spark, root), F.array_join("text", ",").alias("text"))


@query("source_icdar", f"WITH {_NATION} SELECT {_SUM}, name || ',' || name AS text FROM o")
def source_icdar(spark, sf):
    line = lambda b: F.concat_ws(",", *[b[k].cast("int").cast("string") for k in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")], F.col("name"))
    put_each(
        nation(spark, sf), F.concat("_id", F.lit(".txt")), F.concat(F.array_join(F.transform("bboxes", line), "\n"), F.lit("\n1,1,2,1,2,2,1,2,###")),
        root := scratch(spark, "icdar")
    )
    return _sums(A.icdar(spark, root), F.array_join("text", ",").alias("text"))


@query("source_table_chunks", f"WITH {_NATION} SELECT {_SUM}, name || ',' || name AS text FROM o")
def source_table_chunks(spark, sf):
    chunk = lambda b: F.struct(F.array(b["x1"], b["x2"], 842 - b["y2"], 842 - b["y1"]).alias("pos"), F.col("name").alias("text"))
    put_each(nation(spark, sf), F.concat("_id", F.lit(".chunk")), F.to_json(F.struct(F.transform("bboxes", chunk).alias("chunks"))), root := scratch(spark, "chunks"))
    return _sums(A.table_chunks(spark, root), F.array_join("text", ",").alias("text"))


@query("source_facades", f"WITH {_NATION} SELECT {_SUM}, c FROM o")
def source_facades(spark, sf):
    thing = lambda b: F.format_string(
        "<object><points><x>%.0f</x><x>%.0f</x><y>%.0f</y><y>%.0f</y></points><label>%d</label></object>", b["y1"], b["y2"], b["x1"], b["x2"],
        F.col("c") + 1
    )
    put_each(nation(spark, sf), F.concat("_id", F.lit(".xml")), F.array_join(F.transform("bboxes", thing), "\n"), root := scratch(spark, "facades"))
    return _sums(A.facades(spark, root), _class())


@query("source_tables_html", f"WITH {_NATION} SELECT {_SUM}, name || ',' || name AS text, 'train' AS split FROM o")
def source_tables_html(spark, sf):
    cell = lambda b: F.struct(F.split("name", "").alias("tokens"), F.array(b["x1"], b["y1"], b["x2"], b["y2"]).alias("bbox"))
    page = F.struct(
        F.concat("_id", F.lit(".png")).alias("filename"), F.lit("train").alias("split"),
        F.struct(F.struct(F.array(F.lit("<td>")).alias("tokens")).alias("structure"), F.transform("bboxes", cell).alias("cells")).alias("html")
    )
    put(nation(spark, sf), F.to_json(page), root := scratch(spark, "tables"))
    return _sums(A.tables_html(spark, root), F.array_join("text", ",").alias("text"), "split")


@query("source_text_images", f"WITH {_NATION} SELECT _id, name AS content, CASE WHEN k % 2 = 0 THEN name ELSE '' END AS text FROM o")
def source_text_images(spark, sf):
    d, root = nation(spark, sf), scratch(spark, "images")
    put_each(d, F.concat("_id", F.lit(".png")), F.col("name"), f"{root}/images")
    put_each(d.where("k % 2 = 0"), F.concat("_id", F.lit(".txt")), F.col("name"), f"{root}/texts")
    return A.text_images(spark, f"{root}/images", f"{root}/texts").select("_id", F.col("content").cast("string").alias("content"), "text")


@query("source_image_masks", f"WITH {_NATION} SELECT _id, name AS content, _id AS mask FROM o")
def source_image_masks(spark, sf):
    d, root = nation(spark, sf), scratch(spark, "masks")
    put_each(d, F.concat("_id", F.lit(".png")), F.col("name"), f"{root}/images")
    put_each(d, F.concat("_id", F.lit(".png")), F.col("_id"), f"{root}/masks")
    return A.image_masks(spark, f"{root}/images", f"{root}/masks").select("_id", F.col("content").cast("string").alias("content"), F.col("mask").cast("string").alias("mask"))


@query("source_images", f"WITH {_NATION} SELECT _id, name AS content, length(name) AS length FROM o")
def source_images(spark, sf):
    put_each(nation(spark, sf), F.concat("_id", F.lit(".jpg")), F.col("name"), root := scratch(spark, "images"))
    return A.files(spark, root).select("_id", F.col("content").cast("string").alias("content"), "length")


@query("source_zip", f"WITH {_NATION} SELECT _id || '.png' AS name, name AS content FROM o")
def source_zip(spark, sf):
    root = scratch(spark, "zip") + ".zip"
    S.zip_file(nation(spark, sf).select(F.concat("_id", F.lit(".png")).alias("name"), F.col("name").cast("binary").alias("content")), local(root))
    return A.zip_members(spark, root).select("name", F.col("content").cast("string").alias("content"))


@query("source_zip_format", f"WITH {_NATION} SELECT _id || '.png' AS name, name AS content FROM o WHERE k % 2 = 0 UNION ALL SELECT _id || '.jpg', name FROM o WHERE k % 2 = 1")
def source_zip_format(spark, sf):
    """Archives of several tasks in a folder, read by the registered format."""
    formats.register(spark)
    root, d = scratch(spark, "zips"), nation(spark, sf)
    named = F.concat("_id", F.when(F.col("k") % 2 == 0, ".png").otherwise(".jpg"))
    S.zip_parts(d.select(named.alias("name"), F.col("name").cast("binary").alias("content")).repartition(3), local(root))
    found = spark.read.format("corpusmill_zip").option("members", "5").option("suffixes", ".png,.jpg").load(root)
    return found.select("name", F.col("content").cast("string").alias("content"))


@query("sink_class_folders", f"WITH {_NATION} SELECT _id, c AS _class, 4 AS height, 3 AS width, CAST(k * 12 AS DOUBLE) AS total FROM o")
def sink_class_folders(spark, sf):
    """Images written as PNG files to a folder for each class, and read back with the folders' numbers."""
    root = scratch(spark, "classes")
    d = nation(spark, sf).withColumn("folder", F.concat(F.lit("r"), F.col("c").cast("string")))
    shown = image.on_image(image.gray_from(F.array_repeat(F.col("k").cast("double"), 12), 4, 3), lambda a: a.astype("uint8"))
    S.save_images(d.withColumn("image", shown), local(root), "_id", "image", "folder")
    found = A.class_folders(spark, root, {f"r{i}": i for i in range(5)}).select("_id", "_class", media.decode_image(F.col("content"), True).alias("image"))
    total = F.aggregate(image.pixels(F.col("image")), F.lit(0.0), lambda a, x: a + x)
    return found.select("_id", F.col("_class").cast("long").alias("_class"), "image.height", "image.width", total.alias("total"))


@query("sink_sounds", f"WITH {_NATION} SELECT _id, 8000 AS rate, CAST(k AS DOUBLE) / 32768 AS first, 5 AS n FROM o")
def sink_sounds(spark, sf):
    """Samples written as WAV files and read back."""
    root = scratch(spark, "sounds")
    S.save_sounds(nation(spark, sf).withColumn("samples", F.array_repeat(F.col("k") / 32768.0, 5)), local(root), 8000, "_id")
    found = A.files(spark, root, (".wav",)).select("_id", media.decode_sound(F.col("content"), True).alias("s"))
    return found.select("_id", "s.rate", F.get("s.samples", F.lit(0)).alias("first"), F.size("s.samples").alias("n"))


@query("sink_extraction", f"WITH {_PART} SELECT j AS _id, a AS image, b AS content, g AS prompt FROM p")
def sink_extraction(spark, sf):
    """Extraction records written by the sink."""
    d = part(spark, sf).select(
        "k", F.col("a").cast("binary").alias("image"), F.array(F.array(F.lit(0.0))).alias("bbox"), F.col("b").alias("content"),
        F.array(F.struct(F.lit("x").alias("text"), F.lit(0).alias("start"), F.lit(1).alias("end"))).alias("result_list"), F.col("g").alias("prompt"),
    )
    put(d, S.extraction(), root := scratch(spark, "extraction"))
    return X.extraction(spark, root).select(F.col("_id").cast("long").alias("_id"), F.col("image").cast("string").alias("image"), "content", "prompt")


@query("source_labelled_boxes", f"WITH {_NATION} SELECT {_SUM}, CAST(c AS VARCHAR) AS c FROM o")
def source_labelled_boxes(spark, sf):
    d = nation(spark, sf).withColumn("path", F.format_string("/data/upload/ab-%s.jpg", "_id")).withColumn("classes", F.transform("classes", lambda c: c.cast("string")))
    S.as_one_array(d, S.labelling_task("path", S.box_results()), "k", root := scratch(spark, "labels"))
    return _sums(A.labelled_boxes(spark, root), F.get("classes", F.lit(0)).alias("c"))


@query("source_labelled_classes", f"WITH {_NATION} SELECT _id, 'ab' AS sub_id, c FROM o")
def source_labelled_classes(spark, sf):
    d = nation(spark, sf).withColumn("path", F.format_string("/data/upload/ab-%s.jpg", "_id")).withColumn("classes", F.array(F.concat(F.lit("r"), F.col("c"))))
    S.as_one_array(d, S.labelling_task("path", S.choice_results()), "k", root := scratch(spark, "labels"))
    return A.labelled_classes(spark, root, [f"r{i}" for i in range(5)]).select("_id", "sub_id", _class())


@query("source_labelled_speech", f"WITH {_NATION} SELECT _id, name AS text FROM o")
def source_labelled_speech(spark, sf):
    d = nation(spark, sf).withColumn("path", F.format_string("/data/upload/ab-%s.wav", "_id"))
    S.as_one_array(d, S.labelling_task("path", S.text_results("name"), "audio"), "k", root := scratch(spark, "labels"))
    return A.labelled_speech(spark, root).select("_id", "text")


@query("source_labelled_spans", f"WITH {_NATION} SELECT _id, name AS class, x1 AS start, x2 AS \"end\" FROM o")
def source_labelled_spans(spark, sf):
    d = nation(spark, sf).withColumn("path", F.format_string("/data/upload/ab-%s.wav", "_id"))
    d = d.withColumn("timestamps", F.array(F.struct(F.col("b.x1").alias("start"), F.col("b.x2").alias("end")))).withColumn("names", F.array("name"))
    S.as_one_array(d, S.labelling_task("path", S.span_results("timestamps", "names"), "audio"), "k", root := scratch(spark, "labels"))
    t = F.get("timestamps", F.lit(0))
    return A.labelled_spans(spark, root).select("_id", F.get("classes", F.lit(0)).alias("class"), t["start"].alias("start"), t["end"].alias("end"))


@query("source_speech", f"WITH {_PART} SELECT k || '.wav' AS _id, 'au/' || k || '.wav' AS audio, a AS text FROM p")
def source_speech(spark, sf):
    put(part(spark, sf).withColumn("audio", F.format_string("au/%d.wav", "k")), S.speech("audio", "a"), root := scratch(spark, "speech"))
    return A.speech_lines(spark, root)


@query("source_ocr_recognition", f"WITH {_PART} SELECT CAST(k AS VARCHAR) AS _id, a AS text, 1.0::DOUBLE AS conf FROM p")
def source_ocr_recognition(spark, sf):
    put(part(spark, sf).withColumn("path", F.format_string("crops/%d.png", "k")), S.tsv("path", "a"), root := scratch(spark, "rec"))
    return A.ocr_recognition(spark, root).select("_id", "text", "conf")


@query("source_ocr_distilled", f"WITH {_PART} SELECT CAST(k AS VARCHAR) AS _id, a AS text, b AS teacher FROM p")
def source_ocr_distilled(spark, sf):
    d = part(spark, sf).withColumn("path", F.format_string("crops/%d.png", "k")).withColumn("both", F.to_json(F.struct(F.col("a").alias("Student"), F.col("b").alias("Teacher"))))
    put(d, S.tsv("path", "both"), root := scratch(spark, "rec"))
    return A.ocr_recognition(spark, root, True).select("_id", "text", "teacher")


@query("source_synth_words", f"WITH {_PART} SELECT k || '_' || replace(g, '#', '-') || '_' || n AS _id, replace(g, '#', '-') AS text, n AS word FROM p")
def source_synth_words(spark, sf):
    put(part(spark, sf), F.format_string("./1/%d_%s_%d.jpg %d", "k", F.regexp_replace("g", "#", "-"), "n", "n"), root := scratch(spark, "synth"))
    return A.synth_words(spark, root).select("_id", "text", F.col("word").cast("long").alias("word"))


@query("source_attributes", f"WITH {_PART} SELECT k || '.jpg' AS _id, ['train', 'val', 'test'][k % 3 + 1] AS split, n AS identity, 2 AS attrs, n AS x FROM p")
def source_attributes(spark, sf):
    d, root = part(spark, sf), scratch(spark, "faces")
    for f, cells in (("part", "%d.jpg %d"), ("id", "%d.jpg %d"), ("attr", "%d.jpg  1 -1"), ("box", "%d.jpg %d 1 2 3"), ("marks", "%d.jpg %d 5")):
        more = [F.col("k") % 3] if f == "part" else [] if f == "attr" else [F.col("n")]
        put_parts(d, F.format_string(cells, "k", *more), f"{root}/{f}", "count" if f in ("attr", "box") else None)
    first = lambda c: F.get(c, F.lit(0)).cast("long")
    return A.attributes(spark, root, "part", "id", "attr", "box", "marks").select(
        "_id", "split", first("identity").alias("identity"), F.size("attr").cast("int").alias("attrs"), first("bbox").alias("x")
    )


@query("cache_round_trip", f"WITH {_PART} SELECT k, a, s AS split FROM p")
def cache_round_trip(spark, sf):
    """A table with splits, saved and loaded."""
    d = part(spark, sf)
    parts = {s: d.where(F.col("s") == s).select("k", "a") for s in _SPLITS}
    pipeline.save_cache(pipeline.union_splits(parts), root := scratch(spark, "cache"))
    return pipeline.load_cache(spark, root).select("k", "a", "split")


@query("generate_records", "SELECT p_partkey AS k, upper(p_name) AS name FROM part WHERE p_size > 10 AND p_partkey % 7 <> 0 AND length(p_name) > 3")
def generate_records(spark, sf):
    """Hooks in order: filter, parse (which empties some records), convert, filter."""
    gone = F.col("p_partkey") % 7 == 0
    parse = lambda d: d.select(F.when(~gone, F.col("p_partkey")).alias("k"), F.when(gone, "").otherwise(F.col("p_name")).alias("name"))
    return pipeline.generate(
        spark.read.parquet(f"{sf}/part.parquet"), parse, start_filter="p_size > 10", end_convert=lambda d: d.withColumn("name", F.upper("name")),
        end_filter="length(name) > 3"
    )


_register_nli()
