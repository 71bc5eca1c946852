"""Image and audio annotation sources.

Files come from the ``binaryFile`` and text readers; annotations are parsed by
JSON, XPath and regular functions.  Only payloads that need decoding (IDX,
CIFAR's binary form, zip members) run in Python, in Arrow batches.
"""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes as B
from .text import fields, label_index, lines, numbered_lines

_POINTS = "array<array<double>>"


def files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".bmp")) -> DataFrame:
    """Files below a folder: ``path``, ``_id`` (name without suffix), ``length``, ``content``."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ok = None
    for s in suffixes:
        t = F.lower("path").endswith(s)
        ok = t if ok is None else ok | t
    return d.where(ok).select("path", stem_of(F.col("path")).alias("_id"), "length", "content")


def stem_of(path: Column) -> Column:
    """A path's name without its suffix."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def sibling(path: Column, folder_from: str, folder_to: str, suffix: str) -> Column:
    """The path with its last folder of one name replaced, and another suffix."""
    return F.regexp_replace(F.regexp_replace(path, rf"/{folder_from}/(?!.*/{folder_from}/)", f"/{folder_to}/"), r"\.[^./]*$", suffix)


def with_sidecar(images: DataFrame, notes: DataFrame, default: str | None = None) -> DataFrame:
    """Images left-joined with notes (``_id``, ``text``) on the stem, with a default for those without."""
    out = images.join(notes, "_id", "left")
    return out.withColumn("text", F.coalesce("text", F.lit(default))) if default is not None else out


def text_images(spark, images: str, texts: str) -> DataFrame:
    """Images with their text files; '' without one."""
    t = spark.read.text(texts, wholetext=True).select(stem_of(F.col("_metadata.file_path")).alias("_id"), F.col("value").alias("text"))
    return with_sidecar(files(spark, images), t, "")


def image_masks(spark, images: str, masks: str) -> DataFrame:
    """Images joined with their masks by name."""
    m = files(spark, masks).select("_id", F.col("content").alias("mask"))
    return files(spark, images).join(m, "_id")


def repeated_images(spark, path: str) -> DataFrame:
    """Folders named ``{n}_{name}``: each image n times."""
    d = files(spark, path)
    folder = F.element_at(F.split("path", "/"), -2)
    n = F.regexp_extract(folder, r"^(\d+)_", 1).cast("int")
    return d.where(n > 0).select("*", F.regexp_extract(folder, r"^\d+_(.*)$", 1).alias("name"), F.explode(F.sequence(F.lit(1), n)).alias("copy"))


def coco(spark, path: str) -> DataFrame:
    """Images left-joined with their grouped annotations: ``_id``, ``file``, ``size``, ``bboxes``, ``classes``."""
    s = "struct<images:array<struct<id:long,file_name:string,width:int,height:int>>,annotations:array<struct<image_id:long,category_id:int,bbox:array<double>>>,categories:array<struct<id:int,name:string>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", s).alias("d"))
    image = doc.select(F.explode("d.images").alias("i")).select("i.*")
    b = F.col("a.bbox")
    note = doc.select(F.explode("d.annotations").alias("a")).select(
        F.col("a.image_id").alias("id"), F.struct(B.xywh_to_xyxy(b[0], b[1], b[2], b[3]).alias("b"), F.col("a.category_id").alias("c")).alias("n")
    )
    got = note.groupBy("id").agg(F.array_sort(F.collect_list("n")).alias("n"))
    out = image.join(got, "id", "left").withColumn("n", F.coalesce("n", F.array().cast(got.schema["n"].dataType)))
    return out.select(
        F.col("id").alias("_id"), F.col("file_name").alias("file"), F.array("width", "height").alias("size"),
        F.transform("n", lambda x: x["b"]).alias("bboxes"), F.transform("n", lambda x: x["c"]).alias("classes")
    )


def voc(spark, path: str, classes: list[str] | None = None) -> DataFrame:
    """XML boxes: ``_id``, ``size``, ``bboxes``, ``classes`` (names, or numbers with a list), ``difficult``."""
    d = spark.read.text(path, wholetext=True).select(stem_of(F.col("_metadata.file_path")).alias("_id"), F.col("value").alias("x"))
    num = lambda p: F.transform(F.xpath("x", F.lit(p + "/text()")), lambda v: v.cast("double"))
    z = F.arrays_zip(*[num(f"//object/bndbox/{k}").alias(k) for k in ("xmin", "ymin", "xmax", "ymax")])
    names = F.xpath("x", F.lit("//object/name/text()"))
    return d.select(
        "_id", F.array(
            F.xpath_int("x", F.lit("//size/width")), F.xpath_int("x", F.lit("//size/height")), F.xpath_int("x", F.lit("//size/depth"))
        ).alias("size"), F.transform(z, lambda v: B.box(v["xmin"], v["ymin"], v["xmax"], v["ymax"])).alias("bboxes"),
        (
            F.transform(names, lambda n: label_index(n, classes, False)) if classes else names
        ).alias("classes"), F.transform(F.xpath("x", F.lit("//object/difficult/text()")), lambda v: v.cast("int")).alias("difficult"),
    )


def yolo(spark, labels: str, width: Column | float = 1.0, height: Column | float = 1.0) -> DataFrame:
    """Label files ``class cx cy w h`` in shares of the image: one row a file. Images without a file are found by an anti-join."""
    d = lines(spark, labels).where(F.trim("value") != "").select(
        stem_of(F.col("_file")).alias("_id"), F.transform(F.split(F.trim("value"), r"\s+"), lambda v: v.cast("double")).alias("f")
    )
    b = B.xywh_to_xyxy(F.col("f")[1], F.col("f")[2], F.col("f")[3], F.col("f")[4], True, width, height)
    return d.groupBy("_id").agg(F.collect_list(F.struct(b.alias("b"), F.col("f")[0].cast("int").alias("c"))).alias("n")).select(
        "_id", F.transform("n", lambda x: x["b"]).alias("bboxes"), F.transform("n", lambda x: x["c"]).alias("classes")
    )


def yolo_full(spark, labels: str) -> DataFrame:
    """Label files ``class x1 y1 x2 y2 conf w h`` in pixels."""
    d = lines(spark, labels).where(F.trim("value") != "").select(
        stem_of(F.col("_file")).alias("_id"), F.transform(F.split(F.trim("value"), r"[\s,]+"), lambda v: v.cast("double")).alias("f")
    )
    n = F.struct(
        B.box(*[F.col("f")[i] for i in (1, 2, 3, 4)]).alias("b"), F.col("f")[0].cast("int").alias("c"), F.col("f")[5].alias("conf"),
        F.col("f")[6].alias("w"), F.col("f")[7].alias("h")
    )
    g = d.groupBy("_id").agg(F.collect_list(n).alias("n"))
    pick = lambda k, name: F.transform("n", lambda x: x[k]).alias(name)  # noqa: E731  (a second parameter of a lambda would be the index)
    return g.select(
        "_id", *[pick(k, v) for k, v in (("b", "bboxes"), ("c", "classes"), ("conf", "confs"))], F.get("n", F.lit(0))["w"].alias("width"),
        F.get("n", F.lit(0))["h"].alias("height")
    )


def _polygons(c: Column) -> Column:
    return F.transform(c, lambda p: F.transform(p, lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))))


def ocr_detection(spark, path: str) -> DataFrame:
    """Lines ``path<tab>[{points, transcription}]``: polygons, their bounds, texts."""
    d = fields(numbered_lines(spark, path), ["path", "json"], limit=2)
    e = F.from_json("json", f"array<struct<points:{_POINTS},transcription:string>>")
    d = d.select(stem_of(F.col("path")).alias("_id"), "path", e.alias("e")).withColumn("segmentations", _polygons(F.transform("e", lambda x: x["points"])))
    return d.select("_id", "path", "segmentations", F.transform("segmentations", B.bounds).alias("bboxes"), F.transform("e", lambda x: x["transcription"]).alias("text"))


def ocr_recognition(spark, path: str, distilled: bool = False) -> DataFrame:
    """Lines ``path(s)<tab>text[<tab>conf]``; a JSON list of paths becomes a row for each; ``distilled`` reads {Student, Teacher} labels."""
    d = fields(numbered_lines(spark, path), ["paths", "text", "conf"], limit=3)
    many = F.when(F.col("paths").startswith("["), F.from_json("paths", "array<string>", {"allowSingleQuotes": "true"})).otherwise(F.array("paths"))
    d = d.select(F.explode(many).alias("path"), "text", F.coalesce(F.col("conf").cast("double"), F.lit(1.0)).alias("conf"))
    if distilled:
        d = d.select("path", F.get_json_object("text", "$.Student").alias("text"), F.get_json_object("text", "$.Teacher").alias("teacher"), "conf")
    return d.select(stem_of(F.col("path")).alias("_id"), "*")


def icdar(spark, path: str) -> DataFrame:
    """Lines ``x1,y1,...,x4,y4,text``; unreadable ones (###) are dropped; one row a file."""
    d = lines(spark, path).where(F.trim("value") != "").select(
        stem_of(F.col("_file")).alias("_id"), F.split(F.regexp_replace("value", "^﻿", ""), ",", 9).alias("f")
    ).where(F.get("f", F.lit(8)) != "###")
    p = F.array(*[F.struct(F.col("f")[2 * i].cast("double").alias("x"), F.col("f")[2 * i + 1].cast("double").alias("y")) for i in range(4)])
    return d.groupBy("_id").agg(F.collect_list(F.struct(p.alias("p"), F.col("f")[8].alias("t"))).alias("n")).select(
        "_id", F.transform("n", lambda x: x["p"]).alias("segmentations"), F.transform("n", lambda x: B.bounds(x["p"])).alias("bboxes"),
        F.transform("n", lambda x: x["t"]).alias("text")
    )


def synth_words(spark, path: str) -> DataFrame:
    """Lines ``path number``; the text is the second part of the name."""
    d = lines(spark, path).select(F.split("value", r"\s+").alias("f"))
    return d.select(
        stem_of(F.col("f")[0]).alias("_id"), F.col("f")[0].alias("path"), F.get(F.split(stem_of(F.col("f")[0]), "_"), F.lit(1)).alias("text"),
        F.col("f")[1].cast("int").alias("word")
    )


def attributes(spark, root: str, partition: str, identity: str, attr: str, bbox: str, landmarks: str) -> DataFrame:
    """Face tables of white-space columns, inner-joined on the file name; ``split`` from the partition list."""
    table = lambda f: lines(spark, f"{root}/{f}").where(F.col("value").rlike(r"^\S+\.\w+\s")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    rest = lambda f, n: table(f).select(F.col("f")[0].alias("_id"), F.transform(F.slice("f", 2, 1000), lambda x: x.cast("int")).alias(n))
    p = table(partition).select(F.col("f")[0].alias("_id"), F.element_at(F.create_map(*[F.lit(x) for x in ("0", "train", "1", "val", "2", "test")]), F.col("f")[1]).alias("split"))
    out = p
    for f, n in ((identity, "identity"), (attr, "attr"), (bbox, "bbox"), (landmarks, "landmarks")):
        out = out.join(rest(f, n), "_id")
    return out


def tables_html(spark, path: str) -> DataFrame:
    """Table images' JSON lines: ``_id``, ``split``, structure tokens, and the cells that have a box."""
    s = "struct<filename:string,split:string,html:struct<structure:struct<tokens:array<string>>,cells:array<struct<tokens:array<string>,bbox:array<double>>>>>"
    d = lines(spark, path).select(F.from_json("value", s).alias("e"))
    cells = F.filter("e.html.cells", lambda c: c["bbox"].isNotNull())
    return d.select(
        stem_of(F.col("e.filename")).alias("_id"), F.col("e.split").alias("split"), F.col("e.html.structure.tokens").alias("structure"),
        F.transform(cells, lambda c: F.array_join(c["tokens"], "")).alias("text"),
        F.transform(cells, lambda c: B.box(c["bbox"][0], c["bbox"][1], c["bbox"][2], c["bbox"][3])).alias("bboxes")
    )


def table_chunks(spark, path: str, page_height: float = 842.0) -> DataFrame:
    """Chunk files ``{chunks: [{pos: [x1, x2, y1, y2], text}]}`` with y up: boxes with y down."""
    d = spark.read.text(path, wholetext=True).select(
        stem_of(F.col("_metadata.file_path")).alias("_id"),
        F.from_json("value", "struct<chunks:array<struct<pos:array<double>,text:string>>>").alias("e")
    )
    return d.select(
        "_id",
        F.transform("e.chunks", lambda c: B.box(c["pos"][0], page_height - c["pos"][3], c["pos"][1], page_height - c["pos"][2])).alias("bboxes"),
        F.transform("e.chunks", lambda c: c["text"]).alias("text")
    )


def facades(spark, path: str) -> DataFrame:
    """XML points: boxes from the first and last of two shares on each axis, and labels from 0."""
    d = spark.read.text(path, wholetext=True).select(stem_of(F.col("_metadata.file_path")).alias("_id"), F.concat(F.lit("<r>"), F.col("value"), F.lit("</r>")).alias("x"))
    num = lambda p: F.transform(F.xpath("x", F.lit(p)), lambda v: F.trim(v).cast("double"))
    xs, ys, ls = num("//object/points/x/text()"), num("//object/points/y/text()"), num("//object/label/text()")
    k = F.sequence(F.lit(0), F.size(ls) - 1)
    return d.select(
        "_id", F.transform(k, lambda i: B.box(F.get(ys, i * 2), F.get(xs, i * 2), F.get(ys, i * 2 + 1), F.get(xs, i * 2 + 1))).alias("bboxes"),
        F.transform(ls, lambda v: (v - 1).cast("int")).alias("classes")
    )


_LS = "array<struct<id:string,data:map<string,string>,annotations:array<struct<result:array<struct<type:string,original_width:int,original_height:int,value:struct<x:double,y:double,width:double,height:double,points:array<array<double>>,rectanglelabels:array<string>,polygonlabels:array<string>,choices:array<string>,text:array<string>,labels:array<string>,start:double,end:double>>>>>>>"


def labelling_tasks(spark, path: str, key: str = "image") -> DataFrame:
    """Exported labelling tasks, one row each: ``_id`` and ``sub_id`` from the payload's name, ``path``, ``results``."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", _LS)).alias("t"))
    p = F.element_at("t.data", F.lit(key))
    name = stem_of(p)
    r = F.flatten(F.transform("t.annotations", lambda a: a["result"]))
    return d.select(
        F.when(name.contains("-"), F.regexp_extract(name, r"^([^-]*)-", 1)).alias("sub_id"), F.regexp_replace(name, r"^[^-]*-", "").alias("_id"),
        p.alias("path"), r.alias("results")
    )


def labelled_classes(spark, path: str, classes: list[str]) -> DataFrame:
    """Choices as class numbers."""
    d = labelling_tasks(spark, path)
    return d.select(
        "_id", "sub_id", "path",
        F.transform(
            F.flatten(F.transform(F.filter("results", lambda r: r["value"]["choices"].isNotNull()), lambda r: r["value"]["choices"])),
            lambda c: label_index(c, classes, False)
        ).alias("classes")
    )


def labelled_boxes(spark, path: str) -> DataFrame:
    """Rectangles (percent) as boxes in pixels, and polygons as points in pixels, clipped."""
    d = labelling_tasks(spark, path)
    rect, poly = F.filter("results", lambda r: r["value"]["rectanglelabels"].isNotNull()), F.filter("results", lambda r: r["value"]["polygonlabels"].isNotNull())
    px = lambda v, n: F.least(F.greatest(v * n / 100, F.lit(0.0)), n.cast("double"))
    return d.select(
        "_id", "sub_id", "path", F.transform(
            rect,
            lambda r: B.xywh_to_xyxy(
                r["value"]["x"], r["value"]["y"], r["value"]["width"], r["value"]["height"], False, r["original_width"] / 100,
                r["original_height"] / 100
            )
        ).alias("bboxes"), F.transform(rect, lambda r: r["value"]["rectanglelabels"][0]).alias("classes"),
        F.transform(
            poly,
            lambda r: F.transform(
                r["value"]["points"], lambda q: F.struct(px(q[0], r["original_width"]).alias("x"), px(q[1], r["original_height"]).alias("y"))
            )
        ).alias("segmentations"), F.transform(poly, lambda r: r["value"]["polygonlabels"][0]).alias("polygon_classes"),
    )


def labelled_speech(spark, path: str) -> DataFrame:
    """Text areas joined, choices behind."""
    d = labelling_tasks(spark, path, "audio")
    text = F.array_join(F.flatten(F.transform(F.filter("results", lambda r: r["value"]["text"].isNotNull()), lambda r: r["value"]["text"])), "")
    return d.select(
        "_id", "sub_id", F.col("path").alias("audio"), text.alias("text"),
        F.flatten(F.transform(F.filter("results", lambda r: r["value"]["choices"].isNotNull()), lambda r: r["value"]["choices"])).alias("choices")
    )


def labelled_spans(spark, path: str) -> DataFrame:
    """Labelled audio intervals in seconds."""
    d = labelling_tasks(spark, path, "audio")
    r = F.filter("results", lambda r: r["value"]["labels"].isNotNull())
    return d.select(
        "_id", "sub_id", F.col("path").alias("audio"), F.transform(r, lambda x: x["value"]["labels"][0]).alias("classes"),
        F.transform(r, lambda x: F.struct(x["value"]["start"].alias("start"), x["value"]["end"].alias("end"))).alias("timestamps")
    )


def speech_lines(spark, path: str) -> DataFrame:
    """JSON lines {source, target}: ``_id``, ``audio``, ``text``."""
    d = lines(spark, path).select(F.from_json("value", "struct<source:string,target:string>").alias("e"))
    return d.select(F.element_at(F.split("e.source", "/"), -1).alias("_id"), F.col("e.source").alias("audio"), F.col("e.target").alias("text"))


def class_folders(spark, path: str, synsets: dict[str, int]) -> DataFrame:
    """Images in a folder for each class."""
    folder = F.element_at(F.split("path", "/"), -2)
    table = F.create_map(*[x for k, v in synsets.items() for x in (F.lit(k), F.lit(v))])
    return files(spark, path).withColumn("_class", table[folder])


def idx(spark, path: str) -> DataFrame:
    """IDX files (gzip or not), a row for each item: ``_id``, ``shape``, ``data``."""
    import gzip

    def parse(batches):
        for pdf in batches:
            for raw in pdf.content:
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                kind, n = raw[2], raw[3]
                shape = np.frombuffer(raw, ">i4", n, 4)
                a = np.frombuffer(raw, {8: "u1", 9: "i1", 11: ">i2", 12: ">i4", 13: ">f4", 14: ">f8"}[kind], offset=4 + 4 * n).reshape(shape)
                item = [int(x) for x in shape[1:]]
                for i in range(0, len(a), 4096):
                    part = a[i : i + 4096]
                    yield pd.DataFrame({"_id": range(i, i + len(part)), "shape": [item] * len(part), "data": [x.tobytes() for x in part]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "_id long, shape array<int>, data binary")


def cifar_binary(spark, path: str, label_bytes: int = 1) -> DataFrame:
    """Fixed records of labels and 3x32x32 planes (the binary distribution; pickles are never opened): ``_class``, ``data`` in row order."""
    d = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches):
        for pdf in batches:
            for raw in pdf.content:
                a = np.frombuffer(raw, np.uint8).reshape(-1, label_bytes + 3072)
                yield pd.DataFrame({"_class": a[:, label_bytes - 1].astype(int), "data": [x[label_bytes:].reshape(3, 32, 32).transpose(1, 2, 0).tobytes() for x in a]})

    return d.mapInPandas(parse, "_class long, data binary")


def zip_members(spark, path: str, suffixes: tuple[str, ...] = (".jpg", ".png", ".json", ".txt")) -> DataFrame:
    """Members of zip archives: ``archive``, ``name``, ``content``."""

    def parse(batches):
        for pdf in batches:
            for p, raw in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for n in z.namelist():
                        if n.lower().endswith(suffixes):
                            yield pd.DataFrame({"archive": [p], "name": [n], "content": [z.read(n)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "archive string, name string, content binary")


def synthetic_glyphs(spark, n: int, alphabet: str = "0123456789", length: int = 4, seed: int = 0) -> DataFrame:
    """n labelled images of random words in a five-by-three pixel font: ``_id``, ``text``, ``image``."""
    from ..operators.image import FIELDS, to_struct

    rng = np.random.default_rng(17)
    font = {c: rng.integers(0, 2, (5, 3)).astype(np.uint8) * 255 for c in alphabet}

    def draw(batches):
        for pdf in batches:
            rows = []
            for i in pdf.id:
                r = np.random.default_rng([seed, int(i)])
                t = "".join(r.choice(list(alphabet), length))
                rows.append({"_id": int(i), "text": t, "image": to_struct(np.hstack([np.pad(font[c], 1) for c in t]))})
            yield pd.DataFrame(rows)

    return spark.range(n).mapInPandas(draw, f"_id long, text string, image struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")


def shrink_glyph_boxes(boxes: Column, share: float = 0.2, zoom: float = 1.33) -> Column:
    """Character boxes of a page layout shrunk in height from both sides and zoomed to pixels."""
    return F.transform(
        boxes,
        lambda b: B.box(
            b["x1"] * zoom, (b["y1"] + (b["y2"] - b["y1"]) * share / 2) * zoom, b["x2"] * zoom, (b["y2"] - (b["y2"] - b["y1"]) * share / 2) * zoom
        )
    )
