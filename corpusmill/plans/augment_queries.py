"""Queries of composed geometric steps: images are parts, sized by their numbers, with a box each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import augment as A
from ..operators import boxes as B
from ..operators import image
from ..sources import media
from .media_queries import byte_image
from .registry import query
from .vision_queries import _wave

_P = """WITH p AS (SELECT p_partkey AS k, p_brand AS g, CAST(p_size * 10 + 100 AS DOUBLE) AS w, CAST(p_partkey % 50 + 200 AS DOUBLE) AS h,
  CAST(p_size AS DOUBLE) AS x1, 20.0::DOUBLE AS y1, CAST(p_size * 2 + 60 AS DOUBLE) AS x2, 120.0::DOUBLE AS y2
FROM part) """


def _parts(spark, sf) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    n = F.col("p_size").cast("double")
    return p.select(
        F.col("p_partkey").alias("k"), F.col("p_brand").alias("g"), (F.col("p_size") * 10 + 100).cast("int").alias("width"),
        (F.col("p_partkey") % 50 + 200).cast("int").alias("height"), F.array(B.box(n, F.lit(20.0), n * 2 + 60, F.lit(120.0))).alias("bboxes"),
        F.array("p_size").alias("classes")
    )


def _flat(df: DataFrame, digits: int | None = None) -> DataFrame:
    cut = lambda c: F.round(c, digits) if digits else F.col(c)
    # a plain explode makes Spark test first whether there is anything to explode, with all steps written out in one expression: rows without
    # boxes come through here and go by their missing place
    each = df.select("k", "width", "height", F.posexplode_outer("bboxes").alias("n", "b")).where("n is not null")
    return each.select("k", "width", "height", *[cut(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def _letterboxed(dst: str) -> str:
    return f"""s AS (SELECT *, CAST({dst} AS DOUBLE) AS d FROM p), q AS (SELECT *, least(d / w, d / h) AS r FROM s),
z AS (SELECT *, floor((d - round(w * r)) / 2) AS l, floor((d - round(h * r)) / 2) AS t FROM q)
SELECT k, CAST(d AS INTEGER) AS width, CAST(d AS INTEGER) AS height, trunc(x1 * r) + l AS x1, trunc(y1 * r) + t AS y1, trunc(x2 * r) + l AS x2, trunc(y2 * r) + t AS y2 FROM z"""


@query("augment_letterbox", f"{_P}, {_letterboxed('416')}")
def augment_letterbox(spark, sf):
    return _flat(A.augment(_parts(spark, sf), A.letterbox(416, 416)))


@query("augment_batch_letterbox", f"{_P}, {_letterboxed('min(least(w, h)) OVER (PARTITION BY g)')}")
def augment_batch_letterbox(spark, sf):
    """The images of a brand brought to the shortest side among them."""
    return _flat(A.batch_letterbox(_parts(spark, sf), "g"))


@query(
    "augment_batch_pad",
    f"""{_P}, s AS (SELECT *, max(w) OVER (PARTITION BY g) AS dw, max(h) OVER (PARTITION BY g) AS dh FROM p)
SELECT k, CAST(dw AS INTEGER) AS width, CAST(dh AS INTEGER) AS height, x1 + floor((dw - w) / 2) AS x1, y1 + floor((dh - h) / 2) AS y1, x2 + floor((dw - w) / 2) AS x2, y2 + floor((dh - h) / 2) AS y2 FROM s""",
)
def augment_batch_pad(spark, sf):
    """The images of a brand filled up to the largest."""
    return _flat(A.batch_pad(_parts(spark, sf), "g"))


@query(
    "augment_cover",
    f"""{_P}, q AS (SELECT *, CASE WHEN w <= h THEN 100 / w ELSE 100 / h END AS r FROM p), z AS (SELECT *, round(w * r) AS nw, round(h * r) AS nh FROM q),
o AS (SELECT *, floor((nw - least(100, nw)) / 2) AS l, floor((nh - least(100, nh)) / 2) AS t FROM z),
c AS (SELECT k, CAST(least(100, nw) AS INTEGER) AS width, CAST(least(100, nh) AS INTEGER) AS height, least(greatest(trunc(x1 * r) - l, 0), least(100, nw)) AS x1, least(greatest(trunc(y1 * r) - t, 0), least(100, nh)) AS y1, least(greatest(trunc(x2 * r) - l, 0), least(100, nw)) AS x2, least(greatest(trunc(y2 * r) - t, 0), least(100, nh)) AS y2 FROM o)
SELECT * FROM c WHERE x1 <> x2 AND y1 <> y2""",
)
def augment_cover(spark, sf):
    """Resized by the shorter side and cut round the centre."""
    return _flat(A.augment(_parts(spark, sf), A.cover(100, 100)))


@query("augment_restore", f"{_P} SELECT k, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, x1, y1, x2, y2 FROM p")
def augment_restore(spark, sf):
    """Random flips, a random size and a random margin, taken back by the recorded parameters."""
    steps = [A.flip(True, 0.5), A.random_scale(300, 300, truncate=False), A.flip(False, 0.5), A.pad(2000, 2000, ("random", "random"))]
    d = _parts(spark, sf).withColumn("w0", F.col("width")).withColumn("h0", F.col("height"))
    back = A.restore(A.augment(d, steps, "k", 7), steps).withColumn("width", F.col("w0")).withColumn("height", F.col("h0"))
    return _flat(back, 6)


@query("augment_jitter", f"{_P} SELECT k, 224 AS width, 224 AS height, 0 AS outside FROM p")
def augment_jitter(spark, sf):
    """Random windows of a fixed size: no box reaches beyond them, and recorded windows lie within the images."""
    d = A.augment(_parts(spark, sf), A.jitter(224, 224), "k", 3)
    out = F.size(F.filter("bboxes", lambda b: (b["x1"] < 0) | (b["y1"] < 0) | (b["x2"] > 224) | (b["y2"] > 224)))
    wrong = ((F.col("p2_window.x1") < 0) | (F.col("p2_window.y1") < 0)).cast("int")
    return d.select("k", "width", "height", (out + wrong).alias("outside"))


@query("augment_rude_jitter", f"{_P} SELECT k, 0 AS outside FROM p")
def augment_rude_jitter(spark, sf):
    """The same without margins: windows are as large as the images allow."""
    d = A.augment(_parts(spark, sf), A.rude_jitter(224, 224), "k", 3)
    out = F.size(F.filter("bboxes", lambda b: (b["x1"] < 0) | (b["y1"] < 0) | (b["x2"] > F.col("width")) | (b["y2"] > F.col("height"))))
    return d.select("k", (out + ((F.col("width") > 224) | (F.col("height") > 224)).cast("int")).alias("outside"))


@query(
    "augment_images",
    """SELECT vec_id, list_transform(range(100), lambda p: CASE WHEN p // 10 BETWEEN 1 AND 8 AND p % 10 BETWEEN 1 AND 8 THEN CAST(embedding AS DOUBLE[])[(p // 10 - 1) * 8 + 8 - (p % 10 - 1)] ELSE 114 END) AS v,
  1.0::DOUBLE AS x1, 6.0::DOUBLE AS x2 FROM embeddings"""
)
def augment_images(spark, sf):
    """Images mirrored and filled up together with their boxes."""
    d = _wave(spark, sf).select(
        "vec_id", image.gray_from(F.col("v"), 8, 8).alias("image"), F.array(B.box(F.lit(3.0), F.lit(0.0), F.lit(8.0), F.lit(4.0))).alias("bboxes"),
        F.lit(8).alias("width"), F.lit(8).alias("height")
    )
    r = A.augment(d, [A.flip(), A.pad(10, 10)])
    b = F.get("bboxes", F.lit(0))
    return r.select("vec_id", image.pixels(F.col("image")).alias("v"), b["x1"].alias("x1"), b["x2"].alias("x2"))


@query(
    "image_drawn",
    """SELECT vec_id, list_transform(range(64), lambda p: CASE WHEN p // 8 BETWEEN 1 AND 5 AND p % 8 BETWEEN 2 AND 6 AND (p // 8 IN (1,
  5) OR p % 8 IN (2, 6)) THEN 255 ELSE trunc(least(greatest(CAST(embedding AS DOUBLE[])[p + 1] * 30 + 128, 0),
255)) END) AS v FROM embeddings"""
)
def image_drawn(spark, sf):
    """Boxes drawn on images, as PNG files."""
    d = _wave(spark, sf).select("vec_id", byte_image(image.gray_from(F.col("v"), 8, 8)).alias("image"))
    picture = A.drawn(F.col("image"), F.array(B.box(F.lit(2.0), F.lit(1.0), F.lit(7.0), F.lit(6.0))))
    return d.select("vec_id", image.pixels(media.decode_image(media.encode_image(picture), True)).alias("v"))
