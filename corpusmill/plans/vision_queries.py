"""Queries of the box, image and audio operators, over boxes and signals derived from the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audio, boxes, image
from ..operators.pipeline import random_apply
from .registry import query

_BOX = """SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity * 10) AS DOUBLE) AS x1, CAST(l_linenumber * 40 AS DOUBLE) AS y1,
  CAST(trunc(l_quantity * 10 + 50 + l_discount * 100) AS DOUBLE) AS x2, CAST(trunc(l_linenumber * 40 + 30 + l_tax * 100) AS DOUBLE) AS y2,
  CAST(l_suppkey % 10 AS INTEGER) AS c FROM lineitem"""


def flat(spark, sf):
    """A box for each order line on a 640 x 480 image for each order."""
    d = spark.read.parquet(f"{sf}/lineitem.parquet")
    t = lambda c: c.cast("long").cast("double")
    q, n = F.col("l_quantity") * 10, F.col("l_linenumber") * 40
    return d.select(
        "l_orderkey", "l_linenumber",
        boxes.box(t(q), n.cast("double"), t(q + 50 + F.col("l_discount") * 100), t(n + 30 + F.col("l_tax") * 100)).alias("b"),
        (F.col("l_suppkey") % 10).cast("int").alias("c")
    )


def _one(spark, sf, f, *more):
    """f on single boxes, by order line."""
    return flat(spark, sf).select("l_orderkey", "l_linenumber", F.get(f(F.array("b")), F.lit(0)).alias("r"), *more).select(
        "l_orderkey", "l_linenumber", *[F.round(f"r.{k}", 6).alias(k) for k in ("x1", "y1", "x2", "y2")]
    )


@query(
    "box_groups",
    f"""WITH b AS ({_BOX}), g AS (SELECT l_orderkey, count(*) AS n, CAST(sum(x1) AS BIGINT) AS sx
FROM b GROUP BY l_orderkey) SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(sx, 0) AS sx
FROM orders LEFT JOIN g ON l_orderkey = o_orderkey"""
)
def box_groups(spark, sf):
    """Images left-joined with their grouped boxes."""
    g = flat(spark, sf).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("b.x1").cast("long").alias("sx"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    return o.join(g, o.o_orderkey == g.l_orderkey, "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sx", F.lit(0)).alias("sx"))


@query("box_hflip", f"WITH b AS ({_BOX}) SELECT l_orderkey, l_linenumber, 640 - x2 AS x1, y1, 640 - x1 AS x2, y2 FROM b")
def box_hflip(spark, sf):
    return _one(spark, sf, lambda b: boxes.hflip(b, F.lit(640.0)))


@query("box_vflip", f"WITH b AS ({_BOX}) SELECT l_orderkey, l_linenumber, x1, 480 - y2 AS y1, x2, 480 - y1 AS y2 FROM b")
def box_vflip(spark, sf):
    return _one(spark, sf, lambda b: boxes.vflip(b, F.lit(480.0)))


@query("box_rotate90", f"WITH b AS ({_BOX}) SELECT l_orderkey, l_linenumber, y1 AS x1, 640 - x2 AS y1, y2 AS x2, 640 - x1 AS y2 FROM b")
def box_rotate90(spark, sf):
    return _one(spark, sf, lambda b: boxes.rotate90(b, F.lit(640.0), F.lit(480.0), 1))


@query(
    "box_rotate",
    f"""WITH b AS ({_BOX}), p AS (SELECT l_orderkey, l_linenumber, list_transform([[x1, y1], [x2, y1], [x2, y2], [x1, y2]], lambda q: [cos(radians(30.0)) * (q[1] - 320) + sin(radians(30.0)) * (q[2] - 240) + 320, -sin(radians(30.0)) * (q[1] - 320) + cos(radians(30.0)) * (q[2] - 240) + 240]) AS p FROM b),
h AS (SELECT l_orderkey, l_linenumber, list_min([q[1] FOR q IN p]) AS x1, list_min([q[2] FOR q IN p]) AS y1, list_max([q[1] FOR q IN p]) AS x2, list_max([q[2] FOR q IN p]) AS y2 FROM p)
SELECT l_orderkey, l_linenumber, round(least(greatest(x1, 0), 640), 6) AS x1, round(least(greatest(y1, 0), 480), 6) AS y1, round(least(greatest(x2, 0), 640), 6) AS x2, round(least(greatest(y2, 0), 480), 6) AS y2 FROM h""",
)
def box_rotate(spark, sf):
    return _one(spark, sf, lambda b: boxes.rotate(b, F.lit(640), F.lit(480), F.lit(30.0)))


@query("box_pad", f"WITH b AS ({_BOX}) SELECT l_orderkey, l_linenumber, x1 + 80 AS x1, y1 + 160 AS y1, x2 + 80 AS x2, y2 + 160 AS y2 FROM b")
def box_pad(spark, sf):
    return _one(spark, sf, lambda b: boxes.pad(b, boxes.pad_params(F.lit(640), F.lit(480), 800, 800)))


@query(
    "box_crop",
    f"""WITH b AS ({_BOX}), m AS (SELECT l_orderkey, l_linenumber, c, least(greatest(x1 - 100, 0), 300) AS x1, least(greatest(y1 - 50, 0), 200) AS y1, least(greatest(x2 - 100, 0), 300) AS x2, least(greatest(y2 - 50, 0), 200) AS y2 FROM b)
SELECT l_orderkey, count(*) FILTER (WHERE x1 <> x2 AND y1 <> y2) AS kept, count(*) FILTER (WHERE x1 = x2 OR y1 = y2) AS dropped, CAST(coalesce(sum(x1 + y1 + x2 + y2) FILTER (WHERE x1 <> x2 AND y1 <> y2), 0) AS BIGINT) AS coords, CAST(coalesce(sum(c) FILTER (WHERE x1 <> x2 AND y1 <> y2), 0) AS BIGINT) AS classes FROM m GROUP BY l_orderkey""",
)
def box_crop(spark, sf):
    """Boxes and classes of each image in a window."""
    g = flat(spark, sf).groupBy("l_orderkey").agg(F.collect_list(F.struct("b", "c")).alias("p"))
    win = F.struct(F.lit(100).alias("x1"), F.lit(400).alias("x2"), F.lit(50).alias("y1"), F.lit(250).alias("y2"))
    r = g.select("l_orderkey", boxes.crop(F.col("p.b"), F.col("p.c"), win).alias("r"))
    total = F.aggregate("r.bboxes", F.lit(0.0), lambda a, x: a + x["x1"] + x["y1"] + x["x2"] + x["y2"])
    return r.select(
        "l_orderkey", F.size("r.bboxes").cast("long").alias("kept"), F.size("r.dropped").cast("long").alias("dropped"),
        total.cast("long").alias("coords"), F.aggregate("r.classes", F.lit(0).cast("long"), lambda a, x: a + x).alias("classes")
    )


@query("box_scale", f"WITH b AS ({_BOX}) SELECT l_orderkey, l_linenumber, trunc(x1 * 0.65) AS x1, trunc(y1 * 0.65) AS y1, trunc(x2 * 0.65) AS x2, trunc(y2 * 0.65) AS y2 FROM b")
def box_scale(spark, sf):
    """A proportional resize to 416 pixels."""
    return _one(spark, sf, lambda b: boxes.scale(b, boxes.proportion(F.lit(640), F.lit(480), 416, 416)))


@query(
    "box_letterbox",
    f"WITH b AS ({_BOX}) SELECT l_orderkey, l_linenumber, trunc(x1 * 0.65) AS x1, trunc(y1 * 0.65) + 52 AS y1, trunc(x2 * 0.65) AS x2, trunc(y2 * 0.65) + 52 AS y2 FROM b"
)
def box_letterbox(spark, sf):
    return _one(spark, sf, lambda b: boxes.letterbox(b, boxes.letterbox_params(F.lit(640), F.lit(480), 416, 416)))


@query(
    "box_iou",
    f"""WITH b AS ({_BOX}), p AS (SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2 - a.y1, b.y2 - b.y1), 0) AS n, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
SELECT l_orderkey, i, j, round(n / (s - n), 9) AS iou FROM p WHERE n > 0""",
)
def box_iou(spark, sf):
    """Boxes of one image that overlap when laid to the same top."""
    d = flat(spark, sf).groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "b")).alias("g"))
    top = lambda c: F.get(boxes.shift(F.array(c), F.lit(0.0), -c["y1"]), F.lit(0))
    each = d.select("l_orderkey", "g", F.explode("g").alias("p")).select(
        "l_orderkey", "p", F.explode(F.filter("g", lambda q: q["l_linenumber"] > F.col("p.l_linenumber"))).alias("q")
    )
    iou = F.round(boxes.iou(top(F.col("p.b")), top(F.col("q.b"))), 9)
    return each.select("l_orderkey", F.col("p.l_linenumber").alias("i"), F.col("q.l_linenumber").alias("j"), iou.alias("iou")).where("iou > 0")


@query(
    "box_mosaic",
    f"""WITH b AS ({_BOX}) SELECT l_orderkey, l_linenumber, x1 - 320 AS x1, y1 - 100 AS y1, x2 - 320 AS x2, y2 - 100 AS y2
FROM b WHERE x1 > 320 AND y1 > 100 AND x2 > 320 AND y2 > 100"""
)
def box_mosaic(spark, sf):
    return _one(spark, sf, lambda b: boxes.mosaic(b, F.lit(-320.0), F.lit(-100.0), F.lit(640.0), F.lit(480.0))).where("x1 is not null")


@query(
    "box_yolo",
    f"""WITH b AS ({_BOX}) SELECT l_orderkey, l_linenumber, round((x1 + (x2 - x1) / 2) / 640, 9) AS x, round((y1 + (y2 - y1) / 2) / 480,
  9) AS y, round((x2 - x1) / 640, 9) AS w, round((y2 - y1) / 480, 9) AS h
FROM b"""
)
def box_yolo(spark, sf):
    """Centres and sizes in shares of the image."""
    q = boxes.xyxy_to_xywh(F.col("b"), True, 640, 480)
    return flat(spark, sf).select("l_orderkey", "l_linenumber", q.alias("q")).select("l_orderkey", "l_linenumber", *[F.round(f"q.{k}", 9).alias(k) for k in "xywh"])


@query("explode_repeat", "SELECT p_partkey, unnest(range(1, p_size % 3 + 2)) AS copy FROM part")
def explode_repeat(spark, sf):
    """Rows repeated by a count in the row."""
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("p_size").cast("long") % 3 + 1)).alias("copy"))


def _wave(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query("audio_amplify", "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 32768) AS v FROM embeddings")
def audio_amplify(spark, sf):
    return _wave(spark, sf).select("vec_id", audio.amplify(F.col("v")).alias("v"))


@query("audio_frames", "SELECT vec_id, list_transform(range(7), lambda i: CAST(embedding AS DOUBLE[])[i * 8 + 1 : i * 8 + 16]) AS frames FROM embeddings")
def audio_frames(spark, sf):
    return _wave(spark, sf).select("vec_id", audio.frames(F.col("v"), 16, 8).alias("frames"))


@query(
    "audio_stack",
    """WITH f AS (SELECT vec_id, list_transform(range(8), lambda i: CAST(embedding AS DOUBLE[])[i * 8 + 1 : i * 8 + 8]) AS f
FROM embeddings) SELECT vec_id, list_transform(range(2), lambda k: flatten(list_transform(range(7),
lambda j: f[least(greatest(k * 6 + j - 3, 0), 7) + 1]))) AS rows
FROM f"""
)
def audio_stack(spark, sf):
    d = _wave(spark, sf).withColumn("f", audio.frames(F.col("v"), 8, 8))
    return d.select("vec_id", audio.stack_frames(F.col("f")).alias("rows"))


@query("audio_shift_scale", "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: (x + i * 0.5) / (1 + i)) AS v FROM embeddings")
def audio_shift_scale(spark, sf):
    k = F.sequence(F.lit(1), F.lit(64))
    return _wave(spark, sf).select("vec_id", audio.shift_scale(F.col("v"), F.transform(k, lambda i: i * 0.5), F.transform(k, lambda i: (1 + i).cast("double"))).alias("v"))


@query("audio_filter_bank")
def audio_filter_bank(spark, sf):
    return _wave(spark, sf).select("vec_id", audio.filter_bank(F.col("v"), rate=1600, bins=8).alias("features"))


@query("audio_resample")
def audio_resample(spark, sf):
    return _wave(spark, sf).select("vec_id", audio.resample(F.col("v"), 1600, 2400).alias("v"))


def _picture(spark, sf):
    return _wave(spark, sf).select("vec_id", image.gray_from(F.col("v"), 8, 8).alias("image"))


@query("image_flip", "SELECT vec_id, flatten(list_transform(range(8), lambda r: list_reverse(CAST(embedding AS DOUBLE[])[r * 8 + 1 : r * 8 + 8]))) AS v FROM embeddings")
def image_flip(spark, sf):
    return _picture(spark, sf).select("vec_id", image.pixels(image.on_image(F.col("image"), image.hflip)).alias("v"))


@query("image_crop", "SELECT vec_id, flatten(list_transform(range(2, 6), lambda r: CAST(embedding AS DOUBLE[])[r * 8 + 2 : r * 8 + 6])) AS v FROM embeddings")
def image_crop(spark, sf):
    return _picture(spark, sf).select("vec_id", image.pixels(image.on_image(F.col("image"), lambda a: image.crop(a, 1, 6, 2, 6))).alias("v"))


@query("image_min_max", "SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round((x + 4) / 8 * 255, 6)) AS v FROM embeddings")
def image_min_max(spark, sf):
    p = image.pixels(image.on_image(F.col("image"), lambda a: image.min_max(a, -4.0, 4.0)), 6)
    return _picture(spark, sf).select("vec_id", p.alias("v"))


@query(
    "image_normalize",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT vec_id, v, list_reduce(v, lambda a, x: a + x) / 64 AS m FROM e),
s AS (SELECT vec_id, v, m, sqrt(list_reduce(list_transform(v, lambda x: (x - m) * (x - m)), lambda a, x: a + x) / 64) AS s FROM m)
SELECT vec_id, list_transform(v, lambda x: (x - m) / s) AS v FROM s""",
)
def image_normalize(spark, sf):
    p = image.pixels(image.on_image(F.col("image"), image.normalize))
    return _picture(spark, sf).select("vec_id", p.alias("v"))


@query("image_noise")
def image_noise(spark, sf):
    return _picture(spark, sf).select("vec_id", image.on_image(F.col("image"), image.gauss_noise, seed=1, key=F.col("vec_id")).alias("image"))


@query("image_random_apply")
def image_random_apply(spark, sf):
    """Flips with their own chances, recorded."""
    ops = [(lambda c: image.on_image(c, image.hflip), 0.5), (lambda c: image.on_image(c, image.vflip), 0.3)]
    return random_apply(_picture(spark, sf), "vec_id", "image", ops, 4)
