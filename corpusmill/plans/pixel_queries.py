"""Queries of the image kernels over 8 x 8 images, and of the rest of the box operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import boxes, image
from .registry import query
from .vision_queries import _BOX, _picture, flat

# v are an image's values in row order; f and h those of its vertical and horizontal mirror images.
_E = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
i AS (SELECT vec_id, v, list_transform(range(64), lambda p: v[(7 - p // 8) * 8 + p % 8 + 1]) AS f, list_transform(range(64), lambda p: v[(p // 8) * 8 + 7 - p % 8 + 1]) AS h FROM e) """


def _each(n: int, cell: str) -> str:
    return f"list_transform(range({n}), lambda p: {cell})"


def _colours(*channels: str) -> str:
    return f"flatten(list_transform(range(64), lambda p: [{', '.join(c + '[p + 1]' for c in channels)}]))"


def _at(r: str, c: str) -> str:
    """The value at a row and column, edges repeated."""
    return f"v[least(greatest({r}, 0), 7) * 8 + least(greatest({c}, 0), 7) + 1]"


def _mean(cells: list[tuple[int, int, str]], by: str) -> str:
    return "(" + " + ".join(f"{k} * {_at(f'p // 8 + {r}', f'p % 8 + {c}')}" for r, c, k in cells) + f") / {by}"


_HOLE = "p % 8 BETWEEN 1 AND 4 AND p // 8 BETWEEN 2 AND 5"
_GAUSS = "exp(-0.5)"

#: name: kernel, SQL of the values, digits to which both round.  Operations and their order are the same, so the bits are.
PIXELS = {
    "vflip": (image.vflip, "f", None),
    "rotate90": (image.rotate90, _each(64, "v[(p % 8) * 8 + 7 - p // 8 + 1]"), None),
    "hwc_to_chw": (lambda a: image.hwc_to_chw(image.with_mirrors(a)), "list_concat(list_concat(v, f), h)", None),
    "chw_to_hwc": (lambda a: image.chw_to_hwc(image.hwc_to_chw(image.with_mirrors(a))), _colours("v", "f", "h"), None),
    "swap_channels": (lambda a: image.swap_channels(image.with_mirrors(a)), _colours("h", "f", "v"), None),
    "gray_to_bgr": (image.gray_to_bgr, _colours("v", "v", "v"), None),
    "bgr_to_gray": (lambda a: image.bgr_to_gray(image.with_mirrors(a)), _each(64, "0.114::DOUBLE * v[p + 1] + 0.587::DOUBLE * f[p + 1] + 0.299::DOUBLE * h[p + 1]"), 6),
    "keep_3_dims": (image.keep_3_dims, "v", None),
    "keep_3_channels": (image.keep_3_channels, _colours("v", "v", "v"), None),
    "clip": (lambda a: image.clip(a, -1, 1), _each(64, "least(greatest(v[p + 1], -1), 1)"), None),
    "to_image": (lambda a: image.to_image(a * 60 + 100), _each(64, "trunc(least(greatest(v[p + 1] * 60 + 100, 0), 255))"), None),
    "brightness": (lambda a: image.brightness(a, 0.25), _each(64, "v[p + 1] * 1.25::DOUBLE"), None),
    "contrast": (lambda a: image.contrast(a, 0.25), _each(64, "(v[p + 1] - 74) * 1.25::DOUBLE + 74"), None),
    "saturation": (
        lambda a: image.saturation(image.with_mirrors(a), 0.5),
        "flatten(list_transform(range(64), lambda p: [x * 1.5::DOUBLE - (0.114::DOUBLE * v[p + 1] + 0.587::DOUBLE * f[p + 1] + 0.299::DOUBLE * h[p + 1]) * 0.5::DOUBLE FOR x IN [v[p + 1], f[p + 1], h[p + 1]]]))",
        6
    ),
    "denormalize": (lambda a: image.denormalize(a, 3.0, 2.0), _each(64, "v[p + 1] * 2 + 3"), None),
    "erase": (lambda a: image.erase(a, 1, 5, 2, 6, 9), _each(64, f"CASE WHEN {_HOLE} THEN 9 ELSE v[p + 1] END"), None),
    "cut_out": (
        lambda a: image.cut_out(a, [{"x1": 1, "x2": 5, "y1": 2, "y2": 6}, {"x1": 0, "x2": 8, "y1": 7, "y2": 8}]),
        _each(64, f"CASE WHEN {_HOLE} OR p // 8 = 7 THEN 0 ELSE v[p + 1] END"), None
    ),
    "axis_projection": (image.axis_projection, _each(64, "list_sum(list_transform(range(8), lambda r: v[r * 8 + p % 8 + 1])) / 8"), 6),
    "resize_nearest": (lambda a: image.resize(a, 4, 4, True), _each(16, "v[(p // 4) * 16 + (p % 4) * 2 + 1]"), None),
    "resize_bilinear": (
        lambda a: image.resize(a, 4, 4),
        _each(
            16,
            "(v[(p // 4) * 16 + (p % 4) * 2 + 1] + v[(p // 4) * 16 + (p % 4) * 2 + 2] + v[(p // 4) * 16 + (p % 4) * 2 + 9] + v[(p // 4) * 16 + (p % 4) * 2 + 10]) / 4"
        ),
        6
    ),
    "pad": (lambda a: image.pad(a, 1, 2, 0, 1, 7), _each(99, "CASE WHEN p // 11 < 8 AND p % 11 BETWEEN 1 AND 8 THEN v[(p // 11) * 8 + p % 11] ELSE 7 END"), None),
    "pad_edge": (lambda a: image.pad(a, 1, 1, 1, 1, mode="edge"), _each(100, _at("p // 10 - 1", "p % 10 - 1")), None),
    "mix_up": (lambda a: image.mix_up(a, image.hflip(a), 0.25), _each(64, "v[p + 1] * 0.25::DOUBLE + h[p + 1] * 0.75::DOUBLE"), None),
    "cut_mix": (lambda a: image.cut_mix(a, image.hflip(a), 1, 5, 2, 6), _each(64, f"CASE WHEN {_HOLE} THEN h[p + 1] ELSE v[p + 1] END"), None),
    "copy_paste": (lambda a: image.copy_paste(a, image.hflip(a), a > 0), _each(64, "CASE WHEN v[p + 1] > 0 THEN h[p + 1] ELSE v[p + 1] END"), None),
    "mosaic4": (lambda a: image.mosaic4([a] * 4, 8, 8, 8), _each(256, "v[((p // 16) % 8) * 8 + p % 8 + 1]"), None),
    "mosaic9": (lambda a: image.mosaic9([a] * 9, 8), _each(576, "v[((p // 24) % 8) * 8 + p % 8 + 1]"), None),
    "tiles": (lambda a: image.untile(image.tiles(a, 2, 2)[::-1], 2), _each(64, "v[((p // 8 + 4) % 8) * 8 + (p % 8 + 4) % 8 + 1]"), None),
    "convolve": (lambda a: image.convolve(a, [[0, 1, 0], [1, 4, 1], [0, 1, 0]]), _each(64, _mean([(-1, 0, "1"), (0, -1, "1"), (0, 0, "4"), (0, 1, "1"), (1, 0, "1")], "1")), 6),
    "gaussian_blur": (
        lambda a: image.gaussian_blur(a, 3, 1.0),
        _each(
            64,
            _mean([(r, c, " * ".join([_GAUSS] * (abs(r) + abs(c)) or ["1"])) for r in (-1, 0, 1) for c in (-1, 0, 1)], f"pow(1 + 2 * {_GAUSS}, 2)")
        ),
        6
    ),
    "motion_blur": (lambda a: image.motion_blur(a, 3, 0.0), _each(64, _mean([(0, c, "1") for c in (-1, 0, 1)], "3")), 6),
    "warp": (lambda a: image.warp(a, [[1, 0, 1], [0, 1, 0]]), _each(64, "CASE WHEN p % 8 = 0 THEN 114 ELSE v[p] END"), None),
    "perspective": (lambda a: image.warp(a, image.perspective_matrix([(0, 0), (7, 0), (7, 7), (0, 7)], [(7, 0), (0, 0), (0, 7), (7, 7)])), "h", 6),
    "hsv": (
        lambda a: image.hsv(image.with_mirrors(np.abs(a) + 1), gv=0.5),
        "list_transform(flatten(list_transform(range(64), lambda p: [v[p + 1], f[p + 1], h[p + 1]])), lambda x: (abs(x) + 1) / 2)", 6
    ),
    "hue": (
        lambda a: image.hue(image.with_mirrors(np.abs(a) + 1), 1 / 3),
        "list_transform(flatten(list_transform(range(64), lambda p: [f[p + 1], h[p + 1], v[p + 1]])), lambda x: abs(x) + 1)", 6
    ),
    "inside": (
        lambda a: np.where(image.inside(a.shape, [(0.5, 0.5), (5.5, 0.5), (5.5, 3.5), (0.5, 3.5)]), a, 0),
        _each(64, "CASE WHEN p % 8 BETWEEN 1 AND 5 AND p // 8 BETWEEN 1 AND 3 THEN v[p + 1] ELSE 0 END"), None
    ),
    "shrink_map": (lambda a: a * image.shrink_map(a.shape, [[(-8, -8), (16, -8), (16, 16), (-8, 16)]], 0.9), "v", None),
    "border_map": (
        lambda a: a + image.border_map(a.shape, [[(0, 0), (8, 0), (8, 8), (0, 8)]], 0.0),
        _each(64, "v[p + 1] + greatest(1 - least(p % 8, p // 8, 8 - p % 8, 8 - p // 8) / 2.0::DOUBLE, 0)"), 6
    ),
}


def _pixel_query(name: str, kernel, cells: str, digits: int | None) -> None:
    r = f"list_transform({cells}, lambda x: round(x, {digits}))" if digits else f"CAST({cells} AS DOUBLE[])"

    @query(f"image_{name}", f"{_E} SELECT vec_id, {r} AS v FROM i")
    def run(spark, sf):
        return _picture(spark, sf).select("vec_id", image.pixels(image.on_image(F.col("image"), kernel), digits).alias("v"))


for _name, (_kernel, _cells, _digits) in PIXELS.items():
    _pixel_query(_name, _kernel, _cells, _digits)


# Windows of 400 x 300 in images of 640 x 480.
_WINDOWS = {"corner_left_top": (0, 0), "corner_right_top": (240, 0), "corner_left_down": (0, 180), "corner_right_down": (240, 180), "center": (120, 90)}


@query(
    "box_five_crop",
    f"WITH b AS ({_BOX}), w AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(_WINDOWS.values()))
    + """) AS w(no, x, y)), m AS (SELECT l_orderkey, l_linenumber, no, least(greatest(x1 - x, 0),
400) AS x1, least(greatest(y1 - y, 0), 300) AS y1, least(greatest(x2 - x, 0),
400) AS x2, least(greatest(y2 - y, 0), 300) AS y2 FROM b, w) SELECT *
FROM m WHERE x1 <> x2 AND y1 <> y2""",
)
def box_five_crop(spark, sf):
    """Boxes in the windows of the four corners and the centre that hold a part of them."""
    windows = F.posexplode(boxes.five_windows(F.lit(640), F.lit(480), 400, 300)).alias("no", "w")
    d = flat(spark, sf).select("l_orderkey", "l_linenumber", "b", windows)
    r = d.select("l_orderkey", "l_linenumber", "no", boxes.clipped(F.col("b"), F.col("w")).alias("r")).where(~boxes.is_flat(F.col("r")))
    return r.select("l_orderkey", "l_linenumber", "no", "r.x1", "r.y1", "r.x2", "r.y2")


@query("box_uncrop", f"SELECT l_orderkey, l_linenumber, x1, y1, x2, y2 FROM ({_BOX})")
def box_uncrop(spark, sf):
    """Padding and a window taken back."""
    m, w = boxes.pad_params(F.lit(640), F.lit(480), 800, 800), boxes.window("center", F.lit(640), F.lit(480), 400, 300)
    d = flat(spark, sf).withColumn("m", m).withColumn("w", w).withColumn("r", boxes.unpad(boxes.pad(F.array("b"), F.col("m")), F.col("m")))
    moved = boxes.uncrop(boxes.shift(F.col("r"), -F.col("w.x1"), -F.col("w.y1")), F.col("w"))
    return d.select("l_orderkey", "l_linenumber", F.get(moved, F.lit(0)).alias("r")).select("l_orderkey", "l_linenumber", "r.x1", "r.y1", "r.x2", "r.y2")


@query(
    "box_affine",
    f"""SELECT l_orderkey, l_linenumber, round(least(greatest((x1 - 320) * 0.5::DOUBLE + 330, 0),
640), 6) AS x1, round((y1 - 240) * 0.5::DOUBLE + 260, 6) AS y1, round((x2 - 320) * 0.5::DOUBLE + 330, 6) AS x2, round((y2 - 240) * 0.5::DOUBLE + 260,
  6) AS y2 FROM ({_BOX})"""
)
def box_affine(spark, sf):
    """Half the size round the centre, then ten pixels right and twenty down."""
    m = boxes.affine_matrix(640, 480, 0, 0.5, translate=(10, 20))
    return flat(spark, sf).select("l_orderkey", "l_linenumber", F.get(boxes.warp(F.array("b"), m), F.lit(0)).alias("r")).select(
        "l_orderkey", "l_linenumber", *[F.round(f"r.{k}", 6).alias(k) for k in ("x1", "y1", "x2", "y2")]
    )


@query("box_xywh", f"SELECT l_orderkey, l_linenumber, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area FROM ({_BOX})")
def box_xywh(spark, sf):
    """Boxes as corner and sizes and back, with their areas."""
    q = boxes.xyxy_to_xywh(F.col("b"))
    d = flat(spark, sf).withColumn("q", q).withColumn("r", boxes.xywh_to_xyxy(F.col("q.x"), F.col("q.y"), F.col("q.w"), F.col("q.h")))
    return d.select("l_orderkey", "l_linenumber", "r.x1", "r.y1", "r.x2", "r.y2", boxes.area(F.col("r")).alias("area"))


@query(
    "box_proportion",
    """SELECT p_partkey, least(416.0 / (p_size + 100), 416.0 / 120) AS smallest, greatest(416.0 / (p_size + 100),
416.0 / 120) AS largest, CASE WHEN p_size + 100 <= 120 THEN 416.0 / (p_size + 100) ELSE 416.0 / 120 END AS shortest,
  CASE WHEN p_size + 100 >= 120 THEN 416.0 / (p_size + 100) ELSE 416.0 / 120 END AS longest
FROM part"""
)
def box_proportion(spark, sf):
    """Scales by which an image of the part's width and 120 pixels of height is brought to 416 pixels."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    w, h = F.col("p_size") + 100, F.lit(120)
    return p.select(
        "p_partkey",
        *[
            boxes.proportion(w, h, 416.0, 416.0, k).alias(n) for k,
            n in (("min", "smallest"), ("max", "largest"), ("shortest", "shortest"), ("longest", "longest"))
        ]
    )


@query(
    "box_drop_covered",
    f"""WITH b AS ({_BOX}) SELECT l_orderkey, l_linenumber FROM b WHERE greatest(least(x2, 400) - greatest(x1, 0),
0) * greatest(least(y2, 300) - greatest(y1, 0), 0) < 0.02::DOUBLE * ((x2 - x1) * (y2 - y1) + 120000 - greatest(least(x2,
  400) - greatest(x1, 0), 0) * greatest(least(y2, 300) - greatest(y1, 0),
0))"""
)
def box_drop_covered(spark, sf):
    """Boxes that a hole of 400 x 300 in the corner does not cover."""
    hole = F.array(boxes.box(F.lit(0.0), F.lit(0.0), F.lit(400.0), F.lit(300.0)))
    return flat(spark, sf).where(F.size(boxes.drop_covered(F.array("b"), hole, 0.02)) > 0).select("l_orderkey", "l_linenumber")


@query(
    "box_mosaic_clipped",
    f"""WITH b AS ({_BOX}), m AS (SELECT l_orderkey, l_linenumber, least(greatest(x1 - 320, 0),
200) AS x1, least(greatest(y1 - 100, 0), 150) AS y1, least(greatest(x2 - 320, 0),
200) AS x2, least(greatest(y2 - 100, 0), 150) AS y2 FROM b) SELECT *
FROM m WHERE x2 > x1 AND y2 > y1"""
)
def box_mosaic_clipped(spark, sf):
    m = boxes.mosaic(F.array("b"), F.lit(-320.0), F.lit(-100.0), F.lit(200.0), F.lit(150.0), False)
    return flat(spark, sf).select("l_orderkey", "l_linenumber", F.explode(m).alias("r")).select("l_orderkey", "l_linenumber", "r.x1", "r.y1", "r.x2", "r.y2")
