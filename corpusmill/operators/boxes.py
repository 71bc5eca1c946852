"""Box and polygon algebra as array expressions: every operator has apply, and restore where it can be undone.

Boxes are array<struct<x1,y1,x2,y2>>, polygons array<array<struct<x,y>>>.
Integer results are truncated toward zero where pixels are meant.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    """A box struct."""
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def _trunc(c: Column) -> Column:
    return c.cast("long").cast("double")


def shift(boxes: Column, dx, dy) -> Column:
    """Moved boxes."""
    return F.transform(boxes, lambda b: box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy))


def shift_points(polygons: Column, dx, dy) -> Column:
    """Moved polygons."""
    return F.transform(polygons, lambda p: F.transform(p, lambda q: F.struct((q["x"] + dx).alias("x"), (q["y"] + dy).alias("y"))))


def hflip(boxes: Column, w) -> Column:
    """Mirrored left to right; its own inverse."""
    return F.transform(boxes, lambda b: box(w - b["x2"], b["y1"], w - b["x1"], b["y2"]))


def vflip(boxes: Column, h) -> Column:
    """Mirrored top to bottom; its own inverse."""
    return F.transform(boxes, lambda b: box(b["x1"], h - b["y2"], b["x2"], h - b["y1"]))


def rotate90(boxes: Column, w, h, k: int) -> Column:
    """Turned counter-clockwise by k quarter turns; right for non-square images too."""
    k %= 4
    turn = {
        0: lambda b: b, 1: lambda b: box(b["y1"], w - b["x2"], b["y2"], w - b["x1"]),
        2: lambda b: box(w - b["x2"], h - b["y2"], w - b["x1"], h - b["y1"]), 3: lambda b: box(h - b["y2"], b["x1"], h - b["y1"], b["x2"])
    }[k]
    return F.transform(boxes, turn)


def scale(boxes: Column, px, py=None, truncate: bool = True) -> Column:
    """Scaled boxes, truncated to whole pixels."""
    py = px if py is None else py
    t = _trunc if truncate else (lambda c: c)
    return F.transform(boxes, lambda b: box(t(b["x1"] * px), t(b["y1"] * py), t(b["x2"] * px), t(b["y2"] * py)))


def proportion(w: Column, h: Column, dst_w, dst_h, choice: str = "min", max_ratio: tuple[float, float] | None = None) -> Column:
    """The scale factor of a proportional resize: by the smaller or larger factor, the shorter or longer edge, or the smaller change."""
    fw, fh = F.lit(dst_w) / w, F.lit(dst_h) / h
    p = {
        "min": lambda: F.least(fw, fh), "max": lambda: F.greatest(fw, fh), "shortest": lambda: F.when(w <= h, fw).otherwise(fh),
        "longest": lambda: F.when(w >= h, fw).otherwise(fh), "auto": lambda: F.when(F.abs(dst_w - w) / w < F.abs(dst_h - h) / h, fw).otherwise(fh)
    }[choice]()
    return p if max_ratio is None else F.greatest(F.least(p, F.lit(1.0 + max_ratio[1])), F.lit(1 / (1 + max_ratio[0])))


def pad_params(w: Column, h: Column, dst_w, dst_h, side=("center", "center"), u: Column | None = None, v: Column | None = None) -> Column:
    """Margins (l, r, t, d) that fill an image up to a size; sides: left, right, top, down, center, random (with uniforms u, v)."""

    def one(gap, where, r):
        before = {
            "left": gap, "top": gap, "right": F.lit(0), "down": F.lit(0), "center": F.floor(gap / 2),
            "random": F.floor(r * gap) if r is not None else F.lit(0)
        }[where].cast("int")
        return before, (gap - before).cast("int")

    (left, right), (top, down) = one(F.greatest(F.lit(dst_w) - w, F.lit(0)), side[0], u), one(F.greatest(F.lit(dst_h) - h, F.lit(0)), side[1], v)
    return F.struct(left.alias("l"), right.alias("r"), top.alias("t"), down.alias("d"))


def pad(boxes: Column, margins: Column) -> Column:
    """Boxes after padding."""
    return shift(boxes, margins["l"], margins["t"])


def unpad(boxes: Column, margins: Column) -> Column:
    """Boxes before padding."""
    return shift(boxes, -margins["l"], -margins["t"])


def window(kind: str, w: Column, h: Column, dst_w, dst_h, u: Column | None = None, v: Column | None = None, corner=("left", "top")) -> Column:
    """Crop windows (x1, x2, y1, y2): random, center, or a named corner."""
    dw, dh = F.lit(dst_w), F.lit(dst_h)
    if kind == "random":
        x, y = F.floor(u * F.greatest(w - dw + 1, F.lit(1))), F.floor(v * F.greatest(h - dh + 1, F.lit(1)))
    elif kind == "center":
        x, y = F.floor((w - dw) / 2), F.floor((h - dh) / 2)
    else:
        x, y = (F.lit(0) if corner[0] == "left" else w - dw), (F.lit(0) if corner[1] == "top" else h - dh)
    x, y = x.cast("int"), y.cast("int")
    return F.struct(x.alias("x1"), (x + dw).alias("x2"), y.alias("y1"), (y + dh).alias("y2"))


def five_windows(w: Column, h: Column, dst_w, dst_h) -> Column:
    """The four corners and the centre, to be exploded."""
    return F.array(
        *[window("corner", w, h, dst_w, dst_h, corner=c) for c in (("left", "top"), ("right", "top"), ("left", "down"), ("right", "down"))],
        window("center", w, h, dst_w, dst_h)
    )


def once(value: Column, f=lambda x: x) -> Column:
    """f of a value that is computed once, however often f names it: Spark writes out what a struct holds wherever a field of it is named, but not here."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clipped(b: Column, win: Column) -> Column:
    """One box moved into a window and clipped."""
    clip = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), top)
    width, height = (win["x2"] - win["x1"]).cast("double"), (win["y2"] - win["y1"]).cast("double")
    return box(clip(b["x1"] - win["x1"], width), clip(b["y1"] - win["y1"], height), clip(b["x2"] - win["x1"], width), clip(b["y2"] - win["y1"], height))


def is_flat(b: Column) -> Column:
    """Whether a box has no area."""
    return (b["x1"] == b["x2"]) | (b["y1"] == b["y2"])


def crop(boxes: Column, classes: Column, win: Column) -> Column:
    """Boxes moved into a window and clipped; those without an area go with their classes. Gives struct<bboxes, classes, dropped>."""
    boxes = F.coalesce(boxes, F.array())
    both = F.zip_with(boxes, F.slice(F.coalesce(classes, F.array()), 1, F.size(boxes)), lambda b, c: F.struct(clipped(b, win).alias("b"), c.alias("c")))

    def parts(both: Column) -> Column:
        keep, gone = F.filter(both, lambda x: ~is_flat(x["b"])), F.filter(both, lambda x: is_flat(x["b"]))
        return F.struct(F.transform(keep, lambda x: x["b"]).alias("bboxes"), F.transform(keep, lambda x: x["c"]).alias("classes"), F.transform(gone, lambda x: x["b"]).alias("dropped"))

    return once(both, parts)


def uncrop(boxes: Column, win: Column) -> Column:
    """Boxes back in the whole image's frame."""
    return shift(boxes, win["x1"], win["y1"])


def rotate(boxes: Column, w, h, degrees: Column) -> Column:
    """Hulls of boxes turned about the centre, clipped to the image."""
    a = F.radians(degrees)
    c, s = F.cos(a), F.sin(a)
    cx, cy = w / 2.0, h / 2.0

    def hull(b):
        xs, ys = [], []
        for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")):
            dx, dy = b[x] - cx, b[y] - cy
            xs.append(c * dx + s * dy + cx)
            ys.append(-s * dx + c * dy + cy)
        inside = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(top).cast("double") if not isinstance(top, Column) else top.cast("double"))
        return box(inside(F.least(*xs), w), inside(F.least(*ys), h), inside(F.greatest(*xs), w), inside(F.greatest(*ys), h))

    return F.transform(boxes, hull)


def warp(boxes: Column, m: list[list[float]]) -> Column:
    """Hulls of boxes under a 2x3 affine or 3x3 projective matrix."""

    def hull(b):
        xs, ys = [], []
        for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")):
            z = b[x] * m[2][0] + b[y] * m[2][1] + m[2][2] if len(m) > 2 else F.lit(1.0)
            xs.append((b[x] * m[0][0] + b[y] * m[0][1] + m[0][2]) / z)
            ys.append((b[x] * m[1][0] + b[y] * m[1][1] + m[1][2]) / z)
        return box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    return F.transform(boxes, hull)


def affine_matrix(w: float, h: float, angle: float = 0, scale_: float = 1, shear=(0.0, 0.0), translate=(0.0, 0.0)) -> list[list[float]]:
    """A 2x3 matrix: turned, scaled and sheared about the centre, then moved."""
    a, sx, sy = math.radians(angle), math.tan(math.radians(shear[0])), math.tan(math.radians(shear[1]))
    c, s, cx, cy = math.cos(a) * scale_, math.sin(a) * scale_, w / 2, h / 2
    r = [[c + sy * s, s + sx * c], [-s + sy * c, c - sx * s]]
    return [[*r[0], cx - r[0][0] * cx - r[0][1] * cy + translate[0]], [*r[1], cy - r[1][0] * cx - r[1][1] * cy + translate[1]]]


def area(b: Column) -> Column:
    """Area of a box."""
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    inter = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0)) * F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def iou_matrix(a: Column, b: Column) -> Column:
    """IoU of all boxes of two arrays of one row."""
    return F.transform(a, lambda x: F.transform(b, lambda y: iou(x, y)))


def overlap_1d(a: Column, b: Column) -> Column:
    """Overlap lengths of intervals array<struct<start,end>> of one row."""
    return F.transform(a, lambda x: F.transform(b, lambda y: F.greatest(F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]), F.lit(0.0))))


def drop_covered(boxes: Column, holes: Column, most: float = 0.6) -> Column:
    """Boxes that no hole covers with an IoU of ``most`` or more."""
    return F.filter(boxes, lambda b: ~F.exists(holes, lambda x: iou(b, x) >= most))


def mosaic(boxes: Column, dx, dy, w, h, strict: bool = True) -> Column:
    """Boxes of a tile moved into a mosaic. ``strict`` keeps those with all coordinates positive; else they are clipped to the canvas."""
    moved = shift(boxes, dx, dy)
    if strict:
        return F.filter(moved, lambda b: (b["x1"] > 0) & (b["y1"] > 0) & (b["x2"] > 0) & (b["y2"] > 0))
    fit = F.transform(
        moved,
        lambda b: box(
            F.least(F.greatest(b["x1"], F.lit(0.0)), w), F.least(F.greatest(b["y1"], F.lit(0.0)), h), F.least(F.greatest(b["x2"], F.lit(0.0)), w),
            F.least(F.greatest(b["y2"], F.lit(0.0)), h)
        )
    )
    return F.filter(fit, lambda b: area(b) > 0)


def bounds(points: Column) -> Column:
    """The box around a polygon."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def letterbox_params(w: Column, h: Column, dst_w, dst_h, inner: bool = True) -> Column:
    """Scale and margins: resize to fit (or, not ``inner``, to cover) and centre."""
    p = proportion(w, h, dst_w, dst_h, "min" if inner else "shortest")
    nw, nh = F.round(w * p).cast("int"), F.round(h * p).cast("int")
    return F.struct(p.alias("p"), F.floor((dst_w - nw) / 2).cast("int").alias("l"), F.floor((dst_h - nh) / 2).cast("int").alias("t"))


def letterbox(boxes: Column, params: Column) -> Column:
    """Boxes under ``letterbox_params``."""
    return shift(scale(boxes, params["p"]), params["l"], params["t"])


def xywh_to_xyxy(x, y, w, h, centre: bool = False, blow_x=1.0, blow_y=1.0) -> Column:
    """A corner box from a corner or centre with sizes, blown up by image sizes."""
    x0, y0 = (x - w / 2, y - h / 2) if centre else (x, y)
    return box(x0 * blow_x, y0 * blow_y, (x0 + w) * blow_x, (y0 + h) * blow_y)


def xyxy_to_xywh(b: Column, centre: bool = False, blow_x=1.0, blow_y=1.0) -> Column:
    """Corner or centre with sizes, divided by image sizes."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    x, y = (b["x1"] + w / 2, b["y1"] + h / 2) if centre else (b["x1"], b["y1"])
    return F.struct((x / blow_x).alias("x"), (y / blow_y).alias("y"), (w / blow_x).alias("w"), (h / blow_y).alias("h"))
