"""Geometric steps on rows of images and boxes, with recorded parameters and a way back.

A ``Step`` computes its parameters from a row's size (and, if it draws, from
the row's key and a seed), moves the boxes, and changes the size; where the rows
have images, a kernel changes them too.  ``augment`` applies steps in order and
records each one's parameters in a column ``p<i>_<name>``; ``restore`` takes
boxes back through the recorded parameters, last step first.

Columns: ``bboxes`` array<struct<x1,y1,x2,y2>>, ``width``, ``height``, and
perhaps ``classes`` and ``image``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.perturb import uniform
from . import boxes as B
from . import image as I


@dataclass(frozen=True)
class Step:
    """params(w, h, uniforms) -> struct; boxes and back move arrays of boxes; size gives the new width and height; kernel(array, params) the new image."""

    name: str
    params: Callable[[Column, Column, Callable[[int], Column]], Column]
    boxes: Callable[[Column, Column], Column]
    back: Callable[[Column, Column], Column]
    size: Callable[[Column, Column, Column], tuple[Column, Column]]
    kernel: Callable
    window: bool = False  # cuts boxes, and drops those outside with their classes


def _sized(w: Column, h: Column, **more: Column) -> Column:
    return F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"), *[c.alias(k) for k, c in more.items()])


def flip(horizontal: bool = True, prob: float = 1.0) -> Step:
    """Mirrored, with a probability."""
    f = (lambda b, p: B.hflip(b, p["w"].cast("double"))) if horizontal else (lambda b, p: B.vflip(b, p["h"].cast("double")))
    either = lambda b, p: F.when(p["on"], f(b, p)).otherwise(b)
    kernel = lambda a, p: (I.hflip(a) if horizontal else I.vflip(a)) if p["on"] else a
    return Step("hflip" if horizontal else "vflip", lambda w, h, u: _sized(w, h, on=F.lit(True) if prob >= 1 else u(0) < prob), either, either, lambda w, h, p: (w, h), kernel)


def scale(dst_w, dst_h, choice: str = "min", max_ratio: tuple[float, float] | None = None, truncate: bool = True) -> Step:
    """Resized in proportion towards a size (numbers or columns)."""
    params = lambda w, h, u: _sized(w, h, p=B.proportion(w, h, dst_w, dst_h, choice, max_ratio).cast("double"))
    return Step(
        "scale", params, lambda b, p: B.scale(b, p["p"], truncate=truncate), lambda b, p: B.scale(b, 1 / p["p"], truncate=False), lambda w, h,
        p: (F.round(w * p["p"]).cast("int"), F.round(h * p["p"]).cast("int")), _resize
    )


def _resize(a, p):
    return I.resize(a, max(1, round(a.shape[1] * p["p"])), max(1, round(a.shape[0] * p["p"])))


def random_scale(dst_w, dst_h, choice: str = "longest", low: float = 1.14, high: float = 1.71, truncate: bool = True) -> Step:
    """Resized towards a size times a number drawn between two bounds."""
    ratio = lambda u: F.lit(low) + u(0) * (high - low)
    params = lambda w, h, u: _sized(w, h, p=B.proportion(w, h, F.lit(dst_w) * ratio(u), F.lit(dst_h) * ratio(u), choice).cast("double"))
    return Step(
        "random_scale", params, lambda b, p: B.scale(b, p["p"], truncate=truncate), lambda b, p: B.scale(b, 1 / p["p"], truncate=False), lambda w, h,
        p: (F.round(w * p["p"]).cast("int"), F.round(h * p["p"]).cast("int")), _resize
    )


def pad(dst_w, dst_h, side: tuple[str, str] = ("center", "center"), fill: int = 114) -> Step:
    """Filled up to a size."""
    params = lambda w, h, u: B.pad_params(w, h, dst_w, dst_h, side, u(0), u(1))
    return Step("pad", params, B.pad, B.unpad, lambda w, h, p: (w + p["l"] + p["r"], h + p["t"] + p["d"]), lambda a, p: I.pad(a, p["l"], p["r"], p["t"], p["d"], fill))


def window(kind: str, dst_w, dst_h, corner: tuple[str, str] = ("left", "top")) -> Step:
    """Cut to a window: random, center or corner, no larger than the image."""
    params = lambda w, h, u: B.window(kind, w, h, F.least(F.lit(dst_w), w), F.least(F.lit(dst_h), h), u(0), u(1), corner)
    return Step(
        "window", params, lambda b, p: b, B.uncrop, lambda w, h, p: (p["x2"] - p["x1"], p["y2"] - p["y1"]), lambda a,
        p: I.crop(a, p["x1"], p["x2"], p["y1"], p["y2"]), True
    )


def letterbox(dst_w, dst_h) -> list[Step]:
    """Resized to fit, and centred."""
    return [scale(dst_w, dst_h, "min"), pad(dst_w, dst_h)]


def cover(dst_w, dst_h) -> list[Step]:
    """Resized by the shorter side, and cut round the centre."""
    return [scale(dst_w, dst_h, "shortest"), window("center", dst_w, dst_h)]


def jitter(dst_w, dst_h) -> list[Step]:
    """Resized at random by the longer side, filled up, and cut at random."""
    return [random_scale(dst_w, dst_h, "longest"), pad(dst_w, dst_h), window("random", dst_w, dst_h)]


def rude_jitter(dst_w, dst_h) -> list[Step]:
    """Resized at random by the shorter side, and cut at random."""
    return [random_scale(dst_w, dst_h, "shortest"), window("random", dst_w, dst_h)]


def _uniforms(seed: int, step: int, key: str | None) -> Callable[[int], Column]:
    """Numbers in [0, 1) by the seed, the step, the draw, and the row's key where rows have one."""
    return lambda k: uniform(seed * 1000 + step * 8 + k, F.col(key) if key else F.lit(0))


def _kernel(step: Step) -> Callable:
    return lambda a, p: step.kernel(a, p)


def augment(df: DataFrame, steps: list[Step], key: str | None = None, seed: int = 0) -> DataFrame:
    """df with its boxes (and images) taken through the steps."""
    for i, s in enumerate(steps):
        name = f"p{i}_{s.name}"
        df = df.withColumn(name, s.params(F.col("width"), F.col("height"), _uniforms(seed, i, key)))
        p = F.col(name)
        if s.window:
            classes = F.col("classes") if "classes" in df.columns else F.array_repeat(F.lit(0), F.size("bboxes"))
            df = df.withColumn("_kept", B.crop(F.col("bboxes"), classes, p)).withColumn("bboxes", F.col("_kept.bboxes"))
            df = df.withColumn("classes", F.col("_kept.classes")) if "classes" in df.columns else df
            df = df.drop("_kept")
        else:
            df = df.withColumn("bboxes", s.boxes(F.col("bboxes"), p))
        if "image" in df.columns:
            df = df.withColumn("image", I.on_image(F.col("image"), _kernel(s), p))
        w, h = s.size(F.col("width"), F.col("height"), p)
        df = df.withColumns({"width": w.cast("int"), "height": h.cast("int")})
    return df


def restore(df: DataFrame, steps: list[Step]) -> DataFrame:
    """df with its boxes back in the first image's frame; what a window cut off is lost."""
    for i, s in reversed(list(enumerate(steps))):
        df = df.withColumn("bboxes", s.back(F.col("bboxes"), F.col(f"p{i}_{s.name}")))
    return df


def batch_size(df: DataFrame, batch: str, edge: str = "shortest") -> DataFrame:
    """df with ``_dst``: the least, largest or mean side (``shortest``, ``longest``, ``auto``) of the images of a batch."""
    side = {"shortest": F.min(F.least("width", "height")), "longest": F.max(F.greatest("width", "height")), "auto": F.floor(F.avg((F.col("width") + F.col("height")) / 2))}[edge]
    return df.join(df.groupBy(batch).agg(side.cast("int").alias("_dst")), batch)


def batch_letterbox(df: DataFrame, batch: str, edge: str = "shortest") -> DataFrame:
    """All images of a batch letterboxed to one square."""
    d = F.col("_dst")
    return augment(batch_size(df, batch, edge), letterbox(d, d)).drop("_dst")


def batch_pad(df: DataFrame, batch: str, fill: int = 114) -> DataFrame:
    """All images of a batch filled up to the largest width and height among them; boxes move along."""
    most = df.groupBy(batch).agg(F.max("width").alias("_w"), F.max("height").alias("_h"))
    return augment(df.join(most, batch), [pad(F.col("_w"), F.col("_h"), fill=fill)]).drop("_w", "_h")


def outline(a, found, value: int = 255, width: int = 1):
    """A copy of an image with boxes (x1, y1, x2, y2) drawn on it."""
    a = a.copy()
    h, w = a.shape[:2]
    for b in found:
        x1, y1, x2, y2 = (int(min(max(b[k], 0), top)) for k, top in (("x1", w), ("y1", h), ("x2", w), ("y2", h)))
        a[y1 : y1 + width, x1:x2] = value
        a[max(y1, y2 - width) : y2, x1:x2] = value
        a[y1:y2, x1 : x1 + width] = value
        a[y1:y2, max(x1, x2 - width) : x2] = value
    return a


def drawn(image: Column, bboxes: Column, value: int = 255) -> Column:
    """Images with their boxes drawn on them."""
    return I.on_image(image, lambda a, found: a if found is None else outline(a, list(found), value), bboxes)
