import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import audio, boxes, image

RNG = np.random.default_rng(0)
A = RNG.integers(0, 256, (12, 16, 3)).astype(np.uint8)


def test_inverses():
    assert (image.hflip(image.hflip(A)) == A).all() and (image.vflip(image.vflip(A)) == A).all()
    assert (image.chw_to_hwc(image.hwc_to_chw(A)) == A).all() and (image.swap_channels(image.swap_channels(A)) == A).all()
    assert np.allclose(image.min_max(image.min_max(A, 0, 255, -1, 1), -1, 1, 0, 255), A)
    m, s = A.mean((0, 1)), A.std((0, 1))
    assert np.allclose(image.denormalize(image.normalize(A), m, s), A)
    p = image.pad(A, 2, 3, 4, 5)
    assert p.shape == (21, 21, 3) and (image.crop(p, 2, 18, 4, 16) == A).all()
    assert np.abs(image.hsv_to_bgr(image.bgr_to_hsv(A)) - A).max() < 1e-6
    assert (image.warp(A, [[1, 0, 0], [0, 1, 0]]) == A).all()
    t = image.tiles(A, 2, 2)
    assert (image.untile(t, 2) == A).all()
    assert np.allclose(image.perspective_matrix([(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (1, 0), (1, 1), (0, 1)]), np.eye(3))


def test_kernels():
    assert image.bgr_to_gray(A).shape == (12, 16, 1) and image.keep_3_channels(A[:, :, 0]).shape == (12, 16, 3)
    assert image.add_xy(A).shape == (12, 16, 5)
    flat = np.full((9, 9), 7, np.uint8)
    assert (image.gaussian_blur(flat) == 7).all() and (image.motion_blur(flat, 5) == 7).all()
    assert image.resize(A, 32, 24).shape == (24, 32, 3) and (image.resize(A, 16, 12) == A).all()
    assert image.mosaic4([A] * 4, 16, 16, 12).shape == (32, 32, 3) and image.mosaic9([A] * 9, 8).shape == (24, 24, 3)
    assert (image.cut_mix(A, A[::-1], 0, 4, 0, 4)[4:] == A[4:]).all()
    assert (image.mix_up(A, A, 0.3) == A).all()
    r = lambda: np.random.default_rng(1)
    for f in (image.gauss_noise, image.salt_noise, image.poisson_noise, image.speckle_noise, image.jitter, image.random_erase):
        assert (f(A, r()) == f(A, r())).all() and f(A, r()).shape == A.shape
    square = [(2, 2), (10, 2), (10, 10), (2, 10)]
    assert image.inside((12, 12), square)[5, 5] and not image.inside((12, 12), square)[0, 0]
    assert image.shrink_map((12, 12), [square])[6, 6] == 1 and image.border_map((12, 12), [square])[2, 6] == 1
    assert (image.axis_projection(A.astype(float)).std(0) < 1e-9).all()
    assert image.to_image(np.full((2, 2), 0.5)).tolist() == [[127, 127], [127, 127]]


def test_boxes(spark):
    b = F.array(boxes.box(*map(F.lit, (10.0, 20.0, 30.0, 60.0))))
    one = lambda c: [tuple(x) for x in spark.range(1).select(c.alias("r")).first()["r"]]
    w, h = F.lit(100.0), F.lit(80.0)
    assert one(boxes.hflip(boxes.hflip(b, w), w)) == [(10, 20, 30, 60)]
    turned = b
    for k in range(4):
        turned = boxes.rotate90(turned, w if k % 2 == 0 else h, h if k % 2 == 0 else w, 1)
    assert one(turned) == [(10, 20, 30, 60)]
    m = boxes.pad_params(F.lit(100), F.lit(80), 120, 120)
    assert one(boxes.unpad(boxes.pad(b, m), m)) == [(10, 20, 30, 60)]
    assert one(boxes.warp(b, boxes.affine_matrix(100, 80)))[0] == pytest.approx((10, 20, 30, 60))
    assert one(boxes.rotate(b, 100, 80, F.lit(0.0)))[0] == pytest.approx((10, 20, 30, 60))
    assert one(boxes.drop_covered(b, b)) == []
    win = boxes.window("center", F.lit(100), F.lit(80), 50, 40)
    r = spark.range(1).select(boxes.crop(b, F.array(F.lit(3)), win).alias("r")).first()["r"]
    assert [tuple(x) for x in r["bboxes"]] == [(0, 0, 5, 40)] and r["classes"] == [3]
    empty = F.filter(b, lambda x: F.lit(False))
    r = spark.range(1).select(boxes.crop(empty, F.array(F.lit(3)), win).alias("r")).first()["r"]
    assert r["bboxes"] == [] and r["classes"] == []


def test_audio(spark):
    x = np.sin(np.arange(4000) * 2 * np.pi * 440 / 8000)
    f = audio.log_mel(x, 8000, 12)
    assert f.shape == (48, 12) and f.mean(0).argmax() in range(2, 6)
    assert np.allclose(audio.log_mel(x, 8000, 12, subtract_mean=True).mean(0), 0)
    assert audio.log_mel(x[:10], 8000).shape == (0, 23)
    up = audio.resampled(x, 8000, 16000)
    assert len(up) == 8000 and np.abs(up[200:-200] - np.sin(np.arange(8000) * 2 * np.pi * 440 / 16000)[200:-200]).max() < 0.01
    rows = F.array(*[F.array(F.lit(float(i))) for i in range(3)])
    got = spark.range(1).select(audio.stack_frames(rows, 3, 2).alias("r")).first()["r"]
    assert got == [[0, 0, 1], [1, 2, 2]]


def _odd_vectors(tmp_path):
    """Halves of the sixth digit, zeros of both signs, tiny, plain and not finite values, as a table of vectors."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng, inf = np.random.default_rng(1), float("inf")
    rows = [rng.integers(-300, 301, 64) / 128 for _ in range(40)] + [rng.standard_normal(64) * s for s in (1e-6, 1e-7, 1, 1, 1e6)]
    rows += [np.full(64, -0.0), np.where(rng.random(64) < 0.5, -0.0, 0.0), rng.permutation([inf, -inf, float("nan"), 3e38] + [0.3] * 60)]
    pq.write_table(pa.table({"vec_id": range(len(rows)), "embedding": pa.array([list(r) for r in rows], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["axis_projection", "min_max", "border_map", "bgr_to_gray", "saturation", "resize_bilinear", "perspective", "warp", "convolve", "gaussian_blur", "motion_blur", "hue", "hsv"])
def test_pixel_query_to_the_bit(spark, sf, tmp_path, name):
    from oracle import duck

    from corpusmill.plans import registry

    for path in (_odd_vectors(tmp_path), sf):
        got = sorted((tuple(r) for r in registry.QUERIES[f"image_{name}"](spark, path).collect()), key=lambda r: r[0])
        want = duck(path).execute(registry.ORACLES[f"image_{name}"] + " ORDER BY vec_id").fetchall()
        assert [repr(r) for r in got] == [repr(r) for r in want]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_are_not_written_out_twice(spark, sf):
    """A plain explode repeats all steps in a test of its own, within one expression that grows with each of them."""
    from corpusmill.plans import registry

    plan = _plan(registry.QUERIES["augment_cover"](spark, sf))
    assert len(plan) < 10_000 and plan.count("zip_with(") == 1


def test_single_boxes_need_no_arrays(spark, sf):
    from corpusmill.plans import registry

    plan = _plan(registry.QUERIES["box_five_crop"](spark, sf))
    assert "transform(" not in plan and "filter(" not in plan


def test_crop_computes_boxes_once(spark, sf):
    """Whatever is asked of the result; boxes without classes and classes without boxes are as they were."""
    from corpusmill.plans import registry

    plan = _plan(registry.QUERIES["box_crop"](spark, sf))
    assert plan.count("zip_with(") == 1 and "sequence(" not in plan and plan.count("collect_list(") == 2  # once before the shuffle, once behind
    d = spark.createDataFrame([(1, [(0.0, 0.0, 20.0, 20.0), (90.0, 0.0, 99.0, 5.0)], [3, 4, 5]), (2, [], [1]), (3, None, [1]), (4, None, None)], "k int, b array<struct<x1:double,y1:double,x2:double,y2:double>>, c array<int>")
    win = F.struct(F.lit(10).alias("x1"), F.lit(60).alias("x2"), F.lit(5).alias("y1"), F.lit(55).alias("y2"))
    got = {r["k"]: r["r"].asDict(True) for r in d.select("k", boxes.crop(F.col("b"), F.col("c"), win).alias("r")).collect()}
    assert [tuple(b.values()) for b in got[1]["bboxes"]] == [(0.0, 0.0, 10.0, 15.0)] and got[1]["classes"] == [3] and len(got[1]["dropped"]) == 1
    assert all(got[k] == {"bboxes": [], "classes": [], "dropped": []} for k in (2, 3, 4))


def test_images_pass_as_arrow(spark, sf):
    """No step of the image queries goes by pandas (evaluation type 200), which makes an object of every value of a batch."""
    import re

    from pyspark.util import PythonEvalType

    from corpusmill.plans import registry

    for name in ("image_png_colour", "image_png", "image_drawn"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan()
        kinds = {int(k) for k in re.findall(r"ArrowEvalPython \[.*\], (\d+)", plan.toString())}
        assert kinds == {PythonEvalType.SQL_SCALAR_ARROW_UDF}
