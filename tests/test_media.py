"""Payload coding against independent encoders written out by hand, and unreadable payloads."""

import base64
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import image
from corpusmill.sources import media


def png(rows, w, h, depth, kind, filters, palette=b"", clear=b""):
    """A PNG file with chosen filters, by the definition of each filter. rows: unfiltered bytes of each scan line."""
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind] * depth // 8)
    out, up = b"", bytes(len(rows[0]))
    for f, row in zip(filters, rows, strict=True):
        line = bytearray()
        for x, v in enumerate(row):
            a, b, c = (row[x - step] if x >= step else 0), up[x], (up[x - step] if x >= step else 0)
            p = a + b - c
            best = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - (0, a, b, (a + b) // 2, best)[f]) & 255)
        out, up = out + bytes([f]) + bytes(line), row
    chunk = lambda n, x: struct.pack(">I", len(x)) + n + x + struct.pack(">I", zlib.crc32(n + x))
    body = zlib.compress(out)
    more = (chunk(b"PLTE", palette) if palette else b"") + (chunk(b"tRNS", clear) if clear else b"")
    return media.SIGNATURE + chunk(
        b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)
    ) + more + chunk(b"IDAT", body[:10]) + chunk(b"IDAT", body[10:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind, depth, channels", [(0, 8, 1), (2, 8, 3), (4, 8, 2), (6, 8, 4), (0, 16, 1), (2, 16, 3)])
def test_png_filters(kind, depth, channels):
    rng = np.random.default_rng(kind + depth)
    a = rng.integers(0, 1 << depth, (10, 7, channels)).astype(np.uint16 if depth == 16 else np.uint8)
    rows = [r.astype(">u2" if depth == 16 else np.uint8).tobytes() for r in a]
    got = media.read_png(png(rows, 7, 10, depth, kind, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]))
    want = np.concatenate([a[:, :, 2::-1], a[:, :, 3:]], axis=2) if channels >= 3 else a
    assert (got.reshape(want.shape) == want).all() and got.dtype == a.dtype
    assert (media.read_png(media.write_png(got)) == got).all()


def test_png_small_depths_and_palette():
    assert media.read_png(png([b"\xa0", b"\x40"], 3, 2, 1, 0, [0, 0])).tolist() == [[255, 0, 255], [0, 255, 0]]
    assert media.read_png(png([b"\x1b"], 4, 1, 2, 0, [0])).tolist() == [[0, 85, 170, 255]]
    got = media.read_png(png([b"\x01\x00"], 2, 1, 8, 3, [0], bytes([1, 2, 3, 4, 5, 6]), b"\x09"))
    assert got.tolist() == [[[6, 5, 4, 255], [3, 2, 1, 9]]]


def test_other_images():
    a = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)
    rows = b"".join(r.tobytes() + b"\0" * 3 for r in a[::-1])
    bmp = b"BM" + struct.pack("<IIIIiiHHIIIIII", 54 + len(rows), 0, 54, 40, 3, 2, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (media.read_image(bmp) == a).all()
    assert (media.read_image(b"P6 # note\n3 2\n255\n" + a[:, :, ::-1].tobytes()) == a).all()
    assert media.read_image(b"P5\n2 1\n255\n\x05\x06").tolist() == [[5, 6]]


def test_payload_columns(spark):
    raw = media.write_png(np.array([[1, 2], [3, 4]], np.uint8))
    rows = [(1, raw, base64.b64encode(raw).decode()), (2, None, None), (3, b"no image", "data:image/png;base64," + base64.b64encode(raw).decode())]
    df = spark.createDataFrame(rows, "id int, b binary, t string")
    got = {
        r["id"]: (r["b"], r["t"]) for r in df.select(
            "id", image.pixels(media.decode_image(F.col("b"))).alias("b"), image.pixels(media.decode_image(F.col("t"))).alias("t")
        ).collect()
    }
    assert got == {1: ([1, 2, 3, 4], [1, 2, 3, 4]), 2: (None, None), 3: (None, [1, 2, 3, 4])}
    with pytest.raises(Exception):
        df.select(media.decode_image(F.col("b"), True).alias("b")).collect()


def test_payload_kinds(spark):
    import io

    from corpusmill.types import Payload

    raw = io.BytesIO()
    np.save(raw, np.array([[[10, 20, 30]], [[0, 0, 0]]], np.uint8))
    df = spark.createDataFrame([(1, raw.getvalue(), "a/b.png")], "id int, b binary, p string")
    r = df.select(image.pixels(media.get_image(F.col("b"), Payload.NPY)).alias("a"), image.pixels(media.get_image(F.col("b"), Payload.GRAY_ARRAY)).alias("g"), media.get_image(F.col("p"), Payload.PATH).alias("p")).first()
    assert r["a"] == [10, 20, 30, 0, 0, 0] and r["g"] == [22, 0] and r["p"] == "a/b.png"


def test_sounds(spark, tmp_path):
    for width, values, want in (
        (1, [0, 128, 255], [-1, 0, 127 / 128]), (2, [-32768, 0, 16384], [-1, 0, 0.5]), (3, [-(1 << 23), 0, 1 << 22], [-1, 0, 0.5]),
        (4, [-(1 << 31), 0, 1 << 30], [-1, 0, 0.5])
    ):
        path = tmp_path / f"{width}.wav"
        with wave.open(str(path), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(width)
            w.setframerate(8000)
            w.writeframes(b"".join(v.to_bytes(width, "little", signed=width > 1) for v in values))
        rate, channels, x = media.read_sound(path.read_bytes())
        assert (rate, channels, x.tolist()) == (8000, 1, want)
    df = spark.createDataFrame([(1, [0.5, -0.25]), (2, None)], "id int, s array<double>")
    got = {r["id"]: r["s"] for r in df.select("id", media.decode_sound(media.encode_sound(F.col("s"), 100)).alias("s")).collect()}
    assert got[1]["samples"] == [0.5, -0.25] and got[1]["rate"] == 100 and got[2]["samples"] is None


def test_wav_query_to_the_bit(spark, sf, tmp_path):
    """Signs of zeros, null vectors and components that no sample can hold are as in SQL, which ``agree`` does not tell apart."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from oracle import duck

    from corpusmill.plans import registry

    inf = float("inf")
    odd = [[-0.0, 0.0, -0.0004, 0.0004, -1e-30], None, [], [None, 0.1], [float("nan")], [inf, -inf], [1e30, -1e30], [-32.768, -40, 40, 32.767, -32.7679]]
    pq.write_table(pa.table({"vec_id": range(len(odd)), "embedding": pa.array(odd, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    for path in (tmp_path, sf):
        got = sorted((tuple(r) for r in registry.QUERIES["audio_wav"](spark, str(path)).collect()), key=lambda r: r[0])
        want = duck(str(path)).execute(registry.ORACLES["audio_wav"] + " ORDER BY vec_id").fetchall()
        assert [repr(r) for r in got] == [repr(r) for r in want]


def test_character_maps_agree(spark):
    """The table of both coordinates is the join of the two tables on the offset."""
    from corpusmill.operators import idmap

    df = spark.createDataFrame([(1, ["ab", "", "cdef", "g"], ["abc", "def"]), (2, ["x"], ["x", "yz"]), (3, [], [""]), (4, None, None)], "k int, p array<string>, c array<string>")
    both = idmap.char_table(df, "k", "p").join(idmap.char_table(df, "k", "c", ("acid", "cid", "ccid")), ["k", "acid"])
    got = idmap.paragraph_chunk_table(df, "k", "p", "c")
    key = lambda d: sorted(tuple(r[c] for c in ("k", "acid", "pid", "pcid", "cid", "ccid")) for r in d.collect())
    assert key(got) == key(both)


def test_numbers_of_many_ranges(spark):
    from corpusmill.functions import encode

    df = spark.range(1000, numPartitions=5).select((F.col("id") * 7919 % 1000).alias("x"))
    assert [(r["x"], r["id"]) for r in encode.number_rows(df, [F.desc("x")], start=5).orderBy("id").collect()] == [(999 - i, i + 5) for i in range(1000)]
    assert encode.number_rows(df.limit(0), [F.col("x")]).count() == 0
