"""Payloads of images and sounds: files' bytes, or their base64 text, to arrays and back.

PNG (all depths and colours, not interlaced), BMP (24 and 32 bits), PGM, PPM and
arrays in NumPy's format are read here; JPEG and the rest need Pillow or OpenCV on the workers, and are
null without them.  Sounds are WAV files of 8, 16, 24 or 32 bits.  A payload
that cannot be read gives null, so that one bad file does not end a job;
``strict`` raises instead.
"""

from __future__ import annotations

import io
import re
import struct
import wave
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.image import FIELDS, arrays_of, bgr_to_gray, on_image, structs_of
from ..types import Payload

SIGNATURE = b"\x89PNG\r\n\x1a\n"
SOUND = "rate int, channels int, samples array<double>"


def _unfiltered(raw: np.ndarray, rows: int, size: int, step: int) -> np.ndarray:
    """Scan lines of ``size`` bytes with their filters undone; ``step`` is a pixel's bytes."""
    lines = raw.reshape(rows, size + 1)
    out = np.zeros((rows + 1, size), np.uint8)
    for y in range(rows):
        kind, line, up = lines[y, 0], lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:  # what stands left of each byte has been added up already: a running sum
            pad = -size % step
            out[y + 1] = np.add.accumulate(np.r_[line, np.zeros(pad, np.uint8)].reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:size]
        elif kind == 2:
            out[y + 1] = line + up
        else:
            left, corner, now = [0] * size, up.tolist(), line.tolist()
            above = [0] * step + corner
            for x in range(size):
                a = left[x - step] if x >= step else 0
                b, c = corner[x], above[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))  # ties go to the first
                left[x] = (now[x] + guess) & 255
            out[y + 1] = left
    return out[1:]


def read_png(raw: bytes) -> np.ndarray:
    """Rows of a PNG file as (h, w) or (h, w, c), blue first."""
    at, data, palette, clear = len(SIGNATURE), [], None, None
    while at < len(raw):
        n, name = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + n]
        if name == b"IHDR":
            w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif name == b"IDAT":
            data.append(body)
        at += 12 + n
    if interlaced:
        raise ValueError("interlaced PNG")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    size = (w * channels * depth + 7) // 8
    rows = _unfiltered(np.frombuffer(zlib.decompress(b"".join(data)), np.uint8), h, size, max(1, channels * depth // 8))
    if depth == 16:
        a = rows.view(">u2").astype(np.uint16).reshape(h, w, channels)
    elif depth == 8:
        a = rows.reshape(h, w, channels)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, : w * channels]
        a = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8).reshape(h, w, channels)
        a = a if kind == 3 else a * (255 // ((1 << depth) - 1))
    if kind == 3:
        index = a[:, :, 0]
        a = palette[index]
        if clear is not None:
            a = np.dstack([a, np.r_[clear, np.full(max(0, len(palette) - len(clear)), 255, np.uint8)][index]])
    if a.shape[2] >= 3:
        a = np.concatenate([a[:, :, 2::-1], a[:, :, 3:]], axis=2)
    return a[:, :, 0] if a.shape[2] == 1 else a


def write_png(a: np.ndarray) -> bytes:
    """A PNG file of 8 or 16 bits; other values are clipped to 8."""
    a = a if a.dtype in (np.uint8, np.uint16) else np.clip(a, 0, 255).astype(np.uint8)
    a = a[:, :, None] if a.ndim == 2 else a
    if a.shape[2] >= 3:
        a = np.concatenate([a[:, :, 2::-1], a[:, :, 3:]], axis=2)
    h, w, c = a.shape
    rows = np.ascontiguousarray(a.astype(a.dtype.newbyteorder(">"))).view(np.uint8).reshape(h, -1)
    body = zlib.compress(np.c_[np.zeros(h, np.uint8), rows].tobytes(), 6)
    head = struct.pack(">IIBBBBB", w, h, 8 * a.dtype.itemsize, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    chunk = lambda name, x: struct.pack(">I", len(x)) + name + x + struct.pack(">I", zlib.crc32(name + x))
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def read_bmp(raw: bytes) -> np.ndarray:
    """Rows of an uncompressed BMP file of 24 or 32 bits."""
    start, _, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", raw, 10)
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("BMP of another kind")
    size = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(raw, np.uint8, size * abs(h), start).reshape(abs(h), size)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return rows[::-1] if h > 0 else rows


def read_pnm(raw: bytes) -> np.ndarray:
    """Rows of a binary PGM or PPM file."""
    m = re.match(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", raw)
    if not m:
        raise ValueError("PNM of another kind")
    w, h, top = (int(x) for x in m.groups()[1:])
    c = 3 if m[1] == b"6" else 1
    a = np.frombuffer(raw, ">u2" if top > 255 else np.uint8, w * h * c, m.end()).reshape(h, w, c)
    a = a.astype(np.uint16) if top > 255 else a
    return a[:, :, ::-1] if c == 3 else a[:, :, 0]


def read_image(raw: bytes) -> np.ndarray:
    """The array of an image file, blue first."""
    if raw[:8] == SIGNATURE:
        return read_png(raw)
    if raw[:6] == b"\x93NUMPY":
        return np.load(io.BytesIO(raw), allow_pickle=False)
    if raw[:2] == b"BM":
        return read_bmp(raw)
    if raw[:2] in (b"P5", b"P6"):
        return read_pnm(raw)
    try:
        from PIL import Image

        a = np.asarray(Image.open(io.BytesIO(raw)))
        return np.concatenate([a[:, :, 2::-1], a[:, :, 3:]], axis=2) if a.ndim == 3 and a.shape[2] >= 3 else a
    except ImportError:
        import cv2

        a = cv2.imdecode(np.frombuffer(raw, np.uint8), cv2.IMREAD_UNCHANGED)
        if a is None:
            raise ValueError("no image") from None
        return a


def _bytes_of(payload) -> bytes:
    """A payload's bytes; texts are base64, perhaps behind a ``data:`` head."""
    if isinstance(payload, str):
        import base64

        return base64.b64decode(payload.partition(",")[2] if payload.startswith("data:") else payload, validate=False)
    return bytes(payload)


def decode_image(payload: Column, strict: bool = False) -> Column:
    """The image of a binary column (a file's bytes) or a text column (base64)."""

    def read(x):
        try:
            return None if x is None else read_image(_bytes_of(x))
        except Exception:
            if strict:
                raise
            return None

    @F.arrow_udf(FIELDS)
    def apply(payloads: pa.Array) -> pa.Array:
        return structs_of(read(x.as_py()) for x in payloads)

    return apply(payload)


def get_image(payload: Column, kind: Payload, strict: bool = False) -> Column:
    """The payload of an image as a kind asks for it: a path stays what it is, the others are decoded, to one channel for ``GRAY_ARRAY``."""
    if kind in (Payload.PATH, Payload.URL):
        return payload
    image = decode_image(payload, strict)
    if kind != Payload.GRAY_ARRAY:
        return image
    return on_image(image, lambda a: bgr_to_gray(a)[:, :, 0] if a.ndim == 3 and a.shape[2] >= 3 else a if a.ndim == 2 else a[:, :, 0])


def encode_image(image: Column) -> Column:
    """PNG files of images."""

    @F.arrow_udf("binary")
    def apply(images: pa.Array) -> pa.Array:
        return pa.array([None if a is None else write_png(a) for a in arrays_of(images)], pa.binary())

    return apply(image)


def read_sound(raw: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, channels and samples between -1 and 1 of a WAV file; channels alternate."""
    with wave.open(io.BytesIO(raw)) as w:
        size, body = w.getsampwidth(), w.readframes(w.getnframes())
        if size == 1:
            x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
        elif size == 3:
            b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
        else:
            x = np.frombuffer(body, {2: "<i2", 4: "<i4"}[size]) / float(1 << 8 * size - 1)
        return w.getframerate(), w.getnchannels(), x


def write_sound(samples, rate: int, channels: int = 1) -> bytes:
    """A WAV file of 16 bits."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.round(np.asarray(samples, float) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def decode_sound(payload: Column, strict: bool = False) -> Column:
    """The sound of a binary column (a file's bytes) or a text column (base64)."""

    @F.pandas_udf(SOUND)
    def apply(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            try:
                out.append((None, None, None) if x is None else read_sound(_bytes_of(x)))
            except Exception:
                if strict:
                    raise
                out.append((None, None, None))
        return pd.DataFrame(out, columns=["rate", "channels", "samples"]).astype({"rate": "Int32", "channels": "Int32"})

    return apply(payload)


def encode_sound(samples: Column, rate: int, channels: int = 1) -> Column:
    """WAV files of arrays of samples."""

    @F.pandas_udf("binary")
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else write_sound(x, rate, channels))

    return apply(samples)
