"""Record types and the vocabulary of splits and payload encodings."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class Split(str, Enum):
    """Names of data splits; FULL stands for all that a source has by default."""

    MIX, FULL, TRAIN, TEST, VAL, DEV, TRAIN_VAL = "mix", "full", "train", "test", "val", "dev", "train_val"


class Payload(str, Enum):
    """How an image or a sound is held in a column."""

    PATH, ARRAY, GRAY_ARRAY, NPY, BASE64, ZIP, URL, BYTES = "path", "array", "gray_array", "npy", "base64", "zip", "url", "bytes"


class Special(str, Enum):
    """Names of special tokens."""

    CLS, SEP, PAD, MASK, UNK = "[CLS]", "[SEP]", "[PAD]", "[MASK]", "[UNK]"


def unused(i: int) -> str:
    """The i-th unused token's name."""
    return f"[unused{i}]"


BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")])
POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y")])
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
IMAGE = T.StructType(
    [
        T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("channels", T.IntegerType()),
        T.StructField("dtype", T.StringType()), T.StructField("data", T.BinaryType())
    ]
)
SPAN = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
IMAGE_CLASS = T.StructType([T.StructField("_id", T.StringType()), T.StructField("image", IMAGE), T.StructField("_class", T.IntegerType())])
DETECTION = T.StructType(
    [
        T.StructField("_id", T.StringType()), T.StructField("image", IMAGE), T.StructField("size", T.ArrayType(T.IntegerType())),
        T.StructField("bboxes", T.ArrayType(BOX)), T.StructField("classes", T.ArrayType(T.IntegerType()))
    ]
)
SEGMENTATION = T.StructType([T.StructField("_id", T.StringType()), T.StructField("image", IMAGE), T.StructField("label_mask", IMAGE)])
AUDIO_CLASS = T.StructType([T.StructField("_id", T.StringType()), T.StructField("audio", T.ArrayType(T.FloatType())), T.StructField("_class", T.IntegerType())])
AUDIO_DETECTION = T.StructType(
    [
        T.StructField("_id", T.StringType()), T.StructField("audio", T.StringType()),
        T.StructField("bboxes", T.ArrayType(BOX)), T.StructField("classes", T.ArrayType(T.IntegerType()))
    ]
)
AUDIO_SPANS = T.StructType(
    [
        T.StructField("_id", T.StringType()), T.StructField("audio", T.StringType()), T.StructField("timestamps", T.ArrayType(SPAN)),
        T.StructField("classes", T.ArrayType(T.StringType()))
    ]
)
