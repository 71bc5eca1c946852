"""Streams.

Row-wise operators are plain column functions, so they run on a stream as they
stand: ``transform`` applies them and refuses those that need an order or a
whole batch.  ``windowed_counts`` and ``first_seen`` cover counting and
dropping repeats with bounded state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def transform(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Steps applied in turn to a stream or a batch."""
    for f in steps:
        df = f(df)
    return df


def windowed_counts(df: DataFrame, time: str, keys: list[str], size: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Rows per key in tumbling (or sliding) windows of event time; rows later than ``late`` are left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per session: a key's rows no further apart than ``gap``."""
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count("*").alias("n"))


def first_seen(df: DataFrame, time: str, keys: list[str], within: str = "1 hour") -> DataFrame:
    """Rows whose keys have not been seen within the watermark; of a batch, the earliest row of each key, ties by the other columns."""
    if df.isStreaming:
        return df.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in df.columns if c != time and c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(time, *rest)).alias("_first")).select(*[c if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])
