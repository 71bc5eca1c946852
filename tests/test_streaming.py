"""The event-time operators on streams give what they give on the same rows as a batch."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusmill import streaming

START = datetime(2024, 1, 1, 10, 0)


def rows():
    out = []
    for i in range(120):
        out.append((i % 5, "ab"[i % 2], START + timedelta(minutes=i // 2 + (40 if i % 5 == 3 and i > 60 else 0))))
    return out


@pytest.fixture()
def files(spark, tmp_path):
    df = spark.createDataFrame(rows(), "user long, kind string, ts timestamp")
    path = str(tmp_path / "in")
    df.orderBy("ts").coalesce(1).write.parquet(path)
    return path, df


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows(spark, files):
    path, df = files
    stream = streaming.windowed_counts(spark.readStream.schema(df.schema).parquet(path), "ts", ["kind"])
    flat = lambda d: sorted((r["window"]["start"], r["kind"], r["n"]) for r in d.collect())
    assert flat(run(spark, stream, "windows", "complete")) == flat(streaming.windowed_counts(df, "ts", ["kind"]))


def test_sliding_windows(spark, files):
    path, df = files
    stream = streaming.windowed_counts(spark.readStream.schema(df.schema).parquet(path), "ts", ["user"], "10 minutes", slide="5 minutes")
    got = run(spark, stream, "sliding", "complete").agg(F.sum("n")).first()[0]
    assert got == 2 * len(rows())


def test_sessions(spark, files):
    path, df = files
    stream = streaming.sessions(spark.readStream.schema(df.schema).parquet(path), "ts", "user")
    flat = lambda d: {(r["session"]["start"], r["user"], r["n"]) for r in d.collect()}
    assert flat(run(spark, stream, "sessions", "complete")) == flat(streaming.sessions(df, "ts", "user"))


def test_first_seen(spark, files):
    path, df = files
    stream = streaming.first_seen(spark.readStream.schema(df.schema).parquet(path), "ts", ["user", "kind"], "1 day")
    got, want = run(spark, stream, "first"), streaming.first_seen(df, "ts", ["user", "kind"])
    assert got.count() == want.count() == df.select("user", "kind").distinct().count()
    assert want.columns == df.columns


def test_late_rows_are_left_out(spark, tmp_path):
    """A row older than the watermark of an earlier file does not come into its window; the watermark for late rows is one batch behind."""
    schema = "kind string, ts timestamp"
    path = str(tmp_path / "late")
    for i, (kind, minute) in enumerate((("a", 0), ("a", 120), ("a", 121), ("b", 1))):
        spark.createDataFrame([(kind, START + timedelta(minutes=minute))], schema).coalesce(1).write.mode("append").parquet(path)
    stream = streaming.windowed_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), "ts", ["kind"])
    got = {(r["kind"], r["window"]["start"]): r["n"] for r in run(spark, stream, "late", "update").orderBy("n").collect()}
    assert got == {("a", START): 1, ("a", START + timedelta(minutes=120)): 2}
