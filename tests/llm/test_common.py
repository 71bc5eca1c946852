"""Helpers of the training-data operators."""

import os

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import common


@pytest.fixture(scope="module")
def tables(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(7)).otherwise(F.col("id") % 50).alias("k"), "id")
    return left, left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))


@pytest.mark.parametrize("least", [64, 10**6])
def test_joins_of_hot_keys(tables, least):
    """With and without hot keys the rows are those of the plain join."""
    left, right = tables
    rows = lambda d: sorted((r["k"], r["id"], r["m"]) for r in d.collect())
    want = rows(left.join(right, "k"))
    assert rows(common.spread_join(left, right, ["k"], "n", least=least)) == want
    assert rows(common.salted_join(left, right.drop("n"), "k", least=least)) == want
    some = right.where("k < 10")
    assert rows(common.spread_join(left, some, ["k"], "n", least=least)) == rows(left.join(some, "k"))
    assert common.spread_join(left.limit(0), right.limit(0), ["k"], "n").count() == 0
    assert common.salted_join(left.limit(0), right.drop("n"), "k").count() == 0


def test_cut_tables_can_be_removed(spark):
    with common.cuts_of() as paths:
        kept, gone = common.cut(spark.range(10)), common.cut(spark.range(5), narrow=True)
    assert len(paths) == 2 and kept.count() == 10 and gone.count() == 5
    common.remove(spark, gone)
    there = [os.path.exists(p.removeprefix("file://").removeprefix("file:")) for p in paths]
    assert there == [True, False]
    common.remove(spark, paths[0])


def test_no_shared_folder_on_a_cluster():
    """Where executors are other processes a temporary folder of this machine is no place for tables."""

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "_bpe int, _BPE_ int")
    assert common.free(df, "_bpe") == "_bpe__" and common.free(df, "_lang") == "_lang"


def test_batches_are_only_lowered(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10")
        common.small_batches(spark.range(1))
        assert spark.conf.get(name) == "10"
        spark.conf.set(name, "50000")
        common.small_batches(spark.range(1))
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, before)
