"""The record pipeline: hooks, filters, limits, splits, caches, and application of several operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.encode import refuse_stream
from ..functions.perturb import uniform


def generate(
    df: DataFrame, parse: Callable[[DataFrame], DataFrame] | None = None, start_convert=None, start_filter=None, end_convert=None, end_filter=None,
    max_size: int | None = None
) -> DataFrame:
    """convert, filter, parse, drop empty records, convert, filter, then at most ``max_size`` rows; 0 and None mean all.

    A record is empty if each of its columns is null or an empty text, array or map.
    """
    for f in (start_convert,):
        df = f(df) if f else df
    df = df.where(start_filter) if start_filter is not None else df
    df = drop_empty(parse(df) if parse else df)
    df = end_convert(df) if end_convert else df
    df = df.where(end_filter) if end_filter is not None else df
    return df.limit(max_size) if max_size else df


def drop_empty(df: DataFrame) -> DataFrame:
    """The rows in which some column is neither null nor an empty text, array or map."""
    some = F.lit(False)
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        there = c.isNotNull()
        if kind == "string":
            there = there & (c != "")
        elif kind in ("array", "map"):
            there = there & (F.size(c) > 0)
        some = some | there
    return df.where(some)


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Splits as one table with a ``split`` column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("split", F.lit(n)) for n, d in parts.items()])


def save_cache(df: DataFrame, path: str) -> None:
    """Write a table as Parquet, partitioned by split if it has one."""
    w = df.write.mode("overwrite")
    (w.partitionBy("split") if "split" in df.columns else w).parquet(path)


def load_cache(spark, path: str) -> DataFrame:
    """Read what ``save_cache`` wrote."""
    return spark.read.parquet(path)


def split_sets(
    df: DataFrame, key: str, ratios: tuple[float, ...] = (0.8, 1.0), names: tuple[str, ...] = ("train", "test"), seed: int = 0,
    group: Callable[[Column], Column] | None = None, bits: int = 10
) -> DataFrame:
    """df with ``split``: groups of keys in hashed order, cut at cumulative shares.

    Sizes are floor(share * groups); with ``group`` (a function of the key, for
    instance its stem) rows of one group stay together.  A null key is a group,
    too.  The hashed order is counted in ``2**bits`` equal stretches of the hash,
    so that ranks need no ordered partition but that of one stretch.
    """
    refuse_stream(df, "split_sets")
    g = (group or (lambda c: c))(F.col(key))
    groups = df.select(g.alias("_g")).distinct()
    order = groups.withColumn("_h", F.xxhash64(F.lit(seed), F.col("_g").cast("string"))).withColumn("_s", F.shiftright("_h", 64 - bits) + (1 << bits - 1))
    sizes = {r["_s"]: r["count"] for r in order.groupBy("_s").count().collect()}  # 2**bits rows at most
    total, before = sum(sizes.values()), [0]
    for i in range((1 << bits) - 1):
        before.append(before[-1] + sizes.get(i, 0))
    offset = F.get(F.from_json(F.lit(str(before)), "array<bigint>"), F.col("_s").cast("int"))
    order = order.withColumn("_r", F.row_number().over(W.partitionBy("_s").orderBy("_h", "_g")) + offset)
    name = reduce(lambda c, x: c.when(F.col("_r") <= int(x[0] * total), x[1]), list(zip(ratios, names, strict=True))[1:], F.when(F.col("_r") <= int(ratios[0] * total), names[0]))
    named = order.select(F.col("_g").alias("_n"), name.alias("split"))
    return df.withColumn("_g", g).join(named, F.col("_g").eqNullSafe(F.col("_n"))).drop("_g", "_n")


def stem(c: Column, sep: str = "_") -> Column:
    """All but the last token of an id."""
    return F.when(c.contains(sep), F.regexp_replace(c, f"\\Q{sep}\\E[^{sep}]*$", "")).otherwise(c)


def apply_all(df: DataFrame, *ops: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Operators one after another."""
    return reduce(lambda d, f: d.transform(f), ops, df)


def random_apply(df: DataFrame, key: str, column: str, ops: list[tuple[Callable[[Column], Column], float]], seed: int = 0, record: str = "applied") -> DataFrame:
    """Each (operator, probability) applied to the column for its own share of rows; ``record`` lists what was."""
    hit = [uniform(seed + i, F.col(key)) < p for i, (_, p) in enumerate(ops)]
    c = F.col(column)
    for (f, _), h in zip(ops, hit, strict=True):
        c = F.when(h, f(c)).otherwise(c)
    return df.withColumn(record, F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(hit)]))).withColumn(column, c)


def random_choice(
    df: DataFrame, key: str, column: str, ops: list[Callable[[Column], Column]], n: int | None = None, weights: list[float] | None = None,
    seed: int = 0, record: str = "applied"
) -> DataFrame:
    """n of the operators without replacement, in random order, by weight; all of them shuffled by default."""
    w = weights or [1.0] * len(ops)
    # exponential keys give weighted sampling without replacement
    draw = F.array_sort(F.array(*[F.struct((-F.ln(1 - uniform(seed + i, F.col(key))) / w[i]).alias("k"), F.lit(i).alias("i")) for i in range(len(ops))]))
    df = df.withColumn(record, F.transform(F.slice(draw, 1, n or len(ops)), lambda x: x["i"]))
    for turn in range(n or len(ops)):
        c = F.col(column)
        chosen = F.get(F.col(record), F.lit(turn))
        df = df.withColumn(column, reduce(lambda e, x: e.when(chosen == x[0], x[1](c)), list(enumerate(ops))[1:], F.when(chosen == 0, ops[0](c))).otherwise(c))
    return df


def positional_join(a: DataFrame, b: DataFrame, on: str = "_line_no") -> DataFrame:
    """Rows of two files matched by line number."""
    return a.join(b, on)


def anti_report(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df without a partner: what an inner join drops."""
    return df.join(other, on, "left_anti")
