"""Benchmark decontamination by winnowing, in built-in functions only.

Words are lower-cased.  A benchmark window is ``window`` consecutive words of
an item (a shorter item is one window).  Both sides hash their k-grams of words
and keep, of every ``window - k + 1`` consecutive k-grams, the rightmost with
the smallest hash.  A shared window holds the same k-grams on both sides and so
the same choice: no shared window escapes.  A kept k-gram of a document that
the benchmark has kept too is extended: the windows around it, as strings, are
joined with the benchmark's windows, so hits are exact.

Before that join a bit map of the benchmark's fingerprints (at most ``2**23``
bits, whatever the size of the benchmark) passes only fingerprints that may be
there, so documents shuffle nothing but likely hits and one row each.  Items
shorter than ``window`` are compared as whole windows of their own lengths.
A benchmark beyond ``BROADCAST_WINDOWS`` windows, or item ids of windows, is
joined by a shuffle in which frequent windows are cut into parts.

Defined cases: null texts and texts without words have no windows and no hits;
rows with equal id and text give equal rows, as many as there were; null ids
are ordinary values; item ids may repeat or be null (null ids are not listed);
long texts are taken whole; equal hashes of k-grams leave the rightmost; other
columns are not read; an empty benchmark leaves every document clean and an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, salted_join, text_key, word_array

BITS, MOST_BITS = 1 << 20, 1 << 23
#: Windows of benchmark text, and ids with them, are broadcast up to this many; beyond, the join shuffles.
BROADCAST_WINDOWS = 200_000


def _with_grams(df: DataFrame, k: int) -> DataFrame:
    """df, which has words ``w``, with the hashes ``g`` of their k-grams, in order; hashed words are a column of their own, so each is hashed once."""
    n = F.size("h") - k + 1
    grams = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(F.col("h"), i + j) for j in range(k)]))
    return df.withColumn("h", F.transform("w", lambda w: F.xxhash64(w))).withColumn("g", F.when(n > 0, grams).otherwise(F.array().cast("array<long>"))).drop("h")


def _kept(grams: Column, w: int) -> Column:
    """Positions of the k-grams that winnowing keeps: those that are smaller than all to their right, and not larger than any to their left, within some run of w."""

    # A position is the rightmost minimum of some run of w that holds it iff the stretch around it in which it is
    # (not larger than what stands before, smaller than what stands behind) spans w k-grams.
    def reach(i: Column, ahead: bool) -> Column:
        x = F.get(grams, i)
        step = 1 if ahead else -1
        blocked = [F.coalesce(F.get(grams, i + step * j) <= x if ahead else F.get(grams, F.greatest(i - j, F.lit(-1) + 0 * i)) < x, F.lit(True)) for j in range(1, w)]
        out = F.lit(w - 1)
        for j in range(w - 2, -1, -1):
            out = F.when(blocked[j], F.lit(j)).otherwise(out)
        return out

    return F.filter(F.when(F.size(grams) > 0, F.sequence(F.lit(0), F.size(grams) - 1)).otherwise(F.array().cast("array<int>")), lambda i: reach(i, True) + reach(i, False) >= w - 1)


def bit_map(hashes: DataFrame, bits: int = BITS) -> list[int]:
    """A bit map of a column ``g`` of hashes, as ``bits / 64`` longs; summed up in Spark, so the driver gets these at most."""
    at = F.pmod(F.col("g"), F.lit(bits))
    rows = hashes.select(
        F.floor(at / 64).cast("int").alias("slot"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("bit")
    ).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    out = [0] * (bits // 64)
    for r in rows.collect():
        out[r["slot"]] = r["bits"]
    return out


def _maybe(table: Column, g: Column, bits: int = BITS) -> Column:
    at = F.pmod(g, F.lit(bits))
    return F.call_function("shiftright", F.get(table, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1


def windows_of(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: ``win`` (words joined by one space), ``len`` (its words) and ``items`` (sorted ids as strings)."""
    w = items.select(F.col(item_col).cast("string").alias("item"), word_array(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - size + 1)
    each = w.select("item", size.alias("len"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i, size), " "))).alias("win"))
    return each.groupBy("win", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _window_at(n: int):
    """A function that cuts the window of n words at a place (of one parameter: a second one would be given the index)."""
    return lambda s: F.struct(s.alias("at"), F.array_join(F.slice(F.col("w"), s + 1, n), " ").alias("win"), F.lit(n).alias("len"))


def find(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = 10, k: int = 5, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """For each document: its id, ``n_words``, ``n_hit``, ``items`` (ids with hits, sorted) and ``spans`` (merged hit spans, from word and up to word).

    One row for each row of docs.
    """
    wins = cut(windows_of(items, item_col, item_text, window))
    count, ids = wins.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    short = sorted(r["len"] for r in wins.where(F.col("len") < window).select("len").distinct().collect())  # lengths below the window: a handful
    run = window - k + 1
    bench = wins.where(F.col("len") == window).withColumn("w", F.split("win", " "))
    prints = _with_grams(bench, k).select(F.explode(F.transform(_kept(F.col("g"), run), lambda i: F.get(F.col("g"), i))).alias("g"))
    if short:
        prints = prints.unionByName(wins.where(F.col("len") < window).select(F.xxhash64("win").alias("g")))
    # a literal array of a bounded size; one bit in sixteen is set as long as that allows
    bits = BITS
    if count:
        n = prints.count()
        while bits < min(16 * n, MOST_BITS):
            bits *= 2
    table = F.array(*[F.lit(0)]) if not count else F.from_json(F.lit(str(bit_map(prints, bits))), "array<bigint>")

    d = docs.select(F.col(id_col).alias("_dc_id"), text_key(F.col(text_col)).alias("_dc_h"), word_array(F.col(text_col)).alias("w"))
    if count:
        d = _with_grams(d, k)
        hits = F.filter(_kept(F.col("g"), run), lambda i: _maybe(table, F.get(F.col("g"), i), bits))
        # the windows that hold the k-gram at i start at i - run + 1 up to i
        starts = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(F.greatest(i - run + 1, F.lit(0)), F.least(i, F.size("w") - window)))))
        starts = F.when(F.size("w") >= window, starts).otherwise(F.array().cast("array<int>"))
        found = F.transform(starts, _window_at(window))
        for n in short:
            places = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
            each = F.transform(places, _window_at(n))
            found = F.concat(found, F.filter(each, lambda x: _maybe(table, F.xxhash64(x["win"]), bits)))
    else:
        found = F.array().cast("array<struct<at:int,win:string,len:int>>")
    # one row a document whatever is found, so that it comes back without a second read
    whole = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("win"), F.lit(0).alias("len")))
    rows = d.select("_dc_id", "_dc_h", F.size("w").alias("n"), F.explode(F.concat(whole, found)).alias("f")).select("_dc_id", "_dc_h", "n", "f.*")
    side = wins.select("win", "len", "items")
    span = F.when(F.col("at") >= 0, F.struct(F.col("at"), (F.col("at") + F.col("len")).alias("to"))).alias("span")
    if max(count, ids) <= broadcast_windows:
        both = rows.join(F.broadcast(side), ["win", "len"], "left").where((F.col("at") < 0) | F.col("items").isNotNull())
    else:  # a shuffled join, in which the one row of each document takes no part
        rows = cut(rows)
        both = salted_join(rows.where("at >= 0"), side.drop("len"), "win").unionByName(rows.where("at < 0").withColumn("items", F.lit(None).cast("array<string>")))
    both = both.select("_dc_id", "_dc_h", "n", span, "items")
    per = both.groupBy("_dc_id", "_dc_h").agg(
        F.max("n").alias("n"), F.sum(F.when(F.col("span").isNull(), 1).otherwise(0)).alias("copies"), F.array_sort(F.collect_set("span")).alias("s"),
        F.collect_set("items").alias("i")
    )
    # the longest span of each start, so that those that can reach a word are among the last ``window``
    per = per.withColumn("s", F.filter("s", lambda x, i: F.coalesce(F.get(F.col("s"), i + 1)["at"] > x["at"], F.lit(True))))
    new = F.filter(
        F.transform("s", lambda x, i: F.struct(x["at"].alias("at"), x["to"].alias("to"), i.alias("i"))),
        lambda x: (x["i"] == 0) | (
            F.array_max(
                F.transform(F.slice(F.col("s"), F.greatest(x["i"] - window + 1, F.lit(1)), F.least(x["i"], F.lit(window))), lambda y: y["to"])
            ) < x["at"]
        ),
    )
    per = per.withColumn("b", new)
    spans = F.transform(
        "b", lambda x,
        j: F.struct(
            x["at"].alias("at"),
            F.array_max(
                F.transform(F.slice(F.col("s"), x["i"] + 1, F.coalesce(F.get(F.col("b"), j + 1)["i"], F.size("s")) - x["i"]), lambda y: y["to"])
            ).alias("to")
        )
    )
    out = per.withColumn("spans", spans).withColumn("items", F.array_sort(F.array_distinct(F.flatten("i"))))
    out = out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["at"]))
    again = F.when(F.col("copies") > 1, F.sequence(F.lit(1).cast("long"), F.col("copies"))).otherwise(F.array(F.lit(1).cast("long")))
    return out.select(
        F.col("_dc_id").alias(id_col), "_dc_h", F.col("n").cast("long").alias("n_words"), "n_hit", "items", "spans",
        F.explode(again).alias("_dc_copy")
    ).drop("_dc_copy")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = find(docs, items)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated")
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) l)
), hit AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""
