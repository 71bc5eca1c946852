"""Character coordinates: article offset (acid), paragraph and offset (pid, pcid), chunk and offset (cid, ccid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _begins(parts: Column) -> Column:
    """Where each string of an array begins in their concatenation."""
    step = lambda a, x: F.struct(F.concat(a["out"], F.array(a["n"])).alias("out"), (a["n"] + F.char_length(x)).alias("n"))
    return F.aggregate(parts, F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("n")), step, lambda a: a["out"])


def char_table(df: DataFrame, key: str, parts: str, names: tuple[str, str, str] = ("acid", "pid", "pcid")) -> DataFrame:
    """A row for each character of an array of strings: key, offset in the whole, number of the part, offset in it."""
    a, p, c = names
    each = df.select(key, parts, _begins(F.col(parts)).alias("_b")).select(key, "_b", F.posexplode(parts).alias(p, "_t")).where(F.char_length("_t") > 0)
    return each.select(
        key, F.get("_b", F.col(p)).alias("_o"), p, F.explode(F.sequence(F.lit(0), F.char_length("_t") - 1)).alias(c)
    ).select(key, (F.col("_o") + F.col(c)).alias(a), p, c)


def paragraph_chunk_table(df: DataFrame, key: str, paragraphs: str, chunks: str) -> DataFrame:
    """A row for each character with its coordinates in both: key, ``acid``, ``pid``, ``pcid``, ``cid``, ``ccid``.

    Each paragraph meets the chunks that it overlaps within its row, so nothing
    is shuffled.  Characters that only one side has are left out.
    """
    d = df.select(key, paragraphs, _begins(F.col(paragraphs)).alias("_p"), chunks, _begins(F.col(chunks)).alias("_c"))
    each = d.select(key, "_p", chunks, "_c", F.posexplode(paragraphs).alias("pid", "_t")).where(F.char_length("_t") > 0)
    each = each.withColumn("_b", F.get("_p", F.col("pid"))).withColumn("_e", F.col("_b") + F.char_length("_t"))
    spans = F.transform(
        F.col(chunks), lambda x,
        i: F.struct(
            i.alias("cid"), F.greatest(F.get("_c", i), F.col("_b")).alias("from"),
            F.least(F.get("_c", i) + F.char_length(x), F.col("_e")).alias("to"), F.get("_c", i).alias("at")
        )
    )
    over = each.select(key, "pid", "_b", F.explode(F.filter(spans, lambda x: x["from"] < x["to"])).alias("o"))
    chars = over.select(key, "pid", "_b", "o.cid", "o.at", F.explode(F.sequence(F.col("o.from"), F.col("o.to") - 1)).alias("acid"))
    return chars.select(key, "acid", "pid", (F.col("acid") - F.col("_b")).alias("pcid"), "cid", (F.col("acid") - F.col("at")).alias("ccid"))


def locate(parts: Column, offset: Column) -> Column:
    """(part, offset in it) of an article offset, by arithmetic; null beyond the end."""
    sizes = F.transform(parts, lambda x: F.char_length(x))
    step = lambda a, n: F.when(a["done"] | (a["rest"] >= n), F.struct((a["rest"] - F.when(a["done"], 0).otherwise(n)).alias("rest"), (a["part"] + F.when(a["done"], 0).otherwise(1)).alias("part"), a["done"].alias("done"))).otherwise(
        F.struct(a["rest"].alias("rest"), a["part"].alias("part"), F.lit(True).alias("done"))
    )
    start = F.struct(offset.cast("int").alias("rest"), F.lit(0).alias("part"), F.lit(False).alias("done"))
    return F.aggregate(sizes, start, step, lambda a: F.when(a["done"], F.struct(a["part"].alias("part"), a["rest"].alias("at"))))


def article_offset(parts: Column, part: Column, at: Column) -> Column:
    """Article offset of a place in a part."""
    return F.aggregate(F.slice(F.transform(parts, lambda x: F.char_length(x)), 1, part), F.lit(0), lambda s, n: s + n) + at


def span_between(paragraphs: Column, chunks: Column, part: Column, start: Column, end: Column) -> Column:
    """A span [start, end) of a paragraph as places in chunks: of its first character, and behind its last."""
    a, b = article_offset(paragraphs, part, start), article_offset(paragraphs, part, end)
    last = locate(chunks, b - 1)
    return F.struct(locate(chunks, a).alias("first"), F.struct(last["part"].alias("part"), (last["at"] + 1).alias("at")).alias("end"))
