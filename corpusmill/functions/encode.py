"""Vocabularies, ids, alignment."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def refuse_stream(df: DataFrame, what: str) -> None:
    """Raise for operations that need an order or a whole batch."""
    if df.isStreaming:
        raise ValueError(f"{what} needs the whole input; it is not defined on a stream")


def word_counts(df: DataFrame, words: str) -> DataFrame:
    """Frequencies of the words of an array column: ``word``, ``n``."""
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def number_rows(df: DataFrame, order: list[Column], name: str = "id", start: int = 0) -> DataFrame:
    """df with dense numbers in an order that no two rows share.

    Ranges of the order are numbered side by side, each from the number of rows
    in the ranges before it; the driver gets one count a range.  The ranges are
    persisted, so that counting and numbering see the same ones; they stay so
    until the session ends or clears its cache.
    """
    refuse_stream(df, "number_rows")
    # a name of its own for each call, so that none is answered from what an earlier call persisted, perhaps of files changed since
    own = F.lit(uuid.uuid4().hex)
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).withColumn("_call", own).persist()
    sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    before = [0]
    for i in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(i, 0))
    offset = F.get(F.from_json(F.lit(str(before)), "array<bigint>"), F.col("_range"))
    n = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, (n - 1 + start + offset).cast("long")).drop("_range", "_call")


def word_ids(df: DataFrame, words: str, order_by: str, start: int = 0, keep=None) -> DataFrame:
    """Dense ids in the order of first sight: ``word``, ``id``. keep: a predicate on the word column.

    First places are aggregated before anything is ordered, and the vocabulary
    is numbered in parallel (``number_rows``).  ``order_by`` has to name a row;
    null comes first.  A row gives each of its words once, and the least of
    each is kept by numbers of fixed width: Spark sorts all words of the table
    to find the least of structs.
    """
    refuse_stream(df, "word_ids")
    seen = df.select(F.col(order_by).alias("at"), F.posexplode(F.array_distinct(words)).alias("pos", "word"))
    if keep is not None:
        seen = seen.where(keep(F.col("word")))
    least = seen.groupBy("word").agg(
        F.min("at").alias("at"), F.min_by("pos", "at").alias("pos"), F.min(F.when(F.col("at").isNull(), F.col("pos"))).alias("unplaced")
    )
    known = F.col("unplaced").isNull()
    first = least.select("word", F.when(known, F.col("at")).alias("at"), F.when(known, F.col("pos")).otherwise(F.col("unplaced")).alias("pos"))
    return number_rows(first, [F.col("at"), F.col("pos")], "id", start).select("word", "id")


def encode_words(words: Column, vocab: dict[str, int], unknown: str = "[UNK]") -> Column:
    """Ids of words by a small vocabulary, which becomes a literal map; large ones join (``encode_by_join``)."""
    table = F.create_map(*[x for k, v in vocab.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(words, lambda w: F.coalesce(table[w], F.lit(vocab[unknown])))


def decode_ids(ids: Column, vocab: dict[str, int]) -> Column:
    """Words of ids."""
    table = F.create_map(*[x for k, v in vocab.items() for x in (F.lit(v), F.lit(k))])
    return F.transform(ids, lambda i: table[i])


def encode_by_join(df: DataFrame, key: str, words: str, vocab: DataFrame, unknown_id: int) -> DataFrame:
    """``key`` and ``ids``, by an equi-join with a vocabulary table (word, id) of any size; rows without words get [].

    ``key`` has to name a row: the words of rows that share a key make one list.
    """
    each = df.select(key, F.posexplode(words).alias("pos", "word")).join(vocab.select("word", "id"), "word", "left")
    got = each.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(unknown_id)).alias("id")))).alias("p")
    ).select(key, F.transform("p", lambda x: x["id"]).alias("ids"))
    return df.select(key).join(got, key, "left").select(key, F.coalesce("ids", F.array().cast("array<long>")).alias("ids"))


def segment_numbers(words: Column, sep: str = "[SEP]", start: int = 0, most: int | None = None) -> Column:
    """For each word how many separators stand before it (the separator counts with what it ends), from ``start``, at most ``most``."""
    ends = F.filter(F.transform(words, lambda w, i: F.when(w == sep, i + 1)), lambda i: i.isNotNull())
    # the lengths of the runs of equal numbers, the last one without separator: linear in the words
    runs = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(ends, F.array(F.size(words))), lambda a, b: b - a)
    number = lambda j: F.least(j + start, F.lit(most)) if most is not None else j + start
    return F.flatten(F.transform(runs, lambda n, j: F.array_repeat(number(j), n)))


def one_hot(ids: Column, size: int) -> Column:
    """Rows of the identity matrix."""
    return F.transform(ids, lambda i: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: (i == j).cast("int")))


def one_hot_back(rows: Column) -> Column:
    """Ids of one-hot rows."""
    return F.transform(rows, lambda r: (F.array_position(r, F.array_max(r)) - 1).cast("int"))


def target_encode(df: DataFrame, category: str, target: str, smoothing: float = 0.0) -> DataFrame:
    """Mean target of each category, drawn to the overall mean by ``smoothing`` rows: ``category``, ``value``."""
    whole = df.agg(F.avg(target).alias("m"))
    return df.groupBy(category).agg(F.sum(target).alias("s"), F.count(target).alias("n")).join(F.broadcast(whole)).select(
        category, ((F.col("s") + F.col("m") * smoothing) / (F.col("n") + smoothing)).alias("value")
    )


def leave_one_out(df: DataFrame, category: str, target: str) -> DataFrame:
    """df with ``value``: the mean target of the other rows of its category; null where there are none."""
    sums = df.groupBy(category).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    return df.join(sums, category).withColumn("value", F.when(F.col("_n") > 1, (F.col("_s") - F.col(target)) / (F.col("_n") - 1))).drop("_s", "_n")


def weight_of_evidence(df: DataFrame, category: str, target: str, smoothing: float = 0.5) -> DataFrame:
    """ln of a category's share of ones over its share of zeros: ``category``, ``value``."""
    one, zero = F.sum(F.col(target)), F.sum(1 - F.col(target))
    whole = df.agg(one.alias("a"), zero.alias("b"))
    part = df.groupBy(category).agg(one.alias("p"), zero.alias("q"))
    return part.join(F.broadcast(whole)).select(
        category, F.ln(((F.col("p") + smoothing) / (F.col("a") + smoothing)) / ((F.col("q") + smoothing) / (F.col("b") + smoothing))).alias("value")
    )


def add_token(items: Column, before=None, after=None) -> Column:
    """An array with a first and a last item added."""
    parts = [F.array(F.lit(before))] if before is not None else []
    parts.append(items)
    return F.concat(*parts, *([F.array(F.lit(after))] if after is not None else []))


def add_end_mark(c: Column, strict: bool = False) -> Column:
    """A full stop behind a text that ends in no punctuation: the ideographic one behind an ideograph. '' stays, or is an error if ``strict``."""
    empty = F.raise_error(F.lit("an empty text has no end")).cast("string") if strict else c
    return F.when(c == "", empty).when(c.rlike(r"(?s).*[\p{P}]$"), c).when(c.rlike(r"(?s).*[一-鿿]$"), F.concat(c, F.lit("。"))).otherwise(F.concat(c, F.lit(".")))


def joint(rows: Column, sep, keep_end: bool = True) -> Column:
    """Arrays joined to one with a separator behind each, the last one only if ``keep_end``."""
    out = F.flatten(F.transform(rows, lambda r: F.concat(r, F.array(F.lit(sep)))))
    return out if keep_end else F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))


def truncate(items: Column, n) -> Column:
    """The first n items."""
    return F.slice(items, 1, n)


def pad(items: Column, n: Column | int, value=None) -> Column:
    """Filled up to n items; without a value nothing happens."""
    if value is None:
        return items
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(items, F.array_repeat(F.lit(value), F.greatest(n - F.size(items), F.lit(0)).cast("int")))


def align(
    df: DataFrame, column: str, mode: str = "auto", size: int = 512, batch: str | None = None, before=None, after=None, padding=None,
    out: str | None = None, keep_end: bool = False
) -> DataFrame:
    """df with the array column (or ``out``) given its end tokens, truncated to ``size`` and padded.

    Modes: ``none`` pads nothing; ``max`` pads to ``size``; ``auto`` pads to the
    longest row of the same ``batch`` value, at most ``size``.  Truncation can
    take the last token away; ``keep_end`` truncates before adding it.
    """
    n_ends = (before is not None) + (after is not None)
    items = add_token(truncate(F.col(column), max(0, size - n_ends)), before, after) if keep_end else truncate(add_token(F.col(column), before, after), size)
    out = out or column
    done = df.withColumn(out, items)
    if mode == "none" or padding is None:
        return done
    if mode == "max":
        return done.withColumn(out, pad(F.col(out), size, padding))
    refuse_stream(df, "align(mode='auto')")
    widest = done.groupBy(batch).agg(F.max(F.size(out)).alias("_widest")) if batch else done.agg(F.max(F.size(out)).alias("_widest"))
    joined = done.join(widest, batch) if batch else done.join(F.broadcast(widest))
    return joined.withColumn(out, pad(F.col(out), F.col("_widest"), padding)).drop("_widest")


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: itself where it is printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class BytePairs:
    """Byte-pair encoding of single words by merge ranks, with a bounded memory of words."""

    def __init__(self, vocab: dict[str, int], ranks: dict[tuple[str, str], int], end: str = "", memory: int = 100_000):
        self.vocab, self.ranks, self.end, self.memory, self.known = vocab, ranks, end, memory, {}
        self.bytes = byte_alphabet()
        self.back = {c: b for b, c in self.bytes.items()}
        self.words = {i: w for w, i in vocab.items()}

    def pieces(self, word: str) -> list[str]:
        if word in self.known:
            return self.known[word]
        parts = [self.bytes[b] for b in word.encode()]
        if parts and self.end:
            parts[-1] += self.end
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.ranks.get(p, float("inf")))
            if best not in self.ranks:
                break
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        if len(self.known) >= self.memory:
            self.known.clear()
        self.known[word] = parts
        return parts

    def encode(self, words: list[str], unknown: int = 0) -> list[int]:
        return [self.vocab.get(p, unknown) for w in words for p in self.pieces(w)]

    def decode(self, ids: list[int]) -> str:
        text = "".join(self.words.get(i, "") for i in ids)
        if self.end:
            text = text.replace(self.end, " ")
        return bytes(b for c in text for b in ([self.back[c]] if c in self.back else c.encode())).decode(errors="replace")


def byte_pair_ids(words: Column, vocab: dict[str, int], ranks: dict[tuple[str, str], int], end: str = "", unknown: int = 0) -> Column:
    """Ids of an array of words."""
    state: list[BytePairs] = []

    @F.pandas_udf("array<int>")
    def apply(s: pd.Series) -> pd.Series:
        if not state:
            state.append(BytePairs(vocab, ranks, end))
        return s.map(lambda w: None if w is None else state[0].encode(list(w), unknown), na_action="ignore")

    return apply(words)


def byte_pair_text(ids: Column, vocab: dict[str, int], end: str = "") -> Column:
    """Texts of arrays of ids; bytes that are no UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        coder = BytePairs(vocab, {}, end)
        return s.map(lambda i: coder.decode(list(i)), na_action="ignore")

    return apply(ids)
