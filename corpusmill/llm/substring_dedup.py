"""Substring dedup by super-k-mer partitioning.

Words are runs without ASCII white space.  A window is ``window`` consecutive
words.  Its minimiser is the leftmost of its m-grams with the smallest hash, so
equal windows have equal minimisers.  Consecutive windows that share a
minimiser place (a super-k-mer) travel as one packed string to the bucket of
the minimiser's hash; there, words become dense numbers and windows are ranked
exactly by sorting (prefix doubling), so counts are of word sequences, not of
hashes.  Windows that occur twice flag their words for removal.

Three things keep this small.  A minimiser that occurs once in the corpus has
only windows that occur once: super-k-mers are packed only where a bit map of a
fixed size says the minimiser may repeat (false hits cost time, not
correctness).  Equal packed strings are counted together before they reach a
bucket.  Minimisers of more than ``hot`` super-k-mers (a fixed number, so what a
bucket can hold is bounded) send windows one by one, each to the bucket of its
own hash, where equal ones have been counted together; which minimisers these
are says a second bit map (a false hit only sends windows singly).

Defined cases: null texts have no words; texts shorter than a window lose
nothing; long texts are taken whole; repeated rows repeat their windows and lose
them; null ids are ordinary values; of equal minimisers in a window the leftmost
counts; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANK_BYTE, by_bytes, cut, mix64, small_batches, span_hashes, text_key, word_spans

NOT_BLANK = ~BLANK_BYTE


def normal(texts: list) -> list[bytes]:
    """Texts as their words joined by one blank."""
    return [b" ".join((t or "").encode("utf-8", "replace").split()) for t in texts]


def super_kmers(texts: list[bytes], window: int, m: int):
    """Super-k-mers of normal texts: arrays of document, first window's word, number of windows and minimiser hash, and the words' starts, ends, first words, window hashes and data."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begin = np.r_[0, np.cumsum([len(t) + 1 for t in texts])[:-1]].astype(np.int64)
    s, e = word_spans(data, NOT_BLANK)
    h = span_hashes(data, s, e)
    doc = np.searchsorted(begin, s, "right") - 1
    first = np.searchsorted(s, begin)
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64), (s, e, first, np.zeros(0, np.uint64), data)
    with np.errstate(over="ignore"):
        grams = np.zeros(len(h) - m + 1, np.uint64)
        for j in range(m):
            grams += h[j : len(h) - m + 1 + j] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 2**64))
        grams = mix64(grams)
        # window hashes from prefix sums
        mult = 0xA3B195354A39B70D
        p = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(h), mult, np.uint64)])
        q = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(h), pow(mult, -1, 2**64), np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(h * p[:-1], dtype=np.uint64)]
        whole = mix64((sums[window:] - sums[:n]) * q[:n])
    # smallest hash, then leftmost place: 32 bits of each
    key = grams >> np.uint64(32) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
    w, span, low = window - m + 1, 1, key
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    place = (low[:n] & np.uint64((1 << 32) - 1)).astype(np.int64)
    ok = doc[:n] == doc[window - 1 :]
    start = ok.copy()
    start[1:] &= (place[1:] != place[:-1]) | ~ok[:-1] | (doc[1:n] != doc[: n - 1])
    at = np.flatnonzero(start)
    count = np.add.reduceat(ok.astype(np.int64), at) if len(at) else none
    return doc[at], at, count, grams[place[at]], (s, e, first, whole, data)


def minimiser_counts(docs: DataFrame, window: int, m: int) -> DataFrame:
    """How many super-k-mers each minimiser has: ``mini``, ``n``."""

    def count(batches):
        for b in batches:
            texts = normal(b.column(0).to_pylist())
            for i, j in by_bytes(texts):
                mini, n = np.unique(super_kmers(texts[i:j], window, m)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(mini.view(np.int64)), pa.array(n)], ["mini", "n"])

    return docs.select("text").mapInArrow(count, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n"))


def bits_above(counts: DataFrame, n: int, bits: int) -> np.ndarray:
    """A bit map of the minimisers that occur more than n times; its size is fixed, and it is filled in Spark."""
    at = F.pmod(F.col("mini"), F.lit(1 << bits))
    rows = counts.where(F.col("n") > n).select(
        F.shiftright(at, 6).cast("int").alias("slot"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("bit")
    ).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << bits - 6, np.int64)
    got = rows.toArrow()
    out[got["slot"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def count_windows(packed: list[str], times: np.ndarray, window: int) -> list[bytes | None]:
    """For each packed string a byte a window, 1 where the window occurs more than once among all strings, or None if none does."""
    words = [p.encode().split() for p in packed]
    n = np.array([len(w) for w in words], np.int64)
    flat = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    rank, span = flat, 1
    while span * 2 <= window:
        rank = pd.factorize(rank[:-span] * (len(flat) + 1) + rank[span:])[0].astype(np.int64)
        span *= 2
    if span < window:
        k = window - span
        rank = pd.factorize(rank[:-k] * (len(flat) + 1) + rank[k:])[0].astype(np.int64)
    valid = owner[: len(rank)] == owner[window - 1 :]
    rank, own = rank[valid], owner[: len(valid)][valid]
    seen = np.bincount(rank, times[own])
    twice = (seen[rank] > 1).astype(np.uint8)
    stop = np.cumsum(n - window + 1)
    return [bytes(f) if f.any() else None for f in np.split(twice, stop[:-1])]


def removed_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, m: int = 6, filter_bits: int = 26, hot: int = 4096,
    hot_bits: int = 24
) -> DataFrame:
    """For each document that loses words ``_sd_id``, ``_sd_h`` and ``spans``: (first word, number of windows, flags) of its super-k-mers with repeats."""
    spark = docs.sparkSession
    d = small_batches(docs).select(F.col(id_col).alias("_sd_id"), text_key(F.col(text_col)).alias("_sd_h"), F.col(text_col).alias("text"))
    counts = cut(minimiser_counts(d, window, m))
    bits = spark.sparkContext.broadcast(bits_above(counts, 1, filter_bits))
    hot_ones = spark.sparkContext.broadcast(bits_above(counts, hot, hot_bits))

    def there(table: np.ndarray, mini: np.ndarray) -> np.ndarray:
        at = mini & np.uint64(len(table) * 64 - 1)
        return (table[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    def pack(batches):
        for b in batches:
            texts = normal(b.column(2).to_pylist())
            for i, j in by_bytes(texts):
                doc, at, n, mini, (s, e, first, whole, data) = super_kmers(texts[i:j], window, m)
                keep = there(bits.value, mini)
                doc, at, n, mini = doc[keep], at[keep], n[keep], mini[keep]
                h = there(hot_ones.value, mini)
                mini = mini.view(np.int64)
                if h.any():  # windows of hot minimisers one by one
                    k = n[h]
                    each = np.repeat(at[h], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    doc, at, n, mini = np.r_[doc[~h], np.repeat(doc[h], k)], np.r_[at[~h], each], np.r_[n[~h], np.ones(len(each), np.int64)], np.r_[mini[~h], whole[each].view(np.int64)]
                raw, lo, hi = data.tobytes(), s[at].tolist(), e[at + n + window - 2].tolist()
                for x in range(0, len(doc), 20_000):
                    y = slice(x, x + 20_000)
                    own = pa.array(doc[y] + i)
                    packed = pa.array([raw[p:q] for p, q in zip(lo[y], hi[y], strict=True)], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(own), b.column(1).take(own), pa.array((at - first[doc])[y].astype(np.int32)),
                            pa.array(n[y].astype(np.int32)), pa.array(mini[y]), packed
                        ],
                        ["_sd_id", "_sd_h", "at", "n", "mini", "packed"]
                    )

    id_type = d.schema["_sd_id"].dataType.simpleString()
    sent = d.select("_sd_id", "_sd_h", "text").mapInArrow(pack, f"_sd_id {id_type}, _sd_h long, at int, n int, mini long, packed string")
    sent = cut(sent.withColumn("k1", F.xxhash64("packed")).withColumn("k2", F.xxhash64(F.lit(7), "packed")))
    distinct = sent.groupBy("mini", "packed").agg(F.count("*").alias("times"))

    def buckets(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size < 24 << 20:
                continue
            t = pa.Table.from_batches(held)
            mini = t["mini"].to_numpy()
            last = int(np.searchsorted(mini, mini[-1]))  # the last bucket may go on
            if last:
                yield from flags(t.slice(0, last))
                held = t.slice(last).to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield from flags(pa.Table.from_batches(held))

    def flags(t):
        found = count_windows(t["packed"].to_pylist(), t["times"].to_numpy().astype(float), window)
        ok = [i for i, f in enumerate(found) if f is not None]
        if ok:
            part = t.select(["mini", "packed"]).take(ok).append_column("flags", pa.array([found[i] for i in ok], pa.binary()))
            yield from part.to_batches(max_chunksize=5000)

    counted = distinct.repartition("mini").sortWithinPartitions("mini").mapInArrow(buckets, "mini long, packed string, flags binary")
    decided = counted.select("flags", F.xxhash64("packed").alias("k1"), F.xxhash64(F.lit(7), "packed").alias("k2"))
    hits = sent.select("_sd_id", "_sd_h", "at", "k1", "k2").join(decided, ["k1", "k2"])  # a packed string has one minimiser, so its 128 bits say it all
    return hits.groupBy("_sd_id", "_sd_h").agg(F.collect_set(F.struct("at", "flags")).alias("spans"))


def keep_mask(n_words: int, spans, window: int) -> np.ndarray:
    """Which of a document's words stay."""
    edge = np.zeros(n_words + 1, np.int64)
    for r in spans:
        at = r["at"] + np.flatnonzero(np.frombuffer(r["flags"], np.uint8))
        edge[at] += 1
        np.subtract.at(edge, at + window, 1)
    return np.cumsum(edge)[:-1] == 0


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, texts: bool = True, **options) -> DataFrame:
    """For each row its id, ``n_words``, ``n_removed`` and the kept words joined by one blank: ``kept``, or ``kept_sha256`` without ``texts``."""
    spans = removed_spans(docs, id_col, text_col, window, **options)
    d = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    joined = d.join(spans.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_sd_id")) & (F.col("h") == F.col("_sd_h")), "left")
    name = "kept" if texts else "kept_sha256"

    @F.pandas_udf(f"n_words long, n_removed long, {name} string")
    def apply(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(text, spans, strict=True):
            words = (t or "").encode("utf-8", "replace").split()
            kept = words
            if s is not None and len(s):
                kept = [w for w, k in zip(words, keep_mask(len(words), s, window).tolist(), strict=True) if k]
            out = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), out.decode() if texts else hashlib.sha256(out).hexdigest()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", name])

    return joined.select("id", apply("text", "spans").alias("r")).select(F.col("id").alias(id_col), "r.*")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The digest of substring dedup over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs, texts=False)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN twice USING (g)),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(gone.p) AS n_removed,
       sha256(coalesce(string_agg(word.word, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY d.doc_id
"""
