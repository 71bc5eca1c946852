"""Exact top-k search by term-at-a-time accumulation.

Vectors are sparse rows over their dimensions ("terms").  Candidates are packed
into blocks where they lie; a block's postings are, for each dimension, its rows
and their weights.  Each query row scatters weight * posting into a dense score
array, one term at a time, for a few queries at once so that the arrays stay in
the processor's cache; a partition selection keeps the best k of each block,
and a window merges the blocks.

Queries are packed into blocks of about ``query_block`` rows by the hash of
their ids.  Up to ``broadcast_bytes`` of packed queries (counted, not estimated)
are broadcast to the candidates' blocks.  Beyond, a grid of cells, query block by
slice of the candidates, is joined by its two numbers in a shuffle: a cell holds
one query block and streams its slice.  The driver sees only counts, and the
result does not depend on any block size or way.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part (``usable``); vectors of unequal length are padded with zeros;
rows without id take no part; rows with the query's own id are no candidates; a
repeated candidate row counts as often as it stands; query rows that share an
id compete for its k ranks; equal scores go by the smaller id; k larger than
the table returns all; other columns are not read; an empty table gives an
empty table.  Scores are 64-bit integers; larger sums wrap around.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

_PACKED = "ids binary, width int, weights binary"
_FOUND = "query_id long, vec_id long, score long"
_LEAST = np.iinfo(np.int64).min


def quantised(vec: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a 64-bit integer."""
    return F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vec: Column) -> Column:
    """Whether a vector is not null and all its components are finite."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def dense(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, short rows filled with zeros."""
    column = pa.array(column) if not isinstance(column, pa.Array) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), int(size.max()) if len(size) else 0), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def accumulate(q: np.ndarray, block: np.ndarray, tile: int = 32) -> np.ndarray:
    """Scores of all queries against a block: for each term, postings are scattered into the queries' score arrays."""
    terms = min(q.shape[1], block.shape[1])
    postings = []
    for term in range(terms):
        rows = np.flatnonzero(block[:, term])
        if len(rows):
            postings.append((term, rows if len(rows) < len(block) else None, np.ascontiguousarray(block[rows, term])))
    scores = np.zeros((len(q), len(block)), np.int64)
    part = np.empty((min(tile, len(q)), len(block)), np.int64)
    for i in range(0, len(q), tile):
        own = scores[i : i + tile]
        for term, rows, weights in postings:
            w = q[i : i + tile, term]
            users = np.flatnonzero(w)
            if len(users) == len(w) and rows is None:
                np.multiply(w[:, None], weights, out=part[: len(w)])
                own += part[: len(w)]
            elif len(users):
                at = slice(None) if rows is None else rows
                own[users[:, None], np.arange(len(block))[at]] += w[users, None] * weights
    return scores


def select_block(scores: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query row in a block as (query id, id, score): partition selection, ties at the threshold to the smaller id.  ids ascend; scores are overwritten."""
    low, high = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    own = np.zeros(scores.shape, bool)
    for i in np.flatnonzero(high > low):
        own[i, low[i] : high[i]] = True
    scores[own] = _LEAST
    n = scores.shape[1]
    near = scores >= np.partition(scores, n - k, axis=1)[:, n - k, None] if n > k else np.ones(scores.shape, bool)
    row, at = np.nonzero(near & ~own)
    value = scores[row, at]
    order = np.lexsort((at, ~value, row))  # ~value falls as value grows, without overflow
    row, at, value = row[order], at[order], value[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return q_ids[row[keep]], ids[at[keep]], value[keep]


def _packed(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(ids, kind="stable")
    return pa.RecordBatch.from_pydict(
        {
            "ids": pa.array([ids[order].tobytes()], pa.binary()), "width": pa.array([rows.shape[1]], pa.int32()),
            "weights": pa.array([rows[order].tobytes()], pa.binary())
        }
    )


def _pack(size: int):
    """A function over Arrow batches of (id, vector) that packs rows into blocks of at most ``size``."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                yield _packed(part.column(0).to_numpy(zero_copy_only=False), dense(part.column(1)))

    return run


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "q", query_block: int = 2048,
    block_rows: int = 1024, broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """The k candidates of the largest inner product for each query id: ``query_id``, ``rank``, ``vec_id``, ``score``; vec_col holds array<long>."""
    spark = candidates.sparkSession
    rows = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    n = rows(queries).count()
    blocks = max(1, -(-n // query_block))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-tasks // blocks))
    by_block = rows(queries).repartition(blocks, F.xxhash64("id")) if blocks > 1 else rows(queries).coalesce(1)
    q = cut(
        by_block.mapInArrow(_pack(query_block), _PACKED).select(
            F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("weights").alias("q_weights"),
            F.pmod(F.xxhash64("ids"), F.lit(blocks)).alias("block")
        )
    )
    c = rows(candidates).mapInArrow(_pack(block_rows), _PACKED)
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    size = q.agg(F.sum(F.octet_length("q_ids") + F.octet_length("q_weights"))).first()[0] or 0
    if size <= broadcast_bytes:
        cells = c.repartition(tasks).withColumn("block", each(blocks)).join(F.broadcast(q), "block")
    else:
        c = c.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)))
        cells = c.withColumn("block", each(blocks)).join(q.withColumn("slice", each(slices)).hint("shuffle_hash"), ["block", "slice"])

    def search(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                block, q = np.frombuffer(r["weights"], np.int64).reshape(len(ids), r["width"]), np.frombuffer(r["q_weights"], np.int64).reshape(len(q_ids), r["q_width"])
                found = select_block(accumulate(q, block), q_ids, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    found = cells.select("ids", "width", "weights", "q_ids", "q_width", "q_weights").mapInArrow(search, _FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The five best neighbours of every 50th vector, over the whole table."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("q"))
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
