"""Line dedup: hashes range-partitioned with documents as secondary order, decisions returned as bitmaps.

A line's key is the line stripped of ASCII white space at both ends, with A-Z
lower-cased.  Keys of at least ``min_chars`` code points that occur in at
least ``min_docs`` documents lose all their lines.

The rows (key hash, document, position) are range-partitioned by hash *and*
document, so a key that a third of all documents share is cut over many
partitions.  Each partition streams through its sorted rows and counts the
documents of every run of equal hashes.  Only the first and the last run of a
partition may go on elsewhere; their counts, two a partition, are summed and
joined back.

Defined cases: a null text is an empty one, which is one empty line; empty
keys never count; rows with equal id and text are one document (each still
gets its row in the result); null ids are ordinary values; long texts are taken
whole; other columns pass through ``drop_lines`` untouched, whatever their
names (the two result columns get ``_`` behind theirs where df has them); an
empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, ascii_lower, cut, free, remove, small_batches, text_key, whole_row

_DECISIONS = "_ld_id {id}, _ld_h long, _ld_pos int, _ld_n int, h1 long, h2 long, open boolean, docs long"


def line_rows(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each line that has a long enough key: its document, position, lines of the document and key hash."""
    key = lambda l: ascii_lower(F.btrim(l, F.lit(BLANKS)))
    lines = (
        df.select(F.col(id_col).alias("_ld_id"), text_key(F.col(text_col)).alias("_ld_h"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"))
        .select("_ld_id", "_ld_h", F.size("lines").alias("_ld_n"), F.posexplode(F.transform("lines", key)).alias("_ld_pos", "key"))
        .where(F.char_length("key") >= max(1, min_chars))
    )
    return lines.select("_ld_id", "_ld_h", "_ld_pos", "_ld_n", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def _stream(schema: pa.Schema, min_docs: int):
    """A function over sorted Arrow batches that emits the lines of frequent keys, and the open runs at both ends."""

    def count(frame: pd.DataFrame, first: bool, last: bool) -> pd.DataFrame | None:
        """frame: whole runs, but for what other partitions may hold of the first and the last."""
        if not len(frame):
            return None
        h1, h2 = frame.h1.to_numpy(), frame.h2.to_numpy()
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        run = np.cumsum(new) - 1
        ids = pd.factorize(frame._ld_id, use_na_sentinel=False)[0]
        docs = new.copy()
        docs[1:] |= (ids[1:] != ids[:-1]) | (frame._ld_h.to_numpy()[1:] != frame._ld_h.to_numpy()[:-1])
        n = np.bincount(run, docs).astype(np.int64)
        open_ = np.zeros(len(n), bool)
        open_[0] |= first
        open_[-1] |= last
        frame["open"] = open_[run]
        frame["docs"] = np.where(new, n[run], 0)
        return frame[open_[run] | (n[run] >= min_docs)]

    def out(frame: pd.DataFrame | None):
        if frame is not None and len(frame):
            yield pa.RecordBatch.from_pandas(frame, schema, preserve_index=False)

    def run(batches):
        held, first = None, True
        for b in batches:
            frame = b.to_pandas()
            if not len(frame):
                continue
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if len(held) < 200_000:
                continue
            a, z = held.h1.to_numpy(), held.h2.to_numpy()
            same = (a == a[-1]) & (z == z[-1])
            cut_at = int(np.argmax(same))  # where the last run begins
            if cut_at:
                yield from out(count(held.iloc[:cut_at].copy(), first, False))
                held, first = held.iloc[cut_at:].reset_index(drop=True), False
            elif first:  # one open run so far: its rows can go as they are, but the last document may go on
                d = (held._ld_h.to_numpy() != held._ld_h.to_numpy()[-1]) | (
                    pd.factorize(held._ld_id, use_na_sentinel=False)[0] != pd.factorize(held._ld_id, use_na_sentinel=False)[0][-1]
                )
                k = int(len(d) - np.argmax(d[::-1])) if d.any() else 0
                if k:
                    yield from out(count(held.iloc[:k].copy(), True, True))
                    held = held.iloc[k:].reset_index(drop=True)
        if held is not None:
            yield from out(count(held.copy(), first, True))

    return run


def line_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 10) -> DataFrame:
    """Keep bitmaps of the documents that lose lines.

    Returns ``_ld_id`` (the id), ``_ld_h`` (hash of the text), ``n_lines`` and
    ``keep`` (zlib-compressed bits, one a line, first line first; 1 is kept).
    """
    id_type = df.schema[id_col].dataType
    lines = cut(line_rows(df, id_col, text_col, min_chars))  # the range partitioning reads them twice, to sample and to send
    spread = lines.repartitionByRange("h1", "h2", "_ld_id", "_ld_h").sortWithinPartitions("h1", "h2", "_ld_id", "_ld_h", "_ld_pos")
    ddl = _DECISIONS.format(id=id_type.simpleString())
    from pyspark.sql.pandas.types import to_arrow_schema

    found = cut(spread.mapInArrow(_stream(to_arrow_schema(T._parse_datatype_string(ddl)), min_docs), ddl))
    remove(df.sparkSession, lines)
    cols = ["_ld_id", "_ld_h", "_ld_n", "_ld_pos"]
    # at most two keys for each partition of the range shuffle: a bound set by the job's settings, not by the data
    ends = found.where("open").groupBy("h1", "h2").agg(F.sum("docs").alias("all")).where(F.col("all") >= min_docs).select("h1", "h2")
    dropped = found.where("not open").select(cols).unionByName(found.where("open").join(F.broadcast(ends), ["h1", "h2"]).select(cols))

    @F.pandas_udf("binary")
    def bitmap(n: pd.Series, pos: pd.Series) -> pd.Series:
        def one(n, pos):
            keep = np.ones(n, np.uint8)
            keep[np.asarray(pos, np.int64)] = 0
            return zlib.compress(np.packbits(keep).tobytes(), 1)

        return pd.Series([one(*x) for x in zip(n, pos, strict=True)], dtype=object)

    out = dropped.groupBy("_ld_id", "_ld_h").agg(
        F.max("_ld_n").alias("n_lines"), F.collect_set("_ld_pos").alias("pos")
    ).select("_ld_id", "_ld_h", "n_lines", bitmap("n_lines", "pos").alias("keep"))
    return cut(out)  # bitmaps are small; whoever applies them needs no second Python worker beside


def kept_flags(keep: bytes, n: int) -> np.ndarray:
    """The bits of a keep bitmap as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n).astype(bool)


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 10) -> DataFrame:
    """df with the text stripped of repeated lines, and ``_ld_lines``, ``_ld_dropped``: lines before, lines dropped."""
    bits = line_bitmaps(df, id_col, text_col, min_chars, min_docs).select("_ld_id", "_ld_h", "keep")
    keyed = small_batches(df).select(whole_row(df), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("h"))
    joined = keyed.join(bits.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_ld_id")) & (F.col("h") == F.col("_ld_h")), "left")

    @F.pandas_udf("text string, n int, dropped int")
    def applied(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
        rows = []
        for t, k in zip(text, keep, strict=True):
            if k is None:
                rows.append((t, (t or "").count("\n") + 1, 0))
                continue
            lines = (t or "").split("\n")
            flags = kept_flags(k, len(lines))
            rows.append(("\n".join(x for x, f in zip(lines, flags, strict=True) if f), len(lines), int(len(lines) - flags.sum())))
        return pd.DataFrame(rows, columns=["text", "n", "dropped"])

    done = joined.select("row", applied(F.col(f"row.`{text_col}`"), F.col("keep")).alias("out"))
    own = [F.col("out.text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns]
    return done.select(*own, F.col("out.n").alias(free(df, "_ld_lines")), F.col("out.dropped").alias(free(df, "_ld_dropped")))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The digest of line dedup over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_lines(docs)
    return out.select(
        "doc_id", F.col("_ld_lines").cast("long").alias("n_lines"), F.col("_ld_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), bad AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad ON k.key = bad.key GROUP BY doc_id
"""
