"""The corpus pipeline: stages over the documents table, each of which applies one operator of corpusmill.llm.

Every stage works on all rows that the one before kept.  All but the last
return the columns of ``documents``.

Defined cases, for every stage: a null text counts as an empty one, which has no
language (``und``), so the first stage drops it; a text that loses all its lines
stays as an empty one; texts of any length are taken whole; null ids are
ordinary values; rows equal in id and text are one document to line dedup, and
near-dedup keeps one of them; near copies that tie go by the smallest id, then
by the text's hash; other columns, whatever their names, pass through all stages
but the last, which has columns of its own; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.llm import bpe, decontaminate, langid, line_dedup, near_dedup
from corpusmill.llm.common import cut, cuts_of, free, remove, text_key, whole_row

#: No SQL can express the learned and sampled stages; tests compare them with brute force.
ORACLE_SQL = None


def language_id_stage(spark, docs, sf_dir):
    """Keep the documents in which a language is recognised: all but ``und``."""
    name = free(docs, "_lang")
    return langid.identify(docs, langid.fit(docs)).where(F.col(f"{name}.pred") != "und").select(docs.columns)


def line_dedup_stage(spark, docs, sf_dir):
    """Take out the lines that ten documents or more share; every document stays, with its new length."""
    return line_dedup.drop_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_dedup_stage(spark, docs, sf_dir):
    """Keep one document of each near-duplicate class."""
    return near_dedup.representatives(docs)


def decontaminate_stage(spark, docs, sf_dir):
    """Drop the documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.find(docs.select("doc_id", "text"), items).where("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("_dc_h").alias("bad_key")).distinct()
    own = docs.select(whole_row(docs), F.col("doc_id").alias("id"), text_key(F.col("text")).alias("key"))
    return own.join(found, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key")), "left_anti").select("row.*")


def bpe_stage(spark, docs, sf_dir):
    """Token ids of each document, and the text they decode to."""
    d = docs.select("doc_id", "lang", "source", "text")
    ids = F.when(F.col("_bpe.ids") == "", F.array().cast("array<int>")).otherwise(F.transform(F.split("_bpe.ids", " "), lambda x: x.cast("int")))
    return bpe.encode(d).select("doc_id", "lang", "source", "_bpe.n_tokens", ids.alias("ids"), F.col("_bpe.decoded").alias("decoded"))


STAGES = [
    ("language_id", language_id_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("bpe", bpe_stage),
]


def run(spark, sf_dir):
    """All stages over the documents of sf_dir, each written to the shared folder and read by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        with cuts_of() as paths:
            done = stage(spark, docs, sf_dir)
            docs = cut(done) if i + 1 < len(STAGES) else done
        if i + 1 < len(STAGES):  # what the stage wrote for itself, and what it read, is read no more
            remove(spark, *paths[:-1], *([before] if before is not None else []))
            before = docs
    return docs
