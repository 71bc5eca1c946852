"""Language identification by prediction by partial matching.

For each language a variable-order context tree over bytes is counted on a
bounded sample of labelled rows and frozen.  Its escape probabilities (method
C, with exclusion) give every (context, next byte) an exact code length.  The
tree is compiled into an automaton: a state is the longest known context, and
two tables hold the code length of each next byte and the state it leads to.
Texts are cut into segments that advance side by side, one byte a step, so the
whole of every text is coded at array speed.  The language with the shortest
code wins; the score is its posterior under equal priors.

Bytes are read through a folding map: A-Z as a-z, digits as one symbol, ASCII
white space as one, other ASCII as one; bytes from 128 on stand for themselves.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without any labelled row every text is ``und``; ties go to the first language
by name; texts of any length are coded whole; repeated rows each get their row;
other columns pass through (one named ``_lang`` too: the result is then in
``_lang_``); an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, free, give_back, small_batches

LETTER = regex.compile(r"\p{L}")  # not the numerals that other engines count as letters
SPACE, DIGIT, OTHER = 26, 27, 28
FOLD = np.full(256, OTHER, np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(26)
FOLD[[9, 10, 11, 12, 13, 32]] = SPACE
FOLD[48:58] = DIGIT
FOLD[128:] = 29 + np.arange(128)
SYMBOLS = 29 + 128


class ContextTree:
    """The frozen statistics of one language: flat tables ``cost`` (nats) and ``next`` (state offset), one row a state."""

    def __init__(self, texts: list[bytes], order: int = 4, max_states: int = 24_000):
        seq = FOLD[np.frombuffer(b" " * order + (b" " * order).join(texts), np.uint8)].astype(np.int64)
        used = np.unique(np.r_[seq, np.arange(29)])
        # symbols that never occur share the last number, which nothing has been counted for
        self.symbols = len(used) + 1
        self.code = np.full(SYMBOLS, len(used), np.uint8)
        self.code[used] = np.arange(len(used))
        a, s = self.symbols, self.code[seq].astype(np.int64)
        levels = []
        for d in range(order + 1):
            key = np.zeros(len(s) - order, np.int64)
            for j in range(d, -1, -1):
                key = key * a + s[order - j : len(s) - j]
            ctx_sym, n = np.unique(key, return_counts=True)
            ctx, at = np.unique(ctx_sym // a, return_inverse=True)
            levels.append((ctx, at, ctx_sym % a, n, np.bincount(at, n).astype(np.int64)))
        totals = np.sort(np.concatenate([x[4] for x in levels[1:]]))[::-1] if len(s) > order else np.zeros(0)
        least = max(2, int(totals[max_states]) + 1) if len(totals) > max_states else 2  # a suffix of a context occurs as often as it, so the kept ones hold all their suffixes
        base, kept, rows = [0], [np.zeros(1, np.int64)], 1
        for d in range(1, order + 1):
            ctx, _, _, _, total = levels[d]
            kept.append(ctx[total >= least])
            base.append(rows)
            rows += len(kept[d])
        self.states = rows
        counts = np.zeros((rows, a), np.float32)
        suffix = np.zeros(rows, np.int64)
        for d in range(order + 1):
            ctx, at, sym, n, _ = levels[d]
            pos = np.searchsorted(kept[d], ctx)
            ok = (pos < len(kept[d])) & (kept[d][np.minimum(pos, len(kept[d]) - 1)] == ctx) if len(kept[d]) else np.zeros(len(ctx), bool)
            use = ok[at]
            counts[base[d] + pos[at[use]], sym[use]] = n[use]
            if d:
                suffix[base[d] : base[d] + len(kept[d])] = base[d - 1] + np.searchsorted(kept[d - 1], kept[d] % a ** (d - 1))
        self.cost = np.zeros((rows, a + 1), np.float32)
        for i in range(0, rows, 4096):
            self.cost[i : i + 4096, :a] = self._code_lengths(counts, suffix, np.arange(i, min(rows, i + 4096)), order)
        self.next = np.zeros((rows, a + 1), np.int32)
        for d in range(order + 1):
            mine = np.arange(base[d], base[d] + len(kept[d]))
            to = self.next[suffix[mine]] if d else np.zeros((1, a + 1), np.int32)
            if d < order and len(kept[d + 1]):
                child = kept[d + 1]
                parent = np.searchsorted(kept[d], child // a)
                # a kept context's prefix is kept too: it occurs at least as often
                to[parent, child % a] = base[d + 1] + np.arange(len(child))
            self.next[mine] = to
        self.next[:, a] = 0
        self.next *= a + 1
        self.cost, self.next = self.cost.ravel(), self.next.ravel()

    @staticmethod
    def _code_lengths(counts, suffix, at, order) -> np.ndarray:
        p = np.zeros((len(at), counts.shape[1]))
        left, out = np.ones(len(at)), np.zeros(p.shape, bool)
        live = np.ones(len(at), bool)
        for _ in range(order + 1):
            n = np.where(out, 0, counts[at]) * live[:, None]
            total, distinct = n.sum(1), (n > 0).sum(1)
            whole = np.maximum(total + distinct, 1)
            p += (left / whole)[:, None] * n
            left = np.where(distinct > 0, left * distinct / whole, left)
            out |= n > 0
            live &= at > 0
            at = suffix[at]
        rest = ~out
        p += rest * (left / np.maximum(rest.sum(1), 1))[:, None]
        return -np.log(np.maximum(p, 1e-12)).astype(np.float32)

    def code_lengths(self, segments: np.ndarray, warm: int) -> np.ndarray:
        """Nats of each segment. segments: folded bytes, one segment a column, 255 behind its end; the first ``warm`` rows only set the state."""
        lut = np.full(256, self.symbols, np.uint8)
        lut[:SYMBOLS] = self.code
        state, total = np.zeros(segments.shape[1], np.int32), np.zeros(segments.shape[1], np.float64)
        run = np.zeros(segments.shape[1], np.float32)
        for t, row in enumerate(segments):
            at = state + lut[row]
            if t >= warm:
                run += self.cost[at]
                if t % 64 == 0:
                    total += run
                    run[:] = 0
            state = self.next[at]
        return total + run


def sample_labelled(df: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> list[tuple[str, str]]:
    """At most ``per_class`` (label, text) rows of each label, those of the smallest hashes of their ids.

    A count of each label first gives the share of hashes to look at, so only
    about as many texts as are asked for leave the scan.
    """
    from pyspark.sql import Window as W

    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 20))
    labelled = df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(
        F.col(label_col).alias("y"), F.col(text_col).alias("t"), h.alias("h"), F.xxhash64(text_col).alias("g")
    )
    sizes = {r["y"]: r["count"] for r in labelled.groupBy("y").count().collect()}
    if not sizes:
        return []
    part = F.lit(False)
    for y, n in sizes.items():
        part = part | ((F.col("y") == y) & (F.col("h") <= min(1.0, 1.3 * per_class / n + 20 / n) * (1 << 20)))
    order = F.row_number().over(W.partitionBy("y").orderBy("h", "g"))
    rows = labelled.where(part).withColumn("r", order).where(F.col("r") <= per_class).orderBy("y", "h", "g").select("y", "t").collect()
    return [(r["y"], r["t"]) for r in rows]


def train(rows: list[tuple[str, str]], order: int = 4, max_states: int = 24_000) -> dict[str, ContextTree]:
    """A context tree for each label."""
    by: dict[str, list[bytes]] = {}
    for y, t in rows:
        by.setdefault(y, []).append(t.encode("utf-8", "replace"))
    return {y: ContextTree(by[y], order, max_states) for y in sorted(by)}


def classify(texts: list[str | None], model: dict[str, ContextTree], order: int = 4, length: int = 512) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    names = list(model)
    pred, score = ["und"] * len(texts), [0.0] * len(texts)
    if not names:
        return pred, score
    live = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    data = [texts[i].encode("utf-8", "replace") for i in live]
    for lo, hi in by_bytes(data):
        pieces, owner = [], []
        for k, d in enumerate(data[lo:hi]):
            folded = np.r_[np.full(order, SPACE, np.uint8), FOLD[np.frombuffer(d, np.uint8)]]
            n = -(-len(d) // length)
            block = np.full(n * length + order, 255, np.uint8)
            block[: len(folded)] = folded
            pieces.append(np.lib.stride_tricks.sliding_window_view(block, length + order)[::length])
            owner.append(np.full(n, k))
        owner = np.concatenate(owner)
        segments = np.ascontiguousarray(np.concatenate(pieces).T)
        nats = np.stack([np.bincount(owner, m.code_lengths(segments, order), hi - lo) for m in model.values()])
        best = nats.argmin(0)
        post = 1 / np.exp(np.minimum(nats.min(0) - nats, 0)).sum(0)
        for k in range(hi - lo):
            pred[live[lo + k]], score[live[lo + k]] = names[best[k]], float(post[k])
    return pred, score


def identify(df: DataFrame, model: dict[str, ContextTree], text_col: str = "text", order: int = 4) -> DataFrame:
    """df with a struct column ``_lang`` of ``pred`` and ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is set by max_states and the number of labels

    @F.pandas_udf("pred string, score double")
    def apply(text: pd.Series) -> pd.DataFrame:
        p, s = classify(list(text), shared.value, order)
        return pd.DataFrame({"pred": p, "score": s})

    return small_batches(df).withColumn(free(df, "_lang"), apply(F.col(text_col)))


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; null ids do not."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_class: int = 1000) -> dict[str, ContextTree]:
    """Trees from at most ``per_class`` labelled rows of each language, outside the held-out fold."""
    learn = docs.where((F.crc32(F.col(id_col).cast("string")) % 5 != 0) & F.col(label_col).isNotNull())
    model = train(sample_labelled(learn, id_col, text_col, label_col, per_class))
    give_back()
    return model


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("_lang.pred").alias("lang_pred"), F.col("_lang.score").alias("score"))
