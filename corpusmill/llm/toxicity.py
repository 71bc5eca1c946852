"""Toxicity by a subsequence string kernel, Nystrom landmarks and a support vector machine.

Instances are tokens: runs between white space with all but letters taken out
("i.d-iot" is "idiot"), and runs of single letters joined ("i d i o t").  When
a text is scored, two or three neighbours in a sentence that no clean document
of the training sample knows are an instance, joined, too ("id iot").  The kernel counts common subsequences of three characters,
each weighted by ``DECAY`` to the power of the stretch it spans in either token
(``REACH`` characters at most), token ends included, so inserted characters and
gaps cost little.  It is scaled by token length.

A document is a bag of tokens.  Labels are the documents', so it is not known
which sentence earns one; a multiple-instance SVM (L2-regularised squared hinge, solved
by Newton steps in the space of the landmarks' Nystrom map) picks the witness
tokens of toxic documents and retrains.  Landmarks are the tokens whose
presence most raises the odds of the label, and the clean tokens most like
them.  As the kernel's features are explicit, the trained machine collapses to
one weight for every character triple, and a new token is scored in a few array
operations.  A document's score is a logistic curve of its best token.

Learning looks at no more than ``per_class`` documents of each label, by hash
of their ids; scoring reads whole texts and nothing else.

Defined cases: a null or empty text, or one without letters, has the score of a
document whose best token is as far from the margin as the clean median;
without labelled rows of both classes every score is 0; rows whose labels
contradict each other count as toxic; texts of any length are scored whole;
repeated rows each get their row; other columns pass through (one named ``_tox``
too: the result is then in ``_tox_``); an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, free, give_back, small_batches

REACH, DECAY, SYMBOLS = 6, 0.6, 64
PAIRS = [(a, b, DECAY ** (b + 1)) for b in range(2, REACH + 1) for a in range(1, b)]
LETTERS = re.compile(r"[^\W\d_]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")
SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][\W\d_]{1,3}){2,}[^\W\d_](?![^\W\d_])")


def tokens(text: str | None) -> set[str]:
    """The distinct tokens of a text."""
    if not text:
        return set()
    low = text.lower()
    out = set(low.split())
    mixed = [t for t in out if not t.isalpha()]
    out.difference_update(mixed)
    for t in mixed:
        out.add(NOT_LETTERS.sub("", t))
        out.update(LETTERS.findall(t))
    out.discard("")
    if any(len(t) == 1 for t in out):
        out.update(NOT_LETTERS.sub("", m) for m in SPELLED.findall(low))
    return out


ENDS = frozenset(".!?")


def split_words(text: str | None, common: frozenset[str], most: int = 3) -> set[str]:
    """Neighbouring words of a sentence that are not common ones, joined two and up to ``most`` at a time."""
    words = (text or "").lower().replace("\n", " . ").split()
    out: set[str] = set()
    run: list[str] = []
    last = -2

    def close():
        for n in range(2, min(most, len(run)) + 1):
            out.update("".join(run[k : k + n]) for k in range(len(run) - n + 1))
        run.clear()

    for i in [i for i, w in enumerate(words) if w not in common]:
        if i != last + 1:
            close()
        w = NOT_LETTERS.sub("", words[i])
        if len(w) > 1 and w not in common:
            run.append(w)
            last = i
            if not ENDS.isdisjoint(words[i]):
                close()
        else:
            close()
    close()
    return out


class Alphabet:
    """Characters as numbers below SYMBOLS: 1 and 2 are a token's ends, 3 any rare character, 0 none."""

    def __init__(self, words: list[str]):
        n: dict[str, int] = {}
        for w in words:
            for c in w:
                n[c] = n.get(c, 0) + 1
        best = sorted(n, key=lambda c: (-n[c], c))[: SYMBOLS - 4]
        self.number = {ord(c): 4 + i for i, c in enumerate(best)}

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words in one array, ends marked and REACH zeros behind each, with the beginning and length of each."""
        raw = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lut = np.full(max(int(raw.max()) + 1 if len(raw) else 1, 1), 3, np.uint8)
        for c, i in self.number.items():
            if c < len(lut):
                lut[c] = i
        size = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(size + 2 + REACH) - (size + 2 + REACH)
        out = np.zeros(int((size + 2 + REACH).sum()) + REACH, np.uint8)
        at = np.repeat(begin + 1 - (np.cumsum(size) - size), size) + np.arange(len(raw))
        out[at] = lut[raw]
        out[begin] = 1
        out[begin + size + 1] = 2
        return out, begin, size + 2


def _scale(size: np.ndarray) -> np.ndarray:
    """1 / the root of the squared weights of all triples in tokens of these lengths (ends included)."""
    most = int(size.max()) if len(size) else 0
    table = np.ones(most + 1)
    for n in range(3, most + 1):
        table[n] = 1 / math.sqrt(sum(w * w * (n - b) for _, b, w in PAIRS if n > b))
    return table[size]


def triples(seq: np.ndarray, begin: np.ndarray):
    """Codes and weights of the triples at every place, one pair of offsets at a time."""
    n = len(seq) - REACH
    s = seq.astype(np.int32)
    for a, b, w in PAIRS:
        yield (s[:n] * SYMBOLS + s[a : a + n]) * SYMBOLS + s[b : b + n], w


def weigh(words: list[str], alphabet: Alphabet, beta: np.ndarray) -> np.ndarray:
    """Kernel expansions: the sum of beta over the triples of each word, scaled."""
    out = np.zeros(len(words))
    for i in range(0, len(words), 20_000):  # so that what is held does not grow with the vocabulary
        seq, begin, size = alphabet.encode(words[i : i + 20_000])
        place = np.zeros(len(seq) - REACH, np.float32)
        for code, w in triples(seq, begin):
            place += np.float32(w) * beta[code]
        out[i : i + 20_000] = np.add.reduceat(place, begin) * _scale(size)
    return out


def features(word: str, alphabet: Alphabet) -> np.ndarray:
    """The explicit kernel features of one word."""
    out = np.zeros(SYMBOLS**3, np.float32)
    seq, begin, size = alphabet.encode([word])
    for code, w in triples(seq, begin):
        np.add.at(out, code, np.float32(w))
    s = np.arange(SYMBOLS**3)
    out[(s % SYMBOLS == 0) | (s // SYMBOLS % SYMBOLS == 0) | (s // SYMBOLS**2 == 0)] = 0
    return out * np.float32(_scale(size)[0])


class Table:
    """The features of some words, a column each, over the triples that any of them has."""

    def __init__(self, words: list[str], alphabet: Alphabet):
        found = []
        for w in words:
            f = features(w, alphabet)
            at = np.flatnonzero(f)
            found.append((at, f[at]))
        self.used = np.unique(np.concatenate([at for at, _ in found]))
        self.row = np.zeros(SYMBOLS**3, np.int32)
        self.row[self.used] = 1 + np.arange(len(self.used))
        self.small = np.zeros((1 + len(self.used), len(words)), np.float32)
        for k, (at, v) in enumerate(found):
            self.small[self.row[at], k] = v

    def spread(self, weights: np.ndarray) -> np.ndarray:
        """A weight for every triple: the features' sum by these weights of the words."""
        out = np.zeros(SYMBOLS**3, np.float32)
        out[self.used] = self.small[1:] @ weights.astype(np.float32)
        return out


def kernel(words: list[str], alphabet: Alphabet, table: Table) -> np.ndarray:
    """Kernel values of words against the words of a table."""
    small, row = table.small, table.row
    out = []
    for i in range(0, len(words), 1000):
        seq, begin, size = alphabet.encode(words[i : i + 1000])
        total = np.zeros((len(begin), small.shape[1]), np.float32)
        owner = np.searchsorted(begin, np.arange(len(seq) - REACH), "right") - 1
        for code, w in triples(seq, begin):
            r = row[code]
            at = np.flatnonzero(r)
            if len(at):
                o = owner[at]
                first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                total[o[first]] += np.float32(w) * np.add.reduceat(small[r[at]], first, axis=0)
        out.append(total * _scale(size)[:, None])
    return np.concatenate(out) if out else np.zeros((0, small.shape[1]))


def solve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """An L2-regularised squared-hinge machine by Newton steps on its active set; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    reg = np.eye(x.shape[1]) * ridge
    reg[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(30):
        a = x[active] * weight[active, None]
        w = np.linalg.solve(reg + x[active].T @ a, a.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


class Machine:
    """A trained scorer. rows: (label, text) pairs."""

    def __init__(self, rows: list[tuple[int, str]], landmarks: int = 240, rounds: int = 6, ridge: float = 0.02):
        self.known: dict[str, float] = {}  # margins of tokens seen lately
        self.trained = len({y for y, _ in rows}) == 2
        if not self.trained:
            return
        one: dict[str, str] = {}  # each token is held once
        bags = [(y, tuple(one.setdefault(t, t) for t in tokens(text))) for y, text in rows]
        del one
        n1 = sum(y == 1 for y, _ in bags)
        n0 = len(bags) - n1
        c1, c0 = Counter(t for y, b in bags if y == 1 for t in b), Counter(t for y, b in bags if y == 0 for t in b)
        self.common = frozenset(c0)
        self.alphabet = Alphabet(sorted(c1.keys() | c0.keys()))
        # evidence: how unlikely so many toxic documents with a token are, if labels were dealt by chance; it must outweigh the choice among all tokens
        least = math.log(len(c1)) + 3
        evidence = {}
        for t, n in c1.items():
            expected = (n + c0[t]) * n1 / (n1 + n0)
            if n / n1 > 3 * c0[t] / n0:
                evidence[t] = n * math.log(n / expected)
        lead = sorted((t for t in evidence if evidence[t] > least), key=lambda t: (-evidence[t], t))[: landmarks // 2]
        if not lead:
            self.trained = False
            return
        calm = sorted(t for t in c0 if evidence.get(t, 0) <= least)
        table = Table(lead, self.alphabet)
        # the first negatives: clean tokens most like the toxic landmarks, and every 200th of the rest (all that turn out to lie
        # within the margin join them below); the nearest of each become landmarks
        rank = np.argsort(-weigh(calm, self.alphabet, table.spread(np.ones(len(lead)))), kind="stable")
        near = sorted(rank[:8_000].tolist())
        close = kernel([calm[i] for i in near], self.alphabet, table)
        order = np.argsort(-close, axis=0, kind="stable")[:4].T
        chosen = list(dict.fromkeys(int(i) for k in range(order.shape[1]) for i in order[:, k]))[: landmarks - len(lead)]
        self.landmarks = lead + [calm[near[i]] for i in chosen]
        used = set(near) | set(rank[8_000::200].tolist())
        table = Table(self.landmarks, self.alphabet)
        gram = kernel(self.landmarks, self.alphabet, table).astype(float)
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
        # what may bear witness: tokens of toxic documents alone, seen too often for chance by half
        suspects = sorted({*lead, *(t for t in c1 if not c0[t] and evidence.get(t, 0) > least / 2)})
        against = lambda i: np.c_[kernel([calm[j] for j in i], self.alphabet, table) @ root, np.ones(len(i))]
        xn = against(sorted(used))
        xs = np.c_[kernel(suspects, self.alphabet, table) @ root, np.ones(len(suspects))]
        index = {t: i for i, t in enumerate(suspects)}
        toxic = [[index[t] for t in sorted(b) if t in index] for y, b in bags if y == 1]
        strength = np.array([evidence.get(t, 0.0) - least for t in suspects])
        for _ in range(rounds):
            # the witness of each toxic document that has one (labels may be wrong)
            found = [max(b, key=lambda i: strength[i]) for b in toxic if b]
            sure = sorted({i for i in found if strength[i] > 0} | {index[t] for t in lead})
            x = np.r_[xs[sure], xn]
            y = np.r_[np.ones(len(sure)), -np.ones(len(xn))]
            w = solve(x, y, np.r_[np.full(len(sure), 4.0), np.ones(len(xn))], ridge)
            strength = xs @ w
            self.beta, self.bias = table.spread(root @ w[:-1]), float(w[-1])
            # clean tokens within the margin join the negatives
            inside = [i for i in np.flatnonzero(self.margins(calm) > -1).tolist() if i not in used]
            if not inside:
                break
            used |= set(inside)
            xn = np.r_[xn, against(inside)]
        self.beta[np.abs(self.beta) < 1e-7] = 0
        words = sorted(c1.keys() | c0.keys())
        margin = dict(zip(words, self.margins(words).tolist(), strict=True))
        best = np.array([max(map(margin.__getitem__, b), default=-1.0) for _, b in bags])
        label = np.array([y for y, _ in bags], float)
        self.floor = float(np.median(best[label == 0]))
        self.slope, self.offset = self._logistic(best, label)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    @staticmethod
    def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Platt's curve of the margins, both classes weighted alike."""
        n1, n0 = y.sum(), (1 - y).sum()
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        weight = np.where(y > 0, 1 / n1, 1 / n0)
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([(weight * (p - target) * x).sum() + 1e-4 * a, (weight * (p - target)).sum()])
            d = weight * p * (1 - p) + 1e-9
            h = np.array([[(d * x * x).sum() + 1e-4, (d * x).sum()], [(d * x).sum(), d.sum()]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        return float(a), float(b)

    def margins(self, words: list[str]) -> np.ndarray:
        return weigh(words, self.alphabet, self.beta) + self.bias

    def curve(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def score(texts: list[str | None], machine: Machine, cache: int = 200_000) -> np.ndarray:
    """The scores of texts; margins of tokens are kept in a bounded cache of the machine's own."""
    if not machine.trained:
        return np.zeros(len(texts))
    known = machine.known
    texts = [t or "" for t in texts]
    out = np.empty(len(texts))
    for i, j in by_bytes(texts):
        bags = [tokens(t) | split_words(t, machine.common) for t in texts[i:j]]
        words = set().union(*bags)
        if len(known) + len(words) > cache:
            known.clear()
        new = [w for w in words if w not in known]
        known.update(zip(new, machine.margins(new).tolist(), strict=True))
        out[i:j] = [max(map(known.__getitem__, b)) if b else machine.floor for b in bags]
    return machine.curve(out)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000) -> Machine:
    """A machine from at most ``per_class`` documents of each label, outside the held-out fold."""
    mine = labels.where(
        (F.crc32(F.col(id_col).cast("string")) % 3 != 1) & F.col(label_col).isin(0, 1)
    ).select(F.col(id_col).alias("_tx_id"), F.col(label_col).cast("int").alias("_tx_y"))
    mine = mine.groupBy("_tx_id").agg(F.max("_tx_y").alias("_tx_y")).withColumn("_tx_h", F.xxhash64("_tx_id", F.lit(11)))
    # at most per_class ids of each label, which is what the broadcast is bounded by; texts are not shuffled
    ids = None
    for y in (0, 1):
        part = mine.where(F.col("_tx_y") == y).orderBy("_tx_h", "_tx_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_tx_d"), F.col(text_col).alias("_tx_t")).where(F.col("_tx_t") != "")
    rows = texts.join(F.broadcast(ids), F.col("_tx_d") == F.col("_tx_id")).groupBy("_tx_id", "_tx_y").agg(F.min("_tx_t").alias("_tx_t")).collect()
    machine = Machine([(r["_tx_y"], r["_tx_t"]) for r in sorted(rows, key=lambda r: (r["_tx_y"], str(r["_tx_id"])))])
    del rows
    give_back()
    return machine


def rate(df: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """df with a column ``_tox``: the score."""
    shared = df.sparkSession.sparkContext.broadcast(machine)  # SYMBOLS**3 weights, whatever the data

    @F.pandas_udf("double")
    def apply(text: pd.Series) -> pd.Series:
        return pd.Series(score(list(text), shared.value))

    return small_batches(df).withColumn(free(df, "_tox"), apply(F.col(text_col)))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = rate(docs, fit(docs, labels))
    return out.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), F.col("_tox").alias("score"),
        (F.col("_tox") >= 0.7).cast("int").alias("predicted")
    )
