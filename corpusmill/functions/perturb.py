"""Seeded random edits of token arrays.

Every choice is a hash of (seed, row key, place), so results do not depend on
partitioning or retries.  Each function gives a struct of ``tokens`` and
``tags``; tags hold ``skip`` where nothing happened.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import STRINGS, by_row

SKIP = -100


class _Dice:
    def __init__(self, seed: int, key):
        self.base = f"{seed}:{key}:"

    def uniform(self, place: int, what: str = "") -> float:
        return int.from_bytes(hashlib.blake2b(f"{self.base}{place}:{what}".encode(), digest_size=7).digest(), "big") / 2**56

    def pick(self, items: list, place: int, what: str):
        return items[int(self.uniform(place, what) * len(items))]


def _edit(mode: str, tokens: list[str], key, vocab: dict[str, int], pool: list[str], seed: int, prob: float, n: int, mask: str, keep_len: bool, strict: bool):
    dice, unk = _Dice(seed, key), vocab.get("[UNK]", SKIP)
    out, tags, done_to = [], [], -1
    hits = [dice.uniform(i) < prob for i in range(len(tokens))]
    allowed = set(pool)
    i = 0
    while i < len(tokens):
        t = tokens[i]
        act = mode
        if mode == "jitter" and hits[i]:
            act = dice.pick(["replace", "append", "delete"], i, "op")
        ok = hits[i] and i > done_to and t in allowed
        if not ok:
            out.append(t)
            tags.append(SKIP)
            i += 1
            continue
        label = vocab.get(t, unk)
        if act == "mask":
            u = dice.uniform(i, "how")
            out.append(mask if u < 0.8 else dice.pick(pool, i, "word") if u < 0.9 else t)
            tags.append(label)
            i += 1
        elif act == "replace":
            span = tokens[i : i + n]
            if len(span) < n or not all(x in allowed for x in span):
                out.append(t)
                tags.append(SKIP)
                i += 1
                continue
            for k, x in enumerate(span):
                out.append(dice.pick(pool, i + k, "word"))
                tags.append(vocab.get(x, unk))
            i += n
            done_to = i - 1
        elif act == "append":
            new = [dice.pick(pool, i, f"word{k}") for k in range(n)]
            out.append(t)
            if keep_len:  # the text stays, the tag says what would have come
                tags.append(vocab.get(new[0], unk))
            else:
                tags.append(SKIP)
                out += new
                tags += [vocab.get(x, unk) for x in new]
            i += 1
        else:  # delete: the tokens behind this one go, or are marked
            span = tokens[i + 1 : i + 1 + n]
            if len(span) < n:
                out.append(t)
                tags.append(SKIP)
                i += 1
                continue
            out.append(t)
            if keep_len:
                tags.append(SKIP)
                out += ["[DEL]"] * n
                tags += [vocab.get(x, unk) for x in span]
            else:
                tags.append(vocab.get(span[0], unk))
            i += 1 + n
            done_to = i - 1
    return out, tags


def _perturb(mode: str, tokens: Column, key: Column, vocab: dict[str, int], seed: int, prob: float, n: int, include, exclude, mask: str, keep_len: bool) -> Column:
    pool = sorted((set(include) if include else set(vocab)) - set(exclude) - {t for t in vocab if t.startswith("[") and t.endswith("]")})

    @by_row(T.StructType([T.StructField("tokens", STRINGS), T.StructField("tags", T.ArrayType(T.IntegerType()))]))
    def apply(t, k):
        return (None, None) if t is None else _edit(mode, t, k, vocab, pool, seed, prob, n, mask, keep_len, True)

    return apply(tokens, key)


def random_mask(tokens, key, vocab, seed=0, prob=0.15, include=None, exclude=(), mask="[MASK]") -> Column:
    """Of the tokens hit, 80 % become the mask, 10 % another word, 10 % stay; their ids are the tags."""
    return _perturb("mask", tokens, key, vocab, seed, prob, 1, include, exclude, mask, False)


def random_replace(tokens, key, vocab, seed=0, prob=0.15, n=1, include=None, exclude=()) -> Column:
    """n consecutive eligible tokens become others."""
    return _perturb("replace", tokens, key, vocab, seed, prob, n, include, exclude, "", False)


def random_append(tokens, key, vocab, seed=0, prob=0.15, n=1, include=None, exclude=(), keep_len=False) -> Column:
    """n words come in behind a token; with ``keep_len`` only the tag tells."""
    return _perturb("append", tokens, key, vocab, seed, prob, n, include, exclude, "", keep_len)


def random_delete(tokens, key, vocab, seed=0, prob=0.15, n=1, include=None, exclude=(), keep_len=False) -> Column:
    """The n tokens behind a token go, or with ``keep_len`` become [DEL]."""
    return _perturb("delete", tokens, key, vocab, seed, prob, n, include, exclude, "", keep_len)


def token_jitter(tokens, key, vocab, seed=0, prob=0.15, include=None, exclude=()) -> Column:
    """Each hit replaced, followed by a new word, or its neighbour deleted, with equal chances."""
    return _perturb("jitter", tokens, key, vocab, seed, prob, 1, include, exclude, "", False)


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from a hash of seed and key, in the JVM."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / float(1 << 53)
