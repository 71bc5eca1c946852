"""Exact byte-pair encoding by dynamic programming over prefixes.

For a word, every prefix has exactly one token that can end its encoding.  The
candidates for a prefix are the vocabulary tokens that are suffixes of it; an
automaton over the vocabulary with suffix links delivers them longest first.
A candidate fits if it is the whole prefix, or if it and the last token of what
stands before it stay two tokens when encoded side by side, which the merge
table decides.  Back-pointers from the end of the word then give the ids.

All new words of a batch advance together, one prefix a step, in array
operations (very long words by themselves); encodings are kept in a bounded cache of each worker.

The file format is that of the ``tokenizers`` library with a word-level BPE:
NFC, lower case, a split into words, digits and runs of other characters, byte
characters, and an end-of-word suffix.  Strings of special tokens in a text are
those tokens.

Defined cases: a null text is an empty one, which has no tokens and decodes to
nothing; repeated rows each get their row; texts and words of any length are
encoded whole; other columns pass through (one named ``_bpe`` too: the result
is then in ``_bpe_``); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, free, small_batches

#: The words of lower-cased text; white space is what stands between them.
_WS = r"\t-\r \x85\xa0  -     　"
#: The same for text within Latin-1, which the standard library's engine splits faster.
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa00-9a-zªµºß-öø-ÿ²³¹¼-¾]+")
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WS}\p{{L}}\p{{N}}]+")
# The library knows letters and numbers up to Unicode 16, while other engines may know those that
# later versions added; here are the additions, which are neither letters nor numbers to it.
_LATER = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    r"\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    r"\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    r"\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    r"\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LATER = regex.compile(f"[{_LATER}]")
#: WORDS for texts with such characters.
PINNED_WORDS = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LATER}]]+|[\p{{N}}--[{_LATER}]]|[[^{_WS}\p{{L}}\p{{N}}]||[{_LATER}]]+")
#: Lower case letters of Unicode 16 and 17, which the library knows (fixed values), and the sigma, which it never takes for a final one.
LOWER = {ord("Σ"): "σ", 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Slots:
    """A map from int64 keys to int32 values by open addressing, looked up for whole arrays; -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        left_k, left_v = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        step, self.steps = 0, 0
        while len(left_k):
            at = (self._home(left_k) + step) & (len(self.keys) - 1)
            free = self.keys[at] == -1
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = left_k[put], left_v[put]
            left_k, left_v = left_k[~put], left_v[~put]
            step += 1
            self.steps = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        home = self._home(keys)
        at = home
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[at] != -1))
        for step in range(1, self.steps):
            if not len(open_):
                break
            at = (home[open_] + step) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (there != -1)]
        return out


class Encoder:
    """A vocabulary compiled for the dynamic programme. spec: the text of a ``tokenizers`` file."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        self.number = [str(i) for i in range(size)]
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + end] for c in chars], np.int64)
        # ranks stand in for ids, so that a pair's token always has a larger number than its parts
        base = [*self.inner, *self.final]
        self.id_of = np.array([*base, *[vocab[a + b] for a, b in merges]], np.int64)
        rank = {self.token[i]: r for r, i in enumerate(self.id_of)}
        self.left = np.r_[np.arange(512), [rank[a] for a, _ in merges]].astype(np.int64)
        self.right = np.r_[np.arange(512), [rank[b] for _, b in merges]].astype(np.int64)
        made = 512 + np.arange(len(merges), dtype=np.int64)
        keys = self.left[512:] << 20 | self.right[512:]
        keys, first = np.unique(keys, return_index=True)  # a pair listed twice merges at its first rank
        self.pairs = Slots(keys, made[first])
        self.merged: dict[int, int] | None = None  # the same as a dictionary, and answers of _fit, once a long word comes
        self.known: dict[int, bool] = {}
        self._automaton()

    def _automaton(self) -> None:
        spell: list[tuple[int, ...]] = [(i,) for i in range(512)]
        for a, b in zip(self.left[512:], self.right[512:], strict=True):
            spell.append(spell[a] + spell[b])
        self.length = np.array([len(s) for s in spell], np.int64)
        child: list[dict[int, int]] = [{}]
        token = [-1]
        depth_nodes: list[list[tuple[int, int, int]]] = []
        ends = {}
        for r, s in enumerate(spell):
            final = s[-1] >= 256
            if final:
                ends[s] = r
            at = 0
            for d, sym in enumerate(s[:-1] if final else s):  # a final token's stem is a path, too
                to = child[at].get(sym)
                if to is None:
                    to = child[at][sym] = len(child)
                    child.append({})
                    token.append(-1)
                    while len(depth_nodes) <= d:
                        depth_nodes.append([])
                    depth_nodes[d].append((at, sym, to))
                at = to
            if not final:
                token[at] = r
        n = len(child)
        # a node without children moves as its suffix does, and has no row of its own
        inner = np.array([bool(c) for c in child])
        self.row = np.where(inner, np.cumsum(inner) - 1, -1).astype(np.int32)
        self.go = np.zeros((int(inner.sum()), 256), np.int32)
        fail, self.longest = np.zeros(n, np.int32), np.array(token, np.int32)
        shorter = np.full(len(spell), -1, np.int32)
        path: list[tuple[int, ...]] = [()] * n
        for level in depth_nodes:
            at, sym, to = (np.array(x, np.int64) for x in zip(*level, strict=True))
            if at[0] == 0:
                self.go[0, sym] = to
            else:
                fail[to] = self.go[self.row[fail[at]], sym]
                self.go[self.row[at], sym] = to
            # a node's other moves are those of its suffix
            for p, s, t in level:
                path[t] = path[p] + (s,)
                if inner[t]:
                    self.go[self.row[t]] = self.go[self.row[fail[t]]]
                else:
                    self.row[t] = self.row[fail[t]]
                up = self.longest[fail[t]]
                if self.longest[t] >= 0:
                    shorter[self.longest[t]] = up
                else:
                    self.longest[t] = up
        # tokens at a word's end, by the state before their last symbol
        where = {p: i for i, p in enumerate(path)}
        keys, values = [], []
        for s, r in ends.items():
            keys.append(where[s[:-1]] << 9 | s[-1])
            values.append(r)
            for k in range(1, len(s)):
                if (up := ends.get(s[k:])) is not None:
                    shorter[r] = up
                    break
        self.ends, self.fail, self.shorter = Slots(np.array(keys), np.array(values)), fail, shorter

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b, side by side, stay these two tokens."""
        out = np.zeros(len(a), bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), 1 << 30, np.int64)
        while len(live):
            made = self.pairs.get(a << 20 | b)
            ok = ~((made >= 0) & (made < limit))
            live, a, b, limit = live[ok], a[ok], b[ok], limit[ok]
            if not len(live):
                break
            la, lb = self.left[b], self.right[a]
            open_a = a > b
            # the later-made token is opened first: what it was made from met before it stood
            nlimit = np.where(open_a, a, b + 1)
            na, nb = np.where(open_a, lb, a), np.where(open_a, b, la)
            stuck = np.where(open_a, na == a, nb == b)
            nlimit2 = np.where(open_a, b + 1, a)
            na2, nb2 = np.where(open_a, a, lb), np.where(open_a, la, b)
            done = stuck & np.where(open_a, nb2 == b, na2 == a)
            out[live[done]] = True
            a, b, limit = np.where(stuck, na2, na), np.where(stuck, nb2, nb), np.where(stuck, nlimit2, nlimit)
            live, a, b, limit = live[~done], a[~done], b[~done], limit[~done]
        return out

    def _fit(self, a: int, b: int) -> bool:
        """``_fits`` for one pair; answers are remembered, up to a bound."""
        key = a << 20 | b
        if (known := self.known.get(key)) is not None:
            return known
        merged, limit, out = self.merged, 1 << 30, None
        while out is None:
            if merged.get(a << 20 | b, limit) < limit:
                out = False
                break
            inner, first = (self.right_of[a], b, a), (a, self.left_of[b], b + 1)
            steps = (inner, first) if a > b else (first, inner)
            moved = next((s for s in steps if s[:2] != (a, b)), None)
            if moved is None:
                out = True
            else:
                a, b, limit = moved
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[key] = out
        return out

    def encode_long(self, word: bytes) -> list[int]:
        """Ids of one long word, for which a step at a time in plain numbers is faster than arrays of length one."""
        if self.merged is None:
            self.merged = {int(k): int(v) for k, v in zip(self.pairs.keys, self.pairs.values, strict=True) if k >= 0}
            self.left_of, self.right_of, self.size_of, self.shorter_of, self.longest_of = (x.tolist() for x in (self.left, self.right, self.length, self.shorter, self.longest))
        last, state = [-1] * len(word), 0
        for t, sym in enumerate(word[:-1]):
            state = int(self.go[self.row[state], sym])
            c = self.longest_of[state]
            while (before := t - self.size_of[c]) >= 0 and not self._fit(last[before], c):
                c = self.shorter_of[c]
            last[t] = c
        t, sym = len(word) - 1, 256 + word[-1]
        while (c := int(self.ends.get(np.array([state << 9 | sym]))[0])) < 0 < state:
            state = int(self.fail[state])
        c = sym if c < 0 else c
        while (before := t - self.size_of[c]) >= 0 and not self._fit(last[before], c):
            c = self.shorter_of[c]
        last[t], ids = c, []
        while t >= 0:
            ids.append(int(self.id_of[last[t]]))
            t -= self.size_of[last[t]]
        return ids[::-1]

    def encode_words(self, words: list[bytes], long: int = 512) -> list[list[int]]:
        """Ids of each word, given as UTF-8 bytes; those of more than ``long`` bytes go by themselves."""
        if any(len(w) > long for w in words):
            rest = iter(self.encode_words([w for w in words if len(w) <= long], long))
            return [self.encode_long(w) if len(w) > long else next(rest) for w in words]
        out: list[list[int]] = [[]] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-size, kind="stable")
        order = order[size[order] > 0]
        if not len(order):
            return out
        size = size[order]
        data = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        start = np.r_[0, np.cumsum(size)[:-1]]
        last = np.full(len(data), -1, np.int64)  # the token that ends each prefix
        state = np.zeros(len(order), np.int64)
        for t in range(int(size[0])):
            n = int(np.searchsorted(-size, -t, "left"))  # words longer than t
            sym = data[start[:n] + t].astype(np.int64)
            ending = size[:n] == t + 1
            moved = self.go[self.row[state[:n]], sym]
            cand = np.where(ending, -1, self.longest[moved]).astype(np.int64)
            at = np.flatnonzero(ending)
            s = state[at]
            while len(at):
                got = self.ends.get(s << 9 | (256 + sym[at]))
                cand[at[got >= 0]] = got[got >= 0]
                open_ = (got < 0) & (s > 0)
                if not open_.any():
                    rest = at[(got < 0) & (s == 0)]
                    cand[rest] = 256 + sym[rest]
                    break
                rest = at[(got < 0) & (s == 0)]
                cand[rest] = 256 + sym[rest]
                at, s = at[open_], self.fail[s[open_]].astype(np.int64)
            live = np.arange(n)
            while len(live):
                c = cand[live]
                before = t - self.length[c]
                good = before < 0
                inner = np.flatnonzero(~good)
                good[inner] = self._fits(last[start[live[inner]] + before[inner]], c[inner])
                last[start[live[good]] + t] = c[good]
                live = live[~good]
                cand[live] = self.shorter[cand[live]]
            state[:n] = moved
        # back-pointers, all words a token at a time
        at, live, step, found = start + size - 1, np.arange(len(order)), 0, []
        while len(live):
            tok = last[at]
            found.append((live, np.full(len(live), -step), self.id_of[tok]))
            at = at - self.length[tok]
            on = at >= start[live]
            live, at, step = live[on], at[on], step + 1
        word, place, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        ids = ids[np.lexsort((place, word))].tolist()
        stop = np.cumsum(np.bincount(word, minlength=len(order))).tolist()
        begin = 0
        for i, e in zip(order.tolist(), stop, strict=True):
            out[i] = ids[begin:e]
            begin = e
        return out


class Codec:
    """Encoder with a bounded cache of words; texts to id strings and back."""

    def __init__(self, spec: str, cache: int = 60_000):
        self.encoder = Encoder(spec)
        self.cache, self.ids, self.shown = cache, {}, {}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.encoder.special, key=len, reverse=True)) + ")") if self.encoder.special else None
        for s, i in self.encoder.special.items():
            self.ids[s], self.shown[s] = str(i), s

    def pieces(self, text: str) -> list[str]:
        """The words of a text; strings of special tokens stay as they are."""
        if self.split is not None and "<|" in text:
            parts = self.split.split(text)
        else:
            parts = [text]
        out: list[str] = []
        for k, p in enumerate(parts):
            if k % 2:
                out.append(p)
            elif p:
                try:
                    p.encode("latin-1")
                except UnicodeEncodeError:
                    p = unicodedata.normalize("NFC", p).translate(LOWER).lower()
                    out += (PINNED_WORDS if LATER.search(p) else WORDS).findall(p)
                else:  # such text is in form NFC
                    out += LATIN_WORDS.findall(p.lower())
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > self.cache:
            self.ids = {s: self.ids[s] for s in self.encoder.special}
            self.shown = {s: s for s in self.encoder.special}
            new = [w for w in words if w not in self.ids]
        number, token = self.encoder.number, self.encoder.token
        for w, ids in zip(new, self.encoder.encode_words([w.encode("utf-8", "replace") for w in new]), strict=True):
            self.ids[w] = " ".join([number[i] for i in ids])
            self.shown[w] = " ".join([token[i] for i in ids])

    def encode(self, texts: list[str | None]) -> tuple[list[str], list[str]]:
        """For each text its decimal ids joined by one space, and its decoded text: the tokens joined by one space."""
        ids: list[str] = [""] * len(texts)
        shown: list[str] = [""] * len(texts)
        texts = [t or "" for t in texts]
        for lo, hi in by_bytes(texts):
            split = [self.pieces(t) for t in texts[lo:hi]]
            self.learn(set().union(*split))
            for k, p in enumerate(split):
                ids[lo + k] = " ".join(map(self.ids.__getitem__, p))
                shown[lo + k] = " ".join(map(self.shown.__getitem__, p))
        return ids, shown


class Vocabulary:
    """The text of a vocabulary file, and its codec once one is asked for; only the text travels.

    In a worker it is the value of a broadcast, so the codec goes when no task needs it any more.
    """

    def __init__(self, spec: str):
        self.spec = spec
        self._codec: Codec | None = None

    def __getstate__(self):
        return {"spec": self.spec, "_codec": None}

    @property
    def codec(self) -> Codec:
        if self._codec is None:
            self._codec = Codec(self.spec)
        return self._codec

    @classmethod
    def read(cls, path: str | None = None) -> Vocabulary:
        with open(path or tokenizer_path()) as f:
            return cls(f.read())


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _coded(df: DataFrame, path: str | None, text_col: str, kind: str, row) -> DataFrame:
    """df with a struct column ``_bpe`` of what ``row`` makes of a text's ids and decoded text."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))  # one vocabulary file, of a fixed size
    names = [x.split(" ")[0] for x in kind.split(", ")]

    @F.pandas_udf(kind)
    def apply(text: pd.Series) -> pd.DataFrame:
        rows = [row(i, s) for i, s in zip(*shared.value.codec.encode(list(text)), strict=True)]
        return pd.DataFrame(rows, columns=names)

    return small_batches(df).withColumn(free(df, "_bpe"), apply(F.col(text_col)))


def _count(ids: str) -> int:
    return ids.count(" ") + 1 if ids else 0


def encode(df: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """df with a struct column ``_bpe``: n_tokens, ids (decimal, joined by one space), decoded."""
    return _coded(df, path, text_col, "n_tokens long, ids string, decoded string", lambda ids, shown: (_count(ids), ids, shown))


def digest(df: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """df with a struct column ``_bpe``: n_tokens and the SHA-256 of the ids and of the decoded text, in hexadecimal."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _coded(df, path, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, shown: (_count(ids), sha(ids), sha(shown)))


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of ids: their tokens joined by one space, as the library does without a decoder."""
    token = vocabulary.codec.encoder.token
    return " ".join([token[i] for i in ids])


def op10_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token counts and digests of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(docs, path).select("doc_id", "_bpe.n_tokens", "_bpe.ids_sha256", "_bpe.decoded_sha256")
