"""Splitting and joining: article, paragraphs, segments."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import SPACE
from .rows import STRINGS, by_row

PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"


def to_article(paragraphs: Column, sep: str = "\n") -> Column:
    """Paragraphs joined."""
    return F.array_join(paragraphs, sep)


def to_paragraphs(article: Column, sep: str = "\n", keep_sep: bool = False) -> Column:
    """An article's paragraphs; ``keep_sep`` puts the separator behind each, the last one too."""
    parts = F.split(article, re.escape(sep), -1)
    return F.transform(parts, lambda p: F.concat(p, F.lit(sep))) if keep_sep else parts


def join_words(segment: Column, sep: str = "") -> Column:
    """A segment's words joined."""
    return F.array_join(segment, sep)


def join_mixed(segment: Column) -> Column:
    """Words joined by one blank, but for neighbours that are both non-ASCII, which are glued."""
    plain = lambda w: w.rlike(r"^[\x00-\x7F]*$")
    step = lambda a, w: F.struct(
        F.concat(
            a["text"], F.when(a["first"] | (~plain(w) & ~a["ascii"]), w).otherwise(F.concat(F.lit(" "), w))
        ).alias("text"), plain(w).alias("ascii"), F.lit(False).alias("first")
    )
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("ascii"), F.lit(True).alias("first"))
    return F.aggregate(segment, start, step, lambda a: a["text"])


def shallow_split(c: Column, sep: str | None = None, pattern: str | None = None) -> Column:
    """By a pattern's matches, or by a separator ('' gives characters), or by Unicode white space without empty parts."""
    if pattern is not None:
        return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    if sep == "":
        return F.when(F.char_length(c) > 0, F.split(c, "", -1)).when(c.isNotNull(), F.array().cast("array<string>"))
    if sep is not None:
        return F.split(c, re.escape(sep), -1)
    return F.filter(F.split(c, SPACE + "+", -1), lambda x: x != "")


def split_punctuation(word: Column) -> Column:
    """A word cut so that each punctuation character stands alone."""
    return F.regexp_extract_all(word, F.lit(f"[{PUNCTUATION}]|[^{PUNCTUATION}]+"), F.lit(0))


def deep_split(segment: Column, *steps: Callable[[Column], Column]) -> Column:
    """Each step (word -> array) applied to every word, results flattened, in order."""
    for f in steps:
        segment = F.flatten(F.transform(segment, f))
    return segment


def to_segment(
    c: Column, sep: str | None = None, pattern: str | None = None, special: tuple[str, ...] = (), punctuation: bool = True,
    cleaner: Callable[[Column], Column] | None = None, steps: tuple = ()
) -> Column:
    """The words of a text: special tokens stay whole, the rest is cleaned, split, and cut at punctuation.

    A text that starts with a special token yields no empty first word here.
    """
    clean = cleaner or (lambda x: x)

    def plain(x: Column) -> Column:
        words = shallow_split(clean(x), sep, pattern)
        return deep_split(words, *([split_punctuation] if punctuation else []), *steps)

    if not special:
        return plain(c)
    names = "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))
    parts = F.regexp_extract_all(c, F.lit(f"(?s){names}|(?:(?!{names}).)+"), F.lit(0))
    return F.flatten(F.transform(parts, lambda p: F.when(F.array_contains(F.array(*map(F.lit, special)), p), F.array(p)).otherwise(plain(p))))


def pieces_of(word: str, vocab: set[str] | dict, mark: str = "##") -> list[str]:
    """Greedy longest-match pieces of a word; the whole word if it cannot be covered."""
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = (mark if at else "") + word[at:end]
            if piece in vocab:
                out.append(piece)
                at = end
                break
        else:
            return [word]
    return out


def word_pieces(segment: Column, vocab, mark: str = "##", memory: int = 50_000) -> Column:
    """Word pieces of all words of an array; words seen are remembered, up to ``memory`` of them."""
    known = frozenset(vocab)
    memo: dict[str, list[str]] = {}

    @by_row(STRINGS)
    def apply(words):
        if words is None:
            return None
        out = []
        for w in words:
            if w not in memo:
                if len(memo) >= memory:
                    memo.clear()
                memo[w] = pieces_of(w, known, mark)
            out += memo[w]
        return out

    return apply(segment)


_SPANNED = "array<struct<word:string,start:double,end:double>>"


def merge_continued(spanned: Column, mark: str = "@@") -> Column:
    """Pieces ending in the mark glued to what follows; a word spans its first piece's start to its last one's end. Takes and gives array<struct<word,start,end>>."""
    step = lambda a, x: F.struct(
        F.when(
            a["open"],
            F.concat(
                F.slice(a["out"], 1, F.size(a["out"]) - 1),
                F.array(
                    F.struct(
                        F.concat(F.element_at(a["out"], -1)["word"], F.regexp_replace(x["word"], re.escape(mark) + "$", "")).alias("word"),
                        F.element_at(a["out"], -1)["start"].alias("start"), x["end"].alias("end")
                    )
                )
            ),
        )
        .otherwise(F.concat(a["out"], F.array(F.struct(F.regexp_replace(x["word"], re.escape(mark) + "$", "").alias("word"), x["start"].alias("start"), x["end"].alias("end")))))
        .alias("out"),
        x["word"].endswith(mark).alias("open"),
    )
    start = F.struct(F.array().cast(_SPANNED).alias("out"), F.lit(False).alias("open"))
    return F.aggregate(spanned, start, step, lambda a: a["out"])


def merge_single_letters(spanned: Column) -> Column:
    """Runs of single ASCII characters glued to one upper-case word, spans merged. Takes and gives array<struct<word,start,end>>."""
    single = lambda w: w.rlike(r"^[\x00-\x7F]$")
    last = lambda a: F.element_at(a["out"], -1)
    step = lambda a, x: F.struct(
        F.when(
            a["open"] & single(x["word"]),
            F.concat(
                F.slice(a["out"], 1, F.size(a["out"]) - 1),
                F.array(F.struct(F.concat(last(a)["word"], F.upper(x["word"])).alias("word"), last(a)["start"].alias("start"), x["end"].alias("end")))
            ),
        )
        .otherwise(
            F.concat(
                a["out"],
                F.array(
                    F.struct(
                        F.when(single(x["word"]), F.upper(x["word"])).otherwise(x["word"]).alias("word"), x["start"].alias("start"),
                        x["end"].alias("end")
                    )
                )
            )
        )
        .alias("out"),
        single(x["word"]).alias("open"),
    )
    start = F.struct(F.array().cast(_SPANNED).alias("out"), F.lit(False).alias("open"))
    return F.aggregate(spanned, start, step, lambda a: a["out"])
