"""Text cleaners: column in, column out; ``over`` and ``over2`` lift them to arrays and arrays of arrays."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rows import STRING, by_row

#: Unicode white space as Python has it; Java's class lacks the four separators.
SPACE = r"(?U)[\s\x1c-\x1f]"
PATTERNS = {
    "zh": "[一-鿿]+",
    "en": "[A-Za-z]+",
    "en_pr": r"[!-/:-@\[-`{-~]",
    "cjk_pr": "[　-〿＀-￯]",
    "en_pr_double": r"\(.*?\)|\[.*?\]|\{.*?\}|<.*?>|\".*?\"|'.*?'",
}


def over(f: Callable[[Column], Column], c: Column) -> Column:
    """f on each string of an array."""
    return F.transform(c, f)


def over2(f: Callable[[Column], Column], c: Column) -> Column:
    """f on each string of an array of arrays."""
    return F.transform(c, lambda x: F.transform(x, f))


def drop_blanks(c: Column) -> Column:
    """Delete all Unicode white space."""
    return F.regexp_replace(c, SPACE + "+", "")


def collapse_blanks(c: Column, blanks: str = " \t", strict: bool = True) -> Column:
    """Runs of blanks become their first one, outer blanks go.

    With ``strict`` a blank behind a non-ASCII character goes too, as
    downstream consumers of CJK text expect; ``strict=False`` keeps it.
    """
    k = "[" + re.escape(blanks) + "]"
    if strict:
        c = F.regexp_replace(c, r"([^\x00-\x7F])" + k + "+", "$1")
    c = F.regexp_replace(c, f"({k}){k}+", "$1")
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def drop_short(c: Column, least: int) -> Column:
    """'' where the text has fewer than ``least`` characters."""
    return F.when(F.char_length(c) >= least, c).otherwise(F.when(c.isNotNull(), ""))


def keep_long(c: Column, least: int) -> Column:
    """An array's strings of at least ``least`` characters."""
    return F.filter(c, lambda x: F.char_length(x) >= least)


def drop_patterns(c: Column, *patterns: str) -> Column:
    """Delete all matches of any of the patterns (Java syntax)."""
    return F.regexp_replace(c, "|".join(patterns), "")


def keep_patterns(c: Column, *patterns: str) -> Column:
    """Only the matches of the patterns, joined."""
    return F.array_join(F.regexp_extract_all(c, F.lit("|".join(patterns)), F.lit(0)), "")


def lower(c: Column) -> Column:
    """Lower case."""
    return F.lower(c)


def _no_marks(t: str) -> str:
    return t if t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")


def strip_accents(c: Column) -> Column:
    """Decompose (NFD) and drop combining marks."""
    return normalize(c, _no_marks)


def normalize(c: Column, f: Callable[[str], str]) -> Column:
    """Any normaliser of one string, for instance a text-normalisation model's method; runs by rows of Arrow batches."""

    return by_row(STRING)(lambda t: None if t is None else f(t))(c)


_ZH, _ZH_UNIT, _ZH_GROUP = "零一二三四五六七八九", ["", "十", "百", "千"], ["", "万", "亿", "万亿", "亿亿"]
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALE = ["", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion"]


def _significant(digits: str) -> int:
    """How many digits there are from the first that is not zero."""
    return next((len(digits) - i for i, d in enumerate(digits) if int(d)), 0)


def number_in_chinese(digits: str) -> str:
    """An integer in Chinese numerals; longer than 20 digits, digit by digit."""
    if _significant(digits) > 20:
        return "".join(_ZH[int(d)] for d in digits)
    n = int(digits[-20:])
    if n == 0:
        return _ZH[0]
    parts, group, gap = [], 0, False
    while n:
        n, low = divmod(n, 10_000)
        text, zero = "", False
        for k in range(3, -1, -1):
            d = low // 10**k % 10
            if d:
                text += ("零" if zero and text else "") + _ZH[d] + _ZH_UNIT[k]
                zero = False
            else:
                zero = True
        if low:
            parts.append(text + _ZH_GROUP[group] + ("零" if gap else ""))
        gap = bool(parts) and 0 < low < 1000 or bool(parts) and not low
        group += 1
    out = "".join(reversed(parts)).rstrip("零")
    return out[1:] if out.startswith("一十") else out


def number_in_english(digits: str) -> str:
    """An integer in English words; longer than 21 digits, digit by digit."""
    if _significant(digits) > 21:
        return " ".join(_ONES[int(d)] for d in digits)
    n = int(digits[-21:])
    if n == 0:
        return _ONES[0]

    def below_thousand(k):
        out = []
        if k >= 100:
            out += [_ONES[k // 100], "hundred"]
            if k % 100:
                out.append("and")
        k %= 100
        if k >= 20:
            out.append(_TENS[k // 10] + (f"-{_ONES[k % 10]}" if k % 10 else ""))
        elif k:
            out.append(_ONES[k])
        return " ".join(out)

    parts, scale = [], 0
    while n:
        n, low = divmod(n, 1000)
        if low:
            parts.append(f"{below_thousand(low)} {_SCALE[scale]}".strip())
        scale += 1
    return ", ".join(reversed(parts))


def spell_numbers(c: Column, language: str = "en") -> Column:
    """Every run of digits in words: ``en`` or ``zh``."""
    spell = {"en": number_in_english, "zh": number_in_chinese}[language]
    return normalize(c, lambda t: re.sub(r"\d+", lambda m: spell(m.group()), t))
