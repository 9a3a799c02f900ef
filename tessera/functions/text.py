"""Text functions as column expressions: all stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hangul syllables: their parts are letters as they are, so they stay whole.
_HANGUL = range(0xAC00, 0xD7A4)


def _base(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


@lru_cache(maxsize=2)
def _tables(ascii_only: bool) -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """From all of Unicode: characters that become one other, and these; those that become several; and a pattern of the latter.

    With ascii_only what isn't ASCII in the result is dropped; characters of
    which nothing is left are in no table.
    """
    single: list[tuple[str, str]] = []
    several: list[tuple[str, str]] = []
    for i in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= i < 0xE000 or i in _HANGUL:
            continue
        c = chr(i)
        if unicodedata.decomposition(c):
            to = _base(c)
            to = "".join(x for x in to if x < "\x80") if ascii_only else to
            if to and to != c:
                (single if len(to) == 1 else several).append((c, to))
    return "".join(c for c, _ in single), "".join(d for _, d in single), tuple(several), _class(ord(c) for c, _ in several)


def _class(points: Iterable[int]) -> str:
    """A pattern of the code points, given in order."""
    ranges: list[list[int]] = []
    for i in points:
        if ranges and i == ranges[-1][1] + 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


@lru_cache(maxsize=1)
def _marks() -> str:
    """A pattern of the characters of which nothing is left without marks."""
    return _class(i for i in range(0x300, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and not _base(chr(i)))


def _spelled(c: Column, ascii_only: bool) -> Column:
    """Compatibility forms and accented letters as their base letters. Forms of several letters are rare; only texts that have them are taken apart."""
    ones, bases, several, pattern = _tables(ascii_only)
    spell = F.create_map(*[F.lit(x) for pair in several for x in pair])
    wide = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(pattern), spell[x]).otherwise(x)), "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(F.when(c.rlike(pattern), wide).otherwise(c), ones, bases)).otherwise(c)


def let(value: Column, use) -> Column:
    """use(value), the value worked out once. Inside a function of array elements it would be worked out wherever it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip_accents(c: Column) -> Column:
    """Compatibility forms spelled out, letters without their marks; letters that have no base form, like ß, stay."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(_spelled(c, False), _marks(), "")).otherwise(c)


def _ascii(c: Column) -> Column:
    """Compatibility forms spelled out, marks off, and all that is still not ASCII dropped."""
    return F.regexp_replace(_spelled(c, True), r"[^\x00-\x7F]", "")


def normalize_text(c: Column) -> Column:
    """Lower case, ASCII, every other sign than letters, digits and underscore a space, spaces single."""
    words = F.regexp_replace(_ascii(F.lower(F.coalesce(c, F.lit("")))), r"[^A-Za-z0-9_\s]", " ")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def tokenize_words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def vector_tokens(c: Column) -> Column:
    """Words of two characters and more, lower-cased, without accents."""
    return F.regexp_extract_all(F.lower(strip_accents(c)), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def word_ngrams(tokens: Column) -> Column:
    """Words and pairs of neighbouring words, repeats kept."""

    def grams(t: Column) -> Column:
        pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(t, F.when(F.size(t) > 1, pairs).otherwise(F.array().cast("array<string>")))

    return let(tokens, grams)


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """Runs of low to high characters of the lower-cased text, over word limits; white space of two and more is one space."""
    t = F.regexp_replace(F.lower(c), r"\s\s+", " ")

    def gram(chars: Column, n: int):
        return lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])

    def of(chars: Column) -> Column:
        # by place in an array: a substring would count from the text's beginning each time
        return F.flatten(F.array(*[
            F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(0), F.size(chars) - n), gram(chars, n))).otherwise(F.array().cast("array<string>"))
            for n in range(low, high + 1)
        ]))

    return let(F.filter(F.split(t, ""), lambda x: x != ""), of)


#: The patterns of sweep tokens and of runs that may be acronyms.
SWEEP_TOKEN = r"([A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*)"
ACRONYM_RUN = r"([A-Z0-9&\-]{2,})"


def sweep_tokens(c: Column) -> Column:
    """Lower-cased ASCII words, which dots and hyphens may join; repeats kept."""
    return F.transform(F.regexp_extract_all(c, F.lit(SWEEP_TOKEN), F.lit(1)), F.lower)


def find_acronyms(c: Column) -> Column:
    """Distinct runs of two and more capitals, digits, & and -, without the signs, with a capital; lower-cased."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(ACRONYM_RUN), F.lit(1)), lambda r: F.regexp_replace(r, r"[^A-Za-z0-9]", ""))
    return F.array_distinct(F.transform(F.filter(runs, lambda r: (F.length(r) >= 2) & r.rlike("[A-Z]")), F.lower))


def counted(terms: Column) -> Column:
    """A struct (t, tf): the distinct terms in ascending order, and how often each stands among the terms."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        ends = lambda at: F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s)))
        return let(starts, lambda at: F.struct(F.transform(at, lambda i: F.get(s, i)).alias("t"), F.zip_with(at, ends(at), lambda a, b: b - a).alias("tf")))

    return let(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(F.struct(s.alias("t"), F.array().cast("array<int>").alias("tf"))))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Overlap of two arrays as sets; `empty` if both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def unordered(a: str, b: str) -> list[Column]:
    """The pair's key, whichever comes first."""
    return [F.least(F.col(a), F.col(b)).alias("lo"), F.greatest(F.col(a), F.col(b)).alias("hi")]
