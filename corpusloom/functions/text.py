"""Text normalisation. Characters are classed by Python's tables, texts are changed by Spark's own functions.

Only texts that NFKC may change go to Python, a few rows at a time, so its memory does not depend on the batches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

# Field contents that mean nothing, the mask, and the relation phrases in front of it.
PLACEHOLDERS = ("", "none", "null", "nan", "no name", "no description")
ISSUE_REF = "[ISSUE_REF]"
RELATION_PHRASES = ("duplicate of", "duplicates", "blocked by", "blocks", "relates to", "depends on")
TOKEN_PATTERN = "[a-z0-9ı][a-z0-9ı_.+-]{1,}"


def _clean(text: str | None) -> str | None:
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = " ".join(text.split())
    if not text.isprintable():  # line breaks and tabs are gone by now, so few texts come here
        text = " ".join("".join(" " if unicodedata.category(c)[0] == "C" else c for c in text).split())
    return text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _class(chars: Iterable[int]) -> str:
    """The inside of a character class of regular expressions, for ascending code points."""
    ranges: list[list[int]] = []
    for c in chars:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


#: Where the common characters are: Latin, Cyrillic, punctuation, the euro, kana, Chinese, Hangul and pictures.
COMMON = ((0xA0, 0x180), (0x400, 0x460), (0x2010, 0x205F), (0x20AC, 0x20AD), (0x3041, 0x3097), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0x1F300, 0x1F600))


@cache
def plain_class() -> str:
    """Common characters that NFKC leaves alone, beside any others of them, and that are neither blank nor control characters."""
    fixed = lambda c: unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) and unicodedata.category(c)[0] not in "CZ"
    return _class(c for a, b in COMMON for c in range(a, b) if fixed(chr(c)))


@cache
def lower_class() -> str:
    """Common characters whose case folding is their lower case; the sharp s beside them."""
    return _class(c for a, b in COMMON for c in range(a, b) if chr(c).casefold() == chr(c).lower() or chr(c) == "ß")


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters with one folded character, these, and those that fold to several."""
    folds = {c: f for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and (f := c.casefold()) != c}
    one = {c: f for c, f in folds.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in folds.items() if len(f) > 1}


@cache
def alphanumeric_class() -> str:
    return _class(c for c in range(0x110000) if chr(c).isalnum())


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


@arrow_udf(StringType())
def _clean_all(text: pa.Array) -> pa.Array:
    parts = (text.slice(at, 64).to_pylist() for at in range(0, len(text), 64))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([_clean(t) for t in part], pa.string()) for part in parts)])


def clean_whitespace(text: Column | str) -> Column:
    """NFKC, control and unassigned characters as blanks, runs of white space as one blank, ends trimmed."""
    text = F.col(text) if isinstance(text, str) else text
    odd = ~_is_ascii(text) & F.rlike(text, F.lit(rf"[^\x00-\x7f{plain_class()}]"))
    plain = F.trim(F.regexp_replace(text, r"[\x00-\x20\x7f]{2,}|[\x00-\x1f\x7f]", " "))
    return F.when(odd, _clean_all(F.when(odd, text))).otherwise(plain)


def casefold(text: Column | str) -> Column:
    """Unicode case folding (not the same as lower: it maps ß to ss)."""
    one, other, several = _folds()
    rare = [c for c in several if c != "ß"]

    def folded(t: Column) -> Column:
        sharp = F.replace(t, F.lit("ß"), F.lit("ss"))
        whole = sharp
        for c in rare:
            whole = F.replace(whole, F.lit(c), F.lit(several[c]))
        whole = F.when(F.rlike(sharp, F.lit(f"[{_class(map(ord, rare))}]")), whole).otherwise(sharp)
        return F.when(_is_ascii(t), F.lower(t)).when(~F.rlike(t, F.lit(rf"[^\x00-\x7f{lower_class()}]")), F.lower(sharp)).otherwise(F.translate(whole, one, other))

    return let(F.col(text) if isinstance(text, str) else text, folded)


def has_alphanumeric(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.rlike(text, F.lit(f"[{alphanumeric_class()}]")), F.lit(False))


def words(text: Column) -> Column:
    """White-space words as array<string>; none for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def clean_word_count(text: Column) -> Column:
    """:func:`word_count` of a cleaned text, whose words are one blank apart."""
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def is_placeholder(text: Column) -> Column:
    return (F.length(text) <= max(map(len, PLACEHOLDERS))) & F.lower(text).isin(list(PLACEHOLDERS))


def mask_urls(text: Column) -> Column:
    """Tracker links become the mask."""
    return F.regexp_replace(text, r"(?iU)https?://[^\s]*(?:/browse/|/issues/)[^\s]+", F.lit(ISSUE_REF))


def issue_pattern(prefixes: list[str]) -> str:
    """Matches a known project prefix with a number, longest prefix first; nothing if there is none."""
    if not prefixes:
        return "(?!)"
    quoted = "|".join(r"\Q" + p + r"\E" for p in sorted(prefixes, key=lambda p: (-len(p), p)))
    return rf"(?iU)\b(?:{quoted})-\d+\b"


def remove_relations(text: Column) -> Column:
    """A relation phrase goes together with the mask that follows it; other words stay."""
    phrases = "|".join(p.replace(" ", r"\s+") for p in RELATION_PHRASES)
    return F.regexp_replace(text, rf"(?iU)\b(?:is\s+)?(?:a\s+)?(?:{phrases})\s+\[ISSUE_REF\]", " ")


def tokens(text: Column) -> Column:
    """Distinct retrieval tokens of a case-folded text, as array<string>."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)))


def squeeze_blanks(text: Column) -> Column:
    """For cleaned texts, whose only white space is the blank."""
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
