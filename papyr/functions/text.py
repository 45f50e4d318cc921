"""Column expressions over text: normalisation, language by script, blocks, sentences, headings, token estimates."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the platform's sense: ASCII, no-break space, Unicode spaces, separators and the byte order mark.
#: Written for Java's regular expressions and DuckDB's alike.
SPACE = r"\t\n\x0B\f\r\x20" + "".join(f"\\x{{{c:X}}}" for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
DEVANAGARI = r"[\x{900}-\x{97F}]"
INLINE_SPACE = SPACE.replace(r"\n", "")
SENTENCE_END = r".!?\x{964}"
#: The same white space as characters, and patterns for texts in Python: a Java class of that many ranges tries each of
#: them for every character.
SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
_WORD, _SENTENCE = re.compile(f"[^{SPACES}]+"), re.compile(f"(?<=[.!?\u0964])[{SPACES}]+")
_BLANK, _LINES = re.compile(f"\n[{SPACES}]*\n+"), re.compile("\n+")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def trim_all(text: Column | str) -> Column:
    return F.btrim(text, F.lit(SPACES))


def nfc(text: Column) -> Column:
    """Canonical composition; only rows with non-ASCII text go through Python."""

    @F.pandas_udf("string")
    def compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    wide = text.rlike(r"[^\x00-\x7F]")
    return F.when(wide, compose(F.when(wide, text))).otherwise(text)


def normalize(text: Column) -> Column:
    """Composed form, no zero-width or control characters, single spaces, at most one blank line, trimmed lines."""
    t = nfc(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(t, r"[\x{200B}-\x{200D}\x{FEFF}]", "")
    t = F.regexp_replace(t, rf"[{INLINE_SPACE}]+", " ")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return trim_all(F.array_join(F.transform(F.split(t, "\n"), trim_all), "\n"))


def script_language(text: Column, least: int = 5) -> Column:
    """hi, en, hi+en by the share of Devanagari among Devanagari and Latin letters; unknown below ``least``."""

    def by(counts: Column) -> Column:
        deva, total = counts["deva"], counts["deva"] + counts["latin"]
        return F.when(total < least, "unknown").when(deva / total > 0.6, "hi").when(deva / total < 0.2, "en").otherwise("hi+en")

    return let(F.struct(F.regexp_count(text, F.lit(DEVANAGARI)).alias("deva"), F.regexp_count(text, F.lit("[a-zA-Z]")).alias("latin")), by)


def query_language(text: Column) -> Column:
    return F.when(F.regexp_count(text, F.lit(DEVANAGARI)) >= 3, "hi").otherwise("en")


def sentence_list(text: str) -> list[str]:
    """Pieces after a sentence mark and white space; the whole text where there is none."""
    return _trimmed(_SENTENCE.split(text))


def block_list(text: str) -> list[str]:
    """Paragraphs; where there is one only, lines; where there is one only, sentences."""
    for pattern in (_BLANK, _LINES):
        parts = _trimmed(pattern.split(text))
        if len(parts) > 1:
            return parts
    return sentence_list(text)


def word_list(text: str) -> list[str]:
    return _WORD.findall(text)


def count_words(text: str) -> int:
    return len(word_list(text))


def token_estimate(words: int) -> int:
    """1.3 tokens a word, rounded."""
    return math.floor(words * 1.3 + 0.5)


def trimmed_heading(t: str) -> bool:
    """``is_heading`` of a text without white space around it."""
    if len(t) > 80 or "\n" in t:
        return False
    if t.endswith(":"):
        return True
    kinds = {unicodedata.category(c) for c in t}
    return len(t) > 3 and "Lu" in kinds and "Ll" not in kinds


def trimmed(text: str) -> str:
    """``text`` without white space around it."""
    return text.strip(SPACES)


def _trimmed(parts: list[str]) -> list[str]:
    return [p for p in map(trimmed, parts) if p]


def by_text(function: Callable[[str], object], kind: str, text: Column) -> Column:
    """A function of one text as a column; null for null."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if t is None else function(t) for t in s], dtype=object)

    return run(text)


def sentences(text: Column) -> Column:
    return by_text(sentence_list, "array<string>", text)


def blocks(text: Column) -> Column:
    return by_text(block_list, "array<string>", text)


def is_heading(block: Column) -> Column:
    """One line of up to 80 characters that ends with a colon, or has capital and no small letters."""
    return let(trim_all(block), is_trimmed_heading)


def is_trimmed_heading(t: Column) -> Column:
    """``is_heading`` of a text without white space around it."""
    capital = (F.length(t) > 3) & t.rlike(r"\p{Lu}") & ~t.rlike(r"\p{Ll}")
    return (F.length(t) <= 80) & ~F.contains(t, F.lit("\n")) & (F.endswith(t, F.lit(":")) | capital)


def word_count(text: Column) -> Column:
    return by_text(count_words, "int", text)


def tokens_of_words(words: Column) -> Column:
    return F.floor(words * 1.3 + 0.5).cast("int")


def estimate_tokens(text: Column) -> Column:
    """1.3 tokens a word, rounded."""
    return tokens_of_words(word_count(text))
