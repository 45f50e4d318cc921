"""Column expressions over extracted fields: dates, amounts, tax numbers, confidence bands, type and category names."""

from __future__ import annotations

import datetime
import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyr.functions.text import SPACE, SPACES, by_text, trim_all, trimmed, word_list

#: Month names (fixed values).
ENGLISH_MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "october": 10, "oct": 10, "november": 11, "nov": 11,
    "december": 12, "dec": 12,
}
HINDI_MONTHS = {
    "जनवरी": 1, "फ़रवरी": 2, "फरवरी": 2, "मार्च": 3, "अप्रैल": 4, "मई": 5, "जून": 6, "जुलाई": 7, "अगस्त": 8, "सितंबर": 9,
    "अक्टूबर": 10, "नवंबर": 11, "दिसंबर": 12,
}
#: Field types, other names for them, and patterns of field names that tell the type (fixed values).
FIELD_TYPES = ("TEXT", "NUMBER", "DATE", "CURRENCY", "BOOLEAN", "LIST", "ADDRESS", "NAME", "ID_NUMBER")
TYPE_ALIASES = {
    "STRING": "TEXT", "INT": "NUMBER", "INTEGER": "NUMBER", "FLOAT": "NUMBER", "DECIMAL": "NUMBER", "MONEY": "CURRENCY", "AMOUNT": "CURRENCY",
    "DATETIME": "DATE", "ARRAY": "LIST", "BOOL": "BOOLEAN", "ID": "ID_NUMBER", "IDNUMBER": "ID_NUMBER", "PERSON": "NAME",
}
TYPE_BY_NAME = (
    (r"_date$|^date$|validity|expiry", "DATE"),
    (r"amount|total|subtotal|balance|ctc|tax|revenue|profit|value|payable", "CURRENCY"),
    (r"number$|_no$|gstin|pan|ifsc|roll|passport|phone", "ID_NUMBER"),
    (r"address", "ADDRESS"),
    (r"name$|holder|sender|recipient|parties|auditor", "NAME"),
)
#: Marks of currencies, the two patterns of a tax number, and the lower bounds of the confidence bands (fixed values).
CURRENCY_MARKS = r"(?i)(INR|RS\.?|RUPEES?|₹|USD|EUR|GBP|AED|[$€£])"
LOOKS_LIKE_GSTIN = r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]"
GSTIN = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$"
HIGH, MEDIUM = 0.85, 0.65


_DMY, _YMD = re.compile(r"([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})"), re.compile(r"([0-9]{4})[/.-]([0-9]{1,2})[/.-]([0-9]{1,2})")
_ENGLISH, _AMERICAN = re.compile(r"([0-9]{1,2}) ([a-zA-Z]+) ([0-9]{4})"), re.compile(r"([a-zA-Z]+)\.? ([0-9]{1,2}),? ([0-9]{4})")
_HINDI, _DEVANAGARI = re.compile(r"([0-9]{1,2})[^0-9]+([0-9]{4})"), re.compile("[\u0900-\u097f]")
_ORDINAL, _OF = re.compile(r"([0-9]{1,2})(?:[sS][tT]|[nN][dD]|[rR][dD]|[tT][hH])\b"), re.compile(r"\b[oO][fF]\b")
_MARKS, _NUMBER = re.compile(CURRENCY_MARKS, re.ASCII), re.compile(r"[0-9]+(?:\.[0-9]+)?")
_WITHOUT = str.maketrans("", "", SPACES + ",")


def _day(year: str, month: int | None, day: str) -> datetime.date | None:
    """A calendar date of the years 1000 to 9999; none where there is no such day."""
    try:
        return datetime.date(int(year), month, int(day)) if month and year >= "1000" else None
    except ValueError:
        return None


@lru_cache(1 << 14)
def date_of(text: str) -> datetime.date | None:
    """D/M/YYYY, YYYY/M/D (also with - or .), English and Hindi month names; none for anything else."""
    t = trimmed(text)
    found = None
    if m := _DMY.fullmatch(t):
        found = _day(m[3], int(m[2]), m[1])
    if not found and (m := _YMD.fullmatch(t)):
        found = _day(m[1], int(m[2]), m[3])
    plain = "" if found else " ".join(word_list(_OF.sub(" ", _ORDINAL.sub(r"\1", t))))
    if not found and (m := _ENGLISH.fullmatch(plain)):
        found = _day(m[3], ENGLISH_MONTHS.get(m[2].lower()), m[1])
    if not found and (m := _AMERICAN.fullmatch(plain)):
        found = _day(m[3], ENGLISH_MONTHS.get(m[1].lower()), m[2])
    if not found and _DEVANAGARI.search(t) and (m := _HINDI.search(t)):
        found = _day(m[2], next((n for name, n in HINDI_MONTHS.items() if name in t), None), m[1])
    return found


def amount_of(text: str) -> float | None:
    """The number of an amount of money without its marks; parentheses or a minus make it negative."""
    t = _MARKS.sub("", text).translate(_WITHOUT).removesuffix("/-").removesuffix(".")
    bracketed = len(t) > 1 and t[0] == "(" and t[-1] == ")"
    inner = t[1:-1] if bracketed else t
    digits = inner[1:] if inner[:1] in ("-", "+") else inner
    if not _NUMBER.fullmatch(digits):
        return None
    return -float(digits) if bracketed or inner[:1] == "-" else float(digits)


def parse_date(raw: Column) -> Column:
    """``date_of`` as a column."""
    return by_text(date_of, "date", raw)


def parse_amount(raw: Column) -> Column:
    """``amount_of`` as a column."""
    return by_text(amount_of, "double", raw)


def looks_like_gstin(raw: Column) -> Column:
    return F.upper(trim_all(raw)).rlike(LOOKS_LIKE_GSTIN)


def is_gstin(raw: Column) -> Column:
    return F.upper(trim_all(raw)).rlike(GSTIN)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "HIGH").when(confidence >= MEDIUM, "MEDIUM").otherwise("LOW")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def enum_token(raw: Column) -> Column:
    t = F.regexp_replace(F.upper(trim_all(F.coalesce(raw, F.lit("")))), rf"[{SPACE}-]+", "_")
    return F.regexp_replace(t, "[^A-Z0-9_]", "")


def field_type(raw: Column, field_name: Column) -> Column:
    """A known type, its other names, what the field's name tells, else TEXT."""
    aliases = F.create_map(*(F.lit(x) for kv in TYPE_ALIASES.items() for x in kv))
    token, name, by_name = enum_token(raw), F.lower(field_name), F.lit("TEXT")
    for pattern, kind in reversed(TYPE_BY_NAME):
        by_name = F.when(name.rlike(pattern), kind).otherwise(by_name)
    return F.when(token.isin(*FIELD_TYPES), token).otherwise(F.coalesce(F.try_element_at(aliases, token), by_name))
