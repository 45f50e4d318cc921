"""Session SQL functions, the twins of the column expressions: call ``register(spark)`` once a session.

Patterns, names and limits are those of the column expressions; a test holds the two against each other.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from papyr.functions import fields as P
from papyr.functions.text import DEVANAGARI, SPACE


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replace(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(by)})"


def _trim(x: str) -> str:
    return _replace(x, rf"^[{SPACE}]+|[{SPACE}]+$")


def _count(pattern: str) -> str:
    return f"regexp_count(text, {_quoted(pattern)})"


def _languages() -> str:
    deva, latin = _count(DEVANAGARI), _count("[a-zA-Z]")
    share = f"{deva} / ({deva} + {latin})"
    return f"CASE WHEN {deva} + {latin} < 5 THEN 'unknown' WHEN {share} > 0.6 THEN 'hi' WHEN {share} < 0.2 THEN 'en' ELSE 'hi+en' END"


def _heading() -> str:
    t = _trim("text")
    capital = f"length({t}) > 3 AND {t} RLIKE {_quoted(chr(92) + 'p{Lu}')} AND NOT {t} RLIKE {_quoted(chr(92) + 'p{Ll}')}"
    return f"length({t}) <= 80 AND NOT contains({t}, '\\n') AND (endswith({t}, ':') OR ({capital}))"


def _date() -> str:
    t = _trim("coalesce(text, '')")
    plain = _trim(_replace(_replace(_replace(t, r"(?i)(\d{1,2})(st|nd|rd|th)\b", "$1"), r"(?i)\bof\b", " "), rf"[{SPACE}]+", " "))
    months = "map(" + ", ".join(f"'{k}', {v}" for k, v in P.ENGLISH_MONTHS.items()) + ")"
    hindi = "CASE " + " ".join(f"WHEN contains({t}, '{k}') THEN {v}" for k, v in P.HINDI_MONTHS.items()) + " END"

    def group(pattern: str, i: int, of: str = t) -> str:
        return f"regexp_extract({of}, {_quoted(pattern)}, {i})"

    def made(year: str, month: str, day: str) -> str:
        text = f"concat({year}, '-', lpad(CAST({month} AS STRING), 2, '0'), '-', lpad({day}, 2, '0'))"
        return f"CASE WHEN length({year}) = 4 AND {year} >= '1000' AND {day} <> '' AND {month} > 0 THEN try_cast({text} AS DATE) END"

    def number(x: str) -> str:
        return f"try_cast({x} AS INT)"

    def named(x: str) -> str:
        return f"try_element_at({months}, lower({x}))"

    dmy, ymd = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})$"
    english, american, loose = r"^(\d{1,2}) ([a-zA-Z]+) (\d{4})$", r"^([a-zA-Z]+)\.? (\d{1,2}),? (\d{4})$", r"(\d{1,2})\D+(\d{4})"
    forms = (
        made(group(dmy, 3), number(group(dmy, 2)), group(dmy, 1)), made(group(ymd, 1), number(group(ymd, 2)), group(ymd, 3)),
        made(group(english, 3, plain), named(group(english, 2, plain)), group(english, 1, plain)),
        made(group(american, 3, plain), named(group(american, 1, plain)), group(american, 2, plain)),
        made(group(loose, 2), hindi, group(loose, 1)),
    )
    return f"coalesce({', '.join(forms)})"


def _amount() -> str:
    t = _replace(_replace(_replace(_replace("coalesce(text, '')", P.CURRENCY_MARKS), rf"[{SPACE},]"), "/-$"), r"\.$")
    inner = _replace(t, r"^\((.*)\)$", "$1")
    digits = _replace(inner, "^[-+]")
    value = f"CASE WHEN {digits} RLIKE {_quoted(r'^\d+(\.\d+)?$')} THEN try_cast({digits} AS DOUBLE) END"
    return f"CASE WHEN {t} RLIKE {_quoted(r'^\(.*\)$')} OR startswith({inner}, '-') THEN -({value}) ELSE {value} END"


#: Name -> arguments, result type, body.
FUNCTIONS = {
    "est_tokens": ("text STRING", "INT", f"CAST(floor({_count(f'[^{SPACE}]+')} * 1.3 + 0.5) AS INT)"),
    "confidence_band": ("confidence DOUBLE", "STRING", f"CASE WHEN confidence >= {P.HIGH} THEN 'HIGH' WHEN confidence >= {P.MEDIUM} THEN 'MEDIUM' ELSE 'LOW' END"),
    "query_lang": ("text STRING", "STRING", f"CASE WHEN {_count(DEVANAGARI)} >= 3 THEN 'hi' ELSE 'en' END"),
    "detect_lang": ("text STRING", "STRING", _languages()),
    "is_heading": ("text STRING", "BOOLEAN", _heading()),
    "parse_doc_date": ("text STRING", "DATE", _date()),
    "parse_amount": ("text STRING", "DOUBLE", _amount()),
    "is_gstin": ("text STRING", "BOOLEAN", f"upper({_trim('text')}) RLIKE {_quoted(P.GSTIN)}"),
    "cosine_sim": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / (sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)))"),
}


def register(spark: SparkSession) -> None:
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
