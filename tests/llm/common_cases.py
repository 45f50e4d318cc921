"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing column names."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, epoch string"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000


def hard_rows() -> list[tuple]:
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a"),
        (2, "the  cat sat\non the mat and looked at the dog", "en", "a"),
        (3, None, None, None),
        (4, "", "en", ""),
        (5, " \t\n", None, "b"),
        (6, LONG, "la", "b"),
        (7, "der hund und die katze und das haus", "de", None),
        (7, "der hund und die katze und das haus", "de", None),
        (7, "another text under the same id", "en", "c"),
        (None, "a row without an id", "en", "c"),
        (None, None, None, None),
        (8, "12345 !!! ???", "en", "c"),
        (9, " 　日本語 é 🤷", "ja", "c"),
    ]
    return [(*r, 0, True, 0.5, "x") for r in rows]


def hard_docs(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(hard_rows() if rows is None else rows, SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
