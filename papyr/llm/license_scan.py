"""Licence scan on DataFrame functions alone: MinHash bands retrieve templates, exact shingles verify them.

Texts are cut into overlapping windows of word shingles, whose length goes by the template's. A window's MinHash in a
band is the smallest of its shingle hashes under that band's permutation; a template is retrieved where a window
agrees with it in any band. The number of bands follows from the bound on misses, see ``bands_for``.

A window can agree with a template only if it holds the template's smallest shingle of that band. So the windows
around such shingles are the only ones that are worked out; the others' MinHashes can't be in the table of bands.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.llm.common import let

SHINGLE, CONTAINMENT = 5, 0.8
#: Highest chance that no band retrieves a template that is there.
MISS = 1e-6
#: Band keys that one pass over the texts looks for; more templates are looked for in several passes.
KEYS_AT_ONCE = 20_000

#: Licence notices (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Released under the 3-Clause BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0-text": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
}


def license_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return let(plain, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " ")))


def _shingles(words: Column, of: Callable[[list[Column]], Column]) -> Column:
    """``of`` the words of each shingle, in order."""
    starts = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: of([F.get(words, i + j) for j in range(SHINGLE)]))


def shingle_texts(words: Column) -> Column:
    return let(words, lambda w: _shingles(w, lambda x: F.concat_ws(" ", *x)))


def shingle_hashes(words: Column) -> Column:
    return let(words, lambda w: _shingles(w, lambda x: F.xxhash64(*x)))


def window_of(shingles: int) -> int:
    """Shingles of a template's windows: the power of two from an eighth to a quarter of the template, two at least.

    Only a template that is one shingle has windows of one, in which a MinHash is the shingle itself.
    """
    return min(shingles, max(1 << max((shingles // 4).bit_length() - 1, 0), 2))


def bands_for(shingles: int, containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """Bands of one row that retrieve a template of so many shingles but for a chance of ``miss``.

    A band fails where the template's smallest shingle was changed, which 1 - containment of them may be, or where one
    of the w - 1 others of a window around it is foreign and smaller, below (w - 1) / (m + w - 1) for m shingles.
    """
    w = window_of(shingles)
    fails = 1 - containment * (1 - (w - 1) / (shingles + w - 1))
    return math.ceil(math.log(miss) / math.log(fails)) if 0 < fails < 1 else 1


def _smallest(hashes: Column, band: Column) -> Column:
    """The MinHash: the shingle hash that comes first in the band's permutation, a hash keyed by the band."""
    return F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, band).alias("rank"), h.alias("h"))))["h"]


@dataclass(frozen=True)
class Templates:
    """The template table, and per band key its entries (window, band, templates that it stands for)."""

    table: DataFrame
    keys: dict[int, list[tuple[int, int, list[str]]]]


def prepare_templates(spark: SparkSession, templates: dict[str, str], containment: float = CONTAINMENT) -> list[Templates]:
    """Shingles, hashes and band keys of the templates, in parts; one of under ``SHINGLE`` words can match nothing."""
    rows = spark.createDataFrame(sorted(templates.items()), "license_id string, notice string")
    rows = rows.withColumn("words", license_words(F.col("notice")))
    rows = rows.select("license_id", F.array_distinct(shingle_texts(F.col("words"))).alias("shingles"), F.array_distinct(shingle_hashes(F.col("words"))).alias("hashes"))
    sizes = sorted(r[0] for r in rows.where(F.size("hashes") > 0).select(F.size("hashes")).distinct().collect())
    most = max((bands_for(m, containment) for m in sizes), default=1)
    bands = F.array(*(_smallest(F.col("hashes"), F.lit(b)) for b in range(most)))
    found = rows.where(F.size("hashes") > 0).select("license_id", F.size("hashes").alias("m"), bands.alias("bands")).orderBy("license_id").collect()
    parts, names, keys, size = [], [], {}, 0
    for r in found:
        own = r["bands"][: bands_for(r["m"], containment)]
        if size and size + len(own) > KEYS_AT_ONCE:
            parts, names, keys, size = [*parts, (names, keys)], [], {}, 0
        names.append(r["license_id"])
        size += len(own)
        for band, key in enumerate(own):
            keys.setdefault(key, {}).setdefault((window_of(r["m"]), band), []).append(r["license_id"])
    parts = [*parts, (names, keys)] if names else parts
    return [Templates(rows.where(F.col("license_id").isin(names)), {k: [(w, b, ids) for (w, b), ids in v.items()] for k, v in keys.items()}) for names, keys in parts]


def _retrieved(hashes: Column, keys: dict[int, list[tuple[int, int, list[str]]]]) -> Column:
    """Templates whose MinHash in some band is that of a window of a text, given by its shingle hashes in order.

    Windows begin at every half of their length. In a window of one shingle that shingle is the smallest in all bands,
    so that the band doesn't matter there.
    """
    entries = {k: {(w, b if w > 1 else 0): None for w, b, _ in v} for k, v in keys.items()}
    ids = {k: {e: sorted({i for w, b, own in v for i in own if (w, b if w > 1 else 0) == e}) for e in entries[k]} for k, v in keys.items()}
    table = F.create_map(*(x for k, v in ids.items() for x in (F.lit(k), F.array(*(F.struct(F.lit(w).alias("w"), F.lit(b).alias("band"), F.array(*map(F.lit, own)).alias("ids")) for (w, b), own in v.items())))))
    is_key = lambda h: h.isin(list(keys))

    def windows_agree(entry: Column, at: Column) -> Column:
        half = F.greatest((entry["w"] / 2).cast("int"), F.lit(1))
        first = F.floor(at / half).cast("int") * half

        def agrees(begin: Column) -> Column:
            return (begin >= 0) & (_smallest(F.slice(hashes, F.greatest(begin, F.lit(0)) + 1, entry["w"]), entry["band"]) == F.get(hashes, at))

        return (entry["w"] == 1) | agrees(first) | agrees(first - half)

    def of_position(at: Column) -> Column:
        agreeing = F.filter(F.element_at(table, F.get(hashes, at)), lambda entry: windows_agree(entry, at))
        return F.flatten(F.transform(agreeing, lambda entry: entry["ids"]))

    spots = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: is_key(F.get(hashes, i)))
    found = F.array_distinct(F.flatten(F.transform(spots, of_position)))
    return F.when(F.exists(hashes, is_key), found).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of ``docs`` and template found in it: doc_id, license_id, containment, n_found, n_shingles, first_word.

    Words are lower-cased runs of letters and digits. A template is found where the text has at least ``containment``
    of its distinct five-word shingles; ``first_word`` is the word index of the first of them. Whole texts are
    scanned; null, empty and shorter ones match nothing. Repeated rows are scanned each; a null id is kept as it is.
    Other columns are ignored; an empty table, or no template, gives an empty result. No shuffle: the templates go to
    the texts, at most ``KEYS_AT_ONCE`` band keys in one pass.
    """
    prepared = prepare_templates(docs.sparkSession, templates, containment)
    rows = docs.select(docs[id_col].alias("doc_id"), license_words(docs[text_col]).alias("words"))
    if not prepared:
        prepared = [Templates(docs.sparkSession.createDataFrame([], "license_id string, shingles array<string>, hashes array<long>"), {})]
    return reduce(DataFrame.unionByName, [_scan(rows, part, containment) for part in prepared])


def _scan(rows: DataFrame, templates: Templates, containment: float) -> DataFrame:
    """(doc_id, words) against one part of the templates."""
    ids = let(shingle_hashes(F.col("words")), lambda h: _retrieved(h, templates.keys)) if templates.keys else F.array().cast("array<string>")
    candidates = rows.withColumn("license_id", F.explode(ids))
    pairs = candidates.join(F.broadcast(templates.table), "license_id").withColumn("own", shingle_texts(F.col("words")))
    shared = F.size(F.array_intersect("shingles", "own"))
    at = F.transform("shingles", lambda s: F.array_position("own", s))
    found = pairs.select(
        "doc_id", "license_id",
        shared.cast("long").alias("n_found"),
        F.size("shingles").cast("long").alias("n_shingles"),
        (F.array_min(F.filter(at, lambda p: p > 0)) - 1).cast("long").alias("first_word"),
    )
    return found.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= containment)


def oracle(templates: dict[str, str] = TEMPLATES) -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    words = r"list_filter(string_split(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    grams = "list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))"
    return f"""
WITH templates AS (
  SELECT license_id, list_distinct({grams}) AS shingles
  FROM (SELECT license_id, {words.format('notice')} AS w FROM (VALUES {values}) AS v(license_id, notice))
), texts AS (
  SELECT doc_id, {grams} AS own FROM (SELECT doc_id, {words.format('text')} AS w FROM documents)
), pairs AS (
  SELECT doc_id, license_id, len(shingles) AS n_shingles, own,
         list_filter(shingles, lambda s: list_contains(own, s)) AS found
  FROM texts CROSS JOIN templates
)
SELECT doc_id, license_id, len(found) AS n_found, n_shingles,
       list_min(list_transform(found, lambda s: list_position(own, s))) - 1 AS first_word,
       len(found) / n_shingles AS containment
FROM pairs WHERE len(found) / n_shingles >= {CONTAINMENT}
"""
