"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: every slot holds one bit per language, so the AND of the slots of
an n-gram is the mask of all languages in whose learned texts it stands, common and rare n-grams alike. A text's
languages are ranked by how many of its n-grams each holds, after the share of false positives that the slice's fill
implies is taken off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.llm.common import checkpointed, hash_share, held_out, named, numbered

GRAMS = (3, 4)
HASHES = 3
#: Slots for each n-gram of the richest language, and the most bytes that all slots take.
SLOTS_A_GRAM, FILTER_BYTES = 32, 1 << 26
#: No language fills more than about this share of its slots: a false positive is then rarer than one in eight.
FILL = 0.5
#: The fit takes at most about so many documents of a language, and fewer where their n-grams would fill the slots.
SAMPLE_DOCS = 2000
#: Odd factors whose products with an n-gram's hash are its slots, independent of one another.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9][:HASHES], np.uint64)
#: Up to so many languages their sizes are broadcast; beyond that Spark chooses the join.
BROADCAST_LANGUAGES = 10_000
#: The columns that the operator adds.
ADDED = ("held_out", "lang_pred", "score", "share")
#: Code points worked on at once.
BLOCK = 1 << 19


@lru_cache(1)
def _folding() -> np.ndarray:
    """Code point -> its lower-case letter, or 32 for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """Folded code points of several texts at once, in blocks of bounded size.

    Gives (code points, start of each piece, where its n-grams must have begun, text of each piece). A long text comes
    in several pieces that overlap by the longest n-gram less one, so that each n-gram begins in one piece only.
    """
    fold, reach = _folding(), max(GRAMS) - 1
    gap = np.full(reach, 32, np.uint32)
    parts, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        points = fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        for at in range(0, len(points), BLOCK):
            piece, lead = points[at : at + BLOCK + reach], int(at == 0)
            parts += [gap[:lead], piece, gap]
            whole = lead + len(piece) + reach
            pieces.append((size, size + (lead + BLOCK if at + BLOCK < len(points) else whole), i))
            size += whole
            if size >= BLOCK:
                yield np.concatenate(parts), *np.array(pieces).T
                parts, pieces, size = [], [], 0
    if parts:
        yield np.concatenate(parts), *np.array(pieces).T


def _grams(block: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's n-grams whose inner characters are all letters: their texts and 64-bit hashes."""
    points, starts, limits, owner = block
    m = len(points) - n + 1
    letter = points != 32
    ok = letter[1 : 1 + m].copy()
    for j in range(2, n - 1):
        ok &= letter[j : j + m]
    at = np.flatnonzero(ok)
    piece = np.searchsorted(starts, at, "right") - 1
    inside = at < limits[piece]
    at, piece = at[inside], piece[inside]
    h = np.full(len(at), n, np.uint64)
    for j in range(n):
        h = (h ^ points[at + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return owner[piece], h


@dataclass(frozen=True)
class LanguageFilters:
    """languages; slots: masks by (word of 64 languages, slot); fpr: false-positive share of each language."""

    languages: tuple[str, ...]
    slots: np.ndarray
    fpr: np.ndarray

    @staticmethod
    def of_slots(languages: tuple[str, ...], slot_bits: int, words: np.ndarray, at: np.ndarray, bits: np.ndarray) -> LanguageFilters:
        """From the slots that hold anything: word of 64 languages, slot, mask."""
        slots = np.zeros(((len(languages) + 63) // 64 or 1, 1 << slot_bits), np.uint64)
        slots[words, at] = bits
        fill = [np.count_nonzero(slots[i // 64] & (np.uint64(1) << np.uint64(i % 64))) for i in range(len(languages))]
        return LanguageFilters(languages, slots, (np.array(fill, float) / (1 << slot_bits)) ** HASHES)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """Of each n-gram, the mask of the languages that contain it: (word of 64 languages, n-gram)."""
        slot_bits = self.slots.shape[1].bit_length() - 1
        a, *rest = (self.slots[:, at] for at in _slots_of(grams, slot_bits))
        for b in rest:
            a = a & b
        return a

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """(text, language): share of the text's n-grams that the language holds, corrected for false positives."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for block in _blocks(texts):
            for n in GRAMS:
                doc, grams = _grams(block, n)
                total += np.bincount(doc, minlength=len(texts))
                masks = self.masks(grams)
                for i in range(len(self.languages)):
                    has = (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                    hits[:, i] += np.bincount(doc, weights=has, minlength=len(texts))
        n = np.maximum(total, 1)[:, None]
        told = 1 - self.fpr  # 0 for a full slice, which tells nothing
        return np.clip(np.divide(hits / n - self.fpr, told, out=np.zeros(hits.shape), where=told > 0), 0, 1)


def _slots_of(grams: np.ndarray, slot_bits: int) -> list[np.ndarray]:
    """The slots of 64-bit hashes: the leading bits of each, mixed, times each factor."""
    return [((grams ^ (grams >> np.uint64(32))) * f >> np.uint64(64 - slot_bits)).astype(np.int64) for f in FACTORS]


def _own_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(number, text) -> the distinct n-grams of each block of a language's texts."""
    for pdf in batches:
        for number, texts in pdf.groupby("number")["text"]:
            for block in _blocks(texts.tolist()):
                for n in GRAMS:
                    yield pd.DataFrame({"number": number, "gram": np.unique(_grams(block, n)[1]).view(np.int64)})


def slot_bits_for(grams: int, languages: int) -> int:
    """Enough slots for the richest language, as far as all slots together stay in ``FILTER_BYTES``."""
    wanted = max(grams * SLOTS_A_GRAM, 1 << 10).bit_length()
    return min(wanted, (FILTER_BYTES // (8 * ((languages + 63) // 64 or 1))).bit_length() - 1)


def overfull(grams: int, slot_bits: int) -> bool:
    """Whether so many n-grams are expected to fill more than ``FILL`` of the slots."""
    return grams * HASHES > -math.log(1 - FILL) * (1 << slot_bits)


def fit_language_filters(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> LanguageFilters:
    """Learn the filters from at most about ``sample_docs`` whole texts of each language, chosen by hash of the id.

    A language's filter takes every n-gram of those texts; where they would fill more than ``FILL`` of the slots, half
    as many texts are taken, and so on. The slots are filled on Spark; to the driver go the slots themselves, at most
    ``FILTER_BYTES``, which are the model. Rows without text or language are passed over; without
    any row the filters know no language.
    """
    rows = labelled.select(labelled[id_col].alias("id"), labelled[lang_col].alias("lang"), labelled[text_col].alias("text")).where("lang is not null and text is not null")
    sizes = checkpointed(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    languages = tuple(sorted(r["lang"] for r in sizes.select("lang").collect()))  # the names are part of the model
    if not languages:
        return LanguageFilters((), np.zeros((1, 1), np.uint64), np.zeros(0))
    numbers = rows.sparkSession.createDataFrame([(lang, i) for i, lang in enumerate(languages)], "lang string, number int")
    sizes = sizes.join(numbers, "lang")
    sizes = F.broadcast(sizes) if len(languages) <= BROADCAST_LANGUAGES else sizes
    while True:
        chosen = rows.join(sizes, "lang").where(hash_share(F.col("id").cast("string"), F.least(F.lit(1.0), sample_docs / F.col("n")), 9))
        grams = checkpointed(chosen.select("number", "text").mapInPandas(_own_grams, "number int, gram long").distinct())
        richest = grams.groupBy("number").count().agg(F.max("count")).first()[0] or 0
        bits = slot_bits_for(richest, len(languages))
        if not overfull(richest, bits) or sample_docs <= 1:
            break
        sample_docs = sample_docs // 2

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            number, slots = pdf["number"].to_numpy(), _slots_of(pdf["gram"].to_numpy().view(np.uint64), bits)
            mask = np.left_shift(np.uint64(1), (number % 64).astype(np.uint64)).view(np.int64)
            for at in slots:
                yield pd.DataFrame({"word": number // 64, "slot": at, "mask": mask})

    filled = grams.mapInPandas(fill, "word int, slot long, mask long")
    filled = filled.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    return LanguageFilters.of_slots(languages, bits, filled["word"].to_numpy(), filled["slot"].to_numpy(), filled["mask"].to_numpy(np.int64).view(np.uint64))


def language_column(spark: SparkSession, filters: LanguageFilters, text: Column) -> Column:
    """Struct (lang_pred, score, share): the language, its part of all languages' shares, its corrected share itself.

    Of languages with equal shares, also where every share is 0, the first by name is taken. ``und`` with score 0 for
    null, for a text without any letter, and where no language was learned.
    """
    shipped = spark.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double, share double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = shipped.value
        for s in batches:
            texts = [x if isinstance(x, str) and any(map(str.isalpha, x)) else None for x in s]
            known = np.array([x is not None for x in texts], bool) & bool(f.languages)
            shares = f.shares(texts) if f.languages else np.zeros((len(texts), 1))
            best = shares.argmax(1) if len(texts) else np.zeros(0, int)
            top = shares[np.arange(len(texts)), best]
            score = np.divide(top, shares.sum(1), out=np.zeros(len(texts)), where=shares.sum(1) > 0)
            yield pd.DataFrame({"lang_pred": [f.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], "score": np.where(known, score, 0.0), "share": np.where(known, top, 0.0)})

    return predict(text)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 5, remainder: int = 0) -> DataFrame:
    """All rows of ``docs`` with held_out, lang_pred, score, share added; learns only from rows that aren't held out.

    Every text is scored whole. Null and letterless texts get ``und`` and 0; languages that tie are settled by name.
    Rows with a null id are scored but never learned from. Repeated rows get equal results. Columns of ``docs`` named
    like the four new ones are replaced, all others kept. An empty table gives an empty result.
    """
    docs, names = numbered(docs)
    out = held_out(F.col(names[id_col]), modulus, remainder)
    filters = fit_language_filters(docs.where(~out), names[lang_col], names[text_col], names[id_col])
    found = docs.withColumns({"found": language_column(docs.sparkSession, filters, F.col(names[text_col])), "held_out": out})
    kept = {old: new for old, new in names.items() if old not in ADDED}
    return named(found, kept, "held_out", *(F.col(f"found.{c}").alias(c) for c in ADDED[1:]))
