"""Retrieval for a table of queries: lexical scores, snippets, vectors, fusion, context and citations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from papyr.functions.text import SPACE, let, trim_all
from papyr.operators.joins import join_by_hot_key
from papyr.operators.storage import shared_checkpoint

STRIP = "'\":*&|!()\\"
#: Queries that one pass over the chunks looks for, and words of whole passages among them.
QUERIES_AT_ONCE, TERMS_AT_ONCE = 65_536, 2_000_000
#: Texts that are matched at once, queries of a group, their words, and bytes of a group's table, about.
TEXTS_AT_ONCE, GROUP_QUERIES, GROUP_TERMS, TABLE_BYTES = 2048, 2048, 1 << 16, 1 << 26
#: Pairs of queries and chunks that a task holds at once, about; pieces of texts that it remembers, and the longest of them.
PAIRS, PIECES_KNOWN, PIECE = 1 << 17, 1 << 17, 64
#: Weight of a position, its highest number and count a word, and the limit of the sum of 1 / n^2 (fixed values).
WEIGHT, LAST_POSITION, MOST_POSITIONS, LIMIT = 0.1, 16383, 256, 1.64493406685
#: What scores may gain when they are rounded.
ROUNDING = 1e-4
#: What two places add to the logarithm of a rank, by their distance: nothing at 0, next to nothing from 101 on.
APART = np.log1p(-WEIGHT * np.sqrt(np.append(1 / (1.005 + 0.05 * np.exp(np.arange(101) / 1.5 - 2)), 1e-30))) * (np.arange(102) > 0)
#: Places of a query's words in a text whose distances are worked out at once.
PLACES_AT_ONCE = 256
TOKEN = re.compile(r"[^\W_]+")
#: Vectors are compared in blocks of this many queries.
QUERY_BLOCK = 512
#: Vectors or queries of a user and model that one group holds, about.
SLICE = 20_000


def query_terms(query: Column) -> Column:
    """Words of a query without operators, of two characters or more; the whole query where none is left."""
    words = F.transform(F.split(trim_all(query), rf"[{SPACE}]+"), lambda w: F.translate(w, STRIP, ""))
    kept = F.filter(words, lambda w: F.length(w) >= 2)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(trim_all(query)))


def round4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


@dataclass(frozen=True)
class KeywordQueries:
    """A block of queries: ids and their type, whole texts, search words, and words for the full-text rank, all in lower case."""

    ids: list
    kind: str
    wholes: list[str]
    terms: list[list[str]]
    tokens: list[list[str]]

    def distinct(self) -> tuple[KeywordQueries, np.ndarray]:
        """The block with equal queries once, under the first one's id, and the number that each of its queries has there."""
        known: dict[tuple, int] = {}
        of = np.array([known.setdefault((whole, tuple(terms), tuple(tokens)), len(known)) for whole, terms, tokens in zip(self.wholes, self.terms, self.tokens, strict=True)], np.int64)
        first = np.unique(of, return_index=True)[1].tolist()
        return KeywordQueries([self.ids[i] for i in first], self.kind, *([own[i] for i in first] for own in (self.wholes, self.terms, self.tokens))), of


class WordMatcher:
    """Finds all search words and whole texts of a block of queries in a text, each distinct one once.

    Words hold no white space, so they are looked for in the distinct pieces of a text between white space; what a piece
    holds is remembered.
    """

    def __init__(self, wholes: list[str], terms: list[list[str]]) -> None:
        self.count = len(wholes)
        self.n_terms = np.array([max(len(t), 1) for t in terms])
        needles: dict[str, tuple[list[int], list[int]]] = {}
        for i, (whole, own) in enumerate(zip(wholes, terms, strict=True)):
            needles.setdefault(whole, ([], []))[1].append(i)
            for term in own:
                needles.setdefault(term, ([], []))[0].append(i)
        self.short = {j: np.array(own[0], np.int32) for j, (n, own) in enumerate(needles.items()) if own[0] and len(n) < 3}
        self.long = {j: np.array(own[0], np.int32) for j, (n, own) in enumerate(needles.items()) if own[0] and len(n) >= 3}
        self.whole = {j: np.array(own[1], np.int32) for j, own in enumerate(needles.values()) if own[1]}
        self.spaced, self.plain = ahocorasick.Automaton(), ahocorasick.Automaton()
        for j, needle in enumerate(needles):
            (self.plain if len(needle.split()) == 1 and not re.search(r"\s", needle) else self.spaced).add_word(needle, j)
        for automaton in (self.spaced, self.plain):
            automaton.make_automaton()
        self.known: dict[str, tuple[int, ...]] = {}

    def _sum(self, of: dict[int, np.ndarray], hits: set[int]) -> np.ndarray:
        lists = [of[j] for j in of.keys() & hits]
        return np.bincount(np.concatenate(lists), minlength=self.count) if lists else np.zeros(self.count, np.int64)

    def _held(self, piece: str) -> tuple[int, ...]:
        own = self.known.get(piece)
        if own is None:
            own = tuple({j for _, j in self.plain.iter(piece)})
            if len(piece) <= PIECE:
                if len(self.known) >= PIECES_KNOWN:
                    self.known.clear()
                self.known[piece] = own
        return own

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query: the number of its words that the text holds, of those of three characters or more, and whether it holds the whole query."""
        hits = set().union(*map(self._held, set(text.split()))) if len(self.plain) else set()
        if len(self.spaced):
            hits.update(j for _, j in self.spaced.iter(text))
        long = self._sum(self.long, hits)
        return self._sum(self.short, hits) + long, long, self._sum(self.whole, hits) > 0


class Holders:
    """Sets of words (``sets``, of which an empty one is never held): which of them a text's words hold whole."""

    def __init__(self, sets: list[Iterable[str]]) -> None:
        own: dict[str, list[int]] = {}
        for i, words in enumerate(sets):
            for w in words:
                own.setdefault(w, []).append(i)
        self.of = {w: np.array(i, np.int32) for w, i in own.items()}
        self.sizes = np.array([len(set(words)) for words in sets], np.int64)

    def full(self, words: set[str]) -> np.ndarray:
        lists = [self.of[w] for w in words & self.of.keys()]
        if not lists:
            return np.empty(0, np.int64)
        return np.flatnonzero((np.bincount(np.concatenate(lists), minlength=len(self.sizes)) == self.sizes) & (self.sizes > 0))


def word_places(words: Iterable[str], wanted: set[str]) -> dict[str, np.ndarray]:
    """The places (from 1) of the wanted ones of a text's words in order, as many as count; an empty word has a place only."""
    places: dict[str, list[int]] = {}
    for at, word in enumerate(words, 1):
        if word in wanted:
            own, at = places.setdefault(word, []), min(at, LAST_POSITION)
            if len(own) < MOST_POSITIONS and not (own and own[-1] == at):
                own.append(at)
    return {w: np.array(own) for w, own in places.items()}


@dataclass(frozen=True)
class Hits:
    """Which words a batch of texts hold: a word's number and a text's place, each pair once."""

    words: np.ndarray
    texts: np.ndarray
    n_texts: int

    @classmethod
    def of(cls, held: list[set[int]]) -> Hits:
        sizes = [*map(len, held)]
        return cls(np.fromiter(chain.from_iterable(held), np.int32, sum(sizes)), np.repeat(np.arange(len(held), dtype=np.int32), sizes), len(held))


class RowSets:
    """Lists of words of a group of queries, as rows of a table that has a byte for each of their words and a text."""

    def __init__(self, sets: list[list[int]], n_words: int) -> None:
        flat = np.array([*chain.from_iterable(sets)], np.int64)
        self.used, self.n_words = np.unique(flat), n_words
        self.flat, self.ends = np.searchsorted(self.used, flat), np.cumsum([0, *map(len, sets)])

    def table(self, hits: Hits) -> np.ndarray:
        row = np.full(self.n_words, -1, np.int32)
        row[self.used] = np.arange(len(self.used))
        own = row[hits.words]
        there = own >= 0
        table = np.zeros((len(self.used), hits.n_texts), np.uint8)
        table[own[there], hits.texts[there]] = 1
        return table

    def rows(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] : self.ends[i + 1]]

    def count(self, i: int, table: np.ndarray) -> np.ndarray:
        """How many of a list's words each text has, repeated ones as often as they come."""
        rows = self.rows(i)
        if len(rows) <= 255:  # as many as a byte counts
            return np.add.reduce(table[rows], axis=0, dtype=np.uint8)
        return sum(np.add.reduce(table[rows[at : at + 255]], axis=0, dtype=np.uint8).astype(np.int64) for at in range(0, len(rows), 255))

    def held(self, table: np.ndarray, lists: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Of some lists those, none of them empty, that some text has whole, and the texts."""
        there = np.r_[0, np.cumsum(table.any(axis=1)[self.flat])]
        begin, end = self.ends[lists], self.ends[lists + 1]
        for i in lists[(end > begin) & (there[end] - there[begin] == end - begin)].tolist():
            rows = self.rows(i)
            parts = (np.bitwise_and.reduce(table[rows[at : at + 255]], axis=0) for at in range(0, len(rows), 255))
            texts = np.flatnonzero(reduce(np.bitwise_and, parts))
            if len(texts):
                yield i, texts


class Group:
    """Queries of a block that share a table: their search words, the pieces between white space, longer words, and words of their ranks."""

    def __init__(self, queries: range, words: dict[str, int], block: KeywordQueries, tokens: dict[str, int], ranks) -> None:
        self.queries, n = queries, len(queries)
        terms = [block.terms[i] for i in queries]
        #: Queries with words of less than three characters, too: a text that holds those alone doesn't qualify.
        self.short = [any(len(t) < 3 for t in own) for own in terms]
        long = [[t for t in own if len(t) >= 3] if short else [] for own, short in zip(terms, self.short, strict=True)]
        self.words = RowSets([[words[w] for w in own] for own in chain(terms, (block.wholes[i].split() or [block.wholes[i]] for i in queries), long)], len(words))
        sets = [(i, most, own) for i in queries for most, own in ranks.demanded(i)]
        self.of_set, self.tokens = np.array([i for i, *_ in sets], np.int64), RowSets([[tokens[w] for w in own] for *_, own in sets], len(tokens))
        self.most = np.array([most for _, most, _ in sets]) + ROUNDING
        self.n_rows = max(len(self.words.used), len(self.tokens.used), 1)

    def alone(self, texts: list[str], wholes: list[str], table: np.ndarray, hits: Hits, worst: np.ndarray) -> tuple[dict[int, dict[int, bool]], dict[int, np.ndarray]]:
        """Of a query: the texts that may have a rank or hold it whole, and whether they do hold it whole; and those whose rank doesn't come up to its worst score."""
        found: dict[int, dict[int, bool]] = {}
        low: dict[int, np.ndarray] = {}
        for j, own in self.tokens.held(self.tokens.table(hits), np.arange(len(self.of_set))):
            i = int(self.of_set[j])
            if self.most[j] >= worst[i]:
                found.setdefault(i, {}).update(dict.fromkeys(own.tolist(), False))
            else:
                low[i] = np.union1d(low[i], own) if i in low else own
        n = len(self.queries)
        for j, own in self.words.held(table, np.arange(n, 2 * n)):
            i = self.queries[j - n]
            if at := [t for t in own.tolist() if wholes[i] in texts[t]]:
                found.setdefault(i, {}).update(dict.fromkeys(at, True))
        return found, low

    def best_shares(self, j: int, counts: np.ndarray, table: np.ndarray, fewest: int, k: int, n_terms: int) -> np.ndarray:
        """The ``k`` texts that hold most words of a query, the first ones of equal scores, of those that hold ``fewest`` and qualify."""
        at = np.flatnonzero(counts >= fewest)
        at = at[self.long(j, at, table)]
        return at if len(at) <= k else at[np.argsort(-_partial(counts[at].astype(np.int64), n_terms), kind="stable")[:k]]

    def long(self, j: int, texts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Which of the texts, all with a search word of the query, hold one of three characters or more."""
        if not (len(texts) and self.short[j]):
            return np.ones(len(texts), bool)
        return table[self.words.rows(2 * len(self.queries) + j)][:, texts].any(axis=0)


class KeywordRanks:
    """The ranks of a block's queries in the texts that have all words of one, by the rules of ``KeywordMatcher``."""

    #: Columns of ranks and the factors by which they count.
    factors = {"text_rank": 1.5}

    def __init__(self, block: KeywordQueries) -> None:
        self.block = block

    def demanded(self, i: int) -> list[tuple[float, list[str]]]:
        """Lists of words of a query, and what a rank adds up to at most by one; a text has a rank only if it has all words of a list."""
        return [(self.factors["text_rank"] * (WEIGHT if len(self.block.tokens[i]) == 1 else 1.0), self.block.tokens[i])]

    def words(self, text: str) -> list[str]:
        return TOKEN.findall(text)

    def of(self, words: list[str], queries: list[int]) -> list[tuple[float, ...]]:
        own = [tuple(self.block.tokens[i]) for i in queries]
        places = word_places(words, {*chain.from_iterable(own)})
        ranks = {tokens: text_rank([places[t] for t in tokens]) if tokens and all(t in places for t in tokens) else 0.0 for tokens in {*own}}
        return [(ranks[tokens],) for tokens in own]


class KeywordMatcher:
    """Scores a block of queries against one text after another."""

    Ranks = KeywordRanks

    def __init__(self, block: KeywordQueries) -> None:
        self.block, self.count = block, len(block.ids)
        self.found = WordMatcher(block.wholes, block.terms)
        self.holders = Holders(block.tokens)

    def ranks(self, text: str) -> dict[int, float]:
        """Of each query all of whose words the text has: the full-text rank."""
        tokens = TOKEN.findall(text)
        full = self.holders.full(set(tokens)).tolist()
        places = word_places(tokens, {t for i in full for t in self.block.tokens[i]}) if full else {}
        return {i: text_rank([places[t] for t in self.block.tokens[i]]) for i in full}

    def scores(self, text: str) -> dict[str, np.ndarray]:
        """Of the queries that qualify: query (its number), whole, partial_score, text_rank, keyword_score."""
        found, long, whole = self.found.words(text)
        rank = np.zeros(self.count)
        for i, r in self.ranks(text).items():
            rank[i] = r
        at = np.flatnonzero((long > 0) | whole | (rank > 0))
        whole, rank, partial = whole[at], rank[at], 0.10 + 0.35 * (found / self.found.n_terms)[at]
        score = np.maximum(np.maximum(np.where(whole, 0.95, 0.0), 1.5 * rank), partial)
        return {"query": at, "whole": whole, "partial_score": rounded4(partial), "text_rank": rank, "keyword_score": rounded4(score)}

    def rank_rows(self, text: str) -> dict[str, np.ndarray]:
        """Of the queries all of whose words the text has: query and text_rank."""
        ranks = self.ranks(text)
        return {"query": np.array(list(ranks), np.int64), "text_rank": np.array(list(ranks.values()), float)}


def rounded4(x: np.ndarray) -> np.ndarray:
    """``round4`` of an array."""
    return np.floor(x * 10000 + 0.5) / 10000


class Best:
    """The ``k`` best rows of each query of a block, of those that a task has seen: by score, then by chunk id."""

    def __init__(self, count: int, k: int) -> None:
        self.k, self.worst, self.parts, self.size = k, np.full(count, -np.inf), [], 0

    def add(self, rows: dict[str, np.ndarray], chunk: pa.Array) -> None:
        keep = np.flatnonzero(rows["keyword_score"] >= self.worst[rows["query"]])
        if len(keep):
            self.parts.append(pa.table({**{n: v[keep] for n, v in rows.items()}, "chunk_id": chunk.take(pa.array(keep))}))
            self.size += len(keep)
            if self.size >= PAIRS + 2 * self.k * len(self.worst):
                self.rows()

    def rows(self) -> pa.Table | None:
        """What is kept so far; scores below it are passed over from now on."""
        if not self.parts:
            return None
        rows = pa.concat_tables(self.parts)
        rows = rows.take(pc.sort_indices(rows, [("query", "ascending"), ("keyword_score", "descending"), ("chunk_id", "ascending")], null_placement="at_start"))
        query, score = rows["query"].to_numpy(), rows["keyword_score"].to_numpy()
        begin = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        nth = np.arange(len(query)) - np.repeat(begin, np.diff(np.r_[begin, len(query)]))
        last = nth == self.k - 1
        self.worst[query[last]] = score[last]
        rows = rows.filter(pa.array(nth < self.k)).combine_chunks()
        self.parts, self.size = [rows], len(rows)
        return rows


class BestPairs:
    """The ``k`` best texts of each query of a block, of those that a task has seen.

    Each text is searched once for the words of all queries. How many words of a query the texts of a batch hold is then
    the sum of some rows of bytes, for all of them at once (``RowSets``). A text that holds a whole query or has a rank
    is scored by itself, any other by its share of the query's words alone: of these only those that come up to the
    ``k``-th best score so far are looked at.
    """

    def __init__(self, block: KeywordQueries, ranks, k: int) -> None:
        self.block, self.ranks, self.k, count = block, ranks, k, len(block.ids)
        self.words: dict[str, int] = {}
        self.tokens: dict[str, int] = {}
        for i, (whole, own) in enumerate(zip(block.wholes, block.terms, strict=True)):
            for w in chain(own, whole.split() or [whole]):
                self.words.setdefault(w, len(self.words))
            for w in chain.from_iterable(own for _, own in ranks.demanded(i)):
                self.tokens.setdefault(w, len(self.tokens))
        self.finder = ahocorasick.Automaton()
        for word, j in self.words.items():
            self.finder.add_word(word, j)
        self.finder.make_automaton()
        self.n_terms = np.array([max(len(t), 1) for t in block.terms])
        self.groups, begin, size = [], 0, 0
        for i, own in enumerate(block.terms):
            size += len(own)
            if i + 1 == count or i + 1 - begin >= GROUP_QUERIES or size >= GROUP_TERMS:
                self.groups.append(Group(range(begin, i + 1), self.words, block, self.tokens, ranks))
                begin, size = i + 1, 0
        self.at_once = int(np.clip(TABLE_BYTES // max(g.n_rows for g in self.groups), 64, TEXTS_AT_ONCE))
        self.best, self.least, self.kept = Best(count, k), np.ones(count, np.int64), 0

    def add(self, batch: pa.RecordBatch) -> None:
        """The texts (chunk_id, content) of a batch."""
        batch = batch.take(pc.sort_indices(batch.column("chunk_id"), null_placement="at_start"))  # equal scores go by chunk
        for begin in range(0, batch.num_rows, self.at_once):
            part = batch.slice(begin, self.at_once)
            rows = self._rows(part.column("content").to_pylist())
            self.best.add(rows, part.column("chunk_id").take(pa.array(rows.pop("text"))))
            if self.best.size - self.kept >= self.k * len(self.least) // 2:
                self.kept = len(self.best.rows())
                self.least = _least_counts(self.best.worst, self.n_terms)

    def _rows(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Rows (query, text, whole, the ranks, partial_score, keyword_score) that may be among the ``k`` best of their query."""
        words = [self.ranks.words(text) for text in texts]
        held = Hits.of([{*map(itemgetter(1), self.finder.iter(text))} for text in texts])
        there = Hits.of([{self.tokens[w] for w in self.tokens.keys() & own} for own in words])
        shares: list[tuple[int, np.ndarray, np.ndarray]] = []  # query, texts, words that they hold
        alone: dict[int, list[tuple[int, int, bool]]] = {}  # of a text: query, words of it that it holds, and whether it holds it whole
        least = self.least.tolist()
        for group in self.groups:
            table = group.words.table(held)
            own, low = group.alone(texts, self.block.wholes, table, there, self.best.worst)
            for j, i in enumerate(group.queries):
                counts = group.words.count(j, table)
                at = group.best_shares(j, counts, table, least[i], self.k, int(self.n_terms[i]))
                mine = own.get(i, {})
                if i in low:  # ranks that tell only where the share of words does, or whether the text qualifies
                    by_rank = low[i][counts[low[i]] >= least[i]]
                    for t in by_rank[np.isin(by_rank, at) | ~group.long(j, by_rank, table)].tolist():
                        mine.setdefault(t, False)
                for t, whole in mine.items():
                    alone.setdefault(t, []).append((i, int(counts[t]), whole))
                if len(at):
                    shares.append((i, at, counts[at].astype(np.int64)))
        scored = []
        for t, own in alone.items():
            for (i, n, whole), found in zip(own, self.ranks.of(words[t], [i for i, *_ in own]), strict=True):
                if whole or any(found):
                    scored.append((i, t, n, whole, *found))
        return self._scores(shares, scored, len(texts))

    def _scores(self, shares: list[tuple[int, np.ndarray, np.ndarray]], scored: list[tuple], n_texts: int) -> dict[str, np.ndarray]:
        factors = self.ranks.factors
        query, text, n, whole, *found = (np.array(x) for x in zip(*scored, strict=True)) if scored else (np.empty(0, np.int64),) * 3 + (np.empty(0, bool),) + (np.empty(0),) * len(factors)
        if shares:
            by_share = [np.repeat([i for i, *_ in shares], [len(at) for _, at, _ in shares]), *(np.concatenate(x) for x in [*zip(*shares, strict=True)][1:])]
            other = ~np.isin(by_share[0] * n_texts + by_share[1], query * n_texts + text)
            more = int(other.sum())
            query, text, n = (np.concatenate([x, y[other]]) for x, y in zip((query, text, n), by_share, strict=True))
            whole, *found = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (whole, *found))
        partial = _partial(n, self.n_terms[query])
        score = np.maximum.reduce([np.where(whole, 0.95, 0.0), *(f * r for f, r in zip(factors.values(), found, strict=True))])
        return {"query": query, "text": text, "whole": whole, **dict(zip(factors, found, strict=True)), "partial_score": partial, "keyword_score": np.maximum(rounded4(score), partial)}


def _partial(held: np.ndarray, n_terms: np.ndarray) -> np.ndarray:
    """The score of a share of a query's words."""
    return rounded4(0.10 + 0.35 * (held / n_terms))


def _least_counts(worst: np.ndarray, n_terms: np.ndarray) -> np.ndarray:
    """The least number of words, one at least, with which a text comes up to each query's worst score; one more than there are, if none does."""
    least = np.where(np.isfinite(worst), np.clip(np.ceil((worst - 0.10) / 0.35 * n_terms) + 1, 1, n_terms + 1), 1).astype(np.int64)
    while len(lower := np.flatnonzero((least > 1) & (_partial(least - 1, n_terms) >= worst))):
        least[lower] -= 1
    return least


def text_rank(places: list[np.ndarray]) -> float:
    """Rank of a text that has all words, by their positions: one word counts its places, several how near they are."""
    if len(places) == 1:
        return one_word_rank(len(places[0]))
    every = np.concatenate(places)
    if len(every) <= PLACES_AT_ONCE:
        word = np.repeat(np.arange(len(places)), [len(p) for p in places])
        apart = APART[np.minimum(np.abs(every[:, None] - every), 101)][word[:, None] > word].sum()
    else:
        apart = sum(APART[np.minimum(np.abs(places[i][:, None] - places[k]), 101)].sum() for i in range(len(places)) for k in range(i))
    return float(-np.expm1(apart)) or 1e-20


@lru_cache(MOST_POSITIONS + 1)
def one_word_rank(n: int) -> float:
    """Rank of a text that has a word at ``n`` places; ``WEIGHT`` at most."""
    return float((WEIGHT / np.arange(1, n + 1) ** 2).sum() / LIMIT)


def keyword_matches(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(chunk_id, content) x (query_id, query) -> query_id, chunk_id, whole, partial_score, text_rank, keyword_score.

    A chunk qualifies where it holds the whole query, a search word of three characters or more, or all words of the
    query as words. The score is the best of 0.95 for the whole query, 1.5 times the full-text rank, and 0.10 plus 0.35
    times the share of search words that it holds, all in lower case and without stemming. Blank queries and null
    chunks match nothing. The queries, a stated set, are looked for in blocks; chunks are read once a block and never
    shuffled.
    """
    return match_blocks(chunks, keyword_blocks(queries), KeywordMatcher, KeywordMatcher.scores, "whole boolean, partial_score double, text_rank double, keyword_score double")


def keyword_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id and keyword_score of the pairs of ``keyword_matches``."""
    return match_blocks(chunks, keyword_blocks(queries), KeywordMatcher, KeywordMatcher.scores, "keyword_score double")


def distinct_texts(chunks: DataFrame) -> DataFrame:
    """(chunk_id, content) -> of chunks with the same text that with the smallest id, once; chunks without text go.

    A score tells by the text alone, so that copies have the same for every query: they are left out before they are
    scored, and no pairs of queries and chunks are brought together.
    """
    keyed = chunks.where("content is not null").select("chunk_id", F.sha2("content", 256).alias("content_key"), "content")
    first = keyed.groupBy("content_key").agg(F.min("chunk_id").alias("chunk_id"))
    own = keyed.join(first, ["chunk_id", "content_key"], "left_semi")
    return own.groupBy("chunk_id", "content_key").agg(F.first("content").alias("content")).drop("content_key")


def text_ranks(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id and text_rank of the chunks that have all words of a query."""
    return match_blocks(chunks, keyword_blocks(queries), KeywordMatcher, KeywordMatcher.rank_rows, "text_rank double")


def keyword_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, keyword_score and rank of the ``k`` best pairs of each query in ``keyword_matches``.

    Each task passes on its own best alone, as many as ``k`` a query.
    """
    return top_k(match_blocks(chunks, keyword_blocks(queries), KeywordMatcher, KeywordMatcher.scores, "keyword_score double", k), "keyword_score", k)


def keyword_blocks(queries: DataFrame, tokens: bool = True) -> list[KeywordQueries]:
    """The queries that aren't blank, as blocks."""
    asked = queries.where(trim_all("query") != "").select("query_id", trim_all("query").alias("query"))
    low = F.lower("query")
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), 0)) if tokens else F.array().cast("array<string>")
    q = shared_checkpoint(asked.select("query_id", low.alias("query"), F.transform(query_terms(F.col("query")), F.lower).alias("terms"), words.alias("tokens")))
    sizes = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(-(-sizes[0] // QUERIES_AT_ONCE), -(-sizes[1] // TERMS_AT_ONCE), 1)
    out, kind, known = [], q.schema["query_id"].dataType.simpleString(), {}
    shared = lambda words: [known.setdefault(w, w) for w in words]
    for i in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect()  # one block of the stated queries
        out.append(KeywordQueries([r["query_id"] for r in rows], kind, [r["query"] for r in rows], [shared(r["terms"]) for r in rows], [shared(r["tokens"]) for r in rows]))
    return out


def match_blocks(chunks: DataFrame, blocks: list[KeywordQueries], matcher: type, scores: Callable, columns: str, k: int | None = None) -> DataFrame:
    """query_id, chunk_id and ``columns`` of all pairs for which ``scores`` of the matcher gives rows, or of each task's ``k`` best a query."""
    texts = chunks.select("chunk_id", F.lower("content").alias("content")).where("content is not null")
    return reduce(DataFrame.unionByName, [_match(texts, block, matcher, scores, columns, k) for block in blocks])


def _match(texts: DataFrame, block: KeywordQueries, matcher: type, scores: Callable, columns: str, k: int | None) -> DataFrame:
    schema = StructType.fromDDL(f"query_id {block.kind}, chunk_id {texts.schema['chunk_id'].dataType.simpleString()}, {columns}")
    shipped, types = texts.sparkSession.sparkContext.broadcast(block), to_arrow_schema(schema)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        if not own.ids:
            return
        ids = pa.array(own.ids, types.field("query_id").type)
        if not k:
            for rows, chunk in _rows_of(batches, matcher(own), scores):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows["query"])), chunk, *(pa.array(rows[n]) for n in types.names[2:])], schema=types)
            return
        distinct, of = own.distinct()
        best = BestPairs(distinct, matcher.Ranks(distinct), k)
        for batch in batches:
            best.add(batch)
        if (kept := best.best.rows()) is not None:
            by_query, copies = np.argsort(of, kind="stable"), np.bincount(of)
            query = kept["query"].to_numpy()
            row = np.repeat(np.arange(len(query)), copies[query])
            nth = np.arange(len(row)) - np.repeat(np.cumsum(copies[query]) - copies[query], copies[query])
            kept = kept.take(pa.array(row)).append_column("query_id", ids.take(pa.array(by_query[(np.cumsum(copies) - copies)[query[row]] + nth])))
            yield from kept.select(types.names).cast(types).to_batches(PAIRS)

    return texts.mapInArrow(match, schema)


def _rows_of(batches: Iterator[pa.RecordBatch], found, scores: Callable) -> Iterator[tuple[dict[str, np.ndarray], pa.Array]]:
    """The rows of one text after another, about ``PAIRS`` of them at once, and the chunk of each."""
    for batch in batches:
        keys, own, size = batch.column("chunk_id"), [], 0
        begin = 0
        for at in range(batch.num_rows):
            own.append(scores(found, batch.column("content")[at].as_py()))
            size += len(own[-1]["query"])
            if size >= PAIRS or at == batch.num_rows - 1:
                chunk = np.repeat(np.arange(begin, at + 1), [len(r["query"]) for r in own])
                if size:
                    yield {n: np.concatenate([r[n] for r in own]) for n in own[0]}, keys.take(pa.array(chunk))
                own, size, begin = [], 0, at + 1


def bm25_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(chunk_id, content) x (query_id, query) -> query_id, chunk_id, bm25 of the chunks that have a word of the query.

    Words are counted text by text, so that only the counts of the queries' words are kept, one short row a chunk; from
    these come the chunks that hold each word, and then the scores, both without bringing the pairs of queries and
    chunks together.
    """
    return reduce(DataFrame.unionByName, [_bm25(chunks, block) for block in keyword_blocks(queries, tokens=False)])


def _bm25(chunks: DataFrame, block: KeywordQueries) -> DataFrame:
    sc = chunks.sparkSession.sparkContext
    of: dict[str, list[int]] = {}
    for i, terms in enumerate(block.terms):
        for term in dict.fromkeys(terms):
            of.setdefault(term, []).append(i)
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    counted = StructType.fromDDL(f"chunk_id {kind}, n long, terms array<int>, counts array<int>")
    known, types = sc.broadcast({term: j for j, term in enumerate(of)}), to_arrow_schema(counted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column("content"):
                tokens = TOKEN.findall(text.as_py())
                own = Counter(tokens)
                held = own.keys() & known.value.keys()
                sizes.append(len(tokens))
                terms.append([known.value[t] for t in held])
                counts.append([own[t] for t in held])
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), *(pa.array(c, types.field(i).type) for i, c in enumerate((sizes, terms, counts), 1))], schema=types)

    texts = chunks.select("chunk_id", F.lower("content").alias("content")).where("content is not null")
    rows = shared_checkpoint(texts.mapInArrow(count, counted).where("n > 0"))
    docs, mean = rows.agg(F.count(F.lit(1)), F.avg("n")).first()
    holders = np.zeros(len(of))
    for term, df in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the words of one block of queries
        holders[term] = df
    weights = np.log(1 + (docs - holders + 0.5) / (holders + 0.5))
    first = np.cumsum([0, *map(len, of.values())])
    shipped = sc.broadcast((weights, first, np.array([i for own in of.values() for i in own], np.int64), block.ids))
    schema = StructType.fromDDL(f"query_id {block.kind}, chunk_id {kind}, bm25 double")
    out = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, first, askers, ids = shipped.value
        ids = pa.array(ids, out.field("query_id").type)
        for batch in batches:
            step = max(1, PAIRS // max(len(ids), 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lengths = part.column("terms").value_lengths().to_numpy()
                term, tf = part.column("terms").flatten().to_numpy(), part.column("counts").flatten().to_numpy().astype(float)
                chunk = np.repeat(np.arange(part.num_rows), lengths)
                gain = weights[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * part.column("n").to_numpy()[chunk] / mean))
                times = first[term + 1] - first[term]
                query = askers[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[term], times)]
                pair, nth = np.unique(np.repeat(chunk, times) * len(ids) + query, return_inverse=True)
                total = np.floor(np.bincount(nth, np.repeat(gain, times), len(pair)) * 1000 + 0.5) / 1000
                if len(pair):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(pair % len(ids))), part.column("chunk_id").take(pa.array(pair // len(ids))), pa.array(total)], schema=out)

    return rows.mapInArrow(score, schema)


def top_k(scores: DataFrame, score: str, k: int, by: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def snippet(content: Column, query: Column) -> Column:
    """200 characters around the first query term found, terms in bold; the first 200 where none is found."""
    terms = F.filter(F.split(F.lower(query), rf"[{SPACE}]+"), lambda t: F.length(t) > 2)

    def cut(clean: Column) -> Column:
        n = F.length(clean)
        start = F.concat(F.substring(clean, 1, 200), F.when(n > 200, "...").otherwise(""))
        found = F.filter(F.transform(terms, lambda t: F.instr(F.lower(clean), t)), lambda p: p > 0)

        def around(at: Column) -> Column:
            first, last = F.greatest(at - 71, F.lit(0)), F.least(n, at + 129)
            window = F.concat(F.when(first > 0, "...").otherwise(""), F.substring(clean, first + 1, last - first), F.when(last < n, "...").otherwise(""))
            escaped = F.transform(terms, lambda t: F.concat(F.lit("(?iu)("), F.regexp_replace(t, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit(")")))
            return F.aggregate(escaped, window, lambda acc, p: F.regexp_replace(acc, p, F.lit("**$1**")))

        return F.when(F.size(found) > 0, let(F.get(found, F.lit(0)), around)).otherwise(start)

    return let(trim_all(F.regexp_replace(content, rf"[{SPACE}]+", " ")), cut)


def hash_embed_column(text: Column, dim: int = 64) -> Column:
    """Deterministic vector of a text: counts of hashed characters and trigrams, of length one."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([hash_embed(t or "", dim) for t in s], dtype=object)

    return embed(text)


def checked_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """The rows as they are; a missing vector or one of another dimension fails the job."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    wrong = F.concat(F.lit(f"expected {dim} dimensions but got "), size.cast("string"))
    return rows.withColumn("embedding", F.when(size == dim, F.col("embedding")).otherwise(F.raise_error(wrong).cast("array<float>")))


def hash_embed(text: str, dim: int) -> np.ndarray:
    units = np.frombuffer(text.lower().strip().encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.int64)
    vec = np.bincount((units * 31 + np.arange(len(units))) % dim, minlength=dim).astype(float)
    if len(units) > 2:
        vec += 2.0 * np.bincount((units[:-2] * 961 + units[1:-1] * 31 + units[2:]) % dim, minlength=dim)
    return (vec / (np.sqrt((vec * vec).sum()) or 1.0)).astype(np.float32)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(user_id, model, chunk_id, embedding) x (query_id, user_id, model, vector) -> query_id, chunk_id, semantic_score.

    Queries meet the vectors of their user and model only; each task multiplies a block of vectors with the block of
    queries and passes on its own best k a query, so that the shuffle to the final ranking stays small. A vector of
    length 0, that of an empty text, is like none: score 0.
    """

    def unit(x: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(length > 0, length, 1)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        a = unit(np.array(left["embedding"].tolist(), np.float64))
        for at in range(0, len(right), QUERY_BLOCK):
            part = right.iloc[at : at + QUERY_BLOCK]
            b = np.array(part["vector"].tolist(), np.float64)
            scores = np.round(np.maximum(unit(b) @ a.T, 0), 4)
            for q, row in zip(part["query_id"], scores, strict=True):
                order = np.lexsort((left["chunk_id"], -row))[:k]
                out.append(pd.DataFrame({"query_id": q, "chunk_id": left["chunk_id"].to_numpy()[order], "semantic_score": row[order]}))
        return pd.concat(out)

    queries = queries.select(*(F.col(c).alias(c) for c in queries.columns))  # they may be made of the same rows
    # A user with many vectors or queries is cut: each slice of the vectors meets each part of the queries in one group.
    keys = ["user_id", "model"]
    # Users with many of them meet their number of cuts by a broadcast, so that they aren't brought together before.
    count = lambda rows, name: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = shared_checkpoint(count(vectors, "v").join(count(queries, "q"), keys))
    total = both.agg(F.coalesce(F.sum(F.col("v") + F.col("q")), F.lit(0))).first()[0]
    cuts = both.select(*keys, F.ceil(F.col("v") / SLICE).alias("slices"), F.ceil(F.col("q") / SLICE).alias("parts"), F.greatest("v", "q").alias("n"))
    left = join_by_hot_key(vectors, cuts, keys, total).withColumn("slice", F.pmod(F.xxhash64("chunk_id"), "slices")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = join_by_hot_key(queries, cuts, keys, total).withColumn("part", F.pmod(F.xxhash64("query_id"), "parts")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    empty = pd.DataFrame({"query_id": [], "chunk_id": [], "semantic_score": []})
    keys += ["slice", "part"]
    groups = left.drop("slices", "parts").groupBy(*keys).cogroup(right.drop("slices", "parts").groupBy(*keys))
    near = groups.applyInPandas(lambda a, b: best(a, b) if len(a) and len(b) else empty, "query_id long, chunk_id long, semantic_score double")
    return top_k(near, "semantic_score", k)


def fuse(semantic: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Blend 0.6 of the semantic and 0.4 of the lexical score, each divided by its query's largest; the best k."""

    def normal(rows: DataFrame, score: str) -> DataFrame:
        most = F.greatest(F.max(score).over(Window.partitionBy("query_id")), F.lit(0.001))
        return rows.select("query_id", "chunk_id", (F.col(score) / most).alias(score))

    both = normal(semantic, "semantic_score").join(normal(lexical, "keyword_score"), ["query_id", "chunk_id"], "full_outer")
    s, w = F.col("semantic_score"), F.col("keyword_score")
    final = F.when(s.isNotNull() & w.isNotNull(), F.round(s, 4) * 0.6 + w * 0.4).when(s.isNotNull(), s * 0.6).otherwise(w * 0.4)
    rows = both.select("query_id", "chunk_id", F.coalesce(F.round(s, 4), F.lit(0.0)).alias("semantic_score"), F.coalesce(F.round(w, 4), F.lit(0.0)).alias("keyword_score"), F.round(final, 4).alias("final_score"))
    return top_k(rows, "final_score", k)


def text_semantic_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(chunk_id, content) x (query_id, query): nearest chunks by the hash vectors of the texts."""
    one = (F.lit(0).alias("user_id"), F.lit("hash").alias("model"))
    vectors = chunks.select(*one, "chunk_id", hash_embed_column(F.col("content")).alias("embedding"))
    return semantic_topk(vectors, queries.select("query_id", *one, hash_embed_column(F.col("query")).alias("vector")), k)


def hybrid_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``fuse`` of twice ``k`` semantic and lexical candidates each."""
    lexical = keyword_topk(chunks, queries, 2 * k)
    return fuse(text_semantic_topk(chunks, queries, 2 * k), lexical, k)


def cited_sources(answer: Column) -> Column:
    """Source numbers that an answer cites, in order of first mention, each once."""
    numbers = F.regexp_extract_all(answer, F.lit(r"(?i)[\[【]?Source\s*(\d+)[^\]】\n]*[\]】]?"), 1)
    return F.array_distinct(F.transform(numbers, lambda n: n.cast("int")))


#: What a prompt gets where nothing was found (fixed value).
NO_CONTEXT = "No relevant document context found."


def build_context(queries: DataFrame, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, query), (query_id, chunk_id, rank[, snippet]), (chunk_id, title, page, section, category, content) -> query_id, context.

    A source line and the whole text of each chunk in order of rank; of a chunk that is gone the snippet that was kept,
    if any. A query without results gets a fixed message.
    """
    if "snippet" not in ranked.columns:
        ranked = ranked.withColumn("snippet", F.lit(None).cast("string"))
    rows = ranked.select("query_id", "chunk_id", "rank", "snippet").join(chunks, "chunk_id", "left")
    text = F.replace(F.coalesce("content", "snippet", F.lit("")), F.lit("**"), F.lit(""))
    section = F.when(F.col("section").isNotNull(), F.concat(F.lit(" Section: "), F.col("section"), F.lit(","))).otherwise("")
    head = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.coalesce("title", F.lit("Document")), F.lit(", Page "), F.coalesce(F.col("page").cast("string"), F.lit("1")), F.lit(","),
        section, F.lit(" Category: "), F.coalesce("category", F.lit("General")), F.lit("]\n"),
    )
    lines = rows.select("query_id", "rank", F.concat(head, text).alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    context = F.array_join(F.transform("l", lambda x: x["line"]), "\n\n")
    return queries.select("query_id").join(lines, "query_id", "left").select("query_id", F.coalesce(context, F.lit(NO_CONTEXT)).alias("context"))
