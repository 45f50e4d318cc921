"""Alignment of two tokenizers' tokens over the same bytes, and the corpus-wide counts of the linked id pairs.

Texts are cut before each run of spaces that follows a character other than white space: there both tokenizers begin a
token, so a text's tokens are those of its units, and no group of overlapping tokens reaches over a cut. A worker
aligns each distinct unit once and remembers it; the tokens of all new units of a block are coalesced together.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from papyr.llm.common import checkpointed
from papyr.llm.sentencepiece_codec import SentencePieceModel

#: How a byte-level tokenizer cuts texts before merging (a fixed value of that kind of tokenizer).
BYTE_LEVEL_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNIT_STARTS = re.compile(r"(?<=\S)(?= +[^ ])")
SPACE_BEFORE_SPACE = re.compile(r"\s ")
#: Units that a worker remembers; beyond it begins anew (a matter of speed alone).
REMEMBERED = 400_000
#: Characters whose units are looked up at once, rows that are held as Python objects at once.
BLOCK, ROWS = 1 << 20, 256
#: Id pairs whose counts are broadcast at most: those that most documents hold.
BROADCAST_PAIRS = 1 << 20


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_level_table(tokenizer: Tokenizer) -> list[bytes]:
    alphabet = byte_level_alphabet()
    table = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for piece, i in tokenizer.get_vocab(with_added_tokens=True).items():
        table[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
    return table


def _ranked(spec: dict) -> tiktoken.Encoding | None:
    """The tokenizer for the tiktoken library, if its ids are in the order of its merges: the same ids, faster."""
    model, alphabet = spec["model"], byte_level_alphabet()
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["content"] for t in spec["added_tokens"]}
    ids = [model["vocab"][a + b] for a, b in merges]
    plain = {p: i for p, i in model["vocab"].items() if p not in special}
    if ids != sorted(set(ids)) or set(plain) != {*alphabet, *(a + b for a, b in merges)} or max(plain[c] for c in alphabet) > min(ids, default=256):
        return None
    return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks={bytes(map(alphabet.__getitem__, p)): i for p, i in plain.items()}, special_tokens={})


@dataclass
class Aligner:
    """Groups and links of texts; remembers the units that it has aligned.

    A unit's slot points to its numbers (tokens of either side, groups, links), its groups as text, and its distinct
    linked id pairs with how many links each has. ``a`` is a byte-level tokenizer file's content, ``b`` a model's.
    """

    a: bytes
    b: bytes
    slots: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        gc.set_threshold(1_000_000)  # units and ids are many small objects without cycles
        self.first = Tokenizer.from_str(self.a.decode())
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=self.b)
        model, spec = SentencePieceModel.parse(self.b), json.loads(self.a)
        self.bytes_a, self.bytes_b = _byte_level_table(self.first), model.piece_bytes()
        self.size_a, self.size_b = np.array([*map(len, self.bytes_a)]), np.array([*map(len, self.bytes_b)])
        splits = spec["pre_tokenizer"]
        self.by_units = model.splits_at_words and model.dummy_prefix and not (model.charsmap or model.squeeze_spaces)
        self.by_units &= not spec["normalizer"] and splits["type"] == "ByteLevel" and splits["use_regex"]
        ranked = _ranked(spec) if self.by_units else None
        self.encode_a = (lambda units: [*map(ranked.encode_ordinary, units)]) if ranked else lambda units: [e.ids for e in self.first.encode_batch_fast(units, add_special_tokens=False)]
        self.n_b = len(self.bytes_b)
        most = max(len(self.bytes_a), self.n_b)
        self.names = [f"{mark}{i}" for mark in ";,|," for i in range(most)]
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.slots.clear()
        self.numbers, self.texts = np.empty((0, 5), np.int64), []
        self.offsets, self.pairs, self.links = np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def units(self, text: str) -> Iterator[list[str]]:
        """The units of a space and ``text`` without the space that each begins with, in parts of about ``BLOCK`` characters."""
        whole, at = " " + text, 0
        while at < len(whole):
            cut = UNIT_STARTS.search(whole, at + BLOCK) if self.by_units else None
            end = cut.start() if cut else len(whole)
            part, at = whole[at + 1 : end], end
            if not self.by_units:
                yield [part]
            elif part[:1] == " " or part[-1:] == " " or SPACE_BEFORE_SPACE.search(part):
                yield [u[1:] for u in UNIT_STARTS.split(" " + part)]
            else:  # each space begins a unit
                yield part.split(" ")

    def learn(self, units: list[str]) -> None:
        """Align units that have no slot yet, all at once."""
        ids_a = self.encode_a([" " + u for u in units])
        ids_b = self.second.encode(units, num_threads=1)
        plain = [b" " + u.encode() for u in units]
        good = np.array([b"".join([self.bytes_a[i] for i in x]) == p == b"".join([self.bytes_b[i] for i in y]) for x, y, p in zip(ids_a, ids_b, plain, strict=True)])
        if not good.all():  # their bytes can't be laid over each other: no tokens
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, good, strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.array([*map(len, ids)], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        group_a, group_b = coalesce(self.size_a[a], self.size_b[b])
        n_groups = int(group_a[-1]) + 1 if len(a) else 0
        unit_of = np.zeros(n_groups, np.int64)
        unit_of[group_a] = np.repeat(np.arange(len(units)), n_a)
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        per_unit = lambda x: np.bincount(unit_of, x, len(units)).astype(np.int64)
        numbers = np.stack([n_a, n_b, per_unit(np.ones(n_groups)), per_unit(in_a * in_b), ~good], 1)

        # Each group's distinct ids of either side with their counts, then all pairs of them.
        own_a, count_a = np.unique(group_a * self.most + a, return_counts=True)
        own_b, count_b = np.unique(group_b * self.most + b, return_counts=True)
        distinct_b = np.bincount(own_b // self.most, minlength=n_groups)
        begin_b = np.cumsum(distinct_b) - distinct_b
        of = own_a // self.most
        wide = distinct_b[of]
        row = np.repeat(np.arange(len(own_a)), wide)
        col = np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide) + begin_b[of][row]
        pairs = own_a[row] % self.most * self.n_b + own_b[col] % self.most
        held = np.bincount(unit_of[of[row]], minlength=len(units))

        # Groups as text: each id with the mark before it, in the order of groups, A before B.
        side = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
        group, ids = np.concatenate([group_a, group_b]), np.concatenate([a, b])
        order = np.argsort(group * 2 + side, kind="stable")
        key = (group * 2 + side)[order]
        later = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.empty(0, bool)
        names = [self.names[i] for i in ((2 * side[order] + later) * self.most + ids[order]).tolist()]
        ends = np.cumsum(n_a + n_b).tolist()
        self.texts += ["".join(names[x:y])[1:] for x, y in zip([0, *ends], ends, strict=False)]

        base = len(self.slots)
        self.slots.update(zip(units, range(base, base + len(units)), strict=True))
        self.numbers = np.concatenate([self.numbers, numbers])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(held)])
        self.pairs, self.links = np.concatenate([self.pairs, pairs]), np.concatenate([self.links, count_a[row] * count_b[col]])

    def align(self, texts: list[str | None]) -> list[tuple | None]:
        """(tokens A, tokens B, groups, links, groups as text, distinct pairs, links of each) of each text.

        None where the text is null or empty or its tokens' bytes differ between the sides.
        """
        found: list[tuple | None] = []
        some: list[tuple[int, list[str]]] = []
        parts: list[list[tuple]] = [[] for _ in texts]
        size = 0

        def flush() -> None:
            nonlocal some, size
            if some:
                for (i, _), part in zip(some, self._parts([units for _, units in some]), strict=True):
                    parts[i].append(part)
            some, size = [], 0

        for i, text in enumerate(texts):
            for units in self.units(text) if text else ():
                some.append((i, units))
                size += sum(map(len, units)) if len(text) > BLOCK else len(text)
                if size >= BLOCK:
                    flush()
        flush()
        for own in parts:
            numbers = sum((p[0] for p in own), np.zeros(5, np.int64))
            if not own or numbers[4]:
                found.append(None)
            elif len(own) == 1:
                found.append((*numbers[:4].tolist(), *own[0][1:]))
            else:  # a long text: its parts' pairs come together
                pairs, at = np.unique(np.concatenate([p[2] for p in own]), return_inverse=True)
                links = np.bincount(at, np.concatenate([p[3] for p in own]), len(pairs)).astype(np.int64)
                found.append((*numbers[:4].tolist(), ";".join(p[1] for p in own), pairs, links))
        return found

    def _parts(self, rows: list[list[str]]) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Numbers, groups as text, distinct pairs and their links of each row of units."""
        if len(self.slots) > REMEMBERED:
            self._forget()
        units = [*chain.from_iterable(rows)]
        at = [*map(self.slots.get, units)]
        if missing := [k for k, i in enumerate(at) if i is None]:
            self.learn([*dict.fromkeys([units[k] for k in missing])])
            for k in missing:
                at[k] = self.slots[units[k]]
        slot = np.array(at, np.int64)
        n = np.array([*map(len, rows)])
        ends = np.cumsum(n)
        numbers = np.add.reduceat(self.numbers[slot], ends - n)
        wide = self.offsets[slot + 1] - self.offsets[slot]
        place = np.arange(wide.sum()) + np.repeat(self.offsets[slot] - (np.cumsum(wide) - wide), wide)
        key = np.repeat(np.repeat(np.arange(len(rows)), n), wide) << 40 | self.pairs[place]
        links = self.links[place]
        if links.sum() <= 2 * len(links) + 64:
            key = np.sort(np.repeat(key, links))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            links, key = np.diff(np.append(first, len(key))), key[first]
        else:
            key, where = np.unique(key, return_inverse=True)
            links = np.bincount(where, links, len(key)).astype(np.int64)
        cuts = np.searchsorted(key, np.arange(len(rows) + 1) << 40)
        pairs = key & (1 << 40) - 1
        begin = 0
        for i, end in enumerate(ends.tolist()):
            yield numbers[i], ";".join([self.texts[x] for x in at[begin:end]]), pairs[cuts[i] : cuts[i + 1]], links[cuts[i] : cuts[i + 1]]
            begin = end


def coalesce(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B token, given their sizes in bytes: both sides cover the same bytes, in order.

    The tokens of both sides are taken by start; a group ends where a start reaches the largest end before it.
    """
    end = np.concatenate([np.cumsum(size_a), np.cumsum(size_b)])
    start = end - np.concatenate([size_a, size_b])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(size_a)], group[len(size_a) :]


@lru_cache(1)
def aligner(a: bytes, b: bytes) -> Aligner:
    return Aligner(a, b)


def _lists(rows: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    sizes = [0 if r is None else len(r) for r in rows]
    values = np.concatenate([np.empty(0, np.int64), *(r for r in rows if r is not None)])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype())))


def align_documents(docs: DataFrame, a: bytes, b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, groups, pairs, pair_links.

    ``a`` (a byte-level tokenizer's file) encodes a space and the text, ``b`` (a SentencePiece model, which adds the
    space itself) the text, both without special tokens. groups: ids of the tokens between the byte offsets where
    both sides end a token, as ``a1,a2|b1;a3|b2,b3``. pairs: the distinct linked ids, ascending, as
    ``a * vocabulary of b + b``; pair_links: how many links each has, all pairs of occurrences in one group. A null or
    empty text, or one whose tokens' bytes are not those of a space and the text (a normalising model, the metaspace
    character), has zeros, null groups and no pairs. Repeated rows and null ids give rows of their own; other columns
    are ignored; whole texts whatever their length, a part at a time. No shuffle; both files are bounded broadcasts.
    """
    sc = docs.sparkSession.sparkContext
    shipped = sc.broadcast((a, b))
    small = len(json.loads(a)["model"]["vocab"]) * len(SentencePieceModel.parse(b).pieces) < 1 << 31
    kind = pa.int32() if small else pa.int64()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = own.align(part.column("text").to_pylist())
                numbers = [pa.array([0 if x is None else x[i] for x in found], pa.int64()) for i in range(4)]
                text = pa.array([None if x is None else x[4] for x in found], pa.string())
                lists = [_lists([None if x is None else x[i] for x in found], k) for i, k in ((5, kind), (6, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *numbers, text, *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "pair_links"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string"
    return rows.mapInArrow(align, f"{schema}, pairs array<{'int' if small else 'bigint'}>, pair_links array<int>")


def weigh_links(aligned: DataFrame, n_b: int) -> DataFrame:
    """``aligned`` without pairs and pair_links, but with n_best and count_sum; all other columns as they are.

    A pair's count is the number of rows that hold it. n_best: links whose count is the highest that their A id has,
    ties included; count_sum: the counts of all links, added up. ``n_b``: the size of B's vocabulary. Rows without
    pairs have zeros; no rows: an empty table.

    The rows are checkpointed once. The counts of the pairs that most rows hold (``BROADCAST_PAIRS`` at most, found by
    a histogram) are broadcast, so that their links stay where they are; the links of the others are shuffled, and
    those are in few rows each. The best counts are as many as A's ids at most, whatever the corpus.
    """
    kept = [c for c in aligned.columns if c not in ("pairs", "pair_links")]
    rows = checkpointed(aligned.withColumn("_row", F.monotonically_increasing_id()))
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts)
    best = counts.groupBy(F.floor(F.col("pair") / n_b).alias("a")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("a", F.floor(F.col("pair") / n_b)).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("is_best"))
    step = F.floor(F.log2("n") * 16)
    bound, total = None, 0
    for s, m in sorted(counts.groupBy(step.alias("s")).count().collect(), reverse=True):  # some hundreds of steps at most
        total += m
        if total > BROADCAST_PAIRS:
            break
        bound = s
    often = F.lit(False) if bound is None else step >= bound
    hot = F.broadcast(counts.where(often))
    links = rows.select("_row", F.inline(F.arrays_zip("pairs", "pair_links"))).withColumnsRenamed({"pairs": "pair", "pair_links": "m"})

    def sums(joined: DataFrame) -> DataFrame:
        return joined.groupBy("_row").agg(F.sum(F.col("m") * F.col("is_best")).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum"))

    own = sums(links.join(hot, "pair"))
    rest = sums(links.join(hot.select("pair"), "pair", "left_anti").join(counts.where(~often), "pair"))
    both = own.unionByName(rest).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    numbers = [F.coalesce(both[c], F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.join(both, "_row", "left").select(*(rows[c] for c in kept), *numbers)
