"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model's protobuf is parsed, and normaliser, metaspace marker, merges or unigram scores, and byte fallback are
rebuilt as a ``tokenizers`` pipeline. Where no piece of the vocabulary reaches over a word's start, a text's ids are
the ids of its words, so a task encodes each distinct word once, in multithreaded batches, and checks it against the
sentencepiece library; otherwise whole texts are encoded and checked.
"""

from __future__ import annotations

import gc
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers, pre_tokenizers

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words that a worker remembers: so many that came once, and so many that came again (a matter of speed alone).
FRESH, FREQUENT = 100_000, 150_000
#: Threads that encode a batch: the cores of a task's worker.
THREADS = 2
#: Characters of texts whose words are looked up at once.
BLOCK = 1 << 19
#: Rows that are held as Python objects at once.
ROWS = 256
#: Piece kinds and model kinds of the format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields: varints as int, everything else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass(frozen=True)
class SentencePieceModel:
    """What of a model file matters here. pieces: (text, score, kind)."""

    pieces: list[tuple[str, float, int]]
    kind: int
    unk_id: int
    charsmap: bytes
    dummy_prefix: bool
    squeeze_spaces: bool
    escape_spaces: bool

    @staticmethod
    def parse(data: bytes) -> SentencePieceModel:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        return SentencePieceModel(pieces, trainer.get(3, UNIGRAM), unk, normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)))

    @property
    def splits_at_words(self) -> bool:
        """No piece has a marker after another character, so no merge can reach over a word's start."""
        own = [p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)]
        return self.escape_spaces and not any(MARK in p.lstrip(MARK) for p in own) and not any(k == USER_DEFINED for _, _, k in self.pieces)

    def tokenizer(self) -> Tokenizer:
        """The same model for the tokenizers library."""
        byte_fallback = any(kind == BYTE for _, _, kind in self.pieces)
        if self.kind == BPE:
            ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            merges = []
            for piece, score, kind in self.pieces:
                if kind in (NORMAL, USER_DEFINED):
                    pairs = ((piece[:j], piece[j:]) for j in range(1, len(piece)))
                    own = sorted((ids[a], ids[b], a, b) for a, b in pairs if a in ids and b in ids)
                    merges += [(-score, n, a, b) for n, (_, _, a, b) in enumerate(own)]
            merges.sort(key=lambda m: m[0])  # stable: equal scores keep the order of their pieces
            unk = self.pieces[self.unk_id][0]
            built = Tokenizer(models.BPE(ids, [(a, b) for _, _, a, b in merges], unk_token=unk, fuse_unk=True, byte_fallback=byte_fallback))
        elif self.kind == UNIGRAM:
            built = Tokenizer(models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unk_id, byte_fallback=byte_fallback))
        else:
            raise ValueError(f"model type {self.kind}: only unigram and BPE models are known")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze_spaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]  # spaces alone
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if self.escape_spaces else " "))
        if self.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        built.normalizer = normalizers.Sequence(steps)
        if self.splits_at_words:
            built.pre_tokenizer = pre_tokenizers.Split(Regex(WORD.pattern), "isolated")
        own = [AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER_DEFINED]
        if own:
            built.add_tokens(own)
        return built

    def piece_bytes(self) -> list[bytes]:
        """What each id decodes to; control pieces decode to nothing."""
        out = []
        for text, _, kind in self.pieces:
            plain = text.replace(MARK, " ").encode()
            out.append(bytes([int(text[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else plain)
        return out


@dataclass
class Codec:
    """Encodes and decodes batches of texts; remembers the words that it has encoded and checked."""

    data: bytes
    model: SentencePieceModel = field(init=False)
    frequent: dict[str, bytes] = field(default_factory=dict)
    fresh: dict[str, bytes] = field(default_factory=dict)
    wrong: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read once, at the process's first batch
        self.model = SentencePieceModel.parse(self.data)
        self.tokenizer = self.model.tokenizer()
        gc.set_threshold(100_000)  # the words are many small objects without cycles
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        self.table = self.model.piece_bytes()
        plain = not (self.model.charsmap or self.model.squeeze_spaces)
        prefix = MARK if self.model.dummy_prefix else ""
        self.normalize = (lambda t: t and prefix + t.replace(" ", MARK)) if plain else self.tokenizer.normalizer.normalize_str
        self.by_words = self.model.splits_at_words and plain and self.model.dummy_prefix
        if self.by_words:  # the words come normalised and split: the model alone encodes them
            self.tokenizer.normalizer = self.tokenizer.pre_tokenizer = None

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether they equal the sentencepiece library's."""
        if not self.by_words:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            peer = self.peer.encode(texts)
            return [np.array(x, np.int32) for x in ids], [a == b for a, b in zip(ids, peer, strict=True)]
        out, same, some, size = [], [], [], 0
        for text in texts:
            some.append(WORD.findall(self.normalize(text)))
            size += len(text)
            if size >= BLOCK:
                self._by_words(some, out, same)
                some, size = [], 0
        self._by_words(some, out, same)
        return out, same

    def _by_words(self, rows: list[list[str]], out: list[np.ndarray], same: list[bool]) -> None:
        """Append the ids of texts that are given as words; each distinct word of them is looked up once."""
        places: dict[str, int] = {}
        at = [places.setdefault(w, len(places)) for w in chain.from_iterable(rows)]
        words = list(places)
        ids = [self.frequent.get(w) for w in words]
        missing = [i for i, x in enumerate(ids) if x is None]
        for i in missing:
            if (known := self.fresh.pop(words[i], None)) is not None:
                ids[i] = self.frequent[words[i]] = known
        missing = [i for i in missing if ids[i] is None]
        own = self._learn([words[i] for i in missing])
        for i in missing:
            ids[i] = own[words[i]]
        end = 0
        for row in rows:
            begin, end = end, end + len(row)
            out.append(np.frombuffer(b"".join([ids[i] for i in at[begin:end]]), np.int32))
            same.append(not self.wrong or self.wrong.isdisjoint(row))
        if len(self.fresh) + len(own) > FRESH:
            self.fresh = {}
        self.fresh.update(own)
        if len(self.frequent) > FREQUENT:
            self.frequent = {}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Encode words that carry their markers, and compare with the peer, which puts the first marker by itself.

        The peer gets them as one text, as words are apart in it; only where that differs are they compared one by one.
        """
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        if list(chain.from_iterable(ids)) != self.peer.encode("".join(words)[1:].replace(MARK, " ")):
            for word, mine in zip(words, ids, strict=True):
                if word != MARK and mine != self.peer.encode(word[1:].replace(MARK, " ")):
                    self.wrong.add(word)
        return {word: array("i", mine).tobytes() for word, mine in zip(words, ids, strict=True)}

    def decode(self, ids: np.ndarray) -> str:
        table = self.table
        text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(2)
def codec(data: bytes) -> Codec:
    return Codec(data)


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    """An Arrow array of int lists, null for None."""
    sizes = [0 if r is None else len(r) for r in rows]
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    values = pa.array(np.concatenate([r for r in rows if r is not None] or [np.empty(0, np.int32)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array([r is None for r in rows]))


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids, parity, round_trip.

    parity: the ids equal the sentencepiece library's; round_trip: they decode to the text again (false for a text
    that holds the metaspace character itself). Texts are encoded whole, whatever their length; the empty text has no
    ids and round-trips; a null text gives nulls. Repeated rows give equal rows; a null id is kept as it is; other
    columns are ignored. ``model`` is the content of a model file, a bounded broadcast. No shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column("text").to_pylist()
                found = iter(zip(*own.encode([t for t in texts if t is not None]), strict=True))
                rows = [(None, None) if t is None else next(found) for t in texts]
                again = [None if t is None else own.decode(ids) == t for t, (ids, _) in zip(texts, rows, strict=True)]
                columns = [part.column("doc_id"), _lists([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.bool_()), pa.array(again, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "parity", "round_trip"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, parity boolean, round_trip boolean")


def decode_documents(coded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids) -> (doc_id, text), one row per input row; null ids give a null text, no ids the empty text."""
    shipped = coded.sparkSession.sparkContext.broadcast(model)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [None if x is None else own.decode(np.array(x, np.int32)) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = coded.select(coded[id_col].alias("doc_id"), coded[ids_col].alias("ids"))
    return rows.mapInArrow(decode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
