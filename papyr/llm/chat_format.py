"""Conversations as training text: each turn's span is found by rendering successive prefixes with a template.

A template is a black box: a function from turns to one text. What a turn adds is where the rendering with it differs
from the rendering without it; a rendering that doesn't begin with the one before it has rewritten history.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Turn = tuple[str, str]
#: Turns beyond which a task's log tells of a conversation, as whole prefixes take the square of their number.
WHOLE_TURNS = 1024
#: Turns of a result that are held at once, and their characters.
TURNS, CHARACTERS = 256, 1 << 20
#: Strings that steer a model; a text never holds one of them once it is formatted (fixed values).
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_GUARDED = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\])")
_OPEN = re.compile(r"([<\[])\\(\\*)(?=/?s>|/?INST\])")


def escape(text: str) -> str:
    """``text`` with one more backslash inside each control string, whether or not it has some already."""
    return _GUARDED.sub(r"\1\\\2", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _OPEN.sub(r"\1\2", text) if "\\" in text else text


def marked_turns(turns: list[Turn]) -> str:
    """The package's own template: ``<s>role``, a line feed, the text and ``</s>``, a line feed, for each turn."""
    return "".join(f"<s>{escape(role.replace('~', '~~').replace(chr(10), '~n'))}\n{escape(text)}</s>\n" for role, text in turns)


def read_turns(formatted: str) -> list[Turn]:
    """The turns that ``marked_turns`` has formatted."""
    found = re.findall(r"<s>(.*)\n((?s:.*?))</s>\n", formatted)
    return [(re.sub("~(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)), unescape(text)) for role, text in found]


@dataclass
class Spans:
    """Renders one conversation turn by turn: ``add`` gives what a turn appends and where.

    All turns before a turn are its context, whatever their number: a black box tells by no sample of its renderings
    that it would append the same with fewer. The work grows with the square of a conversation's turns.
    """

    render: Callable[[list[Turn]], str]
    unescape: Callable[[str], str]
    turns: list[Turn] = field(default_factory=list)
    before: str = ""

    @property
    def whole(self) -> bool:
        """Whether the turns so far are rendered otherwise together than one by one."""
        return self.before != "".join(self.render([turn]) for turn in self.turns)

    def add(self, turn: Turn) -> tuple[str, int, int, int, bool]:
        """(piece, begin, text_begin, text_end, rewrites).

        The conversation's text is the earlier one up to ``begin`` and then the piece. text_begin and text_end bound
        the turn's escaped text; they are -1 where the piece doesn't hold the text as it was given.
        """
        after = self.render([*self.turns, turn])
        rewrites = not after.startswith(self.before)
        kept = _common(self.before, after) if rewrites else len(self.before)
        begin, end = (-1, -1) if rewrites else self._text(turn, after, kept)
        self.turns.append(turn)
        self.before = after
        return after[kept:], kept, begin, end, rewrites

    def _text(self, turn: Turn, after: str, kept: int) -> tuple[int, int]:
        """Where the turn's text is in ``after``: between what comes before and after a character put in its place."""
        role, text = turn
        probe = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in after)
        probed = self.render([*self.turns, (role, probe)])
        if probed.count(probe) != 1:  # the template may say it too
            empty = self.render([*self.turns, (role, "")])
            probe = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in empty and c not in after)
            probed = self.render([*self.turns, (role, probe)])
        begin = probed.find(probe)
        tail = len(probed) - begin - 1
        end = len(after) - tail
        if begin < kept or end < begin or probed.count(probe) != 1 or after[:begin] != probed[:begin] or after[end:] != probed[begin + 1 :] or self.unescape(after[begin:end]) != text:
            return -1, -1
        return begin, end


def _common(a: str, b: str) -> int:
    """Characters that two texts have in common at their beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def format_conversations(
    turns: DataFrame,
    render: Callable[[list[Turn]], str] = marked_turns,
    unescaped: Callable[[str], str] = unescape,
    trained: tuple[str, ...] = ("assistant",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn: conv_id, turn, n, role, piece, begin, text_begin, text_end, loss, rewrites.

    The rows of a conversation stand next to each other in one partition, in the order of ``turn`` (nulls first; equal
    turns by role, then text); n counts them from 0. A conversation's text is, turn by turn, what it was up to
    ``begin`` (code points), then ``piece``; where ``rewrites`` is false for all turns that is the pieces joined.
    text_begin and text_end bound the turn's escaped text, null where the template doesn't render the text as given.
    loss: the turn's role is ``trained`` and its text is bounded, so it is under the loss mask; a turn that rewrites
    history has none. Null roles and texts count as empty, a null conversation is one of its own, repeated rows are
    turns of their own; no rows give an empty table; other columns are ignored.

    The turns are shuffled once. A conversation is rendered in order by one task, as every turn's place depends on all
    before it. A task holds the turns of one conversation, two of its renderings and a block of results.
    """
    kinds = [turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col)]
    rows = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), *(F.coalesce(turns[c], F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {kinds[0]}, turn {kinds[1]}, n long, role string, piece string, begin long, text_begin long, text_end long, loss boolean, rewrites boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for _, own in groupby(_rows(batches), key=lambda row: row[0]):
            spans = Spans(render, unescaped)
            for n, (conv, turn, role, text) in enumerate(own):
                if n == WHOLE_TURNS:
                    warnings.warn(f"conversation {conv} has more than {n} turns; each of its prefixes is rendered whole", stacklevel=1)
                piece, begin, first, last, rewrites = spans.add((role, text))
                out.append((conv, turn, n, role, piece, begin, first if first >= 0 else None, last if first >= 0 else None, role in trained and first >= 0, rewrites))
                size += len(piece)
                if len(out) >= TURNS or size >= CHARACTERS:
                    yield _batch(out, types)
                    out, size = [], 0
        if out:
            yield _batch(out, types)

    types = to_arrow_schema(StructType.fromDDL(schema))
    return rows.mapInArrow(run, schema)


def conversation_digests(formatted: DataFrame, read: Callable[[str], list[Turn]] = read_turns, unescaped: Callable[[str], str] = unescape) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``formatted`` is what ``format_conversations`` gives, rows in its order; everything is read back from the pieces:
    the turns by ``read``, and under the loss mask the unescaped texts. A conversation whose history is rewritten has
    nulls. No shuffle: the pieces are digested as they come, one at a time.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, own in groupby(_rows(batches), key=lambda row: row[0]):
            turns, loss, n, chars, end, broken = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False
            for _, piece, begin, first, last, trained, rewrites in own:
                broken |= rewrites
                for role, text in read(piece):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                if trained:
                    under = unescaped(piece[first - begin : last - begin])
                    loss.update(under.encode())
                    chars += len(under)
                end = begin + len(piece)
            out.append((conv, *([None] * 5 if broken else (n, turns.hexdigest(), chars, loss.hexdigest(), end))))
            if len(out) >= TURNS:
                yield _batch(out, types)
                out = []
        if out:
            yield _batch(out, types)

    return formatted.select("conv_id", "piece", "begin", "text_begin", "text_end", "loss", "rewrites").mapInArrow(run, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of all batches, some of them Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, TURNS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, TURNS).columns), strict=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


#: The digests of ``conversations`` with conversation -1 beside them, from their roles and texts alone.
ORACLE = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 9 + length(replace(replace(role, '~', '~~'), chr(10), '~n')) + length(text)
    + len(regexp_extract_all(role, '[<\[]\\*(?:/?s>|/?INST\])')) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?INST\])')) AS chars
  FROM given)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
