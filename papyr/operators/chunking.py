"""Chunking of pages: a fold over a page's blocks inside its row, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyr.functions import text as T

TARGET_MIN, TARGET_MAX, HARD_MAX, MIN_CHARS = 300, 600, 1000, 20
WORDS_PER_PIECE = int(HARD_MAX / 1.3)
JOIN = "\n\n"


def fold_blocks(blocks: Iterable[str]) -> Iterator[tuple[str | None, str]]:
    """Trimmed blocks -> (section, content): headings start sections, 300 tokens close a chunk, 600 are the most."""
    held: list[str] = []
    words, section = 0, None
    for block in blocks:
        own = T.count_words(block)
        both = T.token_estimate(words + own)
        if T.trimmed_heading(block):
            if held:
                yield section, JOIN.join(held)
            held, words, section = [block], own, block
        elif both > TARGET_MAX and held:
            yield section, JOIN.join(held)
            held, words = [block], own
            if T.token_estimate(own) >= TARGET_MAX:
                yield section, block
                held, words = [], 0
        else:
            held.append(block)
            words += own
            if both >= TARGET_MIN:
                yield section, JOIN.join(held)
                held, words = [], 0
    if held:
        yield section, JOIN.join(held)


def limited(content: str) -> list[str]:
    """A text of over 1000 tokens -> sentences packed up to 1000; a longer sentence is cut every 769 words."""
    if T.token_estimate(T.count_words(content)) <= HARD_MAX:
        return [content]
    out: list[str] = []
    held: list[str] = []
    words = 0
    for sentence in T.sentence_list(content):
        own = T.count_words(sentence)
        long = T.token_estimate(own) > HARD_MAX
        if held and (long or T.token_estimate(words + own) > HARD_MAX):
            out.append(" ".join(held))
            held, words = [], 0
        if long:
            all_words = T.word_list(sentence)
            out += [" ".join(all_words[i : i + WORDS_PER_PIECE]) for i in range(0, own, WORDS_PER_PIECE)]
        else:
            held.append(sentence)
            words += own
    return out + [" ".join(held)] if held else out


def enforce_hard_limit(content: Column) -> Column:
    """``limited`` as a column."""
    return T.by_text(limited, "array<string>", content)


def page_chunks(text: str, hard_limit: bool) -> list[tuple[str | None, str, int, int]]:
    """(section, content, tokens, characters) of a page's chunks."""
    pieces = ((section, T.trimmed(p)) for section, content in fold_blocks(T.block_list(text)) for p in (limited(content) if hard_limit else (content,)))
    return [(section, p, T.token_estimate(T.count_words(p)), len(p)) for section, p in pieces if len(p) >= MIN_CHARS]


def chunk_pages(pages: DataFrame, text_col: str = "raw_text", hard_limit: bool = True) -> DataFrame:
    """Pages -> one row a chunk: the page's columns, pos, section_title, content, token_count, char_count.

    Blank and null pages give no chunk. Without ``hard_limit`` a block of over 1000 tokens stays whole.
    """
    cut = T.by_text(lambda t: page_chunks(t, hard_limit), "array<struct<section_title:string,content:string,token_count:int,char_count:int>>", F.col(text_col))
    keep = [c for c in pages.columns if c != text_col]
    return pages.select(*keep, F.posexplode(cut).alias("pos", "chunk")).select(*keep, "pos", "chunk.*")


def chunk_documents(pages: DataFrame, hard_limit: bool = True) -> DataFrame:
    """Chunks of all pages of a version, numbered from 0 in page order.

    Where pages have them, a chunk's ``language`` is that of the page, else of the document (``document_language``).
    """
    order = Window.partitionBy("version_id").orderBy("page_number", "pos")
    if "document_language" in pages.columns:
        pages = pages.withColumn("language", F.coalesce("language", "document_language")).drop("document_language")
    return chunk_pages(pages, hard_limit=hard_limit).withColumn("chunk_index", F.row_number().over(order) - 1).drop("pos")
