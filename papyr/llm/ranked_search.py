"""Ranked lexical search of a set of items over all documents, by groups of documents that match the same terms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyr.llm.common import checkpointed

#: Characters of terms: ASCII letters and digits, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of the items that are searched together; documents and counts that are held at once; an item's terms whose bits are.
TERMS_AT_ONCE, DOCS_AT_ONCE, COUNTS_AT_ONCE, BITS_AT_ONCE = 1 << 15, 1 << 14, 1 << 22, 1 << 10
#: Groups of tasks whose best documents meet before those of all tasks do.
SALTS = 64
#: For bytes of UTF-8: ASCII capitals become small letters, other ASCII characters than letters and digits spaces.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, terms): the distinct terms of each item; rows of one id are one item; items without a term are left out."""
    terms = F.explode(F.regexp_extract_all(F.translate(items[text_col], UPPER, LOWER), F.lit(TERM), F.lit(0)))
    return items.select(items[id_col].alias("item_id"), terms.alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """One row per document with a term: doc_id, n (terms with repeats), terms (ids of ``vocabulary``, ascending), tf."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value.get
        for batch in batches:
            keep, sizes, lists, tfs = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                if words := (text.as_py() or b"").translate(_FOLD).split():
                    found, tf = np.unique(np.array([x for x in map(known, words) if x is not None], np.int32), return_counts=True)
                    keep.append(i)
                    sizes.append(len(words))
                    lists.append(found)
                    tfs.append(tf)
            ends = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
            wide = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, kind), *x]).astype(kind)))
            own = batch.column("doc_id").take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array(sizes, pa.int64()), wide(lists, np.int32), wide(tfs, np.int64)], names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, terms array<int>, tf array<long>")


class Block:
    """Postings and bitmaps of a block of documents: for each term its documents, ascending, and what it adds for each."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray, total: int, length: int, n_terms: int) -> None:
        m = 100 - 50 + (50 * n * total) // length
        of = np.repeat(np.arange(len(n)), sizes)
        order = np.argsort(terms, kind="stable")
        self.docs = of[order]
        gain = (1_000_000_000 * tf) // (1000 * tf + 20 * m[of])
        self.gains = gain[order]
        self.ends = np.searchsorted(terms[order], np.arange(n_terms + 1))
        filled = np.flatnonzero(np.diff(self.ends))
        self.most = np.zeros(n_terms, np.int64)
        self.most[filled] = np.maximum.reduceat(self.gains, self.ends[filled]) if len(filled) else 0
        self.width = (len(n) + 7) // 8
        self.bits = np.zeros((n_terms, self.width), np.uint8)
        flat = terms[order].astype(np.int64) * self.width * 8 + self.docs
        np.bitwise_or.at(self.bits.reshape(-1), flat >> 3, (128 >> (flat & 7)).astype(np.uint8))

    def masks(self, terms: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sum of ``most`` over the terms of each distinct mask, the matching documents by mask, and where each mask's begin."""
        docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(self.bits[terms], 0)))
        parts = [slice(at, at + BITS_AT_ONCE) for at in range(0, len(terms), BITS_AT_ONCE)]
        held = np.concatenate([np.packbits(np.unpackbits(self.bits[terms[p]], axis=1)[:, docs], axis=0) for p in parts]).T  # a document's mask in bytes
        wide = np.zeros((len(docs), -(-held.shape[1] // 8) * 8), np.uint8)
        wide[:, : held.shape[1]] = held
        keys = wide.view(np.uint64)
        order = np.lexsort(keys.T)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(docs) else np.empty(0, np.int64)
        bounds, own = np.zeros(len(first), np.int64), wide[order[first]]
        for p in parts:
            bounds += np.unpackbits(own[:, p.start // 8 : p.stop // 8], axis=1)[:, : len(most[p])] @ most[p]
        return bounds, docs[order], np.append(first, len(docs))

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of some documents."""
        out = np.zeros(len(docs), np.int64)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            begin, end = self.ends[t], self.ends[t + 1]
            if begin < end:
                at = np.minimum(np.searchsorted(self.docs[begin:end], docs), end - begin - 1) + begin
                out += np.where(self.docs[at] == docs, w * self.gains[at], 0)
        return out


def best_of_block(block: Block, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, best: np.ndarray) -> np.ndarray:
    """The ``k`` best (score, order of id) of those before, ``best``, and of a block's documents, by groups of one mask.

    A mask's documents can't score above the sum of the most that its terms add in the block. Masks are evaluated from
    the highest such bound down, some documents at a time, until the next bound is below the ``k``-th best score; equal
    scores are decided by id, so an equal bound is still evaluated.
    """
    bounds, docs, starts = block.masks(terms, weights * block.most[terms])
    order = np.argsort(-bounds, kind="stable")
    sizes = np.diff(starts)[order]
    ends, at, step = np.cumsum(sizes), 0, 2 * k
    while at < len(order):
        if bounds[order[at]] <= 0 or len(best) == k and bounds[order[at]] < best[-1, 0]:
            break
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step)))
        own = order[at:to]
        mine = docs[np.concatenate([np.arange(starts[g], starts[g + 1]) for g in own.tolist()])]
        score = block.scores(mine, terms, weights)
        both = np.concatenate([best, np.stack([score, ids[mine]], 1)[score > 0]])
        best = both[np.lexsort((both[:, 1], -both[:, 0]))[:k]]
        at, step = to, 2 * step
    return best


def _top(rows: DataFrame, k: int, *by: str | Column) -> DataFrame:
    window = Window.partitionBy("item_id", *by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents with a score above 0.

    Null texts have no terms; the empty table gives no rows, nor does an item without terms. Every row of ``docs`` is a
    document of its own, also where ids repeat; equal scores go by ascending id, null ids last. Rows of ``items`` with
    one id (null is one too) are one item with the terms of all. Other columns are ignored. The id must be an integer.

    The items are searched in blocks, by hash, of about ``TERMS_AT_ONCE`` terms, whose vocabulary is broadcast; for
    each the texts are read once and give the counts of the block's terms alone, which are checkpointed. A task goes
    through its documents in blocks of ``DOCS_AT_ONCE`` and passes on each item's ``k`` best.
    """
    own = checkpointed(item_terms(items, item_col, item_text_col))
    total = own.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = -(-total // TERMS_AT_ONCE)
    found = []
    for b in range(blocks):
        part = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        if part:
            found.append(_search(docs, [(r["item_id"], r["terms"]) for r in part], k, id_col, text_col, items.schema[item_col].dataType.simpleString()))
    schema = f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score long"
    out = docs.sparkSession.createDataFrame([], schema)
    for rows in found:
        out = out.unionByName(rows)
    return out


def _search(docs: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str, item_type: str) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    names = sorted({t for _, terms in items for t in terms})
    place = {t: i for i, t in enumerate(names)}
    rows = checkpointed(term_counts(docs, {t.encode(): i for t, i in place.items()}, id_col, text_col))
    total, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(names), np.int64)
    for term, n in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the block's terms at most
        held[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    own = [np.array(sorted(place[t] for t in terms), np.int64) for _, terms in items]
    shipped = sc.broadcast((own, weight, total, length))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of, weights, n_docs, n_length = shipped.value
        best = [np.empty((0, 2), np.int64) for _ in terms_of]

        def blocks() -> Iterator[pa.Table]:
            waiting, size, counts = [], 0, 0
            for batch in batches:
                for at in range(0, batch.num_rows, DOCS_AT_ONCE // 16):
                    waiting.append(batch.slice(at, DOCS_AT_ONCE // 16))
                    size += waiting[-1].num_rows
                    counts += len(waiting[-1].column("terms").flatten())
                    if size >= DOCS_AT_ONCE or counts >= COUNTS_AT_ONCE:
                        yield pa.Table.from_batches(waiting)
                        waiting, size, counts = [], 0, 0
            if waiting:
                yield pa.Table.from_batches(waiting)

        for rows in blocks():
            ids, n, terms, tf = (rows.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "tf"))
            sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
            block = Block(n.to_numpy(), sizes, terms.flatten().to_numpy(), tf.flatten().to_numpy(), n_docs, n_length, len(weights))
            known = ids.fill_null(LAST).to_numpy().astype(np.int64)
            for i, own_terms in enumerate(terms_of):
                best[i] = best_of_block(block, known, own_terms, weights[own_terms], k, best[i])
        found = np.concatenate([np.empty((0, 2), np.int64), *best])
        if len(found):
            item = np.repeat(np.arange(len(best)), [*map(len, best)])
            last = found[:, 1] == LAST
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(found[:, 0]), pa.array(found[:, 1], mask=last)], names=["item", "score", "id"])

    best = rows.mapInArrow(search, "item int, score long, id long")
    best = best.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    named = docs.sparkSession.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], f"item int, item_id {item_type}")
    best = best.select(F.col("item").alias("item_id"), "score", F.col("id").cast(docs.schema[id_col].dataType).alias("doc_id"), "salt")
    best = _top(_top(best, k, "salt").drop("rank", "salt"), k)
    return best.join(F.broadcast(named), best["item_id"] == named["item"]).select(named["item_id"], "rank", "doc_id", "score")


#: A null id sorts after all others.
LAST = (1 << 63) - 1

ORACLE = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
docs AS (SELECT row_number() OVER () AS doc, doc_id, terms, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
tfs AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) GROUP BY ALL),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs JOIN (SELECT DISTINCT term FROM items) USING (term), totals GROUP BY term),
scored AS (
  SELECT item_id, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN tfs USING (term) JOIN docs USING (doc), totals GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored JOIN docs USING (doc) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
