"""Exact deduplication by a distributed content sort.

Sampled splitters range-partition the normalised texts, each partition is sorted externally, and neighbours are
compared in full, so that equal texts become runs. The order is by a bounded prefix, then the digest, then the whole
text and the id: the prefix keeps the sample that the driver sees small, and with the id as last key a group of copies
of any size is cut over several partitions instead of filling one. A run that lies within a partition is settled
there; only the runs that a partition's edge cuts are matched again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyr.llm.common import SPACES, checkpointed

#: Characters of the normalised text that take part in the range key.
PREFIX = 48
#: Rows of a run that are held together; a longer run is settled in several pieces, like one that an edge cuts.
PIECE = 1 << 16


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted (norm, doc_id, digest) -> pieces of runs: ids in order, digest, place (partition, number), open.

    A piece is open where its run can go on in another one: the first and the last run of a partition, and a run that
    is cut at ``most`` rows.
    """
    part, number, last, first = TaskContext.get().partitionId(), 0, None, True
    held, digest, count, cut = [], None, 0, False  # the run in progress, and whether a part of it is out or elsewhere

    def pieces(ids: pa.ListArray, digests: pa.Array, is_open: bool) -> pa.RecordBatch:
        n = len(ids)
        columns = [ids, digests, pa.array([part] * n, pa.int32()), pa.array(range(number, number + n), pa.int64()), pa.array([is_open] * n)]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "digest", "part", "number", "open"])

    def piece(is_open: bool) -> pa.RecordBatch:
        ids = pa.chunked_array(held).combine_chunks()
        return pieces(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([digest], pa.binary()), is_open)

    for batch in batches:
        if not batch.num_rows:
            continue
        norm, ids, digests = (batch.column(c) for c in ("norm", "doc_id", "digest"))
        differs = pc.not_equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
        begins = np.concatenate(([0] if norm[0].as_py() != last else [], np.flatnonzero(differs) + 1)).astype(int).tolist()
        last = norm[-1].as_py()
        goes_on = begins[0] if begins else len(norm)
        if goes_on:
            if count + goes_on > most:
                yield piece(True)
                held, count, number, cut = [], 0, number + 1, True
            held, count = [*held, ids.slice(0, goes_on)], count + goes_on
        if not begins:
            continue
        if count:
            yield piece(cut)
            number += 1
        if first and len(begins) > 1:
            held, digest, first = [ids.slice(0, begins[1])], digests[0].as_py(), False
            yield piece(True)
            begins, number = begins[1:], number + 1
        if len(begins) > 1:
            yield pieces(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), ids), digests.take(pa.array(begins[:-1])), False)
            number += len(begins) - 1
        held, digest, count, cut, first = [ids.slice(begins[-1])], digests[begins[-1]].as_py(), len(norm) - begins[-1], first, False
    if count:
        yield piece(True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ``SPACES`` became one space; null counts as empty. The row with
    the smallest id stays, its id is ``keep_id``. Null ids sort last: such a row stays only where its whole group has
    null ids (keep_id null). Of rows that repeat both id and text exactly one is kept. Other columns are ignored; an
    empty table gives an empty result.

    The texts are shuffled once, by range. Runs are pieces of at most ``PIECE`` ids; those that are open, a few a
    partition, are summed by digest and broadcast.
    """
    doc_id, kind = docs[id_col], doc_id_type(docs, id_col)
    keyed = docs.select(
        doc_id.alias("doc_id"), F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), SPACES, " ").alias("norm")
    ).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    keys = [F.substring("norm", 1, PREFIX), F.col("digest")]
    order, most = F.asc_nulls_last("doc_id"), PIECE
    pieces = checkpointed(
        keyed.repartitionByRange(*keys, order)
        .sortWithinPartitions(*keys, "norm", order)
        .mapInArrow(lambda batches: _runs(batches, most), f"ids array<{kind}>, digest binary, part int, number long, open boolean")
    )
    sums = pieces.where("open").groupBy("digest").agg(
        F.min(F.get("ids", F.lit(0))).alias("least"), F.sum(F.size("ids").cast("long")).alias("n"), F.min(F.struct("part", "number")).alias("first")
    )
    # Broadcast: pieces are open at the edges of partitions and every PIECE rows only.
    joined = pieces.join(F.broadcast(sums.withColumn("open", F.lit(True))), ["digest", "open"], "left")
    leads = F.when(F.col("open"), F.struct("part", "number") == F.col("first")).otherwise(F.lit(True))
    return joined.select(
        F.when(F.col("open"), F.col("least")).otherwise(F.get("ids", F.lit(0))).alias("keep_id"),
        F.coalesce("n", F.size("ids").cast("long")).alias("group_size"),
        leads.alias("leads"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.posexplode("ids").alias("at", "doc_id"),
    ).select("doc_id", "keep_id", "group_size", (F.col("leads") & (F.col("at") == 0)).alias("kept"), "text_sha256")


def doc_id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept, whatever their names.

    An id that comes on several rows (or null) is told apart by its text's digest; of rows that repeat both, one stays.
    The ids that go, the smaller side, are anti-joined: texts are shuffled a second time only where those ids are too
    many to be broadcast.
    """
    verdicts = checkpointed(exact_dedup(docs, id_col, text_col))
    ids = checkpointed(verdicts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("any_kept")))
    gone = ids.where("n = 1 and not any_kept and doc_id is not null").select("doc_id")
    repeated = ids.where("n > 1 or doc_id is null").select("doc_id")
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    packed = docs.select(docs[id_col].alias("doc_id"), whole)
    if repeated.isEmpty():  # every id is on one row: no need to read the texts for them again
        return packed.join(gone, "doc_id", "left_anti").select("row.*")
    single = packed.where("doc_id is not null").join(gone.unionByName(repeated), "doc_id", "left_anti").select("row")
    digest = F.sha2(F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), SPACES, " "), 256).alias("digest")
    several = docs.select(docs[id_col].alias("doc_id"), digest, whole).alias("a")
    several = several.join(repeated.alias("r"), F.expr("a.doc_id <=> r.doc_id"), "left_semi").alias("a")
    winners = verdicts.where("kept").alias("w")
    several = several.join(winners, F.expr("a.doc_id <=> w.doc_id and a.digest = w.text_sha256"), "left_semi")
    return single.unionByName(several.dropDuplicates(["doc_id", "digest"]).select("row")).select("row.*")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
