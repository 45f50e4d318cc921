"""Bounded samples of labelled documents, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyr.llm.common import checkpointed, hash_share, held_out

#: Bytes of text that the sample of one class has at most; the first document by hash is taken whatever its length.
CLASS_BYTES = 1 << 26


def sample_labelled(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, modulus: int, remainder: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """About ``per_class`` labelled rows (id, text, label) of each class, chosen by hash of the id; share of label 1.

    Rows whose id is held out, null ids and null labels are left out; of several labels of one id the largest counts.
    Where the texts of a class take more than ``CLASS_BYTES``, documents are taken whole, in the order of a hash of the
    id, as long as they fit. Only the chosen ids, a bounded table, are broadcast.
    """
    known = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("label"))
    known = known.where(F.col("_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("_id"), modulus, remainder))
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = F.lit(False)
    for label, n in sizes.items():
        chosen = chosen | ((F.col("label") == label) & hash_share(F.col("_id").cast("string"), min(1.0, per_class / n), 10))
    total = sum(sizes.values())
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = checkpointed(rows.join(F.broadcast(known.where(chosen)), rows["id"] == F.col("_id")).select("id", "text", "label"))
    lengths = rows.groupBy("label", "id").agg(F.sum(F.octet_length("text")).alias("n"), F.xxhash64(F.lit(11), "id").alias("place"))
    taken: dict[int, int] = {}
    left = []
    for r in sorted(lengths.collect(), key=lambda r: (r["label"], r["place"], r["id"])):  # as many as were chosen
        if taken.get(r["label"], 0) and taken[r["label"]] + r["n"] > CLASS_BYTES:
            left.append((r["id"],))
        else:
            taken[r["label"]] = taken.get(r["label"], 0) + r["n"]
    if left:
        rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(left, rows.select("id").schema)), "id", "left_anti")
    return rows, sizes.get(1, 0) / total if total else 0.5
