"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyr.llm.common import checkpointed, join_by_hot_key


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) integer pairs -> (node, root): for every node of an edge the smallest node that it reaches.

    Minima are pre-aggregated before they are shuffled, and those of hubs, to which the members of a large component
    all turn, are broadcast, so that no task gets a component as a whole; every round is checkpointed. Loops and
    repeated or null edges are passed over. No edges: an empty table.
    """

    def least_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = checkpointed(e), None
    total = e.count()
    while total:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least_of(both).select("u", F.least("u", "m").alias("m"), "n")
        large = join_by_hot_key(both, least, "u", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = least_of(large)
        small = join_by_hot_key(large, least, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before, total = now, now[0]
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
