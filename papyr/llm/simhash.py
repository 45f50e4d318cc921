"""Near-duplicates by SimHash fingerprints and a vantage-point tree over Hamming distance.

A tree of vantage points, grown on a bounded sample, deals the distinct fingerprints to shards. At each vantage point
the triangle bound tells which side can hold a partner within the radius: a fingerprint whose ball crosses the
boundary is also sent, as a guest, to the shard beyond it. Each shard then searches its own members exactly with a
local tree of the same kind and returns a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyr.llm.common import checkpointed, hash_share, join_by_hot_key
from papyr.llm.components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Aimed-at home fingerprints of a shard, and of a leaf of its local tree.
SHARD, LEAF = 4096, 96
#: A shard with more members than this is searched block by block.
BLOCK = 1 << 17
#: One sampled fingerprint stands for this many, but the driver gets no more than the bound.
SAMPLE_ONE_IN, SAMPLE_BOUND = 64, 1 << 20
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the XXH64 hashes of word shingles (repeats count); 0 where there is no word."""
    words = (text or b"").lower().split()  # both touch ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - shingle] + 1))
    digest, seed, hashes = xxhash.xxh64_intdigest, SEED, []
    hashes = [digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        some = np.array(hashes[at : at + COUNTED], "<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed bigint; null and wordless texts get 0."""

    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([simhash(t, shingle) for t in s], np.uint64).view(np.int64))

    return fingerprint(text.cast("binary"))


@dataclass(frozen=True)
class VantageTree:
    """Node i: a point, a distance, and the nodes for items up to and beyond it; a child below 0 is leaf ~child."""

    points: np.ndarray
    radii: np.ndarray
    children: np.ndarray
    leaves: int

    @staticmethod
    def grow(items: np.ndarray, most: float, candidates: int = 5) -> VantageTree:
        """Split until a leaf holds at most ``most`` of the (distinct) items."""
        nodes, leaves, todo = [], 0, [(items, -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            if len(own) <= max(most, 1):
                child, leaves = ~leaves, leaves + 1
            else:
                child = len(nodes)
                best = None
                for point in own[np.linspace(0, len(own) - 1, candidates).astype(int)]:
                    d = np.bitwise_count(own ^ point)
                    mu = min(int(np.median(d)), int(d.max()) - 1)
                    # few near the boundary and even halves
                    cost = np.count_nonzero((d > mu - RADIUS) & (d <= mu + RADIUS)) + abs(2 * np.count_nonzero(d <= mu) - len(own))
                    if best is None or cost < best[0]:
                        best = cost, point, mu, d
                _, point, mu, d = best
                nodes.append([point, mu, [0, 0]])
                todo += [(own[d <= mu], child, 0), (own[d > mu], child, 1)]
            if parent >= 0:
                nodes[parent][2][side] = child
        points, radii, children = ([n[i] for n in nodes] for i in range(3))
        return VantageTree(np.array(points, np.uint64), np.array(radii, np.int64), np.array(children, np.int64).reshape(-1, 2), leaves)

    def route(self, items: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per leaf: the indices of the items that reach it and whether each is at home there.

        Every two items within the radius, of which one at least is at home in the tree, meet in a leaf where one is
        at home: of a home pair that a boundary parts, the inner one is a guest on the outer side.
        """
        todo = [(0 if len(self.points) else ~0, np.arange(len(items)), home)]
        while todo:
            node, at, own = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield ~node, at, own
                continue
            d = np.bitwise_count(items[at] ^ self.points[node]).astype(np.int64)
            mu = self.radii[node]
            inner, outer = d <= mu, d > mu - radius
            inner |= ~own & (d <= mu + radius)
            todo.append((self.children[node, 0], at[inner], own[inner]))
            todo.append((self.children[node, 1], at[outer], own[outer] & (d[outer] > mu)))


def _forest(members: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (child, parent) that join the members linked within the radius, where one of each two is at home."""
    label = np.arange(len(members))
    if not home.any():
        return label[:0], label[:0]
    tree = VantageTree.grow(members[home], LEAF)
    for _, at, own in tree.route(members, home, radius):
        mine = at[own]
        for lo in range(0, len(mine) if len(at) else 0, 512):
            some = mine[lo : lo + 512]
            for part in range(0, len(at), 1 << 14):
                near = np.bitwise_count(members[some][:, None] ^ members[at[part : part + (1 << 14)]][None, :]) <= radius
                a, b = np.nonzero(near)
                a, b = some[a], at[part + b]
                while len(a):
                    x, y = label[a], label[b]
                    apart = x != y
                    a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                    low = np.minimum(x, y)
                    np.minimum.at(label, x, low)
                    np.minimum.at(label, y, low)
                    while (label != label[label]).any():
                        label = label[label]
    child = np.flatnonzero(label != np.arange(len(members)))
    return child, label[child]


def link_fingerprints(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct bigints ``fp`` -> (a, b): edges that connect exactly those that a chain of near ones connects."""
    spark, n = fingerprints.sparkSession, fingerprints.count()
    share = min(1 / 8, max(1 / SAMPLE_ONE_IN, 2048 / max(n, 1)), SAMPLE_BOUND / max(n, 1))
    sample = fingerprints.where(hash_share(F.col("fp"), share, 1)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = VantageTree.grow(np.sort(sample), max(2, SHARD * share))
    shipped = spark.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items = pdf["fp"].to_numpy(np.int64)
            dealt = list(shipped.value.route(items.view(np.uint64), np.ones(len(items), bool), radius))
            if dealt:
                leaves, at, own = zip(*dealt, strict=True)
                shard = np.repeat(np.array(leaves, np.int64), [len(a) for a in at])
                yield pd.DataFrame({"shard": shard, "fp": items[np.concatenate(at)], "home": np.concatenate(own)})

    dealt = checkpointed(fingerprints.select("fp").mapInPandas(deal, "shard long, fp long, home boolean"))
    # A shard above BLOCK members is cut in blocks; each two of its blocks meet in one group.
    sizes = dealt.groupBy("shard").count().where(F.col("count") > BLOCK)
    blocks = sizes.select("shard", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    cut = dealt.join(blocks, "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("shard", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp", "home")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        members = pdf["fp"].to_numpy(np.int64)
        child, parent = _forest(members.view(np.uint64), pdf["home"].to_numpy(bool), radius)
        return pd.DataFrame({"a": members[child], "b": members[parent]})

    return cut.groupBy("shard", "p", "q").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is the smallest id in all rows
    that links reach. Equal fingerprints are one node, so copies never make pairs. Null and empty texts have
    fingerprint zero and are linked like any other. A null id is never a component's id: it is null only where every
    row of a component has a null id. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), fingerprint_column(docs[text_col], shingle).alias("fp"))
    rows = checkpointed(rows)
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    linked = _rooted(nodes, radius)
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    linked = join_by_hot_key(linked.drop("n"), least, "root", linked.count()).select("fp", "component_id")
    classes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = join_by_hot_key(rows, checkpointed(classes), "fp", total)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(nodes: DataFrame, radius: int) -> DataFrame:
    """Those of the distinct ``fp`` that are linked to others, with all their columns and ``root``, one for each component."""
    roots = connected_components(link_fingerprints(nodes.select("fp"), radius))
    return checkpointed(roots.join(nodes, roots["node"] == nodes["fp"]).drop("node"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component, all columns kept, whatever their names: that of the smallest id.

    Null ids sort last; of rows of one id the smallest fingerprint stays, then the smallest digest of the text, then
    any one. An id that comes on several rows (or null) is told apart by its text's digest, so that a row that goes
    takes no other row of its id with it.
    """
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    digest = F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)).alias("digest")
    packed = docs.select(docs[id_col].alias("doc_id"), whole)
    rows = checkpointed(docs.select(docs[id_col].alias("doc_id"), fingerprint_column(docs[text_col], shingle).alias("fp"), digest))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "fp", "digest")).alias("best")))
    linked = _rooted(nodes, radius)
    alone = nodes.join(linked.select("fp"), "fp", "left_anti").select("best")
    best = alone.unionByName(linked.groupBy("root").agg(F.min("best").alias("best")).select("best"))
    winners = checkpointed(best.select("best.doc_id", "best.digest"))
    ids = checkpointed(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    several = F.expr("n > 1 or doc_id is null")
    gone = ids.where(~several).join(winners, "doc_id", "left_anti").select("doc_id")
    repeated = ids.where(several).select("doc_id")
    if repeated.isEmpty():  # every id is on one row: no need to read the texts for them again
        return packed.join(gone, "doc_id", "left_anti").select("row.*")
    single = packed.where("doc_id is not null").join(gone.unionByName(repeated), "doc_id", "left_anti").select("row")
    kept = winners.alias("w").join(repeated.alias("r"), F.expr("w.doc_id <=> r.doc_id"), "left_semi")
    again = docs.select(docs[id_col].alias("doc_id"), digest, whole)
    again = again.alias("a").join(kept.alias("k"), F.expr("a.doc_id <=> k.doc_id and a.digest = k.digest"), "left_semi")
    return single.unionByName(again.dropDuplicates(["doc_id", "digest"]).select("row")).select("row.*")
