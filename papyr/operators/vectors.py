"""Approximate nearest vectors: an inverted file of k-means cells with product-quantised residuals, ranked exactly in the end.

All work is grouped by user, model and cell (or slice of the vectors), so that Spark deals it out; a group is one block
of numpy. Vectors are compared by cosine; each is kept whole beside its code, so that what the codes pick is ranked
exactly in the same group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyr.operators.joins import join_by_hot_key
from papyr.operators.retrieval import semantic_topk, top_k
from papyr.operators.storage import shared_checkpoint

#: Vectors of a user and model up to which they are one cell; cells at most; vectors a cell that the fit sees; rounds of it.
ONE_CELL, MOST_CELLS, FIT_A_CELL, ROUNDS = 256, 1024, 32, 8
#: Parts of a residual that are quantised apart, code words of each, and residuals of a model that they are fitted on.
PARTS, WORDS, FIT_RESIDUALS = 8, 64, 8192
#: Vectors of a group and queries of a group, about; queries that are looked up at once; candidates by code, times ``k``, that are ranked exactly in a cell.
SLICE, ASKED, AT_ONCE, KEPT = 20_000, 10_000, 256, 8
#: Queries on which the share of cells to look into is measured, and the share of true neighbours that it is to reach there.
MEASURED, RECALL = 200, 0.95
KEYS = ["user_id", "model"]


@dataclass(frozen=True)
class VectorIndex:
    """vectors: user_id, model, cell, chunk_id, embedding (unit length), code; cells: user_id, model, cell, centroid, cells; books: model, words."""

    vectors: DataFrame
    cells: DataFrame
    books: DataFrame


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(length > 0, length, 1)).astype(np.float32)


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """``k`` centres of the rows by Lloyd's rounds, first spread by distance; an empty cell moves to a row far from its centre."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    chosen, apart = [int(rng.integers(len(x)))], np.full(len(x), np.inf)
    while len(chosen) < k:
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(1, dtype=np.float64))
        total = apart.sum()
        chosen.append(int(np.searchsorted(np.cumsum(apart), rng.random() * total, "right").clip(0, len(x) - 1)) if total > 0 else len(chosen))
    centres = x[chosen].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres).astype(np.float32)
        if (empty := np.flatnonzero(counts == 0)).size:
            far = np.argsort(-((x - centres[near]) ** 2).sum(1), kind="stable")[: empty.size]
            centres[empty] = x[far]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre next to each row; the first of equal ones."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[at : at + 4096] @ centres.T - half, 1) for at in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def _apart(rows: DataFrame) -> DataFrame:
    """The rows under columns of their own, so that they can be grouped beside those that they were made of."""
    return rows.select(*(F.col(c).alias(c) for c in rows.columns))


def _parts(dim: int) -> list[slice]:
    ends = np.linspace(0, dim, min(PARTS, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def build_vector_index(rows: DataFrame) -> VectorIndex:
    """(user_id, model, chunk_id, embedding) -> the index of every row; no vector is left out.

    A user's vectors of a model have about as many cells as the square root of their number. Cells and code words are
    fitted on bounded samples by hash (``FIT_A_CELL`` a cell, ``FIT_RESIDUALS`` a model).
    """
    sizes = shared_checkpoint(rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = F.when(F.col("n") <= ONE_CELL, 1).otherwise(F.least(F.ceil(F.sqrt("n")), F.lit(MOST_CELLS))).cast("int")
    plan = sizes.select(*KEYS, "n", F.col("n").alias("size"), count.alias("cells"), F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    wide = shared_checkpoint(join_by_hot_key(rows.select(*KEYS, "chunk_id", "embedding"), plan, KEYS, total).withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.col("slices"))))
    share = F.pmod(F.xxhash64(F.lit(5), "chunk_id"), F.lit(1_000_003)) / 1_000_003
    in_fit = share * F.col("size") <= F.greatest(F.col("cells"), F.lit(ONE_CELL // FIT_A_CELL)) * FIT_A_CELL  # all of a single cell
    kinds = [rows.schema[c].dataType.simpleString() for c in (*KEYS, "chunk_id")]

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        centres = lloyd(_unit(_matrix(pdf["embedding"])), int(pdf["cells"].iloc[0]), ROUNDS)
        return pd.DataFrame({"user_id": key[0], "model": key[1], "cell": np.arange(len(centres)), "centroid": list(centres), "cells": len(centres)})

    cells = wide.where(in_fit).groupBy(*KEYS).applyInPandas(fit, f"user_id {kinds[0]}, model {kinds[1]}, cell int, centroid array<float>, cells int")
    cells = shared_checkpoint(cells)

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Slices without a fitted cell can't be: every user and model has one that some of its vectors made."""
        x, own = _unit(_matrix(left["embedding"])), right.sort_values("cell")
        at = nearest(x, _matrix(own["centroid"])) if len(own) else np.zeros(len(x), int)
        residual = x - (_matrix(own["centroid"])[at] if len(own) else 0)
        return pd.DataFrame({**{c: left[c] for c in (*KEYS, "chunk_id")}, "cell": at, "embedding": list(x), "residual": list(residual)})

    spread = plan.select(*KEYS, F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1)).alias("slice"))
    per_slice = _apart(cells.join(spread, KEYS))
    own = f"user_id {kinds[0]}, model {kinds[1]}, chunk_id {kinds[2]}, cell int, embedding array<float>, residual array<float>"
    placed = wide.groupBy(*KEYS, "slice").cogroup(per_slice.groupBy(*KEYS, "slice")).applyInPandas(lambda a, b: assign(a, b) if len(a) else pd.DataFrame({c: [] for c in (*KEYS, "chunk_id", "cell", "embedding", "residual")}), own)
    placed = shared_checkpoint(placed)

    def books(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["residual"])
        words = [lloyd(np.ascontiguousarray(x[:, p]), WORDS, ROUNDS) for p in _parts(x.shape[1])]
        return pd.DataFrame({"model": key[0], "words": [[w.ravel().tolist() for w in words]]})

    models = placed.groupBy("model").agg(F.count(F.lit(1)).alias("m"))
    fitted = placed.join(F.broadcast(models), "model").where(F.pmod(F.xxhash64(F.lit(6), "chunk_id"), F.col("m")) < FIT_RESIDUALS)
    book = shared_checkpoint(fitted.select("model", "residual").groupBy("model").applyInPandas(books, f"model {kinds[1]}, words array<array<float>>"))
    known = {r["model"]: [np.array(w, np.float32) for w in r["words"]] for r in book.collect()}  # one book a model, of WORDS vectors
    shipped = rows.sparkSession.sparkContext.broadcast(known)

    def encode(batches):
        for pdf in batches:
            codes = np.empty(len(pdf), object)
            for model, at in pdf.groupby("model", dropna=False).indices.items():
                x = _matrix(pdf["residual"].iloc[at])
                own = np.stack([nearest(x[:, p], w.reshape(-1, p.stop - p.start)) for p, w in zip(_parts(x.shape[1]), shipped.value[model], strict=True)], 1).astype(np.uint8)
                for i, c in zip(at, own, strict=True):
                    codes[i] = c.tobytes()
            yield pdf.drop(columns="residual").assign(code=codes)

    vectors = placed.mapInPandas(encode, f"user_id {kinds[0]}, model {kinds[1]}, chunk_id {kinds[2]}, cell int, embedding array<float>, code binary")
    return VectorIndex(shared_checkpoint(vectors), cells, book)


def _near_cells(q: np.ndarray, centres: np.ndarray, share: float | None) -> np.ndarray:
    """The share of the cells (all for none) that each query looks into, nearest first."""
    near = np.argsort(-(q @ centres.T - (centres**2).sum(1) / 2), 1, kind="stable")
    return near if share is None else near[:, : max(1, int(np.ceil(share * near.shape[1])))]


def _probes(index: VectorIndex, queries: DataFrame, share: float | None) -> DataFrame:
    """The cells that each query looks into, nearest first: query_id, user_id, model, vector, cell, place (share of cells before it)."""
    kinds = [queries.schema[c].dataType.simpleString() for c in ("query_id", *KEYS)]
    own = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(64)))
    cells = _apart(index.cells.join(own.select(*KEYS, "part").distinct(), KEYS))

    def order(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        right = right.sort_values("cell")
        for at in range(0, len(left) if len(right) else 0, 256):
            part = left.iloc[at : at + 256]
            q = _unit(_matrix(part["vector"]))
            near = _near_cells(q, _matrix(right["centroid"]), share)
            keep, count = near.shape[1], len(right)
            rows = np.repeat(np.arange(len(part)), keep)
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[rows], **{c: part[c].to_numpy()[rows] for c in KEYS}, "vector": [q[i] for i in rows], "cell": near.ravel(), "place": np.tile(np.arange(keep) / count, len(part))}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", *KEYS, "vector", "cell", "place")})

    schema = f"query_id {kinds[0]}, user_id {kinds[1]}, model {kinds[2]}, vector array<float>, cell int, place double"
    return own.groupBy(*KEYS, "part").cogroup(cells.groupBy(*KEYS, "part")).applyInPandas(order, schema)


def measured_share(rows: DataFrame, index: VectorIndex, queries: DataFrame, k: int, recall: float = RECALL) -> float:
    """The share of a user's cells that must be looked into to meet ``recall`` of the true neighbours of a bounded sample of queries."""
    n = queries.count()
    sample = queries.where(F.pmod(F.xxhash64(F.lit(8), "query_id"), F.lit(max(n, 1))) < MEASURED)
    true = semantic_topk(rows, sample, k).select("query_id", "chunk_id")
    home = true.join(sample.select("query_id", *KEYS), "query_id").join(index.vectors.select(*KEYS, "chunk_id", "cell"), [*KEYS, "chunk_id"])
    places = home.join(_probes(index, sample, None).select("query_id", "cell", "place"), ["query_id", "cell"])
    place = places.agg(F.percentile("place", recall)).first()[0]
    return 1.0 if place is None else float(place) + 1e-9


def _bundles(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """The cells of users who ask: user_id, model, cell, n, slices, bundle, low, high, most, parts.

    Cells that follow one another are bundled up to about ``SLICE`` vectors, a larger one is cut into slices; low and
    high are a bundle's first and last cell, most its most slices, parts the parts that the user's queries are cut into.
    """
    asked = queries.groupBy(*KEYS).agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("parts"))
    sizes = index.vectors.groupBy(*KEYS, "cell").agg(F.count(F.lit(1)).alias("n")).join(asked, KEYS)
    before = F.sum("n").over(Window.partitionBy(*KEYS).orderBy("cell")) - F.col("n")
    sizes = sizes.withColumns({"slices": F.ceil(F.col("n") / SLICE).cast("int"), "bundle": F.floor(before / SLICE).cast("int")})
    of = Window.partitionBy(*KEYS, "bundle")
    return shared_checkpoint(sizes.withColumns({"low": F.min("cell").over(of), "high": F.max("cell").over(of), "most": F.max("slices").over(of)}))


def _asked_bundles(index: VectorIndex, queries: DataFrame, bundles: DataFrame, share: float) -> DataFrame:
    """The bundles that each query looks into: query_id, user_id, model, vector, bundle, most, part, cells (bits of its cells, from the lowest)."""
    kinds = [queries.schema[c].dataType.simpleString() for c in ("query_id", *KEYS)]
    own = queries.withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(64)))
    cells = index.cells.select(*KEYS, "cell", "centroid").join(bundles.drop("n", "slices"), [*KEYS, "cell"], "left")
    cells = _apart(cells.join(own.select(*KEYS, "deal").distinct(), KEYS))
    names = ["query_id", *KEYS, "vector", "bundle", "most", "parts", "cells"]

    def order(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("cell")
            number, centres = right["cell"].to_numpy(), _matrix(right["centroid"])
            groups = right.dropna(subset=["bundle"]).drop_duplicates("bundle")[["bundle", "low", "high", "most", "parts"]].astype(int)
            for at in range(0, len(left), AT_ONCE):
                part = left.iloc[at : at + AT_ONCE]
                q = _unit(_matrix(part["vector"]))
                wanted = np.zeros((len(part), number[-1] + 1), bool)
                wanted[np.arange(len(part))[:, None], number[_near_cells(q, centres, share)]] = True
                for bundle, low, high, most, parts in groups.itertuples(index=False):
                    bits = wanted[:, low : high + 1]
                    rows = np.flatnonzero(bits.any(1))
                    if not len(rows):
                        continue
                    packed = [x.tobytes() for x in np.packbits(bits[rows], axis=1)]
                    out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[rows], **{c: part[c].to_numpy()[rows] for c in KEYS}, "vector": list(q[rows]), "bundle": bundle, "most": most, "parts": parts, "cells": packed}))
        return pd.concat(out)[names] if out else pd.DataFrame({c: [] for c in names}, dtype=object)

    schema = f"query_id {kinds[0]}, user_id {kinds[1]}, model {kinds[2]}, vector array<float>, bundle int, most int, parts int, cells binary"
    asked = own.groupBy(*KEYS, "deal").cogroup(cells.groupBy(*KEYS, "deal")).applyInPandas(order, schema)
    return asked.withColumn("part", F.pmod(F.xxhash64(F.lit(9), "query_id"), F.col("parts")).cast("int")).drop("parts")


def search_vectors(rows: DataFrame, index: VectorIndex, queries: DataFrame, k: int, share: float) -> DataFrame:
    """query_id, chunk_id, semantic_score, rank: the best ``k`` found for each query in ``share`` of its user's cells.

    A group is a bundle of cells and a part of the queries that look into some of them. In each cell the codes pick
    ``KEPT`` times ``k`` candidates a query, which are scored whole, all queries of a block in one product of matrices; a
    group passes on ``k`` a query. A query with fewer than ``k`` results is compared with all vectors of its user and model.
    """
    bundles = _bundles(index, queries)
    total = bundles.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    key = [*KEYS, "bundle", "slice", "part"]
    left = join_by_hot_key(index.vectors, bundles.select(*KEYS, "cell", "n", "slices", "bundle", "low", "parts"), [*KEYS, "cell"], total)
    left = left.withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.col("slices")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("slices", "parts")
    right = _asked_bundles(index, queries, bundles, share).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("most") - 1))).drop("most")
    left, right = _apart(left), _apart(right)
    books = {r["model"]: [np.array(w, np.float32) for w in r["words"]] for r in index.books.collect()}
    shipped = rows.sparkSession.sparkContext.broadcast(books)

    def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            a = a.sort_values(["cell", "chunk_id"])
            x, ids, cell = _matrix(a["embedding"]), a["chunk_id"].to_numpy(), a["cell"].to_numpy()
            codes = np.frombuffer(b"".join(a["code"]), np.uint8).reshape(len(a), -1)
            cuts = _parts(x.shape[1])
            coded = np.concatenate([w.reshape(-1, p.stop - p.start)[codes[:, i]] for i, (p, w) in enumerate(zip(cuts, shipped.value[a["model"].iloc[0]], strict=True))], 1)
            ends = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
            for at in range(0, len(b), AT_ONCE):
                part = b.iloc[at : at + AT_ONCE]
                q = _matrix(part["vector"])
                wanted = np.unpackbits(np.frombuffer(b"".join(part["cells"]), np.uint8).reshape(len(part), -1), axis=1).astype(bool)
                found = [_best_of_cell(x[i:j], coded[i:j], q, np.flatnonzero(wanted[:, cell[i] - a["low"].iloc[0]]), k, i) for i, j in zip(ends[:-1], ends[1:], strict=True)]
                query, place, score = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((ids[place], -score, query))
                query = query[order]
                begin = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])[: len(query)]
                order, query = (z[np.arange(len(query)) - np.repeat(begin, np.diff(np.r_[begin, len(query)])) < k] for z in (order, query))
                out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[query], "chunk_id": ids[place[order]], "semantic_score": score[order]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "chunk_id", "semantic_score")})

    kinds = [queries.schema["query_id"].dataType.simpleString(), rows.schema["chunk_id"].dataType.simpleString()]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(scan, f"query_id {kinds[0]}, chunk_id {kinds[1]}, semantic_score double")
    best = shared_checkpoint(top_k(found, "semantic_score", k))
    full = best.where(F.col("rank") == k).select("query_id")
    short = queries.join(full, "query_id", "left_anti")
    return best.join(full, "query_id", "left_semi").unionByName(semantic_topk(rows, short, k))


def _best_of_cell(x: np.ndarray, coded: np.ndarray, q: np.ndarray, asking: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each asking query (its number in ``q``) the ``k`` best vectors of a cell: query, place (from ``first``) and score.

    ``coded`` are the residuals as their codes have them; the centre adds the same to all of a cell.
    """
    own = q[asking]
    if len(x) > KEPT * k:
        near = np.sort(np.argpartition(-(own @ coded.T), KEPT * k, axis=1)[:, : KEPT * k], axis=1)  # vectors are in the order of their ids
        score = np.matmul(x[near].astype(np.float64), own.astype(np.float64)[:, :, None])[:, :, 0]
    else:
        near = np.broadcast_to(np.arange(len(x)), (len(own), len(x)))
        score = own.astype(np.float64) @ x.astype(np.float64).T
    score = np.round(np.maximum(score, 0), 4)
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    return np.repeat(asking, best.shape[1]), np.take_along_axis(near, best, 1).ravel() + first, np.take_along_axis(score, best, 1).ravel()


def ivf_topk(rows: DataFrame, queries: DataFrame, k: int, recall: float = RECALL, told: Callable[[float], None] | None = None) -> DataFrame:
    """(user_id, model, chunk_id, embedding) x (query_id, user_id, model, vector) -> query_id, chunk_id, semantic_score, rank.

    The share of cells is measured on the queries, so that clustered vectors are found in a few cells and others in as
    many as it takes; ``told`` gets it. No rows or queries: an empty table.
    """
    index = build_vector_index(rows)
    share = measured_share(rows, index, queries, k, recall)
    if told:
        told(share)
    return search_vectors(rows, index, queries, k, share)
