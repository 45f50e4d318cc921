"""The inverted file of vectors: cells, codes, recall on clustered vectors at a small share of pairs, whole lists."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyr.operators import retrieval, vectors


def clustered(spark, n, dim=32, clusters=40, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, dim))
    rows = [(1 if i % 50 else 2, "m", i, x[i].tolist()) for i in range(n)] + [(3, "m", n + i, x[i].tolist()) for i in range(3)] + [(1, "m", n + 10, [0.0] * dim)]
    frame = spark.createDataFrame(rows, "user_id long, model string, chunk_id long, embedding array<float>")
    return frame, frame.where("chunk_id % 23 = 0").select(F.col("chunk_id").alias("query_id"), "user_id", "model", F.col("embedding").alias("vector"))


def recall(got, true):
    hits = [len({r.chunk_id for r in got if r.query_id == q} & own) / len(own) for q, own in true.items()]
    return sum(hits) / len(hits)


def lists(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, set()).add(r.chunk_id)
    return out


def test_clustered_vectors_are_found_in_few_cells(spark):
    rows, asked = clustered(spark, 6000)
    true = lists(retrieval.semantic_topk(rows, asked, 10).collect())
    shares = []
    got = vectors.ivf_topk(rows, asked, 10, told=shares.append).collect()
    assert recall(got, true) >= 0.9 and shares[0] < 0.1  # of the cells of each user
    assert {q: len(own) for q, own in lists(got).items()} == {q: len(own) for q, own in true.items()}  # whole lists, of small users too
    exact = {(r.query_id, r.chunk_id): r.semantic_score for r in retrieval.semantic_topk(rows, asked, 6100).collect()}
    assert all(exact[r.query_id, r.chunk_id] == pytest.approx(r.semantic_score, abs=2e-4) for r in got)
    index = vectors.build_vector_index(rows)
    assert index.vectors.count() == rows.count() and index.vectors.select("chunk_id").distinct().count() == rows.count()
    sizes = index.vectors.where("user_id = 1").groupBy("cell").count()
    largest = sizes.agg(F.max("count")).first()[0]
    probes = vectors._probes(index, asked, shares[0]).join(index.vectors.groupBy(*vectors.KEYS, "cell").count(), [*vectors.KEYS, "cell"])
    looked, pairs = probes.agg(F.sum("count")).first()[0], asked.join(rows.groupBy(*vectors.KEYS).count(), vectors.KEYS).agg(F.sum("count")).first()[0]
    assert looked < 0.1 * pairs and largest < 6000 / 4


def test_short_lists_are_completed_and_large_cells_cut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SLICE", 100)
    monkeypatch.setattr(vectors, "ONE_CELL", 50)
    rows, asked = clustered(spark, 900, clusters=5)
    true = lists(retrieval.semantic_topk(rows, asked, 10).collect())
    got = vectors.search_vectors(rows, vectors.build_vector_index(rows), asked, 10, 1e-9).collect()
    assert {q: len(own) for q, own in lists(got).items()} == {q: len(own) for q, own in true.items()}
    assert recall(vectors.search_vectors(rows, vectors.build_vector_index(rows), asked, 10, 1.0).collect(), true) >= 0.97
    assert vectors.ivf_topk(rows.limit(0), asked, 10).collect() == [] and vectors.ivf_topk(rows, asked.limit(0), 10).collect() == []


def test_lloyd_and_codes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (50, 4)) for c in (-5, 0, 5)]).astype(np.float32)
    centres = vectors.lloyd(x, 3, 8)
    near = vectors.nearest(x, centres)
    assert [len(set(near[i : i + 50].tolist())) for i in (0, 50, 100)] == [1, 1, 1] and len(set(near.tolist())) == 3
    assert len(vectors.lloyd(x[:2], 9, 3)) == 2
    assert [(p.start, p.stop) for p in vectors._parts(10)][-1][1] == 10 and len(vectors._parts(3)) == 3


def test_a_group_answers_many_queries_at_once_and_passes_on_k_of_all_its_cells(spark, monkeypatch):
    """The rows between scan and ranking are k a query and bundle of cells, not k a query and cell; the results are those of all cells one by one."""
    rows, asked = clustered(spark, 3000, clusters=6)
    index, passed = vectors.build_vector_index(rows), []
    top = vectors.top_k
    monkeypatch.setattr(vectors, "top_k", lambda found, *a: passed.append(found.count()) or top(found, *a))
    whole = vectors.search_vectors(rows, index, asked, 5, 1.0).collect()
    assert passed[0] <= 5 * asked.count() and index.cells.where("user_id = 1").count() > 50
    monkeypatch.setattr(vectors, "SLICE", 150)
    monkeypatch.setattr(vectors, "ASKED", 20)
    monkeypatch.setattr(vectors, "AT_ONCE", 7)
    cut = vectors.search_vectors(rows, index, asked, 5, 1.0).collect()
    assert passed[1] > passed[0] and sorted(map(tuple, cut)) == sorted(map(tuple, whole))
