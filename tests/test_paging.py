"""Pages of ordered rows against a plain sort."""

from __future__ import annotations

import math
import random

import pytest

from papyr.operators.paging import pages


@pytest.mark.parametrize("cuts", [4, 1024])
def test_pages_are_those_of_a_plain_sort(spark, cuts):
    rng = random.Random(6)
    rows = [(0 if i % 3 else rng.randrange(1, 30), rng.choice([0.5, 0.5, rng.random(), 0.25]), rng.randrange(200), f"f{i}") for i in range(3000)]  # one user has two thirds, one key half
    asked = [(u, rng.randrange(1, 6), rng.randrange(1, 40)) for u in range(1, 32)] + [(0, 7, 100)]
    frame = spark.createDataFrame(rows, "user_id long, confidence double, document_id long, field_name string").repartition(4)
    requests = spark.createDataFrame(asked, "user_id long, page long, size long")
    want = []
    for user, page, size in asked:
        own = sorted((c, d, f) for u, c, d, f in rows if u == user)
        for n in range((page - 1) * size, min(page * size, len(own))):
            want.append((user, *own[n], n + 1, len(own), math.ceil(len(own) / size)))
    got = pages(frame, requests, "user_id", "confidence", "document_id", "field_name", cuts=cuts)
    assert sorted(map(tuple, got.select("user_id", "confidence", "document_id", "field_name", "place", "total", "total_pages").collect())) == sorted(want)
    assert pages(frame.limit(0), requests, "user_id", "confidence", "document_id").collect() == [] and pages(frame, requests.limit(0), "user_id", "confidence", "document_id").collect() == []


@pytest.mark.parametrize(("ordered", "cuts"), [(0, 4), (50, 8), (10_000, 8)])
def test_rows_are_made_once_and_only_large_users_are_cut(spark, ordered, cuts):
    rng = random.Random(7)
    rows = [(0 if i % 3 else rng.randrange(1, 30), rng.choice([0.5, rng.random()]), i, f"f{i}") for i in range(2000)]
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(rows, "user_id long, confidence double, document_id long, field_name string").repartition(4)
    frame = frame.mapInArrow(count, frame.schema)
    requests = spark.createDataFrame([(u, u % 3 + 1, 7) for u in range(31)], "user_id long, page long, size long")
    got = pages(frame, requests, "user_id", "confidence", "document_id", "field_name", cuts=cuts, ordered=ordered)
    want = []
    for user in range(31):
        own = sorted((c, d) for u, c, d, _ in rows if u == user)
        want += [(user, *own[n], n + 1, len(own)) for n in range(user % 3 * 7, min((user % 3 + 1) * 7, len(own)))]
    assert sorted(map(tuple, got.select("user_id", "confidence", "document_id", "place", "total").collect())) == sorted(want)
    assert made.value == len(rows)
