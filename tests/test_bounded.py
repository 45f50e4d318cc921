"""What a task holds and passes on stays bounded, with the results of the plain way."""

from __future__ import annotations

import math
import random

import pyarrow as pa
import pytest

from papyr.functions import text
from papyr.operators import chunking, field_quality, fulltext, platform, retrieval
from papyr.plans import QUERIES, field_queries, optional_queries
from papyr.sources import entities


def searched(spark):
    words = ["the", "of", "cat", "dog", "bird", "fish", "c++", "a"]
    made = lambda i: None if i % 97 == 0 else " ".join(words[(i * j) % 7 if j % 3 else i % 8] for j in range(1, 4 + i % 5))
    chunks = spark.createDataFrame([(i, made(i)) for i in range(600)], "chunk_id long, content string").repartition(3)
    return chunks, spark.createDataFrame([(i, made(i + 7) or "") for i in range(40)], "query_id long, query string")


def test_keyword_topk_is_that_of_all_pairs_and_each_task_passes_on_k_a_query(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIRS", 50)
    chunks, queries = searched(spark)
    want = retrieval.top_k(retrieval.keyword_scores(chunks, queries), "keyword_score", 5)
    assert sorted(map(tuple, retrieval.keyword_topk(chunks, queries, 5).collect())) == sorted(map(tuple, want.collect())) and want.count() >= 5 * 30
    sent = retrieval.match_blocks(chunks, retrieval.keyword_blocks(queries), retrieval.KeywordMatcher, retrieval.KeywordMatcher.scores, "keyword_score double", 5)
    assert 5 * 30 <= sent.count() <= 3 * 5 * 40


def test_rows_of_a_batch_of_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(retrieval, "PAIRS", 50)
    queries = [f"word{i} same" for i in range(20)]
    found = retrieval.KeywordMatcher(retrieval.KeywordQueries(list(range(20)), "bigint", queries, [q.split() for q in queries], [q.split() for q in queries]))
    batch = pa.record_batch({"chunk_id": list(range(30)), "content": ["same text"] * 29 + ["nothing"]})
    parts = list(retrieval._rows_of(iter([batch]), found, retrieval.KeywordMatcher.scores))
    assert sum(len(c) for _, c in parts) == 29 * 20 and max(len(c) for _, c in parts) <= 60
    assert [c for _, part in parts for c in part.to_pylist()] == [i for i in range(29) for _ in range(20)]


def test_english_search_reads_each_text_once_a_block(spark, monkeypatch):
    chunks, queries = searched(spark)
    plans = [f(chunks, queries)._jdf.queryExecution().optimizedPlan().toString() for f in (fulltext.english_ranks, lambda c, q: fulltext.english_topk(c, q, None))]
    assert all("MapInArrow" in p and "Join" not in p for p in plans)
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 7)
    every = {(r.query_id, r.chunk_id): r.plain_rank for r in fulltext.english_topk(chunks, queries, None).where("plain_rank > 0").collect()}
    assert every == {(r.query_id, r.chunk_id): r.plain_rank for r in fulltext.english_ranks(chunks, queries).collect()} and every
    index = fulltext.build_index(chunks)
    assert sorted(map(tuple, fulltext.english_topk(chunks, queries, 4).collect())) == sorted(map(tuple, fulltext.english_topk(chunks, queries, 4, index).select("query_id", "chunk_id", "plain_rank", "web_rank", "partial_score", "keyword_score", "rank").collect()))


def test_chunks_and_fields_are_worked_out_by_row_helpers(spark):
    spaced = "A  b.  c! d। e　\n\nHEAD\n\nx y z\n"
    assert text.block_list(spaced) == ["A  b.  c! d। e", "HEAD", "x y z"] and text.sentence_list("A  b.  c! d। e") == ["A  b.", "c!", "d।", "e"]
    long = " ".join(["word"] * 2000) + ". end."
    assert [text.count_words(p) for p in chunking.limited(long)] == [769, 769, 462, 1] and list(chunking.fold_blocks(["HEAD", "x"])) == [("HEAD", "HEAD\n\nx")]
    rows = spark.createDataFrame([("3rd of March 2024", "CURRENCY"), ("3/2/2024", "DATE"), (None, "DATE")], "raw_value string, field_type string").repartition(1)
    rows = rows.selectExpr("*", "'f' as field_name", "0.5d as confidence", "false as is_rejected")
    found = field_quality.validated(rows)
    assert {(r.raw_value, str(r.parsed_date), r.amount) for r in found.collect()} == {("3rd of March 2024", "None", None), ("3/2/2024", "2024-02-03", None), (None, "None", None)}
    for plan in (found, chunking.chunk_pages(rows.withColumnRenamed("raw_value", "raw_text"))):
        shown = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in shown and "aggregate(" not in shown and "regexp_extract" not in shown


def test_the_field_pipeline_makes_its_rows_once(spark):
    """One join, and one scan of either extraction; rows of one name are scored by the name's best open block."""
    fields = "document_id long, field_name string, field_type string, raw_value string, confidence double, is_verified boolean, is_rejected boolean"
    old = spark.createDataFrame([(1, "a", "TEXT", "alpha", 0.5, True, False), (1, "a", "TEXT", "gone", 0.5, False, True), (1, "a", "TEXT", "other", 0.5, True, False)], fields)
    new = spark.createDataFrame([(1, " b ", "weird", "beta", 0.4, 1.0, 0), (1, "a", "weird", "beta", 0.4, 1.0, 0), (2, "c", "TEXT", "xy", 0.2, 1.0, 0)], "document_id long, field_name string, field_type string, raw_value string, confidence double, source_page double, seq int")
    blocks = spark.createDataFrame([(1, "ALPHA beta", 0.9), (1, "gone", 1.0), (2, "xy", 1.0)], "version_id long, block_text string, confidence double")
    found = field_quality.field_quality_pipeline(old, new, blocks, ["seq"])
    assert sorted((r.document_id, r.field_name, r.raw_value, r.confidence) for r in found.collect()) == [
        (1, "a", "alpha", 0.62), (1, "a", "gone", 0.5), (1, "a", "other", 0.62), (1, "b", "beta", 0.55), (2, "c", "xy", 0.2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("LogicalRDD") == 3


def test_copies_go_before_they_are_scored(spark):
    """Of equal texts the smallest id is scored, once; no pairs of queries and chunks are joined or grouped."""
    rows = [(i, None if i % 50 == 0 else f"the cat {i % 7} of dog") for i in range(1, 300)] + [(9, "the cat 2 of dog"), (9, "own text cat")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string").repartition(5)
    queries = spark.createDataFrame([(1, "cat"), (2, "dog 3"), (3, "own")], "query_id long, query string")
    want = {}
    for r in retrieval.keyword_scores(chunks, queries).join(chunks, "chunk_id").collect():
        key = (r.query_id, r.content)
        want[key] = min(want.get(key, (r.chunk_id, r.keyword_score)), (r.chunk_id, r.keyword_score))
    found = retrieval.keyword_scores(retrieval.distinct_texts(chunks), queries)
    assert sorted((r.query_id, r.chunk_id, r.keyword_score) for r in found.where("chunk_id <> 9").collect()) == sorted((q, *v) for (q, _), v in want.items() if v[0] != 9)
    assert {(r.chunk_id, r.content) for r in retrieval.distinct_texts(chunks).where("chunk_id = 9").collect()} == {(9, "own text cat")}
    plan = optional_queries.context_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Aggregate" not in above and "Join" not in above


def test_bm25_counts_words_text_by_text(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIRS", 50)
    chunks, queries = searched(spark)
    plan = retrieval.bm25_scores(chunks, queries)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Generate" not in plan
    texts = {r.chunk_id: retrieval.TOKEN.findall(r.content.lower()) for r in chunks.collect() if r.content is not None}
    texts = {i: t for i, t in texts.items() if t}
    mean = sum(map(len, texts.values())) / len(texts)
    want = {}
    for r in queries.selectExpr("query_id", "query").collect():
        for term in {w.translate(str.maketrans("", "", retrieval.STRIP)) for w in r.query.split()} if r.query.strip() else ():
            own = {i: t.count(term) for i, t in texts.items() if term in t and len(term) > 1}
            for i, tf in own.items():
                gain = math.log(1 + (len(texts) - len(own) + 0.5) / (len(own) + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(texts[i]) / mean))
                want[r.query_id, i] = want.get((r.query_id, i), 0) + gain
    for at_once in (5000, 9):
        monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", at_once)
        got = {(r.query_id, r.chunk_id): r.bm25 for r in retrieval.bm25_scores(chunks, queries).collect()}
        assert got.keys() == want.keys() and len(got) > 1000 and all(abs(got[k] - want[k]) < 6e-4 for k in got)
    assert retrieval.bm25_scores(chunks.limit(0), queries).collect() == [] and retrieval.bm25_scores(chunks, queries.limit(0)).collect() == []


def test_completeness_groups_one_row_a_document(spark, monkeypatch):
    registry = platform.EXPECTED_FIELDS
    known = [c for c in registry if c != "UNKNOWN"]
    docs = spark.createDataFrame([(i, known[i % len(known)] if i % 5 else None) for i in range(60)] + [(60, "no such")], "document_id long, category string")
    own = lambda i: registry[known[i % len(known)] if i % 5 else "UNKNOWN"]
    rows = [(i, f, n % 4 == 3) for i in range(60) for n, f in enumerate([*own(i), *own(i), "other", None]) if n % 3]
    fields = spark.createDataFrame(rows, "document_id long, field_name string, is_rejected boolean")
    want = sorted((i, len({f for j, f, no in rows if j == i and not no} & own(i).keys()), len(own(i))) for i in range(60)) + [(60, 0, len(registry["UNKNOWN"]))]
    for bits in (62, 5):
        monkeypatch.setattr(platform, "BITS", bits)
        found = platform.schema_completeness(docs, fields)
        assert sorted((r.document_id, r.present, r.expected) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Join ") == 2


def test_block_matches_trim_without_regular_expressions(spark):
    """A Java class of many ranges tries each of them for every character of every block."""
    fields = spark.createDataFrame([(1, "a", "　Total 12 \n"), (1, "b", " x﻿"), (2, "a", "none")], "document_id long, field_name string, raw_value string")
    blocks = spark.createDataFrame([(1, " the TOTAL 12 is ", 0.4), (1, "\ttotal ", 0.7), (2, "​other", 0.9)], "version_id long, block_text string, confidence double")
    best = field_quality.best_block_confidence(fields, blocks)
    assert [tuple(r) for r in best.collect()] == [(1, "a", 0.7)]
    assert "regexp" not in best._jdf.queryExecution().optimizedPlan().toString()


def test_block_matches_work_a_text_out_once(spark):
    """The filter by length reads the trimmed text in small letters that the join reads."""
    fields = spark.createDataFrame([(1, "a", " Bé1 "), (1, "b", "x"), (1, "c", None), (2, "a", "long value")], "document_id long, field_name string, raw_value string")
    blocks = spark.createDataFrame([(1, "\tA BÉ1", 0.4), (1, "bé", 0.9), (1, None, 0.9), (2, " VALUE\n", 0.2), (2, " \u00a0", 0.8)], "version_id long, block_text string, confidence double")
    best = field_quality.best_block_confidence(fields, blocks)
    assert sorted(map(tuple, best.collect())) == [(1, "a", 0.4), (2, "a", 0.2)]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == plan.count("trim(") == 2


def test_second_words_split_no_more_of_a_text(spark, tmp_path):
    texts = {1: None, 2: "", 3: "one", 4: "one ", 5: " two", 6: "one  three", 7: "one two", 8: "one two three four", 9: "one\ntwo three"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = field_queries._text_fields(spark, str(tmp_path))
    second = {r.document_id: r.raw_value for r in found.collect() if r.field_name == "second_word"}
    assert second == {k: t.split(" ")[1] for k, t in texts.items() if t and " " in t}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ", 3)" in plan and ", -1)" not in plan


def searched_block():
    """Queries with copies, short words, web syntax, white space of all kinds and hundreds of words; texts with copies, a null key and one without words."""
    rng = random.Random(7)
    words = ["the", "of", "or", "cat", "cats", "dog", "bird", "c++", "a", "in", "ab", "runner", "running", "x-ray", "a.b", "日本", "naïve", "or", "in\x1cto", '"cat', "-dog"]
    said = lambda most: " ".join(rng.choices(words, k=rng.randrange(1, most)))
    wholes = [said(7) for _ in range(60)] + ["the or of", "in", "cat", "ab or in", "-dog", "in\x1cto", "\x1c\x1d", said(600), said(600)] + ["cat dog", "cat dog", "cat  dog"]
    strip = str.maketrans("", "", retrieval.STRIP)
    terms = [[w.translate(strip) for w in q.split(" ") if len(w.translate(strip)) >= 2] or [q] for q in wholes]
    tokens = [list(dict.fromkeys(retrieval.TOKEN.findall(q))) for q in wholes]
    texts = [said(40) for _ in range(150)] + wholes[::5] + ["", "in in", "ab in", "ab", "of or in", "the cat  dog", "cats running", "a b c++ \x1c\x1d"] + ["cat dog"] * 9
    rng.shuffle(texts)
    return retrieval.KeywordQueries(list(range(100, 100 + len(wholes))), "bigint", wholes, terms, tokens), pa.record_batch({"chunk_id": pa.array([None, *range(len(texts) - 1)]), "content": texts})


@pytest.mark.parametrize("matcher", [retrieval.KeywordMatcher, fulltext.EnglishMatcher])
@pytest.mark.parametrize("k", [1, 4])
def test_tables_of_words_give_the_best_of_all_pairs(monkeypatch, matcher, k):
    """F1 to F3: sums of rows of bytes give the scores that each pair has by itself, whatever the size of batches and groups."""
    block, batch = searched_block()
    found, want = matcher(block), {}
    for key, text in zip(batch["chunk_id"].to_pylist(), batch["content"].to_pylist(), strict=True):
        rows = matcher.scores(found, text)
        names = ["keyword_score", *(n for n in rows if n not in ("query", "whole", "keyword_score"))]
        for i, *own in zip(rows["query"].tolist(), *(rows[n].tolist() for n in names), strict=True):
            want.setdefault(i, []).append((-own[0], -1 if key is None else key, *own[1:]))
    want = {(i, *row) for i, rows in want.items() for row in sorted(rows)[:k]}
    for at_once, queries, terms in ((2048, 2048, 1 << 16), (16, 7, 40)):
        monkeypatch.setattr(retrieval, "TEXTS_AT_ONCE", at_once)
        monkeypatch.setattr(retrieval, "GROUP_QUERIES", queries)
        monkeypatch.setattr(retrieval, "GROUP_TERMS", terms)
        monkeypatch.setattr(retrieval, "TABLE_BYTES", 1 << 26 if at_once > 16 else 0)
        distinct, of = block.distinct()
        assert len(distinct.ids) < len(block.ids) == len(of)
        best = retrieval.BestPairs(distinct, matcher.Ranks(distinct), k)
        for begin in range(0, batch.num_rows, 50):
            best.add(batch.slice(begin, 50))
        rows = best.best.rows().to_pylist()
        got = {(r["query"], -r["keyword_score"], -1 if r["chunk_id"] is None else r["chunk_id"], *(r[n] for n in names[1:])) for r in rows}
        assert {(i, *row) for i, n in enumerate(of.tolist()) for q, *row in got if q == n} == want


def test_a_text_is_searched_once_for_all_queries(spark):
    assert retrieval.QUERIES_AT_ONCE >= 1 << 16
    chunks = spark.createDataFrame([(i, "cat dog " * (1 + i % 3)) for i in range(300)], "chunk_id long, content string").coalesce(1)
    queries = spark.createDataFrame([(i, ("cat dog", "cat")[i % 2]) for i in range(400)], "query_id long, query string")
    blocks = retrieval.keyword_blocks(queries)
    assert len(blocks) == 1 and len({id(t) for own in blocks[0].terms for t in own}) == 2  # words are shared, so that a block is short
    found = retrieval.keyword_topk(chunks, queries, 3).collect()
    assert len(found) == 400 * 3 and {r.chunk_id for r in found if r.query_id % 2} == {0, 1, 2}
    assert len(blocks[0].distinct()[0].ids) == 2


DATA = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString(), rows._jdf.queryExecution().executedPlan().toString()


def test_versions_are_compared_row_by_row(spark):
    """fields are neither shuffled nor sorted, what is made of a line isn't either."""
    for name in ("version_field_diff", "version_diff_summary", "field_name_union"):
        optimized, physical = plan(QUERIES[name](spark, DATA))
        assert physical.count("Exchange ") == 1 and "Aggregate" not in optimized
        assert "OCR failed" not in physical[physical.index("Exchange ") :]
    listed, given = platform.field_pairs(entities.version_fields(spark, DATA)), entities.version_field_pairs(spark, DATA)
    sides = ("document_id", "version_number", "old", "new")
    assert sorted(map(repr, listed.select(*sides).collect())) == sorted(map(repr, given.select(*sides).collect())) and given.count()


def test_field_changes_of_nulls_and_gaps(spark):
    rows = [(1, 1, 3, 0, "a", "x"), (1, 1, 3, 1, None, "n"), (1, 1, 3, 2, "b", None), (1, 3, 3, 0, "a", " x"), (1, 3, 3, 1, "b", "y"), (1, 3, 3, 2, "b", None), (2, 1, 1, 0, "a", "alone")]
    fields = spark.createDataFrame(rows, "document_id long, version_number long, last_version long, seq int, name string, value string")
    got = [tuple(r)[1:] for r in platform.version_field_diff(fields).orderBy("version_number", "place").collect()]
    assert got == [(2, "b", None, None, "ADDED", 1), (2, None, "n", None, "REMOVED", 2), (2, "a", "x", None, "REMOVED", 3), (3, "a", None, " x", "ADDED", 1), (3, "b", None, None, "ADDED", 2)]
    counted = platform.pairs_summary(platform.field_pairs(fields)).orderBy("version_number").collect()
    assert [tuple(r) for r in counted] == [(1, 2, 0, 1, 2, 0), (1, 3, 0, 2, 0, 0)]


def test_quantiles_count_runs_of_one_time(spark):
    """exact percentiles from counts of (stage, time), beyond what a sketch of 1000 keeps too; no task holds the runs."""
    made = lambda i: f'[{{"stage":"OCR","status":"PROCESSING","at":0}},{{"stage":"OCR","status":"COMPLETED","at":{i * i}}}]'
    histories = spark.createDataFrame([(i, made(i)) for i in range(1, 4101)], "document_id long, stage_history string")
    rows = platform.stage_time_quantiles(histories)
    assert [tuple(r) for r in rows.collect()] == [("OCR", 4100, 2050**2, 3690**2, 4059**2)]
    assert "percentile" not in plan(rows)[0]
