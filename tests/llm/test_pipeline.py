import re
from collections import Counter

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from papyr.llm.queries import model_bytes

from .common_cases import empty_docs, hard_docs
from .test_dedup import brute_components, brute_fingerprint, norm


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, frames = docs.columns, [docs.toPandas()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        frames.append(docs.toPandas())
        assert k == 4 or docs.columns == columns
    raw, known, exact, near, mixed, coded = frames
    assert set(known.doc_id) == {i for i, t in zip(raw.doc_id, raw.text, strict=True) if re.search(r"[^\W\d_]", t or "")}
    assert set(exact.doc_id) == set(known.assign(t=known.text.map(norm)).groupby("t").doc_id.min())
    classes = brute_components([brute_fingerprint(t) for t in exact.text], exact.doc_id.tolist())
    assert sorted(near.doc_id) == sorted(set(classes))
    assert set(mixed.doc_id) == set(near.doc_id) and mixed.doc_id.value_counts().max() <= 2
    assert sorted(coded.doc_id) == sorted(mixed.doc_id)
    texts = dict(zip(mixed.doc_id, mixed.text, strict=True))
    peer = sentencepiece.SentencePieceProcessor(model_proto=model_bytes())
    assert all(list(i) == peer.encode(texts[d]) for d, i in zip(coded.doc_id, coded.ids, strict=True))
    assert coded.parity.all() and coded.round_trip.all()


def test_run_gives_the_stages_rows(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "ids", "parity", "round_trip"] and got.count() > 0


CLASHES = ["score", "share", "held_out", "lang_pred", "epoch", "weight", "block", "block_order", "n_tokens", "_id", "_quota", "_bucket", "_language", "row", "digest", "kept", "column_0"]


def test_stages_take_hard_rows_and_keep_their_columns(spark):
    """After each stage every value of every column of each row is one that the row had before."""
    docs = hard_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    key = F.xxhash64("doc_id", "text", "lang", "source")
    docs = docs.select("*", *(F.concat(F.lit(c), key.cast("string")).alias(c) for c in CLASHES)).cache()
    before = Counter(map(repr, docs.collect()))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns, docs = docs.columns, stage(spark, docs, "").cache()
        after = Counter(map(repr, docs.collect()))
        assert after
        if k == 4:
            assert sum(after.values()) == sum(before.values())
            break
        assert docs.columns == columns and set(after) <= set(before)
        assert all(n <= (2 * before[r] if k == 3 else before[r]) for r, n in after.items())
        assert k != 3 or set(after) == set(before)
        before = after


def test_stages_take_empty_tables(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs(spark), "").count() == 0
