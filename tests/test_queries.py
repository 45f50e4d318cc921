"""Every query with SQL gives DuckDB's rows; fixed examples of the platform's rules; streams against their batch twins."""

import datetime
import decimal
import json
import math
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from papyr.functions import fields as P
from papyr.functions import text as T
from papyr.functions.registry import register
from papyr.operators import chunking, field_quality, ocr, platform, retrieval
from papyr.operators import vectors as vectors_of
from papyr.plans import QUERIES, SQL, page_queries
from papyr.sources import entities, files
from papyr.streaming import jobs

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (decimal.Decimal, float)):
        return None if isinstance(value, float) and math.isnan(value) else round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return [plain(v) for v in value] if isinstance(value, list) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    have = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    assert have == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def column(spark, values, of):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string").select("i", of(F.col("v")).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


DATES = {
    "20-08-2026": "2026-08-20", "15/08/2026": "2026-08-15", "15.08.2026": "2026-08-15", "5-8-2026": "2026-08-05", "2026-08-20": "2026-08-20", "20 Aug 2026": "2026-08-20",
    "Aug 20, 2026": "2026-08-20", "September 3 2026": "2026-09-03", "20 अगस्त 2026": "2026-08-20", "15 जनवरी 2026": "2026-01-15", "1 फ़रवरी 2026": "2026-02-01",
    "6th May 2026": "2026-05-06", "22nd of August 2026": "2026-08-22", "29-02-2024": "2024-02-29", "31-02-2026": None, "15-13-2026": None, "00-01-2026": None,
    "29-02-2025": None, "": None, "not a date": None, "20-08": None, None: None,
}
AMOUNTS = {
    "₹1,200.50": 1200.5, "Rs. 45,000": 45000, "INR 1000": 1000, "1,00,000": 100000, "₹12,34,567.89": 1234567.89, "5000/-": 5000, "-500": -500, "(1,200)": -1200,
    "$100.00 USD": 100, "€250": 250, "AED 1,500": 1500, "12 bags of cement": None, "N/A": None, "": None, "1.2.3": None, None: None,
}
HEADINGS = {"GOVERNMENT OF INDIA": True, "Subject:": True, "this is ordinary body text": False, "12-08-2026": False, "1234567890": False, "यह एक पंक्ति है": False, "A" * 81: False}
LANGUAGES = {"abcd": "unknown", "abcde": "en", "नमस्ते दुनिया": "hi", "नमस्ते hello there you": "hi+en", "hello नम": "hi+en"}


def test_dates(spark):
    assert column(spark, list(DATES), lambda v: P.parse_date(v).cast("string")) == list(DATES.values())


def test_amounts(spark):
    assert column(spark, list(AMOUNTS), P.parse_amount) == list(AMOUNTS.values())


def test_gstin_headings_languages_and_normal_form(spark):
    assert column(spark, ["27AAPFU0939F1ZV", "27AAPFU0939F1Z", "AAPFU0939F1ZV", ""], P.is_gstin) == [True, False, False, False]
    assert column(spark, list(HEADINGS), T.is_heading) == list(HEADINGS.values())
    assert column(spark, list(LANGUAGES), T.script_language) == list(LANGUAGES.values())
    rough = ["é ​x \ty\r\nz", "a\n\n\n\n\nb", " \n \n\n \nq ", "", None]
    assert column(spark, rough, T.normalize) == ["é x y\nz", "a\n\nb", "q", "", ""]


def brute_pieces(text):
    """Sentences packed up to the limit, a longer one cut by words."""
    def tokens(t):
        return math.floor(len(t.split()) * 1.3 + 0.5)

    if tokens(text) <= 1000:
        return [text]
    out, buf = [], ""
    for s in [x.strip() for x in re.split(r"(?<=[.!?।])\s+", text) if x.strip()]:
        if tokens(s) > 1000:
            out += [buf] if buf else []
            buf, w = "", s.split()
            out += [" ".join(w[i : i + 769]) for i in range(0, len(w), 769)]
        elif tokens(f"{buf} {s}") > 1000:
            out, buf = out + [buf], s
        else:
            buf = f"{buf} {s}".strip()
    return out + [buf] if buf else out


def test_hard_limit_keeps_every_word(spark):
    texts = ["lorem " * 5000, "one two three four five six seven eight nine ten. " * 300, "short one.", "a b c. " + "w " * 1600 + ". end of it."]
    got = column(spark, [t.strip() for t in texts], chunking.enforce_hard_limit)
    assert got == [brute_pieces(t.strip()) for t in texts]
    assert [" ".join(g).split() for g in got] == [t.split() for t in texts]


def test_headings_become_sections_and_stay_in_the_text(spark):
    pages = spark.createDataFrame([(1, 1, "GOVERNMENT NOTICE\n\n" + "word " * 60), (2, 1, ""), (3, 1, "hi"), (4, 1, None)], "version_id long, page_number long, raw_text string")
    rows = chunking.chunk_documents(pages).collect()
    assert [(r.version_id, r.section_title, r.chunk_index) for r in rows] == [(1, "GOVERNMENT NOTICE", 0)]
    assert rows[0].content.startswith("GOVERNMENT NOTICE\n\nword")


def test_snippets(spark):
    content = "x" * 100 + " We offer an Internship here (c++) " + "y " * 200
    rows = spark.createDataFrame([(content, "internship c++"), (content, "absent"), ("short", "an"), ("", "word")], "c string, q string")
    a, b, c, d = [r.s for r in rows.select(retrieval.snippet(F.col("c"), F.col("q")).alias("s")).collect()]
    assert a.startswith("...") and a.endswith("...") and "**Internship**" in a and "**c++**" in a
    assert b == content[:200] + "..." and c == "short" and d == ""


def test_citations_and_fusion(spark):
    answers = ["[Source 1: x] and 【Source 2】", "Source 3", "none", "[source 2][Source 2] [SOURCE 1]"]
    assert column(spark, answers, retrieval.cited_sources) == [[1, 2], [3], [], [2, 1]]
    semantic = spark.createDataFrame([(1, 7, 0.8)], "query_id long, chunk_id long, semantic_score double")
    lexical = spark.createDataFrame([(1, 7, 0.5)], "query_id long, chunk_id long, keyword_score double")
    r = retrieval.fuse(semantic, lexical, 10).first()
    assert (r.semantic_score, r.keyword_score, r.final_score) == (1.0, 1.0, 1.0)


def test_sql_functions_are_the_column_expressions(spark):
    register(spark)
    got = spark.sql("SELECT est_tokens('a b c') AS t, confidence_band(0.7D) AS b, is_gstin('27AAPFU0939F1ZV') AS g, cosine_sim(array(1D, 0D), array(1D, 0D)) AS c, query_lang('नमस्ते') AS l").first()
    assert tuple(got) == (4, "MEDIUM", True, 1.0, "hi")
    texts = [*DATES, *AMOUNTS, *HEADINGS, *LANGUAGES, " 27AAPFU0939F1ZV\u00a0", "\u200327aapfu0939f1zv", "\n\t", "x" * 200, "A:\nB:", "(1.5)", "+7", "Aug. 3 2026", "99 abc 2026"]
    twins = {"est_tokens": T.estimate_tokens, "query_lang": T.query_language, "detect_lang": T.script_language, "is_heading": T.is_heading, "parse_doc_date": P.parse_date, "parse_amount": P.parse_amount, "is_gstin": P.is_gstin}
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for name, of in twins.items():
        assert [tuple(r) for r in rows.select("text", of(F.col("text")).alias("x")).collect()] == [tuple(r) for r in rows.selectExpr("text", f"{name}(text) as x").collect()], name


def test_files_and_payloads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Page /Type /Pages /Type /Page\n")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 9)
    (tmp_path / "c.webp").write_bytes(b"RIFF1234WEBPxx")
    (tmp_path / "d.txt").write_bytes(b"plain")
    rows = {os.path.basename(r.path): r for r in files.pdf_page_audit(files.ingest_manifest(spark, str(tmp_path))).collect()}
    assert [rows[n].mime_type for n in sorted(rows)] == ["application/pdf", "image/png", "image/webp", None]
    assert rows["d.txt"].reject_reason == "UNSUPPORTED_TYPE" and rows["a.pdf"].page_count == 2
    assert rows["b.png"].page_error is None and rows["b.png"].page_count == 1  # an image is no broken PDF
    listed = spark.createDataFrame([("application/pdf", b"%PDF /Count 7 /Count 9"), ("application/pdf", b"\x89PNG"), ("application/pdf", b"%PDF" + b"/Type /Page " * 101), ("image/png", b"%PDF"), (None, b"")], "declared_mime string, content binary")
    assert [(r.page_count, r.page_error) for r in files.pdf_page_audit(listed).collect()] == [(7, None), (1, "CORRUPT_PDF"), (101, "TOO_MANY_PAGES"), (1, None), (1, None)]
    assert [(r.mime_type, r.status) for r in files.compare_mime(listed).collect()] == [("application/pdf", "OK"), ("image/png", "FAILED"), ("application/pdf", "OK"), ("application/pdf", "FAILED"), (None, "FAILED")]
    names = ["https://x.y/a b/Report Final.PDF", "dir/ümläut__file.tar.gz", "/", ".hidden", "n" * 150 + ".png", "no_ext", "shout.PDF"]
    key = files.storage_key(F.lit("u"), F.lit("d"), F.lit("v"), F.col("v"))
    assert [k.removeprefix("documents/u/d/v/original/") for k in column(spark, names, lambda _: key)] == ["Report_Final_PDF.pdf", "_ml_ut_file_tar.gz", "", "_hidden", "n" * 100 + ".png", "no_ext", "shout_PDF.pdf"]
    ocr = spark.createDataFrame([(1, 2, '{"blocks": [{"text": "x", "confidence": 0.5}, {}]}'), (1, 3, "{}"), (1, 4, "bad")], "version_id long, page_number long, payload string")
    got = files.parse_ocr_payloads(ocr).select("block_id", "block_text", "confidence", "block_order", "block_type").collect()
    assert [tuple(r) for r in got] == [("paddle-2-0", "x", 0.5, 0, "text"), ("paddle-2-1", "", 0.0, 1, "text"), (None,) * 5, (None,) * 5]  # pages without blocks stay
    replies = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('{"a": 2}',), ("oops",), (None,)], "reply string")
    assert [(r.parsed and r.parsed.a, r.malformed) for r in files.parse_llm_payloads(replies, "a int").collect()] == [(1, False), (2, False), (None, True), (None, True)]


def test_upsert_and_partition_replacement(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, version_id long")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2)], "k long, v string, version_id long")
    merged = files.upsert_by_key(old, new, ["k"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 2)]
    some = files.upsert_by_key(old.withColumn("w", F.lit("old")), new.withColumn("w", F.lit("new")), ["k"], ["v"])
    assert sorted((r.k, r.v, r.w) for r in some.collect()) == [(1, "a", "old"), (2, "c", "old"), (3, "d", "new")]
    path = str(tmp_path / "t")
    files.replace_partitions(merged, path)
    files.replace_partitions(spark.createDataFrame([(9, "z", 2)], "k long, v string, version_id long"), path)
    assert sorted((r.k, r.version_id) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 1), (9, 2)]


def stream(spark, frame, path):
    frame.repartition(3).write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def until(spark, frame, name, rows):
    """A stream that waits for time to pass never ends by itself: it is stopped when the rows are there."""
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="1 second").start()
    for _ in range(60):
        if spark.table(name).count() >= rows or not q.isActive:
            break
        q.awaitTermination(1)
    q.stop()
    assert q.exception() is None
    return spark.table(name)


def test_streams_equal_their_batch_twins(spark, tmp_path):
    got = drain(spark, jobs.rate_windows(stream(spark, entities.requests(spark, DATA), str(tmp_path / "e")), "60 days"), "rates", "complete")
    columns = ("user_id", "method", "path", "window_start", "requests", "limited", "remaining", "reset_at")
    assert sorted(got.select(*columns).collect()) == sorted(QUERIES["rate_windows"](spark, DATA).select(*columns).collect())
    audit = entities.audit_logs(spark, DATA)
    got = drain(spark, jobs.audit_counts(stream(spark, audit, str(tmp_path / "a")), "60 days"), "audit", "complete")
    assert sorted((r.event_type, str(r.day.start.date()), r["count"]) for r in got.collect()) == sorted((r.event_type, r.day, r.events) for r in QUERIES["audit_counts"](spark, DATA).collect())


def test_answers_embeddings_and_ingestion(spark, tmp_path):
    deltas = spark.createDataFrame([(1, 1, "b", False), (1, 0, "a", False), (1, 2, None, True), (2, 0, "open", False), (3, 0, "x", True), (1, 0, "a", False)], "message_id long, seq long, delta string, done boolean")
    got = until(spark, jobs.assemble_answers(stream(spark, deltas, str(tmp_path / "d"))), "answers", 2)
    assert {r.message_id: (r.answer, r.complete) for r in got.collect()} == {1: ("ab", True), 3: ("x", True)}
    texts = spark.createDataFrame([("m", t, datetime.datetime(2024, 1, 1, h)) for h, t in enumerate(["a", "b", "a", "a"])], "model string, text string, seen_at timestamp")
    once = drain(spark, jobs.embed_once(stream(spark, texts, str(tmp_path / "t"))), "once")
    assert sorted(r.text for r in once.collect()) == ["a", "b"]


def test_stuck_versions_by_timers_that_outlive_a_restart(spark, tmp_path):
    """One stays queued, one is done in time, one is in work at its last attempt, one came long ago, one is done before an older state comes."""
    now, old = datetime.datetime.now(), datetime.datetime(2020, 1, 1)
    schema = "document_id long, version_number long, version_status string, version_created_at timestamp, attempts int"
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")

    def land(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(landing)

    def acted():
        found = [] if not os.path.exists(out) else spark.read.schema("document_id long, version_number long, attempts int, action string").parquet(out).collect()
        return sorted((r.document_id, r.attempts, r.action) for r in found)

    def watch(enough):
        source = spark.readStream.schema(schema).parquet(landing)
        q = jobs.stuck_monitor(source, timeout=1.0, backoff=0.01).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
        for _ in range(80):
            if enough():
                break
            q.awaitTermination(1)
        q.stop()
        assert q.exception() is None

    later = now + datetime.timedelta(days=1)
    land((1, 1, "QUEUED", now, 0), (2, 1, "PROCESSING", later, 0), (3, 1, "PROCESSING", now, 3), (4, 1, "QUEUED", old, 2), (5, 1, "COMPLETED", later, 0), (5, 1, "QUEUED", now, 0))
    watch(lambda: (3, 3, "FAIL") in acted() and (4, 2, "RETRY") in acted())
    land((2, 1, "COMPLETED", later, 0), (5, 1, "QUEUED", now, 0))
    watch(lambda: (1, 3, "FAIL") in acted() and (4, 3, "FAIL") in acted())
    assert acted() == [(1, 0, "RETRY"), (1, 1, "RETRY"), (1, 2, "RETRY"), (1, 3, "FAIL"), (3, 3, "FAIL"), (4, 2, "RETRY"), (4, 3, "FAIL")]


def test_late_repeats_of_a_given_answer_give_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "d"), "message_id long, seq long, delta string, done boolean"
    for part in ([(1, 0, "a", False), (1, 1, "b", True)], [(1, 0, "a", False)], [(1, 1, "b", True), (2, 0, "x", True)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)
    got = until(spark, jobs.assemble_answers(source), "answers_once", 2)
    assert sorted(map(tuple, got.collect())) == [(1, "ab", True), (2, "x", True)]


def test_boxes_and_line_blocks_by_the_numbers_given(spark):
    w, h, cases = 1200, 800, [
        ([100.0, 500.0, 50.0, 250.0], None, [300, 40, 600, 80]), ([-10.0, 0.0, 2000.0, 990.0], [1.0, 1.0, 1.0, 1.0], [0, 0, 1188, 800]), (None, [0.1, 0.25, 0.5, 1.0], [120, 200, 600, 800]), (None, [5.0, 0.0, 1.0, 1.0], [6000, 0, 1200, 800]),
        (None, [100.0, 100.0, 500.0, 1000.0], [120, 80, 600, 800]), (None, [100.4, 100.5, 500.0, 1000.5], [100, 101, 500, 1001]), (None, [-0.5, -1.5, 1001.0, 3.0], [0, -1, 1001, 3]), (None, [1.0, 2.0, 3.0], [0, 210, 1200, 240]), ([1.0], None, [0, 240, 1200, 270]),
    ]
    rows = [(1, 1, 2 * i, "x", a, b, None, w, h) for i, (a, b, _) in enumerate(cases)] + [(1, 1, 1, " ", None, None, 0.5, w, h), (2, 1, 0, "\u00a0y\u00a0", None, [100.0, 100.0, 500.0, 1000.0], 7.0, 1000, 1000)]
    frame = spark.createDataFrame(rows, "version_id long, page_number long, block_index long, block_text string, box_2d array<double>, bbox array<double>, confidence double, width long, height long")
    got = sorted(ocr.standard_blocks(frame).collect())
    assert [[r.x1, r.y1, r.x2, r.y2] for r in got] == [box for *_, box in cases] + [[100, 100, 500, 1000]]
    assert [r.confidence for r in got] == [0.95] * len(cases) + [1.0] and got[-1].block_text == "y"
    lines = spark.createDataFrame([(1, 1, 0, " a ", 0.0), (1, 1, 1, "", 50.0), (1, 1, 2, "b", None), (1, 1, 3, "c", 3.0), (1, 1, 4, "d", 130.0), (2, 1, 0, "  ", 9.0), (4, 1, 0, "alone", 60.0)], "version_id long, page_number long, line_index long, text string, confidence double")
    pages = spark.createDataFrame([(1, 1, "ignored", 10.0), (2, 1, "\n x \n\n y\n", 0.0), (3, 1, "z", 42.0), (5, 1, " ", 1.0), (6, 1, None, 1.0)], "version_id long, page_number long, raw_text string, confidence double")
    got = sorted(map(tuple, ocr.line_blocks(lines, pages).collect()))
    assert got == [(1, 1, 0, 1, "a", 0.75), (1, 1, 1, 2, "b", 0.75), (1, 1, 2, 3, "c", 0.1), (1, 1, 3, 4, "d", 1.0), (2, 1, 0, 0, "x", 0.8), (2, 1, 1, 1, "y", 0.8), (3, 1, 0, 0, "z", 0.42), (4, 1, 0, 1, "alone", 0.6)]


def test_open_answers_are_given_up(spark, tmp_path):
    deltas = spark.createDataFrame([(2, 1, "open", False), (2, 0, "an ", False)], "message_id long, seq long, delta string, done boolean")
    path = str(tmp_path / "d")
    deltas.write.parquet(path)
    source = spark.readStream.schema(deltas.schema).parquet(path)
    got = until(spark, jobs.assemble_answers(source, "1 second"), "given_up", 1)
    assert [tuple(r) for r in got.collect()] == [(2, "an open", False)]


def test_ingestion_gives_the_batch_result_whatever_the_batches(spark, tmp_path):
    """Every page of a version comes in a batch of its own, some come again, and the stream runs twice."""
    pages = entities.ocr_pages(spark, DATA).select("version_id", "page_number", "raw_text")
    several = pages.where("version_id % 5 = 0 and page_number <= 3").cache()
    stale = several.where("page_number = 1").withColumn("raw_text", F.lit("an earlier reading of this page, which the later one replaces"))
    landing, path = tmp_path / "landing", str(tmp_path / "ingested")
    for i, part in enumerate((stale, several.where("page_number = 2"), several.where("page_number = 1"), several.where("page_number = 3"))):
        part.coalesce(1).write.parquet(str(landing / f"{i}"))
        source = spark.readStream.schema(pages.schema).option("recursiveFileLookup", "true").parquet(str(landing))
        jobs.ingest(source, path, str(tmp_path / "checkpoint")).awaitTermination(120)
    jobs.ingest(spark.readStream.schema(pages.schema).parquet(str(landing / "3")), path, str(tmp_path / "another")).awaitTermination(120)
    columns = ("version_id", "page_number", "chunk_index", "section_title", "content", "token_count")
    got = jobs.ingested(spark, path)
    have = sorted(map(tuple, got.select(*columns).collect()), key=str)
    assert have == sorted(map(tuple, chunking.chunk_documents(several).select(*columns).collect()), key=str) and max(r[1] for r in have) == 3
    r = got.first()
    assert len(r.embedding) == 64 and r.language in ("en", "hi", "hi+en", "unknown")


def test_audit_stream_outlives_a_failure(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "audit_id long, event_type string")
    source = stream(spark, rows, str(tmp_path / "a"))
    (tmp_path / "file").write_text("not a folder")
    q = jobs.append_audit(source, str(tmp_path / "file" / "t"), str(tmp_path / "c1"))
    q.awaitTermination(60)
    assert q.exception() is None
    jobs.append_audit(source, str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination(60)
    assert sorted(map(tuple, jobs.audited(spark, str(tmp_path / "t")).collect())) == [(1, "a"), (2, "b")]
    for done in (tmp_path / "c2" / "commits").iterdir():  # the batch was written, but the stream died before it noted that
        done.unlink()
    jobs.append_audit(source, str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination(60)
    assert sorted(map(tuple, jobs.audited(spark, str(tmp_path / "t")).collect())) == [(1, "a"), (2, "b")]


def test_stuck_versions(spark):
    now = "2024-01-01 12:00:00"
    rows = spark.createDataFrame([(1, "QUEUED", "2024-01-01 11:49:50", 0), (2, "QUEUED", "2024-01-01 11:51:00", 0), (3, "PROCESSING", "2024-01-01 11:00:00", 3), (4, "COMPLETED", "2023-01-01 00:00:00", 0), (5, "QUEUED", "2024-01-01 11:49:50", 2)], "document_id long, version_status string, at string, attempts long")
    got = jobs.stuck_versions(rows.withColumn("version_created_at", F.col("at").cast("timestamp")), now)
    assert sorted((r.document_id, r.action) for r in got.collect()) == [(1, "RETRY"), (3, "FAIL")]


@pytest.mark.parametrize("vectors,queries,name", [("_vectors", "_vector_queries", "semantic_topk_approx"), ("_all_vectors", "_all_vector_queries", "semantic_topk_approx_all")])
def test_approximate_search_recalls_the_nearest_and_gives_whole_lists(spark, vectors, queries, name):
    rows, asked = getattr(page_queries, vectors)(spark, DATA), getattr(page_queries, queries)(spark, DATA)
    want = {(r.query_id, r.chunk_id) for r in retrieval.semantic_topk(rows, asked, 10).collect()}
    index = vectors_of.build_vector_index(rows)
    for found, least in ((QUERIES[name](spark, DATA), 0.9), (vectors_of.search_vectors(rows, index, asked, 10, 1.0), 0.9), (vectors_of.search_vectors(rows, index, asked, 10, 1e-6), 0.1)):
        got = [(r.query_id, r.chunk_id) for r in found.collect()]
        assert len(got) == len(set(got)) == len(want) and {q for q, _ in got} == {q for q, _ in want}
        assert len(set(got) & want) >= least * len(want)


def plain_rank(words, tokens):
    """Full-text rank of a text that has all tokens, by a plain double loop over positions."""
    places = [[i for i, w in enumerate(words, 1) if w == t][:256] for t in tokens]
    if not all(places) or not tokens:
        return 0.0
    if len(places) == 1:
        return sum(0.1 / n**2 for n in range(1, len(places[0]) + 1)) / 1.64493406685
    rest = 1.0
    for i, own in enumerate(places):
        for other in places[:i]:
            for x in own:
                for y in other:
                    d = abs(x - y)
                    rest *= 1 - 0.1 * math.sqrt(1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)))
    return 1 - rest


def plain_keyword(content, query):
    """(qualifies, score) of one text for one query."""
    low, q = content.lower(), query.strip().lower()
    words = ["".join(c for c in w if c not in "'\":*&|!()\\") for w in q.split()]
    words = [w for w in words if len(w) >= 2] or [q]
    rank = plain_rank(re.findall(r"[^\W_]+", low), list(dict.fromkeys(re.findall(r"[^\W_]+", q))))
    share = 0.10 + 0.35 * sum(w in low for w in words) / len(words)
    score = max(0.95 if q in low else 0.0, 1.5 * rank, share)
    return bool(q) and (q in low or any(len(w) >= 3 and w in low for w in words) or rank > 0), math.floor(score * 10000 + 0.5) / 10000


def test_keyword_scores_against_brute_force(spark, monkeypatch):
    texts = ["Notice of the Scholarship notice", "scholarship: apply (online) by 15-09-2026", "c++ and c", "", None, "of of of", "NOTICE notice notice of", "x" * 50 + "scholarship", "apply " * 300 + "online", "ümlaut Straße", "apply now online " * 60]
    asked = ["scholarship notice", "of", "c++", "apply online", '"of" (the) & notice', "  ", "a", "zzz", "notice notice", "Straße", "absent scholarship"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    want = {}
    for i, q in enumerate(asked):
        for k, t in enumerate(texts):
            qualifies, score = plain_keyword(t, q) if t is not None else (False, 0)
            if qualifies:
                want[i, k] = score
    for at_once in (5000, 3):
        monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", at_once)
        got = {(r.query_id, r.chunk_id): r.keyword_score for r in retrieval.keyword_scores(chunks, queries).collect()}
        assert got == pytest.approx(want)
    assert retrieval.keyword_scores(chunks, queries.limit(0)).count() == 0 and retrieval.keyword_scores(chunks.limit(0), queries).count() == 0
    assert want[3, 10] > 0.95  # many words near each other outrank the whole query


def brute_search(texts, queries, k):
    """query -> best chunks: keyword, semantic and hybrid, by plain loops."""
    vectors = {i: retrieval.hash_embed(t, 64).astype(float) for i, t in texts.items()}
    out = {}
    for q, text in queries.items():
        words = {i: s for i, (ok, s) in ((i, plain_keyword(t, text)) for i, t in texts.items()) if ok}
        v = retrieval.hash_embed(text, 64).astype(float)
        near = {i: round(max(float(v @ x / np.linalg.norm(v) / np.linalg.norm(x)), 0), 4) for i, x in vectors.items()}
        best = lambda scores, n: dict(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:n])
        a, b = best(near, 2 * k), best(words, 2 * k)
        a, b = ({i: x / max(max(s.values(), default=0), 0.001) for i, x in s.items()} for s in (a, b))
        both = {i: round(round(a[i], 4) * 0.6 + b[i] * 0.4 if i in a and i in b else a[i] * 0.6 if i in a else b[i] * 0.4, 4) for i in {*a, *b}}
        out[q] = {"keyword": best(words, k), "semantic": best(near, k), "hybrid": best(both, k)}
    return out


def test_hybrid_search_dispatch_and_snippets_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in entities.table(spark, DATA, "documents").collect()}
    queries = {r.query_id: r.query for r in entities.search_queries(spark, DATA).collect()}
    want = brute_search(texts, queries, 10)
    got = {}
    for r in QUERIES["hybrid_topk"](spark, DATA).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.final_score
    for q, own in got.items():
        expected = want[q]["hybrid"]
        assert sorted(own.values()) == pytest.approx(sorted(expected.values()), abs=2e-4)  # near ties may swap by rounding
        assert len(set(own) & set(expected)) >= len(expected) - 1
    modes = {}
    for r in QUERIES["search_dispatch"](spark, DATA).collect():
        modes.setdefault((r.query_id, r.mode), {})[r.chunk_id] = r.score
        assert r.total_results <= 5
    assert {q for q, _ in modes} == set(queries) and all(m == ("hybrid", "semantic", "keyword")[q % 3] for q, m in modes)
    for (q, mode), own in modes.items():
        expected = brute_search(texts, {q: queries[q]}, 5)[q][mode] if mode == "hybrid" else dict(list(want[q][mode].items())[:5])
        assert sorted(own.values()) == pytest.approx(sorted(expected.values()), abs=2e-4)
    for r in QUERIES["snippets"](spark, DATA).collect():
        clean, terms = " ".join(texts[r.chunk_id].split()), [t for t in queries[r.query_id].lower().split() if len(t) > 2]
        at = next((clean.lower().find(t) for t in terms if t in clean.lower()), None)
        if at is None:
            assert r.snippet == clean[:200] + ("..." if len(clean) > 200 else "")
            continue
        lo, hi = max(0, at - 70), min(len(clean), at + 130)
        expected = ("..." if lo else "") + clean[lo:hi] + ("..." if hi < len(clean) else "")
        for t in terms:
            expected = re.sub(f"({re.escape(t)})", r"**\1**", expected, flags=re.I)
        assert r.snippet == expected


def test_contexts_and_prompts(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, query string")
    ranked = spark.createDataFrame([(1, 7, 2, None), (1, 8, 1, None), (2, 9, 1, "a **kept** snippet")], "query_id long, chunk_id long, rank int, snippet string")
    chunks = spark.createDataFrame([(7, "Deed", 3, None, None, "the **bold** text"), (8, "Bill", 1, "Dues", "INVOICE", "one")], "chunk_id long, title string, page long, section string, category string, content string")
    got = {r.query_id: r.context for r in retrieval.build_context(queries, ranked, chunks).collect()}
    assert got == {
        1: "[Source 1: Bill, Page 1, Section: Dues, Category: INVOICE]\none\n\n[Source 2: Deed, Page 3, Category: General]\nthe bold text",
        2: "[Source 1: Document, Page 1, Category: General]\na kept snippet", 3: "No relevant document context found.",
    }
    rows = {(r.conversation_id, r.turn): r for r in QUERIES["prompt_rows"](spark, DATA).collect()}
    messages = entities.messages(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in entities.table(spark, DATA, "documents").collect()}
    users = [m for m in messages if m.role == "USER"]
    assert set(rows) == {(m.conversation_id, m.turn) for m in users}
    for m in users:
        r = rows[m.conversation_id, m.turn]
        before = sorted((x.turn, f"{x.role}: {x.content}") for x in messages if x.conversation_id == m.conversation_id and x.turn < m.turn)[-6:]
        assert r.question == m.content and r.history == ("\n".join(t for _, t in before) or None) and r.language == "en" and "English" in r.system
        best = sorted(((-s, i) for i, (ok, s) in ((i, plain_keyword(t, m.content)) for i, t in texts.items()) if ok))[:5]
        parts = re.split(r"(?:^|\n\n)\[Source \d+: [^\n]*\]\n", r.context)[1:]
        assert parts == [texts[i].replace("**", "") for _, i in best] if best else r.context == "No relevant document context found."


def brute_chunks(text, hard=True):
    """Chunks of one page by a plain walk over its blocks."""
    tokens = lambda t: math.floor(len(t.split()) * 1.3 + 0.5)
    parts = lambda pattern: [p.strip() for p in re.split(pattern, text) if p.strip()]
    blocks = parts(r"\n\s*\n+")
    blocks = blocks if len(blocks) > 1 else parts(r"\n+")
    blocks = blocks if len(blocks) > 1 else parts(r"(?<=[.!?।])\s+")
    out, buf, section = [], "", None
    for b in blocks:
        heading = len(b) <= 80 and "\n" not in b and (b.endswith(":") or (len(b) > 3 and any(c.isupper() for c in b) and not any(c.islower() for c in b)))
        total = tokens(f"{buf} {b}")
        if heading:
            out += [(section, buf)] if buf else []
            buf, section = b, b
        elif buf and total > 600:
            out.append((section, buf))
            out, buf = ([*out, (section, b)], "") if tokens(b) >= 600 else (out, b)
        elif total >= 300:
            out, buf = [*out, (section, f"{buf}\n\n{b}" if buf else b)], ""
        else:
            buf = f"{buf}\n\n{b}" if buf else b
    out += [(section, buf)] if buf else []
    pieces = [(s, p.strip()) for s, c in out for p in (brute_pieces(c) if hard else [c])]
    return [(s, p) for s, p in pieces if len(p) >= 20]


def test_chunks_of_whole_documents_against_a_plain_walk(spark):
    pages = entities.ocr_pages(spark, DATA).select("version_id", "page_number", "raw_text")
    extra = [(90001, 1, "HEAD ONE\n\n" + "word " * 900 + "\n\nSubject:\n\n" + "a b c. " * 400), (90001, 2, "x " * 3000), (90002, 1, None), (90002, 2, " \n ")]
    pages = pages.unionByName(spark.createDataFrame(extra, "version_id long, page_number long, raw_text string"))
    want = {}
    for r in sorted(pages.collect(), key=lambda r: (r.version_id, r.page_number)):
        want.setdefault(r.version_id, []).extend((r.page_number, *c) for c in brute_chunks(r.raw_text or ""))
    got = {}
    for r in sorted(chunking.chunk_documents(pages).collect(), key=lambda r: (r.version_id, r.chunk_index)):
        got.setdefault(r.version_id, []).append((r.page_number, r.section_title, r.content))
        assert r.chunk_index == len(got[r.version_id]) - 1 and r.token_count <= 1000
    assert got == {k: v for k, v in want.items() if v}
    languages = pages.where("version_id = 90001").withColumns({"language": F.when(F.col("page_number") == 1, "hi"), "document_language": F.lit("en")})
    assert {(r.page_number, r.language) for r in chunking.chunk_documents(languages).collect()} == {(1, "hi"), (2, "en")}


def test_engine_choice(spark):
    """One page a case: what the engines gave, and the engine whose result the page takes."""
    cases = [
        ({"layer": (True, 0, 0.0, False)}, False, 0, "layer"), ({"layer": (True, 3, 1.0, False), "paddle": (True, 9, 1.0, False)}, False, 0, "layer"),
        ({"paddle": (True, 9, 0.8, False), "vision": (True, 4, 1.0, False)}, False, 0, "paddle"), ({"paddle": (True, 9, 0.8, False), "vision": (True, 4, 1.0, False)}, True, 0, "vision"),
        ({"paddle": (True, 9, 0.7, False), "vision": (True, 4, 1.0, False)}, False, 0, "vision"), ({"paddle": (True, 9, 0.9, True), "tesseract": (True, 4, 1.0, False)}, False, 0, "tesseract"),
        ({"paddle": (True, 4, 0.9, False), "tesseract": (True, 4, 1.0, False)}, False, 50_000, "paddle"), ({"paddle": (True, 4, 0.9, False), "tesseract": (True, 4, 1.0, False)}, False, 50_001, "tesseract"),
        ({"paddle": (True, 0, 0.9, False), "vision": (False, 0, 0.0, False), "tesseract": (False, 0, 0.0, False)}, False, 0, "paddle"), ({"layer": (False, 0, 0.0, False), "paddle": (True, 9, 0.75, False)}, False, 0, "paddle"),
    ]
    rows = [(i, 1, first, size, engine, *r) for i, (results, first, size, _) in enumerate(cases) for engine, r in results.items()]
    frame = spark.createDataFrame(rows, "version_id long, page_number long, vision_first boolean, image_bytes long, engine string, has_text boolean, blocks long, confidence double, failed boolean")
    assert {r.version_id: r.engine for r in page_queries.choose_engine(frame).collect()} == {i: want for i, (*_, want) in enumerate(cases)}


def test_platform_rules_on_fixed_rows(spark):
    """Rules that the given tables can't tell apart."""
    def history(*marks):
        return json.dumps([{"stage": s, "status": t, "at": a} for s, t, a in marks])

    rows = spark.createDataFrame([(1, history(("OCR", "PROCESSING", 0), ("OCR", "PROCESSING", 5000), ("OCR", "COMPLETED", 8000), ("CHUNKING", "PROCESSING", 8000), ("CHUNKING", "COMPLETED", 14001))), (2, history(("OCR", "PROCESSING", 0), ("OCR", "COMPLETED", 2001), ("X", "PROCESSING", 0))), (3, history(("OCR", "PROCESSING", 0))), (4, None), (5, history(("OCR", "PROCESSING", 0), ("OCR", "COMPLETED", 500), ("OCR", "PROCESSING", 9000))), (6, history(("OCR", "COMPLETED", 7), ("OCR", "PROCESSING", 10), ("OCR", "COMPLETED", 6010), ("OCR", "PROCESSING", 7000), ("OCR", "COMPLETED", 7020)))], "document_id long, stage_history string")
    got = {r.document_id: (r.stages, r.total_ms, r.worst) for r in platform.stage_timings(rows).collect()}
    assert got == {1: (2, 9001, "SLOW"), 2: (1, 2001, "WARN"), 5: (1, 500, "OK"), 6: (1, 20, "OK")}
    assert {r.stage: (r.runs, r.p50_ms, r.p99_ms) for r in platform.stage_time_quantiles(rows).collect()} == {"OCR": (4, 500, 3000), "CHUNKING": (1, 6001, 6001)}
    inventory = spark.createDataFrame([(1, "COMPLETED", "INVOICE", 3, 2, "m1"), (2, "QUEUED", "-", 0, 0, ""), (3, "FAILED", "UNKNOWN", 1, 1, "m1,old")], "document_id long, status string, category string, field_count long, chunk_count long, models string")
    reasons = {r.document_id: r.reasons for r in platform.needs_repair(inventory).collect()}
    assert reasons == {2: ["no-fields", "bad-category", "no-chunks", "stuck"], 3: ["bad-category", "stale-embeddings"]}
    assert [r.document_id for r in platform.needs_repair(inventory, reasons=("stuck",)).collect()] == [2] and [r.document_id for r in platform.needs_repair(inventory, ids=[1]).collect()] == [1]
    requests = spark.createDataFrame([(m, p) for m, p in [("POST", "/api/auth/login"), ("GET", "/documents"), ("POST", "/documents/1"), ("POST", "/conversations/3/messages"), ("GET", "/conversations"), ("GET", "/search?q"), ("POST", "/review/1")]], "method string, path string").withColumn("ts", F.lit("2024-01-01 00:14:59").cast("timestamp"))
    assert [(r.allowed, r.span) for r in platform.with_rate_rule(requests).collect()] == [(10, 900), (150, 60), (20, 60), (40, 60), (150, 60), (80, 60), (150, 60)]
    docs = spark.createDataFrame([(1, "FAILED"), (2, "QUEUED"), (3, "COMPLETED"), (4, "FAILED"), (5, "FAILED"), (6, "FAILED")], "document_id long, status string")
    kept = spark.createDataFrame([(1, 1, None, "[1]", "OCR", 0), (1, 2, "k", "[2]", "OCR", 1), (2, 1, "PENDING", "[3]", "CHUNKING", 5), (3, 1, "k", "[4]", "OCR", 0), (4, 1, "k", "[]", "OCR", 0), (4, 2, None, "[]", "OCR", 0), (5, 1, "", "[]", "OCR", 0)], "document_id long, version_number long, storage_key string, stage_history string, processing_stage string, retry_count long")
    mine = {r.document_id: (r.version_number, r.status, r.processing_stage, r.stage_history, r.retry_count, r.final_attempt, "processing_error_stack" in r.cleared) for r in platform.retry_reset(docs, kept, by_admin=False).collect()}
    assert mine == {1: (2, "QUEUED", "FILE_VALIDATION", "[]", 2, False, True), 2: (1, "QUEUED", "FILE_VALIDATION", "[]", 6, True, True), 3: (1, "QUEUED", "FILE_VALIDATION", "[]", 1, False, True)}
    bulk = {r.document_id: (r.processing_stage, r.stage_history, r.retry_count, r.final_attempt, "processing_error_stack" in r.cleared) for r in platform.retry_reset(docs, kept, by_admin=True).collect()}
    assert bulk == {1: ("OCR", "[2]", 1, False, False), 2: ("CHUNKING", "[3]", 5, True, False)}
    versions = spark.createDataFrame([(1, 1, 2, 0, "a", "x"), (1, 1, 2, 1, "b", " same "), (1, 1, 2, 2, "a", "last"), (1, 2, 2, 0, "b", "same"), (1, 2, 2, 1, "c", "new"), (2, 1, 1, 0, "a", "alone")], "document_id long, version_number long, last_version long, seq int, name string, value string")
    diff = platform.version_field_diff(versions).orderBy("place").collect()
    assert [(r.version_number, r.field_name, r.old_value, r.new_value, r.change) for r in diff] == [(2, "c", None, "new", "ADDED"), (2, "a", "last", None, "REMOVED"), (2, "b", " same ", "same", "UNCHANGED")]


def test_rejected_fields_stay_and_get_what_a_cross_check_sets(spark):
    old = spark.createDataFrame([(1, "total_amount", "CURRENCY", "900", 0.9, False, True), (1, "tax_amount", "CURRENCY", "10", 0.9, True, False), (1, "gone", "TEXT", "x", 0.9, False, False)], "document_id long, field_name string, field_type string, raw_value string, confidence double, is_verified boolean, is_rejected boolean")
    raw = spark.createDataFrame([(1, " subtotal ", "money", "100", None, 0.0, 0), (1, "invoice_date", "weird", "20-08-2026", 1.5, 2.7, 0), (1, "payment_due_date", "date", "1 Aug 2026", 0.8, 1.0, 0), (1, "tax_amount", "money", "99", 0.5, 1.0, 0), (1, "subtotal", "money", "7", 0.5, 1.0, 1)], "document_id long, field_name string, field_type string, raw_value string, confidence double, source_page double, seq int")
    blocks = spark.createDataFrame([(1, "Subtotal: 100 Rs", 0.5), (2, "20-08-2026", 0.1)], "version_id long, block_text string, confidence double")
    got = {r.field_name: (r.field_type, r.normalized_value, r.confidence, r.is_rejected) for r in field_quality.field_quality_pipeline(old, raw, blocks, ["seq"]).collect()}
    assert got == {
        "total_amount": ("CURRENCY", None, 0.9, True), "tax_amount": ("CURRENCY", "10.00", 0.9, False), "subtotal": ("CURRENCY", "100.00", pytest.approx(0.7 * 0.85 + 0.15), False),
        "invoice_date": ("DATE", "2026-08-20", 1.0, False), "payment_due_date": ("DATE", "2026-08-01", 0.35, False),
    }


def test_reembedded_vectors_are_those_of_the_texts(spark):
    texts = {r.doc_id: r.text for r in entities.table(spark, DATA, "documents").collect()}
    before = {r.chunk_id: r for r in entities.embeddings(spark, DATA).collect()}
    after = QUERIES["reembed_vectors"](spark, DATA).collect()
    assert len(after) == len(before) and any(r.replaced for r in after)
    for r in after:
        stale = before[r.chunk_id].model != "m1"
        assert r.replaced == (stale and texts.get(r.chunk_id) is not None)
        want = retrieval.hash_embed(texts[r.chunk_id], 64).tolist() if r.replaced else before[r.chunk_id].embedding
        assert r.embedding == want and r.model == ("hash" if r.replaced else before[r.chunk_id].model)  # the model that made it


def test_full_text_queries_find_later_parts_of_a_passage(spark, tmp_path):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu omicron sigma tau upsilon"
    spark.createDataFrame([(4, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, "only omicron sigma and upsilon stand here"), (2, passage), (3, "none"), (5, "alpha beta gamma")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.query_id, r.chunk_id): r.rank for r in QUERIES["keyword_topk_full_text"](spark, str(tmp_path)).collect()}
    assert (-5, 1) in got and got[-5, 2] == 1 and (-5, 3) not in got
    assert {r.chunk_id for r in QUERIES["keyword_topk"](spark, str(tmp_path)).collect()} == {1, 2, 5}  # the stated queries are whole passages too


def test_chunk_document_stats_are_those_of_the_chunks(spark, tmp_path):
    docs = [(1, "word " * 5000, "en"), (2, "a short text of a few words", "en"), (3, "", "en"), (4, "word " * 900 + "\n\nthe last block of this text", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    chunks = {}
    for r in QUERIES["chunk_documents"](spark, str(tmp_path)).collect():
        chunks.setdefault(r.version_id, []).append(r.token_count)
    got = {r.version_id: r for r in QUERIES["chunk_document_stats"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4} and max(map(max, chunks.values())) <= 1000
    for i, r in got.items():
        own = chunks.get(i, [])
        assert (r.chunk_count, r.average_tokens, r.no_chunks) == (len(own), math.floor(sum(own) / max(len(own), 1) + 0.5), not own)
    assert got[1].chunk_count > 1
