"""Jobs that the platform plans but doesn't have yet: version diffs, context limits, deadlines, filters, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyr.functions import fields as P
from papyr.functions import text as T
from papyr.operators import retrieval as R
from papyr.plans.field_queries import date_sql
from papyr.plans.platform_queries import live
from papyr.plans.retrieval_queries import LEXICAL, _chunks
from papyr.plans.text_queries import SP, tokens_sql, words_sql
from papyr.sources import entities as E
from papyr.sources.entities import oracle

Q, O = {}, {}
#: Tokens that a context holds, the score that a result needs, days ahead that a deadline counts, likeness of equal chunks.
CONTEXT_TOKENS, MIN_SCORE, DAYS_AHEAD, ALIKE = 8000, 0.5, 30, 0.2


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return register


@query(oracle(f"""WITH w AS (SELECT version_id // 2 AS document_id, page_number, version_id % 2 AS side, unnest(regexp_extract_all(raw_text, '[^{SP}]+')) AS word FROM ocr_pages),
old AS (SELECT document_id, page_number, word, count(*) AS n FROM w WHERE side = 0 GROUP BY ALL), new AS (SELECT document_id, page_number, word, count(*) AS n FROM w WHERE side = 1 GROUP BY ALL)
SELECT document_id, page_number, CAST(sum(greatest(coalesce(new.n, 0) - coalesce(old.n, 0), 0)) AS BIGINT) AS added, CAST(sum(greatest(coalesce(old.n, 0) - coalesce(new.n, 0), 0)) AS BIGINT) AS removed FROM old FULL JOIN new USING (document_id, page_number, word) GROUP BY ALL""", "ocr_pages"))
def page_word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words added and removed on each page between two versions (an even document and the next stand for them)."""
    side = F.when(F.col("version_id") % 2 == 1, 1).otherwise(-1)
    words = F.explode(F.regexp_extract_all("raw_text", F.lit(f"[^{SP}]+"), 0))
    rows = E.ocr_pages(spark, sf_dir).select(F.floor(F.col("version_id") / 2).alias("document_id"), "page_number", side.alias("side"), words.alias("word"))
    change = rows.groupBy("document_id", "page_number", "word").agg(F.sum("side").alias("d"))
    zero = F.lit(0)
    return change.groupBy("document_id", "page_number").agg(F.sum(F.greatest(F.col("d"), zero)).alias("added"), F.sum(F.greatest(-F.col("d"), zero)).alias("removed"))


@query(oracle(f"SELECT a.chunk_id // 2 AS document_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS similarity FROM doc_embeddings a JOIN doc_embeddings b ON b.chunk_id = a.chunk_id + 1 WHERE a.chunk_id % 2 = 0 AND a.model = b.model AND round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) < {ALIKE}", "doc_embeddings"))
def semantic_version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two versions (an even vector and the next stand for them) that are less alike than a limit."""
    rows = E.embeddings(spark, sf_dir).select(F.floor(F.col("chunk_id") / 2).alias("document_id"), "model", "chunk_id", "embedding")
    old, new = (rows.where(F.col("chunk_id") % 2 == i).select("document_id", "model", F.col("embedding").alias(n)) for i, n in enumerate(("a", "b")))
    both = old.join(new, ["document_id", "model"]).select("document_id", F.round(R.cosine(F.col("a"), F.col("b")), 4).alias("similarity"))
    return both.where(F.col("similarity") < ALIKE)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_scores(_chunks(spark, sf_dir), E.search_queries(spark, sf_dir))


_BEST = "ORDER BY keyword_score DESC, chunk_id"


@query(oracle(f"WITH {LEXICAL}, sized AS (SELECT query_id, chunk_id, {tokens_sql(words_sql('text'))} AS tokens, keyword_score FROM scored JOIN documents ON doc_id = chunk_id) SELECT query_id, chunk_id, tokens, used FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id {_BEST} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM sized) WHERE used <= {CONTEXT_TOKENS}", "search_queries"))
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of each query up to the tokens of a context: never more chunks than tokens, as each has a word."""
    sizes = _chunks(spark, sf_dir).select("chunk_id", T.estimate_tokens(F.col("content")).alias("tokens"))
    so_far = Window.partitionBy("query_id").orderBy(F.desc("keyword_score"), "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    best = R.top_k(_ranked(spark, sf_dir), "keyword_score", CONTEXT_TOKENS).drop("rank")
    rows = best.join(sizes, "chunk_id").withColumn("used", F.sum("tokens").over(so_far))
    return rows.where(F.col("used") <= CONTEXT_TOKENS).select("query_id", "chunk_id", "tokens", "used")


@query(oracle(f"WITH {LEXICAL} SELECT query_id, chunk_id, keyword_score FROM scored JOIN documents ON doc_id = chunk_id QUALIFY row_number() OVER (PARTITION BY query_id, text {_BEST}) = 1", "search_queries"))
def context_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of chunks with the same text the best of each query."""
    return R.keyword_scores(R.distinct_texts(_chunks(spark, sf_dir)), E.search_queries(spark, sf_dir))


@query(oracle(f"WITH {LEXICAL} SELECT query_id, chunk_id, keyword_score FROM scored WHERE keyword_score >= {MIN_SCORE}", "search_queries"))
def min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).where(F.col("keyword_score") >= MIN_SCORE)


@query(oracle(f"""SELECT user_id, document_id, field_name, CAST(due AS VARCHAR) AS due, CAST(due - DATE '1998-01-01' AS INTEGER) AS days FROM (SELECT d.user_id, f.document_id, f.field_name, {date_sql('raw_value')} AS due FROM fields f JOIN documents_meta d USING (document_id)
  WHERE field_name = 'payment_due_date' AND NOT f.is_rejected AND NOT d.is_deleted) WHERE due BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'""", "fields", "documents_meta"))
def deadlines_next_30_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of live documents that are due from a given day on, within 30 days."""
    rows = E.fields(spark, sf_dir, "DATE").where("field_name = 'payment_due_date' and not is_rejected").join(live(spark, sf_dir).select("document_id", "user_id"), "document_id")
    due = rows.withColumn("due", P.parse_date(F.col("raw_value"))).withColumn("days", F.date_diff("due", F.lit("1998-01-01").cast("date")))
    return due.where(F.col("days").between(0, DAYS_AHEAD)).select("user_id", "document_id", "field_name", F.col("due").cast("string").alias("due"), "days")


@query(oracle("""SELECT q.query_id, d.document_id FROM search_queries q JOIN documents_meta d ON d.user_id = q.query_id AND NOT d.is_deleted LEFT JOIN (SELECT document_id, avg(confidence) FILTER (NOT is_rejected) AS c FROM fields GROUP BY ALL) f USING (document_id)
  WHERE (q.query_id % 2 = 1 OR d.status = 'COMPLETED') AND (q.query_id % 3 <> 0 OR coalesce(f.c, 0) >= 0.5) AND (q.query_id % 5 <> 0 OR d.document_id % 8 = 0)""", "search_queries", "documents_meta", "fields"))
def extra_search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the asking user by status, least mean field confidence and tag (every eighth has it), each optional."""
    q = F.col("query_id")
    asked = E.search_queries(spark, sf_dir).select("query_id", q.alias("user_id"), F.when(q % 2 == 0, "COMPLETED").alias("want_status"), F.when(q % 3 == 0, 0.5).alias("least"), F.when(q % 5 == 0, "archive").alias("tag"))
    sure = E.fields(spark, sf_dir).where("not is_rejected").groupBy("document_id").agg(F.avg("confidence").alias("c"))
    docs = live(spark, sf_dir).join(sure, "document_id", "left").withColumn("tags", F.when(F.col("document_id") % 8 == 0, F.array(F.lit("archive"))).otherwise(F.array().cast("array<string>")))
    rows = docs.join(asked, "user_id").where("(want_status is null or status = want_status) and (least is null or coalesce(c, 0) >= least)")
    return rows.where(F.col("tag").isNull() | F.array_contains("tags", F.col("tag"))).select("query_id", "document_id")


@query(oracle("""WITH m AS (SELECT 'ocr_confidence' AS metric, confidence AS x, 0.1 AS width FROM ocr_blocks UNION ALL SELECT 'version_ms', (page_count * 157 + version_number * 911) % 9000, 1000 FROM versions),
p AS (SELECT metric, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90 FROM m GROUP BY metric) SELECT metric, CAST(floor(round(x / width, 9)) AS BIGINT) AS bin, count(*) AS n, p50, p90 FROM m JOIN p USING (metric) GROUP BY ALL""", "ocr_blocks", "versions"))
def metric_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of OCR confidence and processing time, with median and ninth decile."""
    v = F.col("version_number")
    ocr = E.ocr_blocks(spark, sf_dir).select(F.lit("ocr_confidence").alias("metric"), F.col("confidence").alias("x"), F.lit(0.1).alias("width"))
    ms = E.versions(spark, sf_dir).select(F.lit("version_ms").alias("metric"), ((F.col("page_count") * 157 + v * 911) % 9000).cast("double").alias("x"), F.lit(1000.0).alias("width"))
    # Values repeat: counted first, so that no group is gathered whole.
    counts = ocr.unionByName(ms).groupBy("metric", "x", "width").agg(F.count(F.lit(1)).alias("n"))
    bins = counts.groupBy("metric", F.floor(F.round(F.col("x") / F.col("width"), 9)).alias("bin")).agg(F.sum("n").alias("n"))
    marks = counts.groupBy("metric").agg(*(F.round(F.percentile("x", F.lit(p), F.col("n")), 6).alias(c) for p, c in ((0.5, "p50"), (0.9, "p90"))))
    return bins.join(F.broadcast(marks), "metric")  # one row a metric
