"""Analytics, review, version, ranking and maintenance jobs over the entity tables, with their SQL.

Each job is a DataFrame plan; its SQL states the rule on its own, in another form where there is one. Times are UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyr.functions.fields import enum_token
from papyr.operators import platform as J
from papyr.operators.paging import pages
from papyr.plans.page_queries import ENGINES_SQL, ocr_waterfall
from papyr.sources import entities as E
from papyr.sources import files
from papyr.sources.entities import oracle

Q, O = {}, {}


def query(sql: str | None = None, *entities: str):
    """Register a job; ``sql`` is over the named entity tables and the given ones."""

    def register(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = oracle(sql, *entities) if entities else sql
        return f

    return register


def count_if(condition: Column | str) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.documents_meta(spark, sf_dir).where("not is_deleted")


def percent(part: Column, whole: Column) -> Column:
    return F.floor(100.0 * part / whole + 0.5).cast("int")


# ---- aggregations

LOW = "confidence < 0.65 AND NOT is_verified AND NOT is_rejected"


@query("""SELECT d.user_id, count(*) AS total, count(*) FILTER (status IN ('PROCESSING', 'QUEUED')) AS processing, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed,
  CAST((SELECT count(*) FROM fields f JOIN documents_meta x USING (document_id) WHERE x.user_id = d.user_id AND NOT x.is_deleted AND confidence < 0.65 AND NOT is_verified AND NOT is_rejected) AS BIGINT) AS review_needed,
  CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM documents_meta d WHERE NOT is_deleted GROUP BY d.user_id""", "documents_meta", "fields")
def user_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = E.fields(spark, sf_dir).where(LOW).groupBy("document_id").agg(F.count(F.lit(1)).alias("review"))
    rows = live(spark, sf_dir).join(review, "document_id", "left")
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), count_if("status in ('PROCESSING', 'QUEUED')").alias("processing"), count_if("status = 'COMPLETED'").alias("completed"),
        count_if("status = 'FAILED'").alias("failed"), F.coalesce(F.sum("review"), F.lit(0)).alias("review_needed"), F.sum("file_size_bytes").alias("bytes"),
    )


@query("SELECT user_id, CASE WHEN category IS NULL THEN 'UNKNOWN' ELSE category END AS category, count(*) AS documents FROM documents_meta WHERE is_deleted = false GROUP BY ALL", "documents_meta")
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).groupBy("user_id", F.coalesce("category", F.lit("UNKNOWN")).alias("category")).agg(F.count(F.lit(1)).alias("documents"))


@query("""SELECT *, CASE WHEN documents = 0 THEN 100 ELSE CAST(round(100.0 * completed / documents) AS INTEGER) END AS success_rate FROM (SELECT count(*) AS users FROM users),
  (SELECT count(*) AS documents, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status IN ('PROCESSING', 'QUEUED')) AS in_queue, CAST(coalesce(sum(file_size_bytes), 0) AS BIGINT) AS bytes FROM documents_meta WHERE NOT is_deleted)""", "users", "documents_meta")
def platform_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = E.users(spark, sf_dir).agg(F.count(F.lit(1)).alias("users"))
    counts = live(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("documents"), count_if("status = 'COMPLETED'").alias("completed"), count_if("status = 'FAILED'").alias("failed"),
        count_if("status in ('PROCESSING', 'QUEUED')").alias("in_queue"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes"),
    )
    rate = F.when(F.col("documents") == 0, 100).otherwise(percent(F.col("completed"), F.nullif(F.col("documents"), F.lit(0))))
    return people.crossJoin(counts).withColumn("success_rate", rate)  # one row each


@query("""SELECT u.user_id, u.name, u.email, u.is_active, count(d.document_id) AS documents, count(*) FILTER (d.status = 'COMPLETED') AS completed, count(*) FILTER (d.status = 'QUEUED') AS queued,
  count(*) FILTER (d.status = 'PROCESSING') AS processing, count(*) FILTER (d.status = 'FAILED') AS failed, CASE WHEN count(d.document_id) = 0 THEN 0 ELSE CAST(round(100.0 * count(*) FILTER (d.status = 'COMPLETED') / count(d.document_id)) AS INTEGER) END AS success_rate
  FROM users u LEFT JOIN documents_meta d ON d.user_id = u.user_id AND NOT d.is_deleted GROUP BY ALL""", "users", "documents_meta")
def user_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = live(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("documents"), *(count_if(f"status = '{s.upper()}'").alias(s) for s in ("completed", "queued", "processing", "failed")))
    rows = E.users(spark, sf_dir).join(counts, "user_id", "left").na.fill(0, ["documents", "completed", "queued", "processing", "failed"])
    rate = F.when(F.col("documents") > 0, percent(F.col("completed"), F.col("documents"))).otherwise(0)
    return rows.select("user_id", "name", "email", "is_active", "documents", "completed", "queued", "processing", "failed", rate.alias("success_rate"))


@query("""SELECT user_id, sum(CASE WHEN is_verified OR is_rejected OR confidence >= 0.65 THEN 0 ELSE 1 END)::BIGINT AS pending, sum(CASE WHEN is_verified AND NOT is_rejected THEN 1 ELSE 0 END)::BIGINT AS verified,
  sum(is_rejected::INTEGER)::BIGINT AS rejected FROM fields JOIN documents_meta USING (document_id) WHERE NOT is_deleted GROUP BY user_id""", "fields", "documents_meta")
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.fields(spark, sf_dir).join(live(spark, sf_dir).select("document_id", "user_id"), "document_id")
    return rows.groupBy("user_id").agg(count_if(LOW).alias("pending"), count_if("is_verified and not is_rejected").alias("verified"), count_if("is_rejected").alias("rejected"))


@query("""SELECT f.document_id, round(avg(f.confidence) FILTER (NOT f.is_rejected), 6) AS field_confidence, (SELECT round(avg(c), 6) FROM (SELECT avg(b.confidence) AS c FROM ocr_blocks b WHERE b.version_id = f.document_id GROUP BY b.page_number)) AS page_confidence FROM fields f GROUP BY f.document_id""", "fields", "ocr_blocks")
def document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = E.ocr_blocks(spark, sf_dir).groupBy("version_id", "page_number").agg(F.avg("confidence").alias("c"))
    pages = pages.groupBy(F.col("version_id").alias("document_id")).agg(F.avg("c").alias("page"))
    own = E.fields(spark, sf_dir).groupBy("document_id").agg(F.avg(F.when(~F.col("is_rejected"), F.col("confidence"))).alias("field"))
    return own.join(pages, "document_id", "left").select("document_id", F.round("field", 6).alias("field_confidence"), F.round("page", 6).alias("page_confidence"))


INVENTORY_SQL = """SELECT d.document_id, d.status, coalesce(d.category, '-') AS category, v.version_number, (SELECT count(*) FROM fields f WHERE f.document_id = d.document_id) AS field_count,
  (SELECT count(*) FROM fields f WHERE f.document_id = d.document_id AND f.is_verified) AS verified_count, (SELECT count(*) FROM doc_embeddings e WHERE e.document_id = d.document_id) AS chunk_count,
  coalesce((SELECT string_agg(DISTINCT e.model, ',' ORDER BY e.model) FROM doc_embeddings e WHERE e.document_id = d.document_id), '') AS models
  FROM documents_meta d JOIN versions v ON v.document_id = d.document_id AND v.version_number = CASE WHEN d.document_id % 4 = 0 THEN 1 ELSE v.last_version END WHERE NOT d.is_deleted"""


def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that each document names as its current one (every fourth names its first), else its latest."""
    named = F.when(F.col("document_id") % 4 == 0, F.lit(1).cast("long"))
    return E.versions(spark, sf_dir).where(F.col("version_number") == F.coalesce(named, F.col("last_version")))


@query(INVENTORY_SQL, "documents_meta", "versions", "fields", "doc_embeddings")
def document_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per live document with a current version: all its fields, rejected ones too, its chunks and their models."""
    own = E.fields(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("f"), count_if("is_verified").alias("v"))
    chunks = E.embeddings(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("c"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("m"))
    rows = live(spark, sf_dir).join(current_versions(spark, sf_dir).select("document_id", "version_number"), "document_id").join(own, "document_id", "left").join(chunks, "document_id", "left")
    none = F.lit(0)
    return rows.select(
        "document_id", "status", F.coalesce("category", F.lit("-")).alias("category"), "version_number", F.coalesce("f", none).alias("field_count"), F.coalesce("v", none).alias("verified_count"),
        F.coalesce("c", none).alias("chunk_count"), F.coalesce("m", F.lit("")).alias("models"),
    )


@query("SELECT d.user_id, e.model, e.dimension, count(*) AS vectors FROM doc_embeddings e, documents_meta d WHERE d.document_id = e.document_id GROUP BY ALL", "doc_embeddings", "documents_meta")
def embedding_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.embeddings(spark, sf_dir).join(E.documents_meta(spark, sf_dir), "document_id").groupBy("user_id", "model", "dimension").agg(F.count(F.lit(1)).alias("vectors"))


@query("""SELECT *, CASE WHEN failed > 5 THEN 'degraded' ELSE 'healthy' END AS health FROM (SELECT count(*) FILTER (status = 'QUEUED') AS waiting, count(*) FILTER (status = 'PROCESSING') AS active, count(*) FILTER (status = 'COMPLETED') AS completed,
  count(*) FILTER (status = 'FAILED') AS failed, waiting + active AS backlog FROM documents_meta)""", "documents_meta")
def queue_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.documents_meta(spark, sf_dir).agg(*(count_if(f"status = '{s}'").alias(n) for s, n in (("QUEUED", "waiting"), ("PROCESSING", "active"), ("COMPLETED", "completed"), ("FAILED", "failed"))))
    return rows.withColumns({"backlog": F.col("waiting") + F.col("active"), "health": F.when(F.col("failed") > 5, "degraded").otherwise("healthy")})


@query("SELECT user_id AS batch, status, count(*) AS documents, CASE WHEN status IN ('COMPLETED', 'FAILED') THEN count(*) ELSE 0 END AS settled FROM documents_meta GROUP BY user_id, status", "documents_meta")
def settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.documents_meta(spark, sf_dir).groupBy(F.col("user_id").alias("batch"), "status").agg(F.count(F.lit(1)).alias("documents"), count_if("status in ('COMPLETED', 'FAILED')").alias("settled"))


#: Stages of processing, in order (fixed values).
STAGES = (
    "FILE_VALIDATION", "PDF_RENDERING", "THUMBNAIL", "IMAGE_ENHANCEMENT", "OCR", "LANGUAGE_DETECTION", "CLASSIFICATION", "TEXT_NORMALIZATION", "STRUCTURED_EXTRACTION",
    "CONFIDENCE_SCORING", "VALIDATION", "CHUNKING", "EMBEDDING", "INDEXING",
)


def stage_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories as the platform keeps them, JSON arrays of stage marks: a stage that was tried twice has two starts, one
    that is begun again after its end a start behind it."""
    p, v = F.col("page_count"), F.col("version_number")
    stages = F.array(*map(F.lit, STAGES))
    rows = current_versions(spark, sf_dir).withColumn("reached", (p % 14 + 1).cast("int"))

    def marks(i: Column) -> Column:
        mark = lambda status, at: F.struct(F.get(stages, i).alias("stage"), F.lit(status).alias("status"), at.cast("long").alias("at"))
        begin = i * 100_000
        again = F.when((p + i) % 5 == 0, F.array(mark("PROCESSING", begin - 7000))).otherwise(F.array().cast("array<struct<stage:string,status:string,at:bigint>>"))
        done = F.when((i < F.col("reached") - 1) | (p % 3 != 0), F.array(mark("COMPLETED", begin + (p * 157 + v * 911 + i * 613) % 9000))).otherwise(F.array().cast("array<struct<stage:string,status:string,at:bigint>>"))
        anew = F.when((p * 3 + i) % 11 == 0, F.array(mark("PROCESSING", begin + 9500))).otherwise(F.array().cast("array<struct<stage:string,status:string,at:bigint>>"))
        return F.concat(again, F.array(mark("PROCESSING", begin)), done, anew)

    history = F.to_json(F.flatten(F.transform(F.sequence(F.lit(0), F.col("reached") - 1), marks)))
    return rows.select("document_id", history.alias("stage_history"))


RUNS_SQL = """runs AS (SELECT document_id, i, (page_count * 157 + version_number * 911 + i * 613) % 9000 AS ms FROM (SELECT *, page_count % 14 AS last, page_count % 3 <> 0 AS ended FROM versions
  WHERE version_number = CASE WHEN document_id % 4 = 0 THEN 1 ELSE last_version END), range(14) t(i) WHERE i < last OR (i = last AND ended))"""


@query(f"""WITH {RUNS_SQL} SELECT document_id, count(*) AS stages, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS slowest_ms, CASE WHEN max(ms) > 5000 THEN 'SLOW' WHEN max(ms) > 2000 THEN 'WARN' ELSE 'OK' END AS worst FROM runs GROUP BY document_id""", "versions")
def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each stage that ended, the time since the last start before its end; the longest decides the flag."""
    return J.stage_timings(stage_histories(spark, sf_dir))


@query(f"""WITH {RUNS_SQL}, ranked AS (SELECT [{', '.join(f"'{s}'" for s in STAGES)}][i + 1] AS stage, ms, row_number() OVER (PARTITION BY i ORDER BY ms) AS r, count(*) OVER (PARTITION BY i) AS n FROM runs)
SELECT stage, n AS runs, max(ms) FILTER (r = ceil(n * 0.5)) AS p50_ms, max(ms) FILTER (r = ceil(n * 0.9)) AS p90_ms, max(ms) FILTER (r = ceil(n * 0.99)) AS p99_ms FROM ranked GROUP BY stage, n""", "versions")
def stage_time_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of each stage's time."""
    return J.stage_time_quantiles(stage_histories(spark, sf_dir))


@query(f"""{ENGINES_SQL}, chosen AS (SELECT version_id, page_number, engine AS provider FROM chosen_engines)
SELECT provider, count(*) AS blocks, CAST(sum(length(block_text)) AS BIGINT) AS chars, round(avg(confidence), 4) AS confidence, count(DISTINCT version_id * 100000 + page_number) AS pages, round(count(DISTINCT version_id * 100000 + page_number) / (SELECT count(*) FROM chosen), 6) AS page_share, provider NOT IN ('layer', 'paddle') AS is_fallback
FROM ocr_blocks JOIN chosen USING (version_id, page_number) GROUP BY provider""", "ocr_pages", "ocr_blocks")
def ocr_engine_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, characters, confidence and share of pages of the engine that was chosen for each page."""
    chosen = ocr_waterfall(spark, sf_dir).withColumnRenamed("engine", "provider")
    per_page = E.ocr_blocks(spark, sf_dir).groupBy("version_id", "page_number").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("block_text")).alias("c"), F.sum("confidence").alias("s"))
    rows = per_page.join(chosen, ["version_id", "page_number"]).groupBy("provider").agg(F.sum("n").alias("blocks"), F.sum("c").alias("chars"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("pages"))
    share = F.col("pages") / F.sum("pages").over(Window.partitionBy(F.lit(0)))  # one row an engine
    return rows.select("provider", "blocks", "chars", F.round(F.col("s") / F.col("blocks"), 4).alias("confidence"), "pages", F.round(share, 6).alias("page_share"), (~F.col("provider").isin("layer", "paddle")).alias("is_fallback"))


@query("SELECT n_chars >= 500 AS ai_says, quality = 1 AS user_says, count(*) AS documents, count(*) FILTER ((n_chars >= 500) = (quality = 1)) AS agreed FROM documents, labels WHERE labels.doc_id = documents.doc_id GROUP BY ALL")
def correction_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 500).alias("ai_says")).join(E.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("user_says")), "doc_id")
    return rows.groupBy("ai_says", "user_says").agg(F.count(F.lit(1)).alias("documents"), count_if("ai_says = user_says").alias("agreed"))


@query("SELECT reviewer_id, field_name, count(*) FILTER (action = 'ACCEPTED') AS accepted, count(*) FILTER (action = 'EDITED') AS edited, count(*) FILTER (action = 'REJECTED') AS rejected FROM verification_events GROUP BY ALL", "verification_events")
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.verification_events(spark, sf_dir).groupBy("reviewer_id", "field_name").pivot("action", ["ACCEPTED", "EDITED", "REJECTED"]).agg(F.count(F.lit(1)))
    return rows.na.fill(0).toDF("reviewer_id", "field_name", "accepted", "edited", "rejected")


@query("SELECT user_id, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS uploads, CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM documents_meta GROUP BY ALL", "documents_meta")
def uploads_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.documents_meta(spark, sf_dir).groupBy("user_id", F.to_date("created_at").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("uploads"), F.sum("file_size_bytes").alias("bytes"))


# ---- windows and ranking


@query("SELECT document_id, version_number, version_status, page_count FROM versions QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY version_number DESC) = 1", "versions")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = E.versions(spark, sf_dir).groupBy("document_id").agg(F.max_by(F.struct("version_number", "version_status", "page_count"), "version_number").alias("v"))
    return best.select("document_id", "v.*")


@query("SELECT document_id, coalesce((SELECT max(version_number) FROM versions v WHERE v.document_id = d.document_id), 0) + 1 AS next_version FROM documents_meta d", "documents_meta", "versions")
def next_version_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = E.versions(spark, sf_dir).groupBy("document_id").agg(F.max("version_number").alias("n"))
    return E.documents_meta(spark, sf_dir).join(most, "document_id", "left").select("document_id", (F.coalesce("n", F.lit(0)) + 1).alias("next_version"))


@query(f"""SELECT document_id, [{', '.join(f"'{s}'" for s in STAGES)}][done + 1] AS current_stage, done AS stages_done, CASE WHEN done = 14 THEN 100 ELSE least(100, CAST(round(100.0 * done / 14) AS INTEGER)) END AS progress
  FROM (SELECT d.document_id, CASE WHEN d.status = 'COMPLETED' THEN 14 ELSE (v.page_count * 5 + v.version_number * 3) % 14 END AS done FROM documents_meta d JOIN versions v ON v.document_id = d.document_id AND v.version_number = CASE WHEN d.document_id % 4 = 0 THEN 1 ELSE v.last_version END)""", "documents_meta", "versions")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages before the current one, which the fixture draws from the current version's pages and number, and the progress that they make."""
    current = current_versions(spark, sf_dir).select("document_id", ((F.col("page_count") * 5 + F.col("version_number") * 3) % 14).alias("at"))
    stages = spark.createDataFrame(list(enumerate(STAGES)), "stages_done long, current_stage string")
    done = F.when(F.col("status") == "COMPLETED", F.lit(14)).otherwise(F.col("at")).cast("long")
    rows = E.documents_meta(spark, sf_dir).join(current, "document_id").select("document_id", done.alias("stages_done")).join(F.broadcast(stages), "stages_done", "left")
    return rows.select("document_id", "current_stage", "stages_done", F.when(F.col("stages_done") == 14, 100).otherwise(F.least(F.lit(100), percent(F.col("stages_done"), F.lit(14)))).alias("progress"))


@query("SELECT a.actor_id, a.audit_id, a.event_type, a.n, d.title FROM (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY created_at DESC, audit_id DESC) AS n FROM audit_logs) a LEFT JOIN documents_meta d ON d.document_id = a.document_id WHERE n <= 8", "audit_logs", "documents_meta")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last eight events of each actor with the title of the document that they are about."""
    last = F.row_number().over(Window.partitionBy("actor_id").orderBy(F.desc("created_at"), F.desc("audit_id")))
    rows = E.audit_logs(spark, sf_dir).withColumn("n", last.cast("long")).where("n <= 8")
    return rows.join(E.documents_meta(spark, sf_dir).select("document_id", "title"), "document_id", "left").select("actor_id", "audit_id", "event_type", "n", "title")


# ---- filters


@query("SELECT d.document_id, d.user_id, d.title FROM documents_meta d JOIN search_queries q ON q.query_id = d.user_id WHERE d.is_deleted IS NOT TRUE", "documents_meta", "search_queries")
def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live documents of the users who ask: query ids stand for them."""
    asking = E.search_queries(spark, sf_dir).select(F.col("query_id").alias("user_id"))
    return live(spark, sf_dir).join(asking, "user_id", "left_semi").select("document_id", "user_id", "title")


def filter_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests with optional filters; a null filter holds for every document."""
    q = F.col("query_id")
    return E.search_queries(spark, sf_dir).select(
        "query_id", q.alias("user_id"), F.when(q % 2 == 0, "INVOICE").alias("category"), F.when(q % 3 == 1, "en").alias("language"), F.when(q % 11 == 10, q * 100 + 4).alias("document_id"),
        F.when(q % 5 == 0, F.lit("1996-01-01")).cast("timestamp_ntz").alias("after"), F.when(q % 5 == 0, F.lit("1998-12-31")).cast("timestamp_ntz").alias("before"),
    )


@query("""SELECT q.query_id, d.document_id FROM search_queries q, documents_meta d WHERE d.user_id = q.query_id AND NOT d.is_deleted AND (q.query_id % 2 <> 0 OR d.category = 'INVOICE') AND (q.query_id % 3 <> 1 OR d.primary_language = 'en')
  AND (q.query_id % 11 <> 10 OR d.document_id = q.query_id * 100 + 4) AND (q.query_id % 5 <> 0 OR d.created_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31')""", "search_queries", "documents_meta")
def search_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.search_filters(filter_requests(spark, sf_dir), live(spark, sf_dir)).select("query_id", "document_id")


@query("""SELECT q.query_id, d.document_id FROM search_queries q, documents_meta d JOIN users u ON u.user_id = d.user_id WHERE NOT d.is_deleted AND (d.title ILIKE '%' || (q.query_id * 37) || '%' OR u.email ILIKE '%R#' || (q.query_id * 37) || '@%' OR u.name ILIKE '%' || (q.query_id * 37) || '%')""", "search_queries", "documents_meta", "users")
def contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needles (made of the query ids) in title, owner's e-mail or owner's name, whatever their case."""
    n = (F.col("query_id") * 37).cast("string")
    needles = E.search_queries(spark, sf_dir).select("query_id", F.array(n, F.concat(F.lit("R#"), n, F.lit("@")), n).alias("needles"))
    rows = live(spark, sf_dir).join(E.users(spark, sf_dir).select("user_id", "email", "name"), "user_id")
    return J.contains_any(rows, needles, ["title", "email", "name"], "document_id")


def list_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of documents for each user: filters, order, page and size differ by user."""
    u = F.col("user_id")
    return E.users(spark, sf_dir).select(
        "user_id", (u % 3 + 1).alias("page"), F.least(u % 4 * 40 + 5, F.lit(100)).alias("size"), F.when(u % 2 == 0, "title").otherwise("created_at").alias("sort_by"), (u % 4 < 2).alias("descending"),
        F.when(u % 5 == 0, "COMPLETED").alias("status"), F.when(u % 9 == 0, "INVOICE").alias("category"), F.when(u % 7 == 0, "5").alias("search"),
    )


@query("""SELECT user_id, document_id, title, coalesce(latest, 0) AS latest_version, n, total, CAST(ceil(total / size) AS BIGINT) AS total_pages FROM (
  SELECT d.user_id, d.document_id, d.title, least(d.user_id % 4 * 40 + 5, 100) AS size, count(*) OVER (PARTITION BY d.user_id) AS total, (SELECT max(version_number) FROM versions v WHERE v.document_id = d.document_id) AS latest,
    row_number() OVER (PARTITION BY d.user_id ORDER BY CASE WHEN d.user_id % 2 = 0 AND d.user_id % 4 < 2 THEN title END DESC, CASE WHEN d.user_id % 2 = 0 AND d.user_id % 4 >= 2 THEN title END, CASE WHEN d.user_id % 2 = 1 AND d.user_id % 4 < 2 THEN created_at END DESC, CASE WHEN d.user_id % 2 = 1 AND d.user_id % 4 >= 2 THEN created_at END, d.document_id) AS n
  FROM documents_meta d JOIN users u USING (user_id) WHERE NOT d.is_deleted AND (d.user_id % 5 <> 0 OR d.status = 'COMPLETED') AND (d.user_id % 9 <> 0 OR d.category = 'INVOICE') AND (d.user_id % 7 <> 0 OR d.title LIKE '%5%'))
  WHERE n > (user_id % 3) * size AND n <= (user_id % 3 + 1) * size""", "documents_meta", "users", "versions")
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = E.versions(spark, sf_dir).groupBy("document_id").agg(F.max("version_number").alias("latest_version"))
    return J.list_documents(list_requests(spark, sf_dir), live(spark, sf_dir), latest)


@query("""SELECT actor_id, audit_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY created_at DESC, audit_id) AS n FROM audit_logs
  WHERE (actor_id % 3 <> 0 OR event_type = 'click') AND (actor_id % 5 <> 0 OR resource_type = 'DOCUMENT') AND (actor_id % 4 <> 0 OR (created_at >= TIMESTAMP '2024-01-10' AND created_at <= TIMESTAMP '2024-01-20'))) WHERE n <= greatest(1, least(50, actor_id % 80))""", "audit_logs")
def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each actor its newest events by type, resource and date, at most its limit clamped to 1..50."""
    a = F.col("actor_id")
    asked = E.audit_logs(spark, sf_dir).select("actor_id").distinct().select(
        "actor_id", F.when(a % 3 == 0, "click").alias("want_type"), F.when(a % 5 == 0, "DOCUMENT").alias("want_resource"), (a % 80).alias("most"),
        F.when(a % 4 == 0, F.lit("2024-01-10")).cast("timestamp_ntz").alias("after"), F.when(a % 4 == 0, F.lit("2024-01-20")).cast("timestamp_ntz").alias("before"),
    )
    return J.audit_query(E.audit_logs(spark, sf_dir), asked).select("actor_id", "audit_id", "event_type")


@query("""SELECT user_id, document_id, field_name, raw_value FROM (SELECT d.user_id, f.*, row_number() OVER (PARTITION BY d.user_id ORDER BY d.created_at DESC, f.document_id, f.field_name) AS n FROM fields f JOIN documents_meta d ON d.document_id = f.document_id
  WHERE NOT is_rejected AND NOT d.is_deleted AND regexp_matches(field_name, '(?i)date|deadline|due')) x WHERE n <= 5""", "fields", "documents_meta")
def deadline_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.col("field_name").ilike("%date%") | F.col("field_name").ilike("%deadline%") | F.col("field_name").ilike("%due%")
    rows = E.fields(spark, sf_dir).where(wanted & ~F.col("is_rejected")).join(live(spark, sf_dir).select("document_id", "user_id", "created_at"), "document_id")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "document_id", "field_name"))
    return rows.withColumn("n", n).where("n <= 5").select("user_id", "document_id", "field_name", "raw_value")


@query("""WITH found AS (SELECT * FROM documents_meta WHERE status IN ('FAILED', 'QUEUED') AND NOT is_deleted ORDER BY updated_at DESC, document_id LIMIT 15)
  SELECT d.document_id, d.status, coalesce(u.email, 'Unknown') AS owner, v.error FROM found d LEFT JOIN users u ON u.user_id = d.user_id LEFT JOIN versions v ON v.document_id = d.document_id AND v.version_number = v.last_version""", "documents_meta", "users", "versions")
def stuck_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 live failed or queued documents that were changed last, with owner and latest error."""
    found = live(spark, sf_dir).where("status in ('FAILED', 'QUEUED')").orderBy(F.desc("updated_at"), "document_id").limit(15)
    errors = E.versions(spark, sf_dir).join(F.broadcast(found.select("document_id")), "document_id", "left_semi").where("version_number = last_version").select("document_id", "error")
    rows = found.join(E.users(spark, sf_dir).select("user_id", "email"), "user_id", "left").join(errors, "document_id", "left")
    return rows.select("document_id", "status", F.coalesce("email", F.lit("Unknown")).alias("owner"), "error")


@query("""SELECT v.document_id, v.version_number, p AS page_number, (v.page_count * 10 + p)::BIGINT AS width FROM (SELECT *, generate_series(1, page_count % 5 + 1) AS pages FROM versions) v JOIN documents_meta d USING (document_id), unnest(v.pages) AS t(p)
  WHERE NOT d.is_deleted AND v.version_number = CASE WHEN d.document_id % 3 = 0 AND v.last_version >= 2 THEN 2 ELSE v.last_version END""", "versions", "documents_meta")
def pages_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the version asked for (the second, for every third document), where it is there, else of the latest."""
    asked = live(spark, sf_dir).select("document_id", F.when(F.col("document_id") % 3 == 0, F.lit(2).cast("long")).alias("asked"))
    rows = E.versions(spark, sf_dir).join(asked, "document_id")
    chosen = F.when(F.col("asked") <= F.col("last_version"), F.col("asked")).otherwise(F.col("last_version"))
    pages = rows.where(F.col("version_number") == chosen).withColumn("page_number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("page_count") % 5 + 1)))
    return pages.select("document_id", "version_number", "page_number", (F.col("page_count") * 10 + F.col("page_number")).alias("width"))


@query("""SELECT v.document_id, v.version_number, v.version_status, v.page_count, (v.page_count * 157 + v.version_number * 911) % 9000 AS duration_ms, (SELECT count(DISTINCT f.name) FROM version_fields f WHERE f.document_id = v.document_id AND f.version_number = v.version_number) AS fields, v.last_version AS versions,
  coalesce(v.page_count - lag(v.page_count) OVER (PARTITION BY v.document_id ORDER BY v.version_number), 0) AS page_change FROM versions v""", "versions", "version_fields")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = E.version_fields(spark, sf_dir).groupBy("document_id", "version_number").agg(F.count_distinct("name").alias("fields"))
    before = F.lag("page_count").over(Window.partitionBy("document_id").orderBy("version_number"))
    rows = E.versions(spark, sf_dir).withColumn("page_change", F.coalesce(F.col("page_count") - before, F.lit(0))).join(own, ["document_id", "version_number"], "left")
    return rows.select(
        "document_id", "version_number", "version_status", "page_count", ((F.col("page_count") * 157 + F.col("version_number") * 911) % 9000).alias("duration_ms"),
        F.coalesce("fields", F.lit(0)).alias("fields"), F.col("last_version").alias("versions"), "page_change",
    )


# ---- joins


@query("SELECT document_id, version_number AS current_version, page_count FROM (SELECT v.*, row_number() OVER (PARTITION BY d.document_id ORDER BY CASE WHEN d.document_id % 4 = 0 THEN version_number ELSE -version_number END) AS n FROM documents_meta d JOIN versions v USING (document_id)) WHERE n = 1", "documents_meta", "versions")
def current_version_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.documents_meta(spark, sf_dir).select("document_id").join(current_versions(spark, sf_dir), "document_id")
    return rows.select("document_id", F.col("version_number").alias("current_version"), "page_count")


DIFF_SQL = """WITH one AS (SELECT * FROM version_fields QUALIFY row_number() OVER (PARTITION BY document_id, version_number, name ORDER BY seq DESC) = 1),
old AS (SELECT document_id, version_number + 1 AS v, name, value FROM one WHERE version_number < last_version), new AS (SELECT document_id, version_number AS v, name, value FROM one WHERE version_number > 1),
compared AS (SELECT document_id, v AS version_number, name AS field_name, old.value AS old_value, new.value AS new_value,
  CASE WHEN old.value IS NULL THEN 'ADDED' WHEN new.value IS NULL THEN 'REMOVED' WHEN trim(old.value) = trim(new.value) THEN 'UNCHANGED' ELSE 'CHANGED' END AS change FROM old FULL JOIN new USING (document_id, v, name))"""


@query(f"{DIFF_SQL} SELECT *, row_number() OVER (PARTITION BY document_id, version_number ORDER BY CASE change WHEN 'CHANGED' THEN 1 WHEN 'ADDED' THEN 2 WHEN 'REMOVED' THEN 3 ELSE 4 END, field_name) AS place FROM compared", "versions", "version_fields")
def version_field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of every two consecutive versions, in the order changed, added, removed, unchanged."""
    return J.pairs_diff(E.version_field_pairs(spark, sf_dir))


@query(f"{DIFF_SQL} SELECT document_id, version_number, count(*) FILTER (change = 'CHANGED') AS changed, count(*) FILTER (change = 'ADDED') AS added, count(*) FILTER (change = 'REMOVED') AS removed, count(*) FILTER (change = 'UNCHANGED') AS unchanged FROM compared GROUP BY ALL", "versions", "version_fields")
def version_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.pairs_summary(E.version_field_pairs(spark, sf_dir))


@query("""SELECT version_id, count(*) AS chunks, count(*) FILTER (has) AS embedded, count(*) FILTER (NOT has) AS missing, count(*) FILTER (has) = 0 AS fails, CAST(round(100.0 * count(*) FILTER (has) / count(*)) AS INTEGER) AS coverage
  FROM (SELECT doc_id // 4 AS version_id, doc_id IN (SELECT chunk_id FROM doc_embeddings) AS has FROM documents) GROUP BY version_id""", "doc_embeddings")
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of four chunks each (documents stand for chunks): how many have a vector; one without any fails."""
    have = E.embeddings(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"), F.lit(True).alias("has")).distinct()
    rows = E.table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("version_id")).join(have, "doc_id", "left")
    rows = rows.groupBy("version_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("has").alias("embedded"))
    return rows.select("version_id", "chunks", "embedded", (F.col("chunks") - F.col("embedded")).alias("missing"), (F.col("embedded") == 0).alias("fails"), percent(F.col("embedded"), F.col("chunks")).alias("coverage"))


@query("""SELECT e.document_id, m.user_id, count(*) AS stale, string_agg(DISTINCT e.model, ',' ORDER BY e.model) AS models, CAST(sum(length(d.text)) AS BIGINT) AS chars FROM doc_embeddings e, documents_meta m, documents d
  WHERE m.document_id = e.document_id AND d.doc_id = e.chunk_id AND e.model NOT IN ('m1') AND NOT m.is_deleted GROUP BY ALL""", "doc_embeddings", "documents_meta")
def stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per live document the vectors of other models than m1, with the length of the texts to embed again."""
    texts = E.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.length("text").alias("chars"))
    rows = E.embeddings(spark, sf_dir).where("model <> 'm1'").join(live(spark, sf_dir).select("document_id", "user_id"), "document_id").join(texts, "chunk_id")
    return rows.groupBy("document_id", "user_id").agg(F.count(F.lit(1)).alias("stale"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"), F.sum("chars").alias("chars"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the assistant's messages cite: conversation_id, turn, chunk_id; some of the chunks are gone."""
    return E.messages(spark, sf_dir).where("role = 'ASSISTANT'").select("conversation_id", "turn", (F.col("conversation_id") * 11 + F.col("turn")).alias("chunk_id"))


CITED_SQL = "cited AS (SELECT conversation_id, turn, conversation_id * 11 + turn AS chunk_id FROM messages WHERE role = 'ASSISTANT')"


@query(f"WITH {CITED_SQL} SELECT conversation_id, turn, chunk_id, source, chunk_id // 4 AS version_id, CASE WHEN chunk_id IN (SELECT chunk_id FROM doc_embeddings WHERE model = 'm1') THEN round(chunk_id % 100 / 100, 2) END AS relevance_score FROM cited JOIN documents ON doc_id = chunk_id", "messages", "doc_embeddings")
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of chunks that are there, with the chunk's own version and its score where it was retrieved."""
    chunks = E.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.floor(F.col("doc_id") / 4).alias("version_id"))
    scores = E.embeddings(spark, sf_dir).where("model = 'm1'").select("chunk_id", F.round(F.col("chunk_id") % 100 / 100, 2).alias("relevance_score"))
    return citations(spark, sf_dir).join(chunks, "chunk_id").join(scores, "chunk_id", "left").select("conversation_id", "turn", "chunk_id", "source", "version_id", "relevance_score")


@query(f"WITH {CITED_SQL} SELECT conversation_id, turn, CASE WHEN EXISTS (SELECT 1 FROM documents WHERE doc_id = chunk_id) THEN chunk_id END AS chunk_id FROM cited", "messages")
def citation_null_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = E.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("there"))
    rows = citations(spark, sf_dir)
    return rows.join(chunks, rows["chunk_id"] == F.col("there"), "left").select("conversation_id", "turn", F.col("there").alias("chunk_id"))


@query("SELECT m.conversation_id, m.turn AS last_turn, m.role, m.content AS last_message, d.title, d.category FROM messages m LEFT JOIN documents_meta d ON d.document_id = m.conversation_id WHERE m.turn = (SELECT max(turn) FROM messages x WHERE x.conversation_id = m.conversation_id)", "messages", "documents_meta")
def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = E.messages(spark, sf_dir).groupBy("conversation_id").agg(F.max_by(F.struct(F.col("turn").alias("last_turn"), "role", F.col("content").alias("last_message")), "turn").alias("m"))
    about = E.documents_meta(spark, sf_dir).select(F.col("document_id").alias("conversation_id"), "title", "category")
    return last.join(about, "conversation_id", "left").select("conversation_id", "m.*", "title", "category")


@query(f"""WITH {CITED_SQL} SELECT m.conversation_id, m.turn, m.role, c.chunk_id, CASE WHEN c.chunk_id IS NOT NULL THEN coalesce(d.title, s.source, 'Document') END AS title FROM messages m LEFT JOIN cited c ON c.conversation_id = m.conversation_id AND c.turn = m.turn
  LEFT JOIN documents_meta d ON d.document_id = c.chunk_id AND NOT d.is_deleted LEFT JOIN documents s ON s.doc_id = c.chunk_id""", "messages", "documents_meta")
def conversation_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with what they cite, by the title of the cited document, else of its chunk's source, else Document."""
    cited = citations(spark, sf_dir)
    titles = live(spark, sf_dir).select(F.col("document_id").alias("chunk_id"), F.col("title").alias("own"))
    sources = E.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    named = cited.join(titles, "chunk_id", "left").join(sources, "chunk_id", "left").withColumn("title", F.coalesce("own", "source", F.lit("Document")))
    rows = E.messages(spark, sf_dir).join(named, ["conversation_id", "turn"], "left")
    return rows.select("conversation_id", "turn", "role", "chunk_id", "title")


@query("""SELECT c.conversation_id, CASE WHEN c.conversation_id % 5 = 0 THEN 'Given ' || c.conversation_id WHEN c.conversation_id % 3 = 0 AND d.title IS NOT NULL THEN 'Chat: ' || d.title ELSE coalesce(substr(f.content, 1, 40), 'New Conversation') END AS title
  FROM (SELECT DISTINCT conversation_id FROM messages) c LEFT JOIN documents_meta d ON d.document_id = c.conversation_id AND NOT d.is_deleted LEFT JOIN (SELECT * FROM messages WHERE role = 'USER' QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn) = 1) f ON f.conversation_id = c.conversation_id""", "messages", "documents_meta")
def conversation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A given title (every fifth has one), else that of the live document talked about (every third), else the first question."""
    k = F.col("conversation_id")
    asked = E.messages(spark, sf_dir).groupBy("conversation_id").agg(F.min_by("content", F.when(F.col("role") == "USER", F.col("turn"))).alias("first"))
    about = live(spark, sf_dir).select(F.col("document_id").alias("conversation_id"), F.concat(F.lit("Chat: "), "title").alias("about"))
    rows = asked.join(about, "conversation_id", "left")
    given = F.when(k % 5 == 0, F.concat(F.lit("Given "), k.cast("string")))
    return rows.select("conversation_id", F.coalesce(given, F.when(k % 3 == 0, F.col("about")), F.substring("first", 1, 40), F.lit("New Conversation")).alias("title"))


@query("""SELECT d.user_id, f.document_id, f.field_name, f.confidence, row_number() OVER (PARTITION BY d.user_id ORDER BY f.confidence, f.document_id, f.field_name) AS place, count(*) OVER (PARTITION BY d.user_id) AS total
  FROM fields f JOIN documents_meta d ON d.document_id = f.document_id WHERE f.confidence < 0.65 AND NOT (is_verified OR is_rejected) AND d.status = 'COMPLETED' AND NOT d.is_deleted""", "fields", "documents_meta")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = live(spark, sf_dir).where("status = 'COMPLETED'").select("document_id", "user_id")
    rows = E.fields(spark, sf_dir).where(LOW).join(done, "document_id")
    of = Window.partitionBy("user_id")
    place = F.row_number().over(of.orderBy("confidence", "document_id", "field_name")).cast("long")
    return rows.select("user_id", "document_id", "field_name", "confidence", place.alias("place"), F.count(F.lit(1)).over(of).alias("total"))


@query("""WITH asked AS (SELECT user_id, user_id % 3 + 1 AS page, user_id % 4 * 5 + 1 AS size, CASE WHEN user_id % 5 = 0 THEN 'INVOICE' END AS category, CASE user_id % 7 WHEN 0 THEN 'AMOUNT' WHEN 1 THEN '12' END AS search FROM users),
queue AS (SELECT a.page, a.size, d.user_id, f.document_id, f.field_name, f.confidence, row_number() OVER (PARTITION BY d.user_id ORDER BY f.confidence, f.document_id, f.field_name) AS place, count(*) OVER (PARTITION BY d.user_id) AS total
  FROM fields f JOIN documents_meta d ON d.document_id = f.document_id JOIN asked a ON a.user_id = d.user_id WHERE f.confidence < 0.65 AND NOT (is_verified OR is_rejected) AND d.status = 'COMPLETED' AND NOT d.is_deleted AND (a.category IS NULL OR d.category = a.category)
  AND (a.search IS NULL OR f.field_name ILIKE '%' || a.search || '%' OR f.raw_value ILIKE '%' || a.search || '%' OR d.title ILIKE '%' || a.search || '%'))
SELECT user_id, document_id, field_name, confidence, place, total, CAST(ceil(total / size) AS BIGINT) AS total_pages FROM queue WHERE place > (page - 1) * size AND place <= page * size""", "fields", "documents_meta", "users")
def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each user's review queue, by category and search where asked for; only the page's buckets are sorted."""
    u = F.col("user_id")
    asked = E.users(spark, sf_dir).select(
        "user_id", (u % 3 + 1).alias("page"), (u % 4 * 5 + 1).alias("size"), F.when(u % 5 == 0, "INVOICE").alias("want_category"), F.when(u % 7 == 0, "AMOUNT").when(u % 7 == 1, "12").alias("search"),
    )
    done = live(spark, sf_dir).where("status = 'COMPLETED'").select("document_id", "user_id", "title", "category").join(asked.select("user_id", "want_category", "search"), "user_id")
    done = done.where("want_category is null or category = want_category")
    has = lambda c: F.contains(F.lower(c), F.lower("search"))
    rows = E.fields(spark, sf_dir).where(LOW).join(done, "document_id").where(F.col("search").isNull() | has("field_name") | has("raw_value") | has("title"))
    rows = rows.select("user_id", "document_id", "field_name", "confidence")
    return pages(rows, asked.select("user_id", "page", "size"), "user_id", "confidence", "document_id", "field_name")


@query("""SELECT u.user_id, u.email, d.document_id, d.status, coalesce(v.version_number, 0) AS latest_version, v.version_status, v.error FROM users u, documents_meta d LEFT JOIN versions v ON v.document_id = d.document_id AND v.version_number = v.last_version WHERE d.user_id = u.user_id AND NOT d.is_deleted""", "users", "documents_meta", "versions")
def user_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live documents of every user with their latest version's number, status and error."""
    latest = E.versions(spark, sf_dir).where("version_number = last_version").select("document_id", "version_number", "version_status", "error")
    rows = live(spark, sf_dir).join(E.users(spark, sf_dir).select("user_id", "email"), "user_id").join(latest, "document_id", "left")
    return rows.select("user_id", "email", "document_id", "status", F.coalesce("version_number", F.lit(0)).alias("latest_version"), "version_status", "error")


@query("SELECT p.version_id, p.page_number, coalesce(v.page_count * 10, 0) AS width, coalesce(v.page_count * 14, 0) AS height FROM ocr_pages p LEFT JOIN versions v ON v.document_id = p.version_id AND v.version_number = p.page_number", "ocr_pages", "versions")
def page_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = E.versions(spark, sf_dir).select(F.col("document_id").alias("version_id"), F.col("version_number").alias("page_number"), (F.col("page_count") * 10).alias("w"), (F.col("page_count") * 14).alias("h"))
    rows = E.ocr_pages(spark, sf_dir).join(sizes, ["version_id", "page_number"], "left")
    return rows.select("version_id", "page_number", F.coalesce("w", F.lit(0)).alias("width"), F.coalesce("h", F.lit(0)).alias("height"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY document_id, field_name ORDER BY created_at, event_id) AS n FROM verification_events),
folded AS (SELECT document_id, field_name, bool_or(action = 'REJECTED') AS rejected, max(n) FILTER (action = 'EDITED') AS edit, bool_or(action <> 'REJECTED') AS good FROM e GROUP BY ALL)
SELECT f.document_id, f.field_name, f.is_rejected OR rejected AS is_rejected, true AS is_verified, coalesce(trim(e.new_value), f.raw_value) AS raw_value, CASE WHEN edit IS NOT NULL THEN 1.0 ELSE f.confidence END AS confidence,
  CASE WHEN good THEN 'HIGH' WHEN f.confidence >= 0.85 THEN 'HIGH' WHEN f.confidence >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level
FROM fields f JOIN folded USING (document_id, field_name) LEFT JOIN e ON e.document_id = f.document_id AND e.field_name = f.field_name AND e.n = folded.edit""", "fields", "verification_events")
def apply_review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviewed fields after all their events: accepted, edited (confidence 1) or rejected; all are verified."""
    return J.apply_review_events(E.fields(spark, sf_dir), E.verification_events(spark, sf_dir))


OVERRIDES_SQL = "['INVOICE', 'RECEIPT', 'FORM', 'LETTER']"


@query(f"""SELECT d.document_id, c.user_category AS category, true AS category_override, coalesce(d.category, 'UNKNOWN') AS ai_category, c.user_category, c.corrections FROM documents_meta d JOIN (
  SELECT document_id, {OVERRIDES_SQL}[arg_max(event_id, (created_at, event_id)) % 4 + 1] AS user_category, count(*) AS corrections FROM verification_events WHERE action = 'EDITED' GROUP BY document_id) c USING (document_id)""", "documents_meta", "verification_events")
def apply_category_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last category that a user gave wins; the first one that the model gave stays beside it."""
    given = F.element_at(F.array(*map(F.lit, ("INVOICE", "RECEIPT", "FORM", "LETTER"))), (F.col("event_id") % 4 + 1).cast("int"))
    events = E.verification_events(spark, sf_dir).where("action = 'EDITED'").select("document_id", given.alias("user_category"), "created_at", "event_id")
    return J.apply_category_overrides(E.documents_meta(spark, sf_dir), events)


# ---- sets and maintenance


@query(f"""WITH i AS ({INVENTORY_SQL}), r AS (SELECT document_id, field_count = 0 AS no_fields, category IN ('-', 'UNKNOWN') AS bad_category, models NOT IN ('', 'm1') AS stale, chunk_count = 0 AS no_chunks, NOT (status = 'COMPLETED' OR status = 'FAILED') AS stuck FROM i)
SELECT document_id, concat_ws(',', CASE WHEN no_fields THEN 'no-fields' END, CASE WHEN bad_category THEN 'bad-category' END, CASE WHEN stale THEN 'stale-embeddings' END, CASE WHEN no_chunks THEN 'no-chunks' END, CASE WHEN stuck THEN 'stuck' END) AS reasons FROM r
WHERE no_fields OR bad_category OR stale OR no_chunks OR stuck""", "documents_meta", "versions", "fields", "doc_embeddings")
def needs_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with any reason for a repair; ``platform.needs_repair`` also selects by single reasons or ids."""
    return J.needs_repair(document_inventory(spark, sf_dir)).select("document_id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT document_id, v AS version_number, name AS field_name FROM (SELECT document_id, version_number AS v, name FROM version_fields WHERE version_number > 1 UNION SELECT document_id, version_number + 1, name FROM version_fields WHERE version_number < last_version)", "versions", "version_fields")
def field_name_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of two consecutive versions' fields, each once."""
    names = F.array_distinct(F.concat("old.name", "new.name"))
    return E.version_field_pairs(spark, sf_dir).select("document_id", "version_number", F.explode(names).alias("field_name"))


_KIND = lambda i: "[" + ", ".join(f"'{k[i]}'" for k in E.FILE_KINDS) + "][doc_id % 7 + 1]"
FILES_SQL = f"""stored AS (SELECT doc_id, 'files/' || doc_id AS path, {_KIND(0)} AS declared_mime, octet_length(from_hex({_KIND(1)})) + strlen(repeat('/Type /Page ', CAST(doc_id % 130 AS INTEGER)) || '/Type /Pages /Count ' || (doc_id % 40) || chr(10) || coalesce(text, '')) AS size_bytes,
  [ 'application/pdf', 'image/png', 'image/jpeg', 'image/webp', NULL, 'image/png', NULL][doc_id % 7 + 1] AS mime_type FROM documents)"""


@query(f"WITH {FILES_SQL} SELECT path, size_bytes, declared_mime, CASE WHEN size_bytes > 52428800 THEN 'FILE_TOO_LARGE' WHEN doc_id % 7 = 4 THEN 'UNSUPPORTED_TYPE' END AS reject_reason, CASE WHEN size_bytes > 52428800 OR doc_id % 7 = 4 THEN 'quarantine' ELSE 'accepted' END AS sink FROM stored")
def ingest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.judge_manifest(E.stored_files(spark, sf_dir), F.col("declared_mime"))
    return rows.select("path", "size_bytes", "declared_mime", "reject_reason", F.when(F.col("reject_reason").isNull(), "accepted").otherwise("quarantine").alias("sink"))


@query(f"WITH {FILES_SQL} SELECT path, declared_mime, mime_type, CASE WHEN mime_type IS NULL OR mime_type <> declared_mime THEN 'FAILED' ELSE 'OK' END AS status FROM stored")
def sniff_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first bytes say against what was declared; a mismatch fails the file."""
    return files.compare_mime(E.stored_files(spark, sf_dir)).select("path", "declared_mime", "mime_type", "status")


@query("""SELECT 'files/' || doc_id AS path, CASE WHEN doc_id % 7 IN (0, 5, 6) THEN CASE WHEN doc_id % 130 > 0 THEN doc_id % 130 ELSE doc_id % 40 END ELSE 1 END AS page_count,
  CASE WHEN doc_id % 7 IN (5, 6) THEN 'CORRUPT_PDF' WHEN doc_id % 7 = 0 AND doc_id % 130 > 100 THEN 'TOO_MANY_PAGES' END AS page_error FROM documents""")
def pdf_page_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the files that are declared as PDF, and what is wrong with them; images are one page."""
    return files.pdf_page_audit(E.stored_files(spark, sf_dir)).select("path", F.col("page_count").cast("long").alias("page_count"), "page_error")


@query("""SELECT version_id, page_number, CASE WHEN block_index % 3 = 0 THEN 'paddle-' || page_number || '-' || i ELSE 'b' || block_index END AS block_id, CASE WHEN block_index % 5 = 0 THEN '' ELSE block_text END AS block_text, CASE WHEN block_index % 4 = 0 THEN 0.0 ELSE confidence END AS confidence, i AS block_order, 'text' AS block_type
  FROM (SELECT *, row_number() OVER (PARTITION BY version_id, page_number ORDER BY block_index) - 1 AS i FROM ocr_blocks) WHERE version_id % 10 <> 0 UNION ALL SELECT version_id, page_number, NULL, NULL, NULL, NULL, NULL FROM ocr_pages WHERE version_id % 10 = 0""", "ocr_blocks", "ocr_pages")
def parse_ocr_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of the OCR service (made of the blocks, with gaps) as rows; a page without blocks stays as one row."""
    i = F.col("block_index")
    block = F.struct(i.alias("at"), F.when(i % 3 != 0, F.concat(F.lit("b"), i.cast("string"))).alias("id"), F.when(i % 5 != 0, F.col("block_text")).alias("text"), F.when(i % 4 != 0, F.col("confidence")).alias("confidence"))
    pages = E.ocr_blocks(spark, sf_dir).groupBy("version_id", "page_number").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    payload = F.when(F.col("version_id") % 10 == 0, F.lit("{}")).otherwise(F.to_json(F.struct((F.col("page_number") + 1).alias("page"), F.transform("blocks", lambda b: F.struct(b["id"].alias("id"), b["text"].alias("text"), b["confidence"].alias("confidence"))).alias("blocks"))))
    rows = files.parse_ocr_payloads(pages.select("version_id", "page_number", payload.alias("payload")))
    return rows.select("version_id", "page_number", "block_id", "block_text", "confidence", F.col("block_order").cast("long").alias("block_order"), "block_type")


@query("SELECT doc_id, CASE WHEN doc_id % 4 <> 3 THEN lang END AS category, CASE WHEN doc_id % 4 <> 3 THEN n_chars END AS size, doc_id % 4 = 3 AS malformed FROM documents")
def parse_llm_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model (made of the documents, with and without fences, some cut off) as rows."""
    k = F.col("doc_id")
    body = F.to_json(F.struct(F.col("lang").alias("category"), F.col("n_chars").alias("size")))
    reply = F.when(k % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 4 == 1, F.concat(F.lit("```\n"), body, F.lit("```"))).when(k % 4 == 2, body).otherwise(F.substring(body, 1, 9))
    parsed = files.parse_llm_payloads(E.table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply")), "category string, size long")
    return parsed.select("doc_id", "parsed.category", "parsed.size", "malformed")


@query("SELECT document_id, version_number, CASE WHEN storage_key IS NULL OR storage_key = 'PENDING' THEN 'NO_STORAGE_KEY' ELSE 'MISSING_IN_STORAGE' END AS why FROM versions WHERE storage_key IS NULL OR storage_key = 'PENDING' OR document_id NOT IN (SELECT doc_id FROM documents)", "versions")
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions without a key, and those whose file the listing (one a document) doesn't have."""
    listing = E.table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("storage_key"))
    return J.missing_sources(E.versions(spark, sf_dir), listing).select("document_id", "version_number", "why")


@query("""SELECT m.document_id, 'FAILED' AS status, 'SOURCE_FILE_MISSING' AS error_code FROM documents_meta m WHERE m.status NOT IN ('COMPLETED', 'FAILED') AND EXISTS (SELECT 1 FROM versions v WHERE v.document_id = m.document_id AND v.version_number = CASE WHEN m.document_id % 4 = 0 THEN 1 ELSE v.last_version END
  AND (v.storage_key IS NULL OR v.storage_key = 'PENDING' OR NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = v.document_id)))""", "documents_meta", "versions")
def fail_unusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsettled documents whose current version has no source file: they can never be processed."""
    listing = E.table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("storage_key"))
    gone = J.missing_sources(current_versions(spark, sf_dir), listing).select("document_id")
    open_ones = E.documents_meta(spark, sf_dir).where("status not in ('COMPLETED', 'FAILED')")
    return open_ones.join(gone, "document_id", "left_semi").select("document_id", F.lit("FAILED").alias("status"), F.lit("SOURCE_FILE_MISSING").alias("error_code"))


@query(r"""SELECT page_id, 'documents/' || (page_id % 100) || '/' || page_id || '/1/original/' || substr(regexp_replace(regexp_replace(CASE WHEN ext <> '' AND base <> ext AND ends_with(base, ext) THEN left(base, length(base) - length(ext)) ELSE base END, '[^a-zA-Z0-9_-]', '_', 'g'), '_+', '_', 'g'), 1, 100) || ext AS storage_key
  FROM (SELECT page_id, base, lower(regexp_extract(base, '.(\.[^.]*)$', 1)) AS ext FROM (SELECT page_id, regexp_extract(rtrim(url, '/'), '[^/]*$') AS base FROM pages))""")
def partition_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    return E.table(spark, sf_dir, "pages").select("page_id", files.storage_key((k % 100).cast("string"), k.cast("string"), F.lit("1"), F.col("url")).alias("storage_key"))


@query("""SELECT coalesce(n.document_id, o.document_id) AS document_id, coalesce(n.user_category, o.user_category) AS user_category, o.ai_category FROM (SELECT document_id, category AS ai_category, 'NONE' AS user_category FROM documents_meta) o
  FULL JOIN (SELECT document_id + 7 AS document_id, 'CORRECTED' AS user_category FROM documents_meta WHERE document_id % 10 = 3) n ON n.document_id = o.document_id""", "documents_meta")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections by document: of one that is there only the user's category is updated, the model's stays."""
    old = E.documents_meta(spark, sf_dir).select("document_id", F.col("category").alias("ai_category"), F.lit("NONE").alias("user_category"))
    new = E.documents_meta(spark, sf_dir).where("document_id % 10 = 3").select((F.col("document_id") + 7).alias("document_id"), F.lit(None).cast("string").alias("ai_category"), F.lit("CORRECTED").alias("user_category"))
    return files.upsert_by_key(old, new, ["document_id"], ["user_category"])


@query("SELECT document_id, CASE WHEN document_id % 6 = 0 THEN 'Renamed ' || document_id ELSE title END AS title, CASE WHEN document_id % 8 = 0 AND NOT is_deleted THEN 'archive' END AS tags FROM documents_meta", "documents_meta")
def apply_metadata_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and tags of live documents, where a patch gives them; other documents and columns stay."""
    k = F.col("document_id")
    rows = E.documents_meta(spark, sf_dir).select("document_id", "title", F.lit(None).cast("string").alias("tags"), "is_deleted")
    patch = rows.where((k % 6 == 0) | ((k % 8 == 0) & ~F.col("is_deleted"))).select("document_id", F.when(k % 6 == 0, F.concat(F.lit("Renamed "), k.cast("string"))).alias("title"), F.when((k % 8 == 0) & ~F.col("is_deleted"), "archive").alias("tags"))
    return J.apply_patch(rows, patch, "document_id", ["title", "tags"]).select("document_id", "title", "tags")


@query("""SELECT d.document_id, d.is_deleted OR g.at IS NOT NULL AS is_deleted, CASE WHEN NOT d.is_deleted THEN g.at END AS deleted_at FROM documents_meta d LEFT JOIN (SELECT document_id, max(created_at) AS at FROM verification_events WHERE action = 'REJECTED' GROUP BY document_id) g ON g.document_id = d.document_id""", "documents_meta", "verification_events")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live documents with a rejected field are marked as deleted at the time of the last rejection."""
    gone = E.verification_events(spark, sf_dir).where("action = 'REJECTED'").groupBy("document_id").agg(F.max("created_at").alias("at"))
    return J.soft_delete(E.documents_meta(spark, sf_dir), gone).select("document_id", "is_deleted", "deleted_at")


@query(f"WITH {CITED_SQL} SELECT m.conversation_id, m.turn, (SELECT count(*) FROM cited c WHERE c.conversation_id = m.conversation_id AND c.turn = m.turn) AS citations FROM messages m WHERE m.conversation_id % 6 <> 0", "messages")
def delete_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and citations that are left after every sixth conversation was deleted with all that hangs on it."""
    gone = E.messages(spark, sf_dir).where("conversation_id % 6 = 0").select("conversation_id").distinct()
    messages, cited = J.delete_conversations(E.messages(spark, sf_dir), citations(spark, sf_dir), gone)
    counts = cited.groupBy("conversation_id", "turn").agg(F.count(F.lit(1)).alias("citations"))
    return messages.join(counts, ["conversation_id", "turn"], "left").select("conversation_id", "turn", F.coalesce("citations", F.lit(0)).alias("citations"))


@query("""WITH newest AS (SELECT *, page_count % 4 AS tries FROM versions WHERE version_number = last_version AND page_count <> 1)
SELECT d.document_id, v.version_number, w.path, 'QUEUED' AS status, 'QUEUED' AS processing_status, CASE w.path WHEN 'user' THEN 'FILE_VALIDATION' ELSE 'OCR' END AS processing_stage, CASE w.path WHEN 'user' THEN '[]' ELSE '[' || v.page_count || ']' END AS stage_history,
  v.tries + CASE w.path WHEN 'user' THEN 1 ELSE 0 END AS retry_count, v.tries >= CASE w.path WHEN 'user' THEN 2 ELSE 3 END AS final_attempt,
  CASE w.path WHEN 'user' THEN 'processing_error,processing_error_code,processing_error_stack,started_at,completed_at,processing_duration_ms' ELSE 'processing_error,processing_error_code,started_at,completed_at' END AS cleared
FROM documents_meta d JOIN newest v ON v.document_id = d.document_id, (VALUES ('user'), ('admin')) w(path) WHERE NOT d.is_deleted AND (w.path = 'user' OR d.status IN ('FAILED', 'QUEUED'))""", "documents_meta", "versions")
def retry_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State patches of retries: a user's of any live document whose latest version has a storage key, the admin's of failed and queued ones."""
    n = F.col("page_count")
    versions = E.versions(spark, sf_dir).withColumns({"retry_count": n % 4, "stage_history": F.concat(F.lit("["), n.cast("string"), F.lit("]")), "processing_stage": F.lit("OCR")})
    return J.retry_reset(live(spark, sf_dir), versions, by_admin=False).unionByName(J.retry_reset(live(spark, sf_dir), versions, by_admin=True))


_NAMES = "[" + ", ".join(f"'{c}'" for c in J.CATEGORIES) + "]"


@query(rf"""WITH named AS (SELECT *, {_NAMES}[o_custkey % {len(J.CATEGORIES)} + 1] AS name FROM orders), raw AS (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN '  ' || replace(lower(name), '_', ' ') || ' ' WHEN 1 THEN replace(name, '_', '-') WHEN 2 THEN name WHEN 3 THEN replace(lower(name), '_', '   ') || '!' WHEN 4 THEN name || 'S' WHEN 5 THEN '' END AS category FROM named)
SELECT o_orderkey AS document_id, CASE WHEN list_contains({_NAMES}, token) THEN token ELSE 'UNKNOWN' END AS category, least(1.0, greatest(0.0, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice / 200000 END, 0))) AS confidence
  FROM (SELECT *, regexp_replace(regexp_replace(upper(trim(coalesce(category, ''))), '[\s-]+', '_', 'g'), '[^A-Z0-9_]', '', 'g') AS token FROM raw)""")
def conform_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category names as a model spells them -> the platform's, else UNKNOWN; confidence clamped, 0 where there is none."""
    name, k = F.get(F.array(*map(F.lit, J.CATEGORIES)), (F.col("o_custkey") % len(J.CATEGORIES)).cast("int")), F.col("o_orderkey") % 7
    low = lambda gap: F.replace(F.lower(name), F.lit("_"), F.lit(gap))
    raw = (
        F.when(k == 0, F.concat(F.lit("  "), low(" "), F.lit(" "))).when(k == 1, F.replace(name, F.lit("_"), F.lit("-"))).when(k == 2, name).when(k == 3, F.concat(low("   "), F.lit("!")))
        .when(k == 4, F.concat(name, F.lit("S"))).when(k == 5, F.lit(""))
    )
    conf = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 200000)
    return J.conform_category(E.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), raw.alias("category"), conf.alias("confidence")), enum_token)


@query("""WITH expected AS ({registry}), of AS (SELECT document_id, coalesce((SELECT any_value(e.category) FROM expected e WHERE e.category = d.category), 'UNKNOWN') AS category FROM documents_meta d)
SELECT of.document_id, of.category, count(*) AS expected, count(f.field_name) AS present, round(count(f.field_name) / count(*), 6) AS completeness FROM of JOIN expected e ON e.category = of.category
LEFT JOIN (SELECT DISTINCT document_id, field_name FROM fields WHERE NOT is_rejected) f ON f.document_id = of.document_id AND f.field_name = e.field_name GROUP BY ALL""".replace("{registry}", J.registry_sql()), "documents_meta", "fields")
def schema_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the fields that a document's category expects which are there and not rejected."""
    return J.schema_completeness(E.documents_meta(spark, sf_dir), E.fields(spark, sf_dir))


# ---- batch twins of the streams

RULE_SQL = """CASE WHEN contains(path, '/auth/login') OR contains(path, '/auth/register') THEN [10, 900] WHEN contains(path, '/documents') AND method = 'POST' THEN [20, 60] WHEN contains(path, '/conversations') AND contains(path, '/messages') THEN [40, 60]
  WHEN contains(path, '/search') THEN [80, 60] ELSE [150, 60] END"""


@query(f"""WITH requests AS (SELECT user_id, CASE WHEN event_type = 'view' OR (event_type = 'error' AND event_id % 2 <> 0) THEN 'GET' ELSE 'POST' END AS method, CASE event_type WHEN 'signup' THEN '/auth/register' WHEN 'view' THEN '/search' WHEN 'click' THEN '/review/fields' WHEN 'purchase' THEN '/documents'
    ELSE CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN '/conversations/1/messages' ELSE '/other' END END AS path, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events), ruled AS (SELECT *, {RULE_SQL} AS rule FROM requests)
SELECT user_id, method, path, sec // rule[2] * rule[2] AS window_start, count(*) AS requests, count(*) > rule[1] AS limited, greatest(rule[1] - count(*), 0) AS remaining, sec // rule[2] * rule[2] + rule[2] AS reset_at FROM ruled GROUP BY user_id, method, path, sec // rule[2], rule""")
def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = J.with_rate_rule(E.requests(spark, sf_dir)).groupBy("user_id", "method", "path", "window_start", "allowed", "span").agg(F.count(F.lit(1)).alias("requests"))
    return J.rate_verdicts(rows)


@query("SELECT event_type, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS events FROM audit_logs GROUP BY ALL", "audit_logs")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.audit_logs(spark, sf_dir).groupBy("event_type", F.to_date("created_at").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("events"))


@query("""SELECT document_id, version_number, version_status, page_count % 4 AS attempts, CASE WHEN page_count % 4 >= 3 THEN 'FAIL' ELSE 'RETRY' END AS action FROM versions
  WHERE version_status = 'QUEUED' AND epoch(version_created_at) + 600 + 5 * 2 ** (page_count % 4) < (SELECT epoch(max(version_created_at)) FROM versions)""", "versions")
def stuck_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that were still waiting ten minutes and their back-off before the newest one came."""
    rows = E.versions(spark, sf_dir).withColumn("attempts", F.col("page_count") % 4)
    now = rows.agg(F.max("version_created_at").alias("now"))
    return J.stuck_versions(rows.crossJoin(F.broadcast(now)), F.col("now")).select("document_id", "version_number", "version_status", "attempts", "action")
