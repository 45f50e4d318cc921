"""Page geometry, engine choice, nested details, citations, embedding upkeep and ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyr.operators import ocr
from papyr.operators import retrieval as R
from papyr.operators.vectors import ivf_topk
from papyr.plans.retrieval_queries import LEXICAL, TERMS, _vector_queries, _vectors, keyword_topk
from papyr.plans.text_queries import trim_sql
from papyr.sources import entities as E
from papyr.sources.entities import oracle

Q, O = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return register


#: Boxes as models give them, by the number of the block: grounded (out of order and beyond the page too), parts of the page, thousandths, pixels, three numbers, none.
_BOXES = f"""given AS (SELECT *, row_number() OVER (PARTITION BY version_id, page_number ORDER BY block_index) - 1 AS i, (version_id * 7 + block_index) % 7 AS kind, CAST(block_index * 37 % 1150 AS DOUBLE) AS a, CAST((version_id + block_index * 53) % 930 AS DOUBLE) AS b,
  700 + version_id % 500 AS w, 800 + version_id % 300 AS h FROM (SELECT * REPLACE ({trim_sql('block_text')} AS block_text) FROM ocr_blocks) WHERE block_text <> '')"""


@query(oracle(f"""WITH {_BOXES}, raw AS (SELECT *, CASE kind WHEN 0 THEN greatest(0, least(w, floor(a / 1000 * w + 0.5))) WHEN 1 THEN greatest(0, least(w, floor(least(a + 50, a - 60) / 1000 * w + 0.5))) WHEN 2 THEN floor(a / 2000 / 1.0 * w + 0.5)
      WHEN 3 THEN CASE WHEN greatest(a + 50, b + 20) <= 1000 AND (w > 1000 OR h > 1000) THEN floor(a / 1000 * w + 0.5) ELSE floor(a + 0.5) END WHEN 4 THEN floor(a + 3.5 + 0.5) ELSE 0 END AS x1,
    CASE WHEN kind IN (0, 1) THEN greatest(0, least(h, floor(b / 1000 * h + 0.5))) WHEN kind = 2 THEN floor(b / 2000 / 1.0 * h + 0.5) WHEN kind = 3 THEN CASE WHEN greatest(a + 50, b + 20) <= 1000 AND (w > 1000 OR h > 1000) THEN floor(b / 1000 * h + 0.5) ELSE floor(b + 0.5) END
      WHEN kind = 4 THEN floor(b - 20.5 + 0.5) ELSE i * 30 END AS y1,
    CASE kind WHEN 0 THEN greatest(0, least(w, floor((a + 50) / 1000 * w + 0.5))) WHEN 1 THEN greatest(0, least(w, floor((a + 50) / 1000 * w + 0.5))) WHEN 2 THEN floor((a + 50) / 2000 / 1.0 * w + 0.5)
      WHEN 3 THEN CASE WHEN greatest(a + 50, b + 20) <= 1000 AND (w > 1000 OR h > 1000) THEN floor((a + 50) / 1000 * w + 0.5) ELSE floor(a + 50 + 0.5) END WHEN 4 THEN floor(a + 1200.25 + 0.5) ELSE w END AS x2,
    CASE WHEN kind IN (0, 1) THEN greatest(0, least(h, floor((b + 20) / 1000 * h + 0.5))) WHEN kind = 2 THEN floor((b + 20) / 2000 / 1.0 * h + 0.5) WHEN kind = 3 THEN CASE WHEN greatest(a + 50, b + 20) <= 1000 AND (w > 1000 OR h > 1000) THEN floor((b + 20) / 1000 * h + 0.5) ELSE floor(b + 20 + 0.5) END
      WHEN kind = 4 THEN floor(b + 20 + 0.5) ELSE (i + 1) * 30 END AS y2 FROM given)
SELECT version_id, page_number, i AS block_order, replace(block_text, chr(0), '') AS block_text, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2,
  CASE WHEN block_index % 5 = 0 THEN 0.95 ELSE greatest(0.1, least(1.0, confidence * 1.2)) END AS confidence FROM raw""", "ocr_blocks"))
def bbox_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in any of the forms that models give -> whole pixels; blank blocks go, the others are counted anew."""
    i, v = F.col("block_index"), F.col("version_id")
    a, b, kind = (i * 37 % 1150).cast("double"), ((v + i * 53) % 930).cast("double"), (v * 7 + i) % 7
    grounded = F.when(kind == 0, F.array(b, a, b + 20, a + 50)).when(kind == 1, F.array(b + 20, a + 50, b, a - 60))
    boxed = (
        F.when(kind == 2, F.array(*((x / 2000) for x in (a, b, a + 50, b + 20)))).when(kind == 3, F.array(a, b, a + 50, b + 20))
        .when(kind == 4, F.array(a + 3.5, b - 20.5, a + 1200.25, b + 20)).when(kind == 5, F.array(a, b, a))
    )
    conf = F.when(i % 5 != 0, F.col("confidence") * 1.2)
    return ocr.standard_blocks(E.ocr_blocks(spark, sf_dir).select("version_id", "page_number", "block_index", "block_text", grounded.alias("box_2d"), boxed.alias("bbox"), conf.alias("confidence"), (700 + v % 500).alias("width"), (800 + v % 300).alias("height")))


@query(oracle("SELECT version_id, block_index, least(x, x + 40, x + 37, x - 3) AS x1, least(y, y + 2, y + 14, y + 12) AS y1, greatest(x, x + 40, x + 37, x - 3) AS x2, greatest(y, y + 2, y + 14, y + 12) AS y2 FROM (SELECT version_id, block_index, block_index * 7 % 500 AS x, block_index * 30 AS y FROM ocr_blocks)", "ocr_blocks"))
def polygon_to_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("block_index") * 7 % 500, F.col("block_index") * 30
    corners = F.array(*(F.struct(p.alias("x"), q.alias("y")) for p, q in ((x, y), (x + 40, y + 2), (x + 37, y + 14), (x - 3, y + 12))))
    rows = E.ocr_blocks(spark, sf_dir).select("version_id", "block_index", corners.alias("c"))
    xs, ys = F.transform("c", lambda p: p["x"]), F.transform("c", lambda p: p["y"])
    return rows.select("version_id", "block_index", F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


@query(oracle(f"""WITH lines AS (SELECT version_id, page_number, row_number() OVER (PARTITION BY version_id, page_number ORDER BY block_index) - 1 AS block_order, 1 AS first, {trim_sql('block_text')} AS block_text, CASE WHEN block_index % 3 <> 0 THEN block_index * 13 % 130 END AS given, 75 AS none
    FROM ocr_blocks WHERE {trim_sql('block_text')} <> '' AND (version_id + page_number) % 8 <> 0),
rest AS (SELECT version_id, page_number, {trim_sql('t.line')} AS line, t.i AS i, (version_id * 13 + page_number) % 140 AS given FROM ocr_pages p, LATERAL (SELECT unnest(string_split({trim_sql('p.raw_text')}, chr(10))) AS line, generate_subscripts(string_split({trim_sql('p.raw_text')}, chr(10)), 1) AS i) t
    WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.version_id = p.version_id AND l.page_number = p.page_number)),
both_kinds AS (SELECT * FROM lines UNION ALL SELECT version_id, page_number, row_number() OVER (PARTITION BY version_id, page_number ORDER BY i) - 1, 0, line, given, 80 FROM rest WHERE line <> '')
SELECT version_id, page_number, block_order, block_order + first AS reading_order, block_text, CASE WHEN coalesce(given, 0) = 0 THEN none WHEN given < 10 THEN 10 WHEN given > 100 THEN 100 ELSE given END / 100 AS confidence FROM both_kinds""", "ocr_blocks", "ocr_pages"))
def blocks_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of recognised lines; every eighth page has none and takes the lines of its text."""
    given = F.when(F.col("block_index") % 3 != 0, F.col("block_index") * 13 % 130)
    lines = E.ocr_blocks(spark, sf_dir).where("(version_id + page_number) % 8 <> 0").select("version_id", "page_number", F.col("block_index").alias("line_index"), F.col("block_text").alias("text"), given.alias("confidence"))
    return ocr.line_blocks(lines, E.ocr_pages(spark, sf_dir).select("version_id", "page_number", "raw_text", ((F.col("version_id") * 13 + F.col("page_number")) % 140).alias("confidence")))


ENGINES_SQL = """WITH page AS (SELECT *, version_id % 6 = 1 AS vision_first, octet_length(encode(raw_text)) % 90000 > 50000 AS big, (version_id * 7 + page_number) % 3 = 0 AND trim(raw_text) <> '' AS layer, (version_id * 7 + page_number * 3) % 100 / 100 AS paddle_confidence,
  (version_id + page_number * 3) % 9 AS paddle_blocks, (version_id * 5 + page_number) % 11 = 0 AS paddle_failed, (version_id + page_number * 2) % 4 <> 0 AS vision, (version_id + page_number * 4) % 5 <> 0 AS tesseract FROM ocr_pages),
weighed AS (SELECT *, paddle_confidence < 0.75 OR paddle_failed OR paddle_blocks = 0 OR (paddle_blocks < 5 AND big) AS weak FROM page),
chosen_engines AS (SELECT version_id, page_number, CASE WHEN layer THEN 'layer' WHEN vision_first AND vision THEN 'vision' WHEN NOT weak THEN 'paddle' WHEN vision THEN 'vision' WHEN tesseract THEN 'tesseract' ELSE 'paddle' END AS engine FROM weighed)"""


def engine_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engines gave for each page, one row an engine: whether there is text, blocks, confidence, failure."""
    v, p = F.col("version_id"), F.col("page_number")
    none, well = F.lit(0), F.lit(1.0)
    results = (
        ("layer", ((v * 7 + p) % 3 == 0) & (F.trim("raw_text") != ""), F.lit(1), well, F.lit(False)), ("vision", (v + p * 2) % 4 != 0, F.lit(1), well, F.lit(False)),
        ("paddle", F.lit(True), (v + p * 3) % 9, (v * 7 + p * 3) % 100 / 100, (v * 5 + p) % 11 == 0), ("tesseract", (v + p * 4) % 5 != 0, none, well, F.lit(False)),
    )
    made = F.array(*(F.struct(F.lit(n).alias("engine"), text.alias("has_text"), b.cast("long").alias("blocks"), c.alias("confidence"), f.alias("failed")) for n, text, b, c, f in results))
    pages = E.ocr_pages(spark, sf_dir).select("version_id", "page_number", (v % 6 == 1).alias("vision_first"), F.octet_length("raw_text").alias("n"), F.explode(made).alias("r"))
    return pages.select("version_id", "page_number", "vision_first", (F.col("n") % 90000).alias("image_bytes"), "r.*")


@query(oracle(f"{ENGINES_SQL} SELECT * FROM chosen_engines", "ocr_pages"))
def ocr_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine whose result each page takes."""
    return choose_engine(engine_results(spark, sf_dir))


def choose_engine(results: DataFrame, threshold: float = 0.75, few_blocks: int = 5, big_image: int = 50_000) -> DataFrame:
    """The first usable result of each page: a text layer with any text, vision where it is set first, a strong paddle
    result, vision, tesseract, else what paddle gave.

    A paddle result is weak where it failed, has no block or a confidence below the threshold, or few blocks of a big
    image. One aggregate by page.
    """
    paddle = F.col("engine") == "paddle"
    weak = (F.col("confidence") < threshold) | F.col("failed") | (F.col("blocks") == 0) | ((F.col("blocks") < few_blocks) & (F.col("image_bytes") > big_image))
    has = lambda e: F.max((F.col("engine") == e) & F.col("has_text")).alias(e)
    page = results.groupBy("version_id", "page_number").agg(has("layer"), has("vision"), has("tesseract"), F.max("vision_first").alias("first"), F.max(paddle & weak).alias("weak"))
    engine = (
        F.when(F.col("layer"), "layer").when(F.col("first") & F.col("vision"), "vision").when(~F.col("weak"), "paddle").when(F.col("vision"), "vision").when(F.col("tesseract"), "tesseract").otherwise("paddle")
    )
    return page.select("version_id", "page_number", engine.alias("engine"))


@query(oracle("SELECT d.document_id, d.title, coalesce(v.versions, '') AS versions, coalesce(f.fields, '') AS fields FROM documents_meta d LEFT JOIN (SELECT document_id, string_agg(CAST(version_number AS VARCHAR), ',' ORDER BY version_number DESC) AS versions FROM versions GROUP BY document_id) v ON v.document_id = d.document_id LEFT JOIN (SELECT document_id, string_agg(field_name, ',' ORDER BY confidence DESC, field_name) AS fields FROM fields WHERE NOT is_rejected GROUP BY document_id) f ON f.document_id = d.document_id WHERE NOT d.is_deleted", "documents_meta", "versions", "fields"))
def document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document with its versions, newest first, and its fields, surest first."""
    v = E.versions(spark, sf_dir).groupBy("document_id").agg(F.sort_array(F.collect_list("version_number"), asc=False).alias("v"))
    f = E.fields(spark, sf_dir).where("not is_rejected").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "field_name"))).alias("f"))
    rows = E.documents_meta(spark, sf_dir).where("not is_deleted").join(v, "document_id", "left").join(f, "document_id", "left")
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return rows.select("document_id", "title", text(F.col("v").cast("array<string>")).alias("versions"), text(F.transform("f", lambda x: x["field_name"])).alias("fields"))


@query(oracle(f"WITH {LEXICAL} SELECT query_id, chunk_id, partial_score AS score FROM scored WHERE NOT holds", "search_queries"))
def partial_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score by the share of words alone, of the pairs where the whole query isn't found."""
    chunks = E.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return R.keyword_matches(chunks, E.search_queries(spark, sf_dir)).where("not whole").select("query_id", "chunk_id", F.col("partial_score").alias("score"))


_TOPS = f"{LEXICAL}, ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10)"


@query(oracle(f"""WITH {_TOPS}, cited AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN [2, 1] WHEN query_id % 3 = 1 THEN [4] ELSE CAST([] AS INTEGER[]) END AS n FROM search_queries)
SELECT query_id, chunk_id, CASE WHEN len(n) = 0 THEN rank ELSE list_position(n, rank) END AS place FROM ranked JOIN cited USING (query_id) WHERE (len(n) = 0 AND rank <= 3) OR list_contains(n, rank)""", "search_queries"))
def match_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers citing sources 2 and 1, source 4, or none (then the best three), against each query's ranked chunks."""
    answer = F.when(F.col("query_id") % 3 == 0, "[Source 2] then 【Source 1】, [source 2]").when(F.col("query_id") % 3 == 1, "as Source 4 says").otherwise("no mark")
    asked = E.search_queries(spark, sf_dir).select("query_id", R.cited_sources(answer).alias("n"))
    rows = keyword_topk(spark, sf_dir).join(asked, "query_id")
    none = F.size("n") == 0
    rows = rows.where((none & (F.col("rank") <= 3)) | F.array_contains("n", F.col("rank")))
    return rows.select("query_id", "chunk_id", F.when(none, F.col("rank").cast("long")).otherwise(F.array_position("n", F.col("rank"))).alias("place"))


@query("""SELECT doc_id AS chunk_id, 'hash' AS model, 64 AS dimension, CASE WHEN length(text) > 0 THEN 1.0 ELSE 0.0 END AS norm FROM documents WHERE sha256('m1' || chr(0) || text) NOT IN (SELECT sha256('m1' || chr(0) || text) FROM documents, embeddings WHERE doc_id = vec_id AND label < 8)""")
def embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for the chunks whose text has none of the current model: a text that was embedded once is covered."""
    docs = E.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.sha2(F.concat(F.lit("m1\0"), "text"), 256).alias("content_key"))
    have = E.embeddings(spark, sf_dir).where("model = 'm1'").select("chunk_id").join(docs.select("chunk_id", "content_key"), "chunk_id").select("content_key")
    missing = docs.join(have, "content_key", "left_anti")
    made = R.checked_vectors(missing.withColumn("embedding", R.hash_embed_column(F.col("text"))), 64)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return made.select("chunk_id", F.lit("hash").alias("model"), F.size("embedding").alias("dimension"), F.round(norm, 3).alias("norm"))


@query(oracle("SELECT e.chunk_id, CASE WHEN e.model <> 'hash' AND d.text IS NOT NULL THEN 'hash' ELSE e.model END AS model, e.model <> 'hash' AND d.text IS NOT NULL AS replaced, CASE WHEN e.model <> 'hash' AND d.text IS NOT NULL THEN 1 ELSE round(list_sum(list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x * x)), 3) END AS norm FROM doc_embeddings e LEFT JOIN documents d ON d.doc_id = e.chunk_id", "doc_embeddings"))
def reembed_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of other models than the hash one are made anew where the text is there, and carry the model that made them.

    The squared length stands for the vector, which is 1 for those made anew; ``reembed_vectors`` has the vectors.
    """
    rows = _reembedded(spark, sf_dir, "hash")
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return rows.select("chunk_id", "model", "replaced", F.round(norm, 3).alias("norm"))


def _reembedded(spark: SparkSession, sf_dir: str, current: str) -> DataFrame:
    docs = E.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    rows = E.embeddings(spark, sf_dir).join(docs, "chunk_id", "left")
    replaced = (F.col("model") != current) & F.col("text").isNotNull()
    fresh = F.when(replaced, R.hash_embed_column(F.when(replaced, F.col("text")))).otherwise(F.col("embedding"))
    return rows.select("chunk_id", F.when(replaced, "hash").otherwise(F.col("model")).alias("model"), replaced.alias("replaced"), fresh.alias("embedding"))


@query()
def reembed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors after the renewal of those that aren't of model m1: made anew (by hash) where the chunk's text is there."""
    return _reembedded(spark, sf_dir, "m1")


def _all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.embeddings(spark, sf_dir).select(F.lit(0).alias("user_id"), "model", "chunk_id", "embedding")


def _all_vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_vectors(spark, sf_dir).where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "user_id", "model", F.col("embedding").alias("vector"))


@query()
def semantic_topk_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth vector's ten nearest of its user group and model, by an inverted file of cells."""
    return ivf_topk(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 10)


@query()
def semantic_topk_approx_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all users' vectors, deleted documents too: every vector is indexed."""
    return ivf_topk(_all_vectors(spark, sf_dir), _all_vector_queries(spark, sf_dir), 10)


@query(oracle(f"""WITH {TERMS}, wanted AS (SELECT DISTINCT query_id, lower(unnest(terms)) AS term FROM terms), toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM wanted) GROUP BY ALL), len AS (SELECT doc_id, count(*) AS n FROM toks GROUP BY doc_id), stats AS (SELECT count(*) AS docs, sum(n) / count(*) AS mean FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT query_id, tf.doc_id AS chunk_id, floor(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) * 1000 + 0.5) / 1000 AS bm25 FROM wanted JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.doc_id = tf.doc_id CROSS JOIN stats GROUP BY query_id, tf.doc_id""", "search_queries"))
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of the query terms over whole documents, from term and document frequencies."""
    chunks = E.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return R.bm25_scores(chunks, E.search_queries(spark, sf_dir))
