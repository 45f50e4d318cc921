"""Text and chunk jobs over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.functions import text as T
from papyr.operators import chunking
from papyr.operators.joins import join_by_hot_key
from papyr.sources import entities as E
from papyr.sources.entities import oracle

Q, O = {}, {}
SP = T.SPACE


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql is not None:
            O[f.__name__] = sql
        return f

    return register


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{SP}]+'))"


def tokens_sql(words: str) -> str:
    return f"CAST(floor(({words}) * 1.3 + 0.5) AS INTEGER)"


def parts_sql(x: str, pattern: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{pattern}'), lambda p: {trim_sql('p')}), lambda p: p <> '')"


def sentences_sql(x: str) -> str:
    marked = f"regexp_replace({x}, '([{T.SENTENCE_END}])[{SP}]+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: {trim_sql('p')}), lambda p: p <> '')"


def blocks_sql(x: str) -> str:
    blank, line = parts_sql(x, rf"\n[{SP}]*\n+"), parts_sql(x, r"\n+")
    return f"CASE WHEN len({blank}) > 1 THEN {blank} WHEN len({line}) > 1 THEN {line} ELSE {sentences_sql(x)} END"


def heading_sql(x: str) -> str:
    return f"(length({x}) <= 80 AND NOT contains({x}, chr(10)) AND (ends_with({x}, ':') OR (length({x}) > 3 AND regexp_matches({x}, '\\p{{Lu}}') AND NOT regexp_matches({x}, '\\p{{Ll}}'))))"


def language_sql(x: str, least: int = 5) -> str:
    d, a = f"len(regexp_extract_all({x}, '{T.DEVANAGARI}'))", f"len(regexp_extract_all({x}, '[a-zA-Z]'))"
    return f"CASE WHEN {d} + {a} < {least} THEN 'unknown' WHEN {d} / ({d} + {a}) > 0.6 THEN 'hi' WHEN {d} / ({d} + {a}) < 0.2 THEN 'en' ELSE 'hi+en' END"


def normalize_sql(x: str) -> str:
    t = f"nfc_normalize(coalesce({x}, ''))"
    t = rf"regexp_replace({t}, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g')"
    inline = SP.replace(r"\n", "")
    t = f"regexp_replace({t}, '[{inline}]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
    t = rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return trim_sql(f"array_to_string(list_transform(string_split({t}, chr(10)), lambda p: {trim_sql('p')}), chr(10))")


#: Trouble that the corpus lacks, put around its texts: tabs, carriage returns, zero-width and wide spaces, accents, Hindi.
def _rough(text):
    return F.concat(F.lit(" \t\r\n\n\n\n "), text, F.lit(f"\r\ne{chr(0x301)}  {chr(0x200B)}{chr(0xA0)}x{chr(7)}{chr(0x915)}{chr(0x93E)}\n \n"))


_ROUGH_SQL = "chr(32) || chr(9) || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || ' ' || text || chr(13) || chr(10) || 'e' || chr(769) || '  ' || chr(8203) || chr(160) || 'x' || chr(7) || chr(2325) || chr(2366) || chr(10) || ' ' || chr(10)"


@query(f"SELECT doc_id, {normalize_sql(_ROUGH_SQL)} AS normalized FROM documents")
def normalize_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table(spark, sf_dir, "documents").select("doc_id", T.normalize(_rough(F.col("text"))).alias("normalized"))


@query(oracle(f"SELECT version_id, string_agg({normalize_sql('raw_text')}, chr(10) || chr(10) ORDER BY page_number) AS full_text FROM ocr_pages GROUP BY version_id", "ocr_pages"))
def concat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised pages of a version, joined by a blank line."""
    pages = E.ocr_pages(spark, sf_dir).withColumn("raw_text", T.normalize(F.col("raw_text"))).groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "raw_text"))).alias("p"))
    return pages.select("version_id", F.array_join(F.transform("p", lambda x: x["raw_text"]), "\n\n").alias("full_text"))


@query(oracle(f"SELECT version_id, page_number, {language_sql('raw_text')} AS page_language FROM ocr_pages", "ocr_pages"))
def detect_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ocr_pages(spark, sf_dir).select("version_id", "page_number", T.script_language(F.col("raw_text")).alias("page_language"))


@query(oracle(f"SELECT version_id, block_index, {language_sql('block_text', 1)} AS block_language FROM ocr_blocks", "ocr_blocks"))
def detect_block_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ocr_blocks(spark, sf_dir).select("version_id", "block_index", T.script_language(F.col("block_text"), 1).alias("block_language"))


@query(f"SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '{T.DEVANAGARI}')) >= 3 THEN 'hi' ELSE 'en' END AS query_language FROM conversations WHERE role = 'user'")
def detect_query_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", T.query_language(F.col("text")).alias("query_language"))


@query(f"SELECT doc_id, unnest({blocks_sql('text')}) AS block, unnest(range(len({blocks_sql('text')}))) AS pos FROM documents")
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.blocks(F.col("text"))).alias("pos", "block"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT doc_id, unnest({sentences_sql('text')}) AS sentence FROM documents")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))


@query(oracle(f"SELECT version_id, block_index, {heading_sql(trim_sql('block_text'))} AS is_heading FROM ocr_blocks", "ocr_blocks"))
def flag_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ocr_blocks(spark, sf_dir).select("version_id", "block_index", T.is_heading(F.col("block_text")).alias("is_heading"))


@query(f"SELECT doc_id, {tokens_sql(words_sql('text'))} AS token_count FROM documents")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("token_count"))


_W, _B = words_sql("b"), "w + bw"
CHUNKS_SQL = f"""WITH RECURSIVE blocked AS (
  SELECT version_id, page_number, {blocks_sql('raw_text')} AS blocks FROM ocr_pages WHERE {trim_sql('raw_text')} <> ''
), b AS (
  SELECT version_id, page_number, unnest(blocks) AS b, unnest(range(1, len(blocks) + 1)) AS i, len(blocks) AS n FROM blocked
), steps AS (SELECT *, {_W} AS bw, {heading_sql('b')} AS head FROM b
), walk AS (
  SELECT version_id, page_number, 0 AS i, '' AS buf, 0 AS w, CAST(NULL AS VARCHAR) AS section, CAST(NULL AS VARCHAR) AS out_section, CAST([] AS VARCHAR[]) AS outs FROM blocked
  UNION ALL
  SELECT p.version_id, p.page_number, s.i,
    CASE WHEN head THEN b WHEN {tokens_sql(_B)} > 600 AND buf <> '' THEN CASE WHEN {tokens_sql('bw')} >= 600 THEN '' ELSE b END WHEN {tokens_sql(_B)} >= 300 THEN '' WHEN buf = '' THEN b ELSE buf || chr(10) || chr(10) || b END,
    CASE WHEN head THEN bw WHEN {tokens_sql(_B)} > 600 AND buf <> '' THEN CASE WHEN {tokens_sql('bw')} >= 600 THEN 0 ELSE bw END WHEN {tokens_sql(_B)} >= 300 THEN 0 ELSE w + bw END,
    CASE WHEN head THEN b ELSE p.section END, p.section,
    CASE WHEN head THEN CASE WHEN buf = '' THEN [] ELSE [buf] END
      WHEN {tokens_sql(_B)} > 600 AND buf <> '' THEN CASE WHEN {tokens_sql('bw')} >= 600 THEN [buf, b] ELSE [buf] END
      WHEN {tokens_sql(_B)} >= 300 THEN [CASE WHEN buf = '' THEN b ELSE buf || chr(10) || chr(10) || b END] ELSE [] END
  FROM walk p JOIN steps s ON s.version_id = p.version_id AND s.page_number = p.page_number AND s.i = p.i + 1
), last AS (SELECT version_id, page_number, max(i) AS i FROM walk GROUP BY ALL
), raw AS (
  SELECT version_id, page_number, i, out_section AS section_title, unnest(outs) AS content, unnest(range(len(outs))) AS k FROM walk
  UNION ALL SELECT version_id, page_number, i + 1, section, buf, 0 FROM walk JOIN last USING (version_id, page_number, i) WHERE buf <> ''
)"""


@query(oracle(CHUNKS_SQL + f" SELECT version_id, page_number, row_number() OVER (PARTITION BY version_id ORDER BY page_number, i, k) - 1 AS chunk_index, section_title, content, {tokens_sql(words_sql('content'))} AS token_count FROM (SELECT * REPLACE ({trim_sql('content')} AS content) FROM raw) WHERE length(content) >= 20", "ocr_pages").replace("WITH ocr_pages", "WITH RECURSIVE ocr_pages", 1).replace("RECURSIVE blocked", "blocked", 1))
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold alone, whose blocks SQL can walk through: long blocks stay whole."""
    chunks = chunking.chunk_documents(E.ocr_pages(spark, sf_dir), hard_limit=False)
    return chunks.select("version_id", "page_number", "chunk_index", "section_title", "content", "token_count")


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(E.ocr_pages(spark, sf_dir))


@query()
def enforce_hard_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as single unbroken lines, which only the hard limit cuts."""
    rows = E.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.enforce_hard_limit(T.trim_all(F.regexp_replace("text", r"\n", " ")))).alias("pos", "piece"))
    return rows.withColumn("token_count", T.estimate_tokens(F.col("piece")))


@query(oracle("SELECT version_id, page_number, round(avg(confidence), 4) AS page_confidence FROM ocr_blocks GROUP BY ALL", "ocr_blocks"))
def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ocr_blocks(spark, sf_dir).groupBy("version_id", "page_number").agg(F.round(F.avg("confidence"), 4).alias("page_confidence"))


@query(oracle(f"""SELECT version_id, list(lang ORDER BY n DESC, first_page)[1] AS primary_language, array_to_string(list(lang ORDER BY n DESC, first_page)[2:], ',') AS secondary_languages
FROM (SELECT version_id, lang, count(*) AS n, min(page_number) AS first_page FROM (SELECT version_id, page_number, CASE WHEN page_number % 3 = 2 THEN lang ELSE {language_sql('raw_text')} END AS lang FROM ocr_pages) WHERE lang <> 'unknown' GROUP BY ALL) GROUP BY version_id""", "ocr_pages"))
def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = E.ocr_pages(spark, sf_dir).withColumn("lang", F.when(F.col("page_number") % 3 == 2, F.col("lang")).otherwise(T.script_language(F.col("raw_text"))))
    votes = pages.where("lang <> 'unknown'").groupBy("version_id", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("page_number").alias("first_page"))
    ranked = votes.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first_page", "lang"))).alias("v"))
    langs = F.transform("v", lambda x: x["lang"])
    return ranked.select("version_id", langs[0].alias("primary_language"), F.array_join(F.slice(langs, F.lit(2), F.size(langs)), ",").alias("secondary_languages"))


@query(oracle(CHUNKS_SQL + f", c AS (SELECT version_id, {tokens_sql(words_sql('content'))} AS t FROM (SELECT version_id, {trim_sql('content')} AS content FROM raw) WHERE length(content) >= 20) SELECT doc_id AS version_id, count(t) AS chunk_count, CAST(floor(coalesce(avg(t), 0) + 0.5) AS INTEGER) AS average_tokens, count(t) = 0 AS no_chunks FROM documents LEFT JOIN c ON version_id = doc_id GROUP BY doc_id", "ocr_pages").replace("WITH ocr_pages", "WITH RECURSIVE ocr_pages", 1).replace("RECURSIVE blocked", "blocked", 1))
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the fold alone, as in ``chunk_pages``; ``chunk_document_stats`` counts the chunks cut by the hard limit."""
    return _chunk_stats(spark, sf_dir, hard_limit=False)


@query()
def chunk_document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and mean tokens of the chunks of ``chunk_documents``, of every document."""
    return _chunk_stats(spark, sf_dir, hard_limit=True)


def _chunk_stats(spark: SparkSession, sf_dir: str, hard_limit: bool) -> DataFrame:
    chunks = chunking.chunk_pages(E.ocr_pages(spark, sf_dir), hard_limit=hard_limit)
    per = chunks.groupBy("version_id").agg(F.count(F.lit(1)).alias("n"), F.avg("token_count").alias("avg"))
    docs = E.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(per, F.col("id") == F.col("version_id"), "left")
    return docs.select(F.col("id").alias("version_id"), F.coalesce("n", F.lit(0)).alias("chunk_count"), F.floor(F.coalesce("avg", F.lit(0)) + 0.5).cast("int").alias("average_tokens"), F.col("n").isNull().alias("no_chunks"))


@query("SELECT doc_id, sha256('m1' || chr(0) || text) AS content_key, min(doc_id) OVER (PARTITION BY text) AS embed_with, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS embeds FROM documents")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct text is embedded once: by its document of the smallest id. Only hashes are shuffled, hot ones aren't."""
    rows = E.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.lit("m1\0"), "text"), 256).alias("content_key"))
    first = rows.groupBy("content_key").agg(F.min("doc_id").alias("embed_with"), F.count(F.lit(1)).alias("n"))
    total = E.table(spark, sf_dir, "documents").count()
    return join_by_hot_key(rows, first, "content_key", total).select("doc_id", "content_key", "embed_with", (F.col("doc_id") == F.col("embed_with")).alias("embeds"))


LAYER_SQL = r"""list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') || '<', '>([^<]+)<', 1), lambda p: trim(regexp_replace(p, '[\x20\t\n\r]+', ' ', 'g'))), lambda p: p <> '')"""
#: Confidence of a block and of a page that come from a text layer (fixed values).
LAYER_BLOCK, LAYER_PAGE = 0.99, 0.98


def layer_items(html: Column) -> Column:
    """The runs of text between tags, in order, without scripts, styles and comments."""
    plain = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), r"(?s)<!--.*?-->", "")
    runs = F.regexp_extract_all(F.concat(plain, F.lit("<")), F.lit(">([^<]+)<"), 1)
    return F.filter(F.transform(runs, lambda p: F.trim(F.regexp_replace(p, r"[\x20\t\n\r]+", " "))), lambda p: p != "")


@query(f"SELECT page_id, array_to_string({LAYER_SQL}, ' ') AS page_text FROM pages")
def page_text_from_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table(spark, sf_dir, "pages").select("page_id", F.array_join(layer_items(F.col("html")), " ").alias("page_text"))


@query(f"""SELECT page_id, i - 1 AS block_order, i AS reading_order, items[i] AS block_text, 0.99 AS confidence, 0.98 AS page_confidence FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i FROM (SELECT page_id, {LAYER_SQL} AS items FROM pages))""")
def page_blocks_from_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per run of a page's text layer, and the confidence that such pages have; pages without text have none."""
    rows = E.table(spark, sf_dir, "pages").select("page_id", F.posexplode(layer_items(F.col("html"))).alias("block_order", "block_text"))
    return rows.select("page_id", "block_order", (F.col("block_order") + 1).alias("reading_order"), "block_text", F.lit(LAYER_BLOCK).alias("confidence"), F.lit(LAYER_PAGE).alias("page_confidence"))


@query("SELECT doc_id, length(replace(text || chr(65), 'A', '')) AS kept_chars, text AS clean FROM documents")
def strip_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rough = F.concat("text", F.lit("\0"))
    clean = F.regexp_replace(rough, "\\x00", "")
    return E.table(spark, sf_dir, "documents").select("doc_id", F.length(F.translate(F.concat(clean, F.lit("A")), "A", "")).alias("kept_chars"), clean.alias("clean"))
