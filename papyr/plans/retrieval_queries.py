"""Retrieval and question-answering jobs, with their SQL. The queries are the benchmark's passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyr.functions.text import query_language
from papyr.operators import retrieval as R
from papyr.operators.fulltext import english_ranks, english_topk
from papyr.plans.text_queries import SP, trim_sql
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


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


TERMS = f"""q AS (SELECT query_id, {trim_sql('query')} AS query, list_filter(list_transform(regexp_split_to_array({trim_sql('query')}, '[{SP}]+'), lambda w: regexp_replace(w, '[''":*&|!()\\\\]', '', 'g')), lambda w: length(w) >= 2) AS kept FROM search_queries WHERE {trim_sql('query')} <> ''
), terms AS (SELECT query_id, query, CASE WHEN len(kept) > 0 THEN kept ELSE [query] END AS terms FROM q)"""
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
LEXICAL = f"""{TERMS}, places AS (SELECT DISTINCT doc_id, token, least(pos, 16383) AS pos FROM (SELECT doc_id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents))),
wanted AS (SELECT DISTINCT query_id, unnest({_WORDS.format('query')}) AS token FROM terms), needed AS (SELECT query_id, count(*) AS n FROM wanted GROUP BY query_id),
near AS (SELECT query_id, doc_id, token, pos FROM wanted JOIN places USING (token) QUALIFY row_number() OVER (PARTITION BY query_id, doc_id, token ORDER BY pos) <= 256),
whole AS (SELECT query_id, doc_id, any_value(n) AS n FROM near JOIN needed USING (query_id) GROUP BY query_id, doc_id HAVING count(DISTINCT token) = any_value(n)),
one AS (SELECT query_id, doc_id, sum(0.1 / k / k) / 1.64493406685 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS k FROM near JOIN whole USING (query_id, doc_id) WHERE n = 1) GROUP BY query_id, doc_id),
several AS (SELECT query_id, doc_id, 1 - exp(sum(ln(1 - 0.1 * sqrt(CASE WHEN d > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(d / 1.5 - 2)) END)))) AS rank FROM (SELECT a.query_id, a.doc_id, abs(a.pos - b.pos) AS d FROM near a JOIN whole USING (query_id, doc_id) JOIN near b ON b.query_id = a.query_id AND b.doc_id = a.doc_id AND b.token < a.token WHERE n > 1) WHERE d > 0 GROUP BY query_id, doc_id),
ranks AS (SELECT query_id, doc_id AS chunk_id, coalesce(one.rank, several.rank, 1e-20) AS text_rank FROM whole LEFT JOIN one USING (query_id, doc_id) LEFT JOIN several USING (query_id, doc_id)),
held AS (SELECT query_id, chunk_id, contains(low, lower(query)) AS holds, 0.10 + 0.35 * (len(list_filter(terms, lambda w: contains(low, lower(w)))) / greatest(len(terms), 1)) AS share, len(list_filter(terms, lambda w: length(w) >= 3 AND contains(low, lower(w)))) > 0 AS long
  FROM terms, (SELECT doc_id AS chunk_id, lower(text) AS low FROM documents)),
scored AS (SELECT query_id, chunk_id, holds, floor(share * 10000 + 0.5) / 10000 AS partial_score, floor(greatest(CASE WHEN holds THEN 0.95 ELSE 0.0 END, 1.5 * coalesce(text_rank, 0), share) * 10000 + 0.5) / 10000 AS keyword_score
  FROM held LEFT JOIN ranks USING (query_id, chunk_id) WHERE holds OR long OR text_rank IS NOT NULL)"""


def _top(rows: str, score: str, k: int, columns: str = "*") -> str:
    return f"SELECT * FROM (SELECT {columns}, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, chunk_id) AS INTEGER) AS rank FROM {rows}) WHERE rank <= {k}"


@query(oracle(f"WITH {TERMS} SELECT query_id, array_to_string(terms, '|') AS terms FROM terms", "search_queries"))
def tokenize_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.search_queries(spark, sf_dir).select("query_id", F.array_join(R.query_terms(F.col("query")), "|").alias("terms"))


@query(oracle(f"WITH {LEXICAL} SELECT query_id, chunk_id, round(text_rank, 5) AS text_rank FROM ranks", "search_queries"))
def text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full-text rank, without stemming, of the chunks that have all words of a query."""
    found = R.text_ranks(_chunks(spark, sf_dir), E.search_queries(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("text_rank", 5).alias("text_rank"))


@query(oracle(f"WITH {LEXICAL} SELECT query_id, chunk_id, keyword_score FROM scored", "search_queries"))
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_scores(_chunks(spark, sf_dir), E.search_queries(spark, sf_dir))


@query(oracle(f"WITH {LEXICAL} {_top('scored', 'keyword_score', 10, 'query_id, chunk_id, keyword_score')}", "search_queries"))
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_topk(_chunks(spark, sf_dir), E.search_queries(spark, sf_dir), 10)


@query()
def keyword_topk_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of ``keyword_topk`` for the passages whole, of which the stated queries are the first 60 characters."""
    return R.keyword_topk(_chunks(spark, sf_dir), E.full_text_queries(spark, sf_dir), 10)


@query()
def text_rank_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English full-text rank, stemmed and without stop words, of the chunks that have all words of a passage."""
    found = english_ranks(_chunks(spark, sf_dir), E.full_text_queries(spark, sf_dir))
    return found.select("query_id", "chunk_id", F.round("plain_rank", 5).alias("text_rank"))


@query()
def keyword_score_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole keyword scores, English ranks of plain and web syntax among them, of all chunks that qualify for a query in web syntax."""
    return english_topk(_chunks(spark, sf_dir), E.web_queries(spark, sf_dir), None).select("query_id", "chunk_id", F.round("web_rank", 5).alias("web_rank"), "partial_score", "keyword_score")


@query()
def keyword_topk_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of each passage, whole, by the English keyword score."""
    return english_topk(_chunks(spark, sf_dir), E.full_text_queries(spark, sf_dir), 10).select("query_id", "chunk_id", "keyword_score", "rank")


@query()
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keyword_topk(spark, sf_dir).join(E.search_queries(spark, sf_dir), "query_id").join(_chunks(spark, sf_dir), "chunk_id")
    return found.select("query_id", "chunk_id", R.snippet(F.col("content"), F.col("query")).alias("snippet"))


@query("""WITH b AS (SELECT item_id, lower(trim(text)) AS t FROM benchmark), u AS (SELECT item_id, t, unnest(range(1, length(t) + 1)) AS i FROM b),
 p AS (SELECT item_id, (ascii(substr(t, i, 1)) * 31 + i - 1) % 64 AS slot, 1.0 AS w FROM u UNION ALL
       SELECT item_id, (ascii(substr(t, i, 1)) * 961 + ascii(substr(t, i + 1, 1)) * 31 + ascii(substr(t, i + 2, 1))) % 64, 2.0 FROM u WHERE i + 2 <= length(t)),
 s AS (SELECT item_id, slot, sum(w) AS w FROM p GROUP BY ALL)
 SELECT item_id, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 4) AS value FROM s""")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(R.hash_embed_column(F.col("text"))).alias("slot", "value"))
    return rows.where("value > 0").select("item_id", F.col("slot").cast("long"), F.round(F.col("value").cast("double"), 4).alias("value"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = E.documents_meta(spark, sf_dir).where("not is_deleted").select("document_id", (F.col("user_id") % 7).alias("user_id"))
    return E.embeddings(spark, sf_dir).join(owned, "document_id").select("user_id", "model", "chunk_id", "embedding")


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth vector asks for its like among the live documents of its user group."""
    return _vectors(spark, sf_dir).where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), "user_id", "model", F.col("embedding").alias("vector"))


VECTORS = """vectors AS (SELECT d.user_id % 7 AS user_id, model, chunk_id, CAST(embedding AS DOUBLE[]) AS v FROM doc_embeddings JOIN documents_meta d USING (document_id) WHERE NOT is_deleted
), nearest AS (SELECT a.chunk_id AS query_id, b.chunk_id, round(greatest(list_cosine_similarity(a.v, b.v), 0), 4) AS semantic_score FROM vectors a JOIN vectors b ON a.user_id = b.user_id AND a.model = b.model WHERE a.chunk_id % 10 = 0)"""


@query(oracle(f"WITH {VECTORS} {_top('nearest', 'semantic_score', 10)}", "doc_embeddings", "documents_meta"))
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.semantic_topk(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 10)


@query(oracle(f"WITH {VECTORS} SELECT query_id, chunk_id, round(semantic_score / greatest(max(semantic_score) OVER (PARTITION BY query_id), 0.001), 4) AS normal FROM ({_top('nearest', 'semantic_score', 10)})", "doc_embeddings", "documents_meta"))
def score_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.greatest(F.max("semantic_score").over(Window.partitionBy("query_id")), F.lit(0.001))
    return semantic_topk(spark, sf_dir).select("query_id", "chunk_id", F.round(F.col("semantic_score") / most, 4).alias("normal"))


@query(oracle("SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(greatest(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 4) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "doc_embeddings"))
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = E.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = E.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).select("a_id", "b_id", F.round(F.greatest(R.cosine(F.col("a"), F.col("b")), F.lit(0.0)), 4).alias("similarity"))


#: Hash vectors of texts and queries, and their likeness.
HASHED = f"""source AS (SELECT 'd' AS kind, doc_id AS id, string_split({trim_sql('lower(text)')}, '') AS c FROM documents UNION ALL SELECT 'q', query_id, string_split({trim_sql('lower(query)')}, '') FROM search_queries),
marks AS (SELECT kind, id, unnest(list_transform(range(1, len(c) + 1), lambda i: (ascii(c[i]) * 31 + i - 1) % 64)) AS slot, 1.0 AS w FROM source
  UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(c) - 1), lambda i: (ascii(c[i]) * 961 + ascii(c[i + 1]) * 31 + ascii(c[i + 2])) % 64)), 2.0 FROM source),
summed AS (SELECT kind, id, slot, CAST(sum(w) AS DOUBLE) AS w FROM marks GROUP BY ALL), lengths AS (SELECT kind, id, sqrt(sum(w * w)) AS n FROM summed GROUP BY ALL),
hashed AS (SELECT kind, id, list(CAST(CAST(coalesce(w, 0) / n AS FLOAT) AS DOUBLE) ORDER BY slot) AS v FROM lengths CROSS JOIN range(64) r(slot) LEFT JOIN summed USING (kind, id, slot) GROUP BY ALL),
likeness AS (SELECT q.id AS query_id, d.id AS chunk_id, round(greatest(list_cosine_similarity(q.v, d.v), 0), 4) AS semantic_score FROM hashed q, hashed d WHERE q.kind = 'q' AND d.kind = 'd')"""


def _hybrid(k: int, name: str) -> str:
    """Candidates, twice as many as are wanted, and their blend, as tables named after ``name``."""
    return f"""{name}_near AS ({_top('likeness', 'semantic_score', 2 * k)}), {name}_words AS ({_top('scored', 'keyword_score', 2 * k, 'query_id, chunk_id, keyword_score')}), {name} AS (SELECT query_id, chunk_id, coalesce(round(s, 4), 0.0) AS semantic_score, coalesce(round(w, 4), 0.0) AS keyword_score,
  round(CASE WHEN s IS NOT NULL AND w IS NOT NULL THEN round(s, 4) * 0.6 + w * 0.4 WHEN s IS NOT NULL THEN s * 0.6 ELSE w * 0.4 END, 4) AS final_score
  FROM (SELECT query_id, chunk_id, semantic_score / greatest(max(semantic_score) OVER (PARTITION BY query_id), 0.001) AS s FROM {name}_near) FULL JOIN (SELECT query_id, chunk_id, keyword_score / greatest(max(keyword_score) OVER (PARTITION BY query_id), 0.001) AS w FROM {name}_words) USING (query_id, chunk_id))"""


@query(oracle(f"WITH {LEXICAL}, {HASHED}, {_hybrid(10, 'blend')} {_top('blend', 'final_score', 10)}", "search_queries"))
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash vectors and terms of the benchmark's passages over all documents: 20 candidates each, the best 10."""
    return R.hybrid_topk(_chunks(spark, sf_dir), E.search_queries(spark, sf_dir), 10)


def _text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of ``_vector_queries`` as words: the opening of the document that each vector is of."""
    asked = _vector_queries(spark, sf_dir).select("query_id")
    return asked.join(_chunks(spark, sf_dir), F.col("chunk_id") == F.col("query_id")).select("query_id", F.substring("content", 1, 60).alias("query"))


_ASKED = "search_queries AS (SELECT doc_id AS query_id, substr(text, 1, 60) AS query FROM documents WHERE doc_id IN (SELECT chunk_id FROM vectors WHERE chunk_id % 10 = 0))"
_CANDIDATES = f"{VECTORS}, {_ASKED}, {LEXICAL}, near20 AS ({_top('nearest', 'semantic_score', 20)}), lexk AS ({_top('scored', 'keyword_score', 20, 'query_id, chunk_id, keyword_score')})"


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Semantic candidates by the vectors and lexical ones by the words of the same queries, 20 each."""
    lexical = R.keyword_topk(_chunks(spark, sf_dir), _text_queries(spark, sf_dir), 20)
    return R.semantic_topk(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 20), lexical


@query(oracle(f"""WITH {_CANDIDATES}, fused AS (SELECT query_id, chunk_id, coalesce(round(s, 4), 0.0) AS semantic_score, coalesce(round(w, 4), 0.0) AS keyword_score,
  round(CASE WHEN s IS NOT NULL AND w IS NOT NULL THEN round(s, 4) * 0.6 + w * 0.4 WHEN s IS NOT NULL THEN s * 0.6 ELSE w * 0.4 END, 4) AS final_score
  FROM (SELECT query_id, chunk_id, semantic_score / greatest(max(semantic_score) OVER (PARTITION BY query_id), 0.001) AS s FROM near20) FULL JOIN (SELECT query_id, chunk_id, keyword_score / greatest(max(keyword_score) OVER (PARTITION BY query_id), 0.001) AS w FROM lexk) USING (query_id, chunk_id)) {_top('fused', 'final_score', 10)}""", "doc_embeddings", "documents_meta"))
def fuse_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(*_candidates(spark, sf_dir), 10)


@query(oracle(f"WITH {_CANDIDATES} SELECT query_id, chunk_id, semantic_score, keyword_score FROM near20 FULL JOIN lexk USING (query_id, chunk_id)", "doc_embeddings", "documents_meta"))
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    semantic, lexical = _candidates(spark, sf_dir)
    return semantic.drop("rank").join(lexical.drop("rank"), ["query_id", "chunk_id"], "full_outer")


@query(oracle("SELECT chunk_id, document_id, user_id, title, category, model FROM doc_embeddings JOIN documents_meta USING (document_id) WHERE NOT is_deleted", "doc_embeddings", "documents_meta"))
def corpus_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = E.documents_meta(spark, sf_dir).where("not is_deleted")
    return E.embeddings(spark, sf_dir).join(live, "document_id").select("chunk_id", "document_id", "user_id", "title", "category", "model")


@query(oracle("SELECT d.user_id, model, count(*) AS vectors FROM doc_embeddings JOIN documents_meta d USING (document_id) WHERE NOT is_deleted AND d.user_id NOT IN (SELECT d.user_id FROM doc_embeddings JOIN documents_meta d USING (document_id) WHERE NOT is_deleted AND model = 'm1') GROUP BY ALL", "doc_embeddings", "documents_meta"))
def model_mismatch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose queries under model m1 find nothing although they hold vectors of other models."""
    owned = corpus_join(spark, sf_dir).select("user_id", "model")
    return owned.join(owned.where("model = 'm1'").select("user_id").distinct(), "user_id", "left_anti").groupBy("user_id", "model").agg(F.count(F.lit(1)).alias("vectors"))


@query(oracle(f"""WITH {LEXICAL}, {HASHED}, {_hybrid(5, 'blend')}, answers AS (SELECT query_id, 'hybrid' AS mode, chunk_id, final_score AS score FROM blend WHERE query_id % 3 = 0 UNION ALL SELECT query_id, 'semantic', chunk_id, semantic_score FROM likeness WHERE query_id % 3 = 1
  UNION ALL SELECT query_id, 'keyword', chunk_id, keyword_score FROM scored WHERE query_id % 3 = 2), best AS ({_top('answers', 'score', 5)}) SELECT *, count(*) OVER (PARTITION BY query_id) AS total_results FROM best""", "search_queries"))
def search_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's mode picks its ranking: hybrid, semantic or keyword; with the number of results that it got."""
    asked = E.search_queries(spark, sf_dir).withColumn("mode", F.get(F.array(*map(F.lit, ("hybrid", "semantic", "keyword"))), (F.col("query_id") % 3).cast("int")))
    return dispatch(_chunks(spark, sf_dir), asked, 5)


def dispatch(chunks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, query, mode) -> query_id, mode, chunk_id, score, rank, total_results: at most ``k`` chunks a query."""
    both = R.hybrid_topk(chunks, asked.where("mode = 'hybrid'"), k).select("query_id", "chunk_id", F.col("final_score").alias("score"), "rank")
    near = R.text_semantic_topk(chunks, asked.where("mode = 'semantic'"), k).select("query_id", "chunk_id", F.col("semantic_score").alias("score"), "rank")
    words = R.keyword_topk(chunks, asked.where("mode = 'keyword'"), k).select("query_id", "chunk_id", F.col("keyword_score").alias("score"), "rank")
    rows = both.unionByName(near).unionByName(words).join(asked.select("query_id", "mode"), "query_id")
    return rows.withColumn("total_results", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).select("query_id", "mode", "chunk_id", "score", "rank", "total_results")


_ANSWER = "'See [Source ' || (conv_id % 4 + 1) || ', p. 2] and 【Source 1】.' || chr(10) || CASE WHEN conv_id % 5 = 0 THEN 'Source 3 too' ELSE '[source 2]' END"


@query(f"SELECT conv_id, turn, array_to_string(list_distinct_in_order, ',') AS cited FROM (SELECT conv_id, turn, list_transform(list_sort(list_transform(list_distinct(n), lambda x: list_position(n, x))), lambda p: n[p]) AS list_distinct_in_order FROM (SELECT conv_id, turn, list_transform(regexp_extract_all({_ANSWER}, '(?i)[\\[【]?Source\\s*(\\d+)[^\\]】\\n]*[\\]】]?', 1), lambda x: CAST(x AS INTEGER)) AS n FROM conversations WHERE role = 'assistant'))")
def citation_first_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers are made from the conversation's number: bracketed, lenticular and bare source marks."""
    k = F.col("conv_id")
    answer = F.concat(F.lit("See [Source "), (k % 4 + 1).cast("string"), F.lit(", p. 2] and 【Source 1】.\n"), F.when(k % 5 == 0, "Source 3 too").otherwise("[source 2]"))
    rows = E.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.array_join(R.cited_sources(answer), ",").alias("cited"))


@query(oracle(f"""WITH {LEXICAL}, ranked AS ({_top('scored', 'keyword_score', 8, 'query_id, chunk_id, keyword_score')}), lines AS (SELECT query_id, string_agg('[Source ' || rank || ': ' || coalesce(title, 'Document') || ', Page ' || (chunk_id % 9 + 1) || ',' || CASE WHEN chunk_id % 2 = 0 THEN ' Section: S' || (chunk_id % 5) || ',' ELSE '' END || ' Category: ' || coalesce(category, 'General') || ']' || chr(10) || replace(text, '**', ''), chr(10) || chr(10) ORDER BY rank) AS context
FROM ranked JOIN documents ON doc_id = chunk_id LEFT JOIN documents_meta ON document_id = chunk_id GROUP BY query_id) SELECT q.query_id, coalesce(context, 'No relevant document context found.') AS context FROM search_queries q LEFT JOIN lines USING (query_id)""", "search_queries", "documents_meta"))
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt context of each query from its eight best chunks."""
    asked = E.search_queries(spark, sf_dir)
    ranked = R.keyword_topk(_chunks(spark, sf_dir), asked, 8)
    return R.build_context(asked, ranked, _titled_chunks(spark, sf_dir))


def _titled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with what a context line says of them: title, page, section (every other has one), category."""
    key = F.col("chunk_id")
    meta = E.documents_meta(spark, sf_dir).select(F.col("document_id").alias("chunk_id"), "title", "category")
    section = F.when(key % 2 == 0, F.concat(F.lit("S"), (key % 5).cast("string")))
    return _chunks(spark, sf_dir).join(meta, "chunk_id", "left").select("chunk_id", F.coalesce("title", F.lit("Document")).alias("title"), (key % 9 + 1).alias("page"), section.alias("section"), "category", "content")


@query(oracle("SELECT conversation_id, turn, (SELECT string_agg(m.role || ': ' || m.content, chr(10) ORDER BY m.turn) FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS n FROM messages) m WHERE m.conversation_id = q.conversation_id AND m.n < q.n AND m.n >= q.n - 6) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS n FROM messages) q WHERE role = 'USER'", "messages"))
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six messages before each question, oldest first; null before the first."""
    window = Window.partitionBy("conversation_id").orderBy("turn").rowsBetween(-6, -1)
    rows = E.messages(spark, sf_dir).withColumn("h", F.collect_list(F.concat("role", F.lit(": "), "content")).over(window))
    return rows.where("role = 'USER'").select("conversation_id", "turn", F.when(F.size("h") > 0, F.array_join("h", "\n")).alias("history"))


@query()
def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per question: language, instruction, history, context and question, as the input of a model run elsewhere."""
    asked = E.messages(spark, sf_dir).where("role = 'USER'").withColumn("language", query_language(F.col("content")))
    questions = asked.select(F.struct("conversation_id", "turn").alias("id"), "content").select(F.to_json("id").alias("query_id"), F.col("content").alias("query"))
    ranked = english_topk(_chunks(spark, sf_dir), questions, 5).select("query_id", "chunk_id", "keyword_score", "rank")
    context = R.build_context(questions, ranked, _titled_chunks(spark, sf_dir))
    rows = asked.join(chat_history(spark, sf_dir), ["conversation_id", "turn"]).withColumn("query_id", F.to_json(F.struct("conversation_id", "turn"))).join(context, "query_id")
    instruction = F.when(F.col("language") == "hi", "Answer in Hindi and cite the sources.").otherwise("Answer in English and cite the sources.")
    return rows.select("conversation_id", "turn", "language", instruction.alias("system"), "history", "context", F.col("content").alias("question"))


@query("SELECT doc_id, substr(text, 1, 2500) AS for_classification, substr(text, 1, 16000) AS for_extraction FROM documents")
def text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two budgets of the batch prompts: a feature of the prompt table, not of the corpus."""
    return E.table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 2500).alias("for_classification"), F.substring("text", 1, 16000).alias("for_extraction"))
