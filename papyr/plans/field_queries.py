"""Field-quality jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.functions import fields as P
from papyr.operators import field_quality as Y
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


def _map(values: dict) -> str:
    return "map([" + ", ".join(f"'{k}'" for k in values) + "], [" + ", ".join(map(str, values.values())) + "])"


def _made(y: str, m: str, d: str) -> str:
    return f"CASE WHEN {y} >= '1000' AND length({y}) = 4 AND {d} <> '' THEN TRY_CAST({y} || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) END"


def date_sql(x: str) -> str:
    t = trim_sql(f"coalesce({x}, '')")
    plain = trim_sql(rf"regexp_replace(regexp_replace(regexp_replace({t}, '(?i)(\d{{1,2}})(st|nd|rd|th)\b', '\1', 'g'), '(?i)\bof\b', ' ', 'g'), '[{SP}]+', ' ', 'g')")

    def g(pattern: str, i: int, of: str = t) -> str:
        return f"regexp_extract({of}, '{pattern}', {i})"

    dmy, ymd = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", r"^(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})$"
    nat, usa = r"^(\d{1,2}) ([a-zA-Z]+) (\d{4})$", r"^([a-zA-Z]+)\.? (\d{1,2}),? (\d{4})$"
    hindi = "CASE " + " ".join(f"WHEN contains({t}, '{k}') THEN {v}" for k, v in P.HINDI_MONTHS.items()) + " END"
    return "coalesce(" + ", ".join([
        _made(g(dmy, 3), g(dmy, 2), g(dmy, 1)), _made(g(ymd, 1), g(ymd, 2), g(ymd, 3)),
        _made(g(nat, 3, plain), f"{_map(P.ENGLISH_MONTHS)}[lower({g(nat, 2, plain)})]", g(nat, 1, plain)),
        _made(g(usa, 3, plain), f"{_map(P.ENGLISH_MONTHS)}[lower({g(usa, 1, plain)})]", g(usa, 2, plain)),
        _made(g(r"(\d{1,2})\D+(\d{4})", 2), hindi, g(r"(\d{1,2})\D+(\d{4})", 1)),
    ]) + ")"


def amount_sql(x: str) -> str:
    t = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '{P.CURRENCY_MARKS}', '', 'g'), '[{SP},]', '', 'g'), '/-$', ''), '\\.$', '')"
    inner = rf"regexp_replace({t}, '^\((.*)\)$', '\1')"
    digits = f"regexp_replace({inner}, '^[-+]', '')"
    number = rf"CASE WHEN regexp_matches({digits}, '^\d+(\.\d+)?$') THEN TRY_CAST({digits} AS DOUBLE) END"
    return rf"CASE WHEN regexp_matches({t}, '^\(.*\)$') OR starts_with({inner}, '-') THEN -({number}) ELSE {number} END"


def band_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 0.85 THEN 'HIGH' WHEN {x} >= 0.65 THEN 'MEDIUM' ELSE 'LOW' END"


def token_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(upper({trim_sql(f'coalesce({x}, chr(32))')}), '[{SP}-]+', '_', 'g'), '[^A-Z0-9_]', '', 'g')"


def type_sql(raw: str, name: str) -> str:
    cases = [f"WHEN {token_sql(raw)} IN ({', '.join(map(repr, P.FIELD_TYPES))}) THEN {token_sql(raw)}"]
    cases += [f"WHEN {token_sql(raw)} = '{a}' THEN '{k}'" for a, k in P.TYPE_ALIASES.items()]
    cases += [f"WHEN regexp_matches(lower({name}), '{p}') THEN '{k}'" for p, k in P.TYPE_BY_NAME]
    return f"CASE {' '.join(cases)} ELSE 'TEXT' END"


_GST = f"regexp_matches(upper({trim_sql('raw_value')}), '{P.GSTIN}')"
_LOOKS = f"regexp_matches(upper({trim_sql('raw_value')}), '{P.LOOKS_LIKE_GSTIN}')"
VALIDATED = f"""parsed AS (SELECT *, CASE WHEN field_type = 'DATE' THEN {date_sql('raw_value')} END AS parsed_date, CASE WHEN field_type = 'CURRENCY' THEN {amount_sql('raw_value')} END AS amount
  FROM {{src}} WHERE NOT is_rejected
), validated AS (SELECT document_id, field_name, field_type, raw_value, is_verified, is_rejected, parsed_date, amount, round(least(greatest(CASE
    WHEN field_type = 'DATE' THEN CASE WHEN parsed_date IS NULL THEN least(confidence, 0.40) ELSE confidence END
    WHEN field_type = 'CURRENCY' THEN CASE WHEN amount IS NULL THEN least(confidence, 0.40) WHEN amount < 0 THEN greatest(0.1, confidence - 0.25) WHEN amount > 100000000 THEN least(confidence, 0.60) ELSE confidence END
    WHEN field_type = 'ID_NUMBER' OR contains(field_name, 'gstin') THEN CASE WHEN {_LOOKS} AND {_GST} THEN least(1.0, confidence + 0.1) WHEN {_LOOKS} THEN least(confidence, 0.30) ELSE confidence END
    ELSE confidence END, 0.0), 1.0), 9) AS confidence,
    CASE WHEN field_type = 'DATE' THEN CAST(parsed_date AS VARCHAR) WHEN field_type = 'CURRENCY' THEN CAST(CAST(amount AS DECIMAL(20,2)) AS VARCHAR) WHEN {_GST} THEN upper({trim_sql('raw_value')}) END AS normalized_value FROM parsed
)"""
LATE = """late AS (SELECT document_id, CASE WHEN deadline IS NOT NULL THEN 'deadline' WHEN due IS NOT NULL THEN 'payment_due_date' ELSE 'expiry_date' END AS target FROM (
  SELECT document_id, max(parsed_date) FILTER (field_name = 'deadline') AS deadline, max(parsed_date) FILTER (field_name = 'payment_due_date') AS due, max(parsed_date) FILTER (field_name = 'expiry_date') AS expiry,
    max(parsed_date) FILTER (field_name = 'issue_date') AS issued, max(parsed_date) FILTER (field_name = 'invoice_date') AS invoiced, max(parsed_date) FILTER (field_name = 'date') AS dated FROM validated GROUP BY document_id)
  WHERE coalesce(deadline, due, expiry) < coalesce(issued, invoiced, dated))"""
MATH = """sums AS (SELECT * FROM (SELECT document_id, max(amount) FILTER (field_name = 'subtotal') AS subtotal, max(amount) FILTER (field_name = 'tax_amount') AS tax_amount, max(amount) FILTER (field_name = 'total_amount') AS total_amount FROM validated GROUP BY document_id)
  WHERE abs(subtotal + tax_amount - total_amount) > total_amount * 0.05 AND abs(subtotal + tax_amount - total_amount) > 5)"""
CHECKED = f"checked AS (SELECT v.* REPLACE (round(CASE WHEN l.document_id IS NOT NULL THEN 0.35 WHEN s.document_id IS NOT NULL THEN 0.45 ELSE confidence END, 9) AS confidence) FROM validated v LEFT JOIN late l ON l.document_id = v.document_id AND l.target = v.field_name LEFT JOIN sums s ON s.document_id = v.document_id AND v.field_name IN ('total_amount', 'tax_amount'))"


def _validated(src: str = "fields") -> str:
    return VALIDATED.replace("{src}", src)


@query(oracle(f"SELECT document_id, field_name, raw_value, CAST({date_sql('raw_value')} AS VARCHAR) AS parsed FROM fields WHERE field_type = 'DATE'", "fields"))
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fields(spark, sf_dir, "DATE").select("document_id", "field_name", "raw_value", P.parse_date(F.col("raw_value")).cast("string").alias("parsed"))


@query(oracle(f"SELECT document_id, field_name, raw_value, {amount_sql('raw_value')} AS amount FROM fields WHERE field_type = 'CURRENCY'", "fields"))
def parse_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fields(spark, sf_dir, "CURRENCY").select("document_id", "field_name", "raw_value", P.parse_amount(F.col("raw_value")).alias("amount"))


@query(oracle(f"SELECT document_id, raw_value, {_LOOKS} AS looks_like, {_GST} AS valid FROM fields WHERE field_name = 'gstin'", "fields"))
def validate_gstin(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw_value")
    return E.fields(spark, sf_dir, "ID_NUMBER").select("document_id", "raw_value", P.looks_like_gstin(raw).alias("looks_like"), P.is_gstin(raw).alias("valid"))


@query(oracle(f"SELECT document_id, field_name, {band_sql('confidence')} AS confidence_level FROM fields", "fields"))
def confidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fields(spark, sf_dir).select("document_id", "field_name", P.confidence_band(F.col("confidence")).alias("confidence_level"))


@query(oracle(f"WITH {_validated()} SELECT document_id, field_name, normalized_value, confidence, {band_sql('confidence')} AS confidence_level FROM validated", "fields"))
def validate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.validate_fields(E.fields(spark, sf_dir)).select("document_id", "field_name", "normalized_value", "confidence", "confidence_level")


@query(oracle(f"WITH {_validated()}, {LATE} SELECT document_id, target FROM late", "fields"))
def check_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.chronology_conflicts(Y.validate_fields(E.fields(spark, sf_dir)))


@query(oracle(f"WITH {_validated()}, {MATH} SELECT document_id, subtotal, tax_amount, total_amount FROM sums", "fields"))
def check_invoice_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.invoice_conflicts(Y.validate_fields(E.fields(spark, sf_dir)))


def _text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the text documents: the second word of the text, its first 40 characters, a value that isn't there.

    A text is split no further than behind its second word.
    """
    docs = E.table(spark, sf_dir, "documents")
    made = F.array(
        F.struct(F.lit("second_word").alias("n"), F.get(F.split("text", " ", 3), F.lit(1)).alias("v")),
        F.struct(F.lit("opening").alias("n"), F.substring("text", 1, 40).alias("v")),
        F.struct(F.lit("absent").alias("n"), F.lit("~none~").alias("v")),
    )
    rows = docs.select("doc_id", F.explode(made).alias("f"))
    return rows.select(F.col("doc_id").alias("document_id"), F.col("f.n").alias("field_name"), F.col("f.v").alias("raw_value"), ((F.col("doc_id") * 7 % 100) / 100).alias("confidence")).where("raw_value is not null")


_TEXT_FIELDS = "text_fields AS (SELECT * FROM (SELECT doc_id AS document_id, unnest(['second_word', 'opening', 'absent']) AS field_name, unnest([string_split(text, ' ')[2], substr(text, 1, 40), '~none~']) AS raw_value, (doc_id * 7 % 100) / 100 AS confidence FROM documents) WHERE raw_value IS NOT NULL)"
_BEST = f"""best AS (SELECT document_id, field_name, max(b.confidence) AS best_block FROM (SELECT document_id, field_name, lower({trim_sql('raw_value')}) AS v FROM text_fields) f
  JOIN (SELECT version_id, lower({trim_sql('block_text')}) AS b, confidence FROM ocr_blocks) b ON version_id = document_id WHERE length(v) >= 3 AND length(b) >= 3 AND (contains(b, v) OR contains(v, b)) GROUP BY ALL)"""


@query(oracle(f"WITH {_TEXT_FIELDS}, {_BEST} SELECT * FROM best", "ocr_blocks"))
def field_block_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.best_block_confidence(_text_fields(spark, sf_dir), E.ocr_blocks(spark, sf_dir))


@query(oracle(f"WITH {_TEXT_FIELDS}, {_BEST}, s AS (SELECT document_id, field_name, round(CASE WHEN best_block IS NULL THEN confidence ELSE 0.7 * confidence + 0.3 * best_block END, 9) AS confidence FROM text_fields LEFT JOIN best USING (document_id, field_name)) SELECT *, {band_sql('confidence')} AS confidence_level FROM s", "ocr_blocks"))
def score_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _text_fields(spark, sf_dir)
    return Y.score_confidence(rows, Y.best_block_confidence(rows, E.ocr_blocks(spark, sf_dir))).select("document_id", "field_name", "confidence", "confidence_level")


@query(oracle(f"WITH {_validated()}, {LATE}, {MATH}, {CHECKED} SELECT document_id, field_name, normalized_value, confidence, {band_sql('confidence')} AS confidence_level FROM checked", "fields"))
def cross_check_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and cross-checks of the fields as they are."""
    return Y.cross_check(Y.validate_fields(E.fields(spark, sf_dir))).select("document_id", "field_name", "normalized_value", "confidence", "confidence_level")


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new extraction of every document, as a model spells it: names and types out of form, some twice, some blank."""
    k = F.col("document_id")
    kind = F.when(k % 3 == 0, F.lower("field_type")).when(k % 3 == 1, F.lit("weird")).otherwise(F.replace("field_type", F.lit("_"), F.lit(" ")))
    rows = E.fields(spark, sf_dir).select(k, F.concat(F.lit(" "), "field_name").alias("field_name"), kind.alias("field_type"), "raw_value", (F.col("confidence") * 1.3 - 0.1).alias("confidence"), (k % 4 - 0.5).alias("source_page"), F.explode(F.when(k % 6 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("seq"))
    again = F.when(k % 12 == 0, F.lit("  ")).otherwise(F.lit("1,000"))
    return rows.withColumn("raw_value", F.when(F.col("seq") == 1, again).otherwise(F.col("raw_value")))


def _field_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR blocks of the documents: lines that hold a field's value, some of them cut short."""
    k = F.col("document_id")
    text = F.when(k % 2 == 0, F.concat(F.upper("field_name"), F.lit(": "), "raw_value")).otherwise(F.substring("raw_value", 1, 4))
    return E.fields(spark, sf_dir).where(k % 5 != 0).select(k.alias("version_id"), text.alias("block_text"), ((k * 7 + F.length("field_name")) % 100 / 100).alias("confidence"))


_PIPELINE = f"""extracted AS (SELECT document_id, ' ' || field_name AS field_name, CASE document_id % 3 WHEN 0 THEN lower(field_type) WHEN 1 THEN 'weird' ELSE replace(field_type, '_', ' ') END AS field_type, raw_value, confidence * 1.3 - 0.1 AS confidence, document_id % 4 - 0.5 AS source_page, 0 AS seq FROM fields),
raw AS (SELECT * FROM extracted UNION ALL SELECT * REPLACE (CASE WHEN document_id % 12 = 0 THEN '  ' ELSE '1,000' END AS raw_value, 1 AS seq) FROM extracted WHERE document_id % 6 = 0),
blocks AS (SELECT document_id, lower({trim_sql("CASE WHEN document_id % 2 = 0 THEN upper(field_name) || ': ' || raw_value ELSE substr(raw_value, 1, 4) END")}) AS b, (document_id * 7 + length(field_name)) % 100 / 100 AS block_confidence FROM fields WHERE document_id % 5 <> 0),
kept AS (SELECT document_id, field_name, field_type, raw_value, confidence, is_verified, is_rejected FROM fields WHERE is_verified OR is_rejected),
conformed AS (SELECT document_id, {trim_sql('field_name')} AS field_name, {type_sql('field_type', trim_sql('field_name'))} AS field_type, {trim_sql('raw_value')} AS raw_value, least(greatest(coalesce(confidence, 0.85), 0.0), 1.0) AS confidence, seq FROM raw WHERE {trim_sql('raw_value')} <> ''),
fresh AS (SELECT * FROM conformed WHERE (document_id, field_name) NOT IN (SELECT (document_id, field_name) FROM kept) QUALIFY row_number() OVER (PARTITION BY document_id, field_name ORDER BY seq) = 1),
merged AS (SELECT * FROM kept UNION ALL SELECT document_id, field_name, field_type, raw_value, confidence, false, false FROM fresh),
best AS (SELECT document_id, field_name, max(block_confidence) AS best FROM (SELECT document_id, field_name, lower({trim_sql('raw_value')}) AS v FROM merged WHERE NOT is_rejected) JOIN blocks USING (document_id) WHERE length(v) >= 3 AND length(b) >= 3 AND (contains(b, v) OR contains(v, b)) GROUP BY ALL),
rescored AS (SELECT document_id, field_name, field_type, raw_value, is_verified, is_rejected, CASE WHEN is_rejected OR best IS NULL THEN confidence ELSE 0.7 * confidence + 0.3 * best END AS confidence FROM merged LEFT JOIN best USING (document_id, field_name))"""


@query(oracle(f"""WITH {_PIPELINE}, {_validated('rescored')}, {LATE}, {MATH}, everything AS (SELECT document_id, field_name, field_type, normalized_value, confidence, is_rejected FROM validated UNION ALL SELECT document_id, field_name, field_type, NULL, confidence, true FROM rescored WHERE is_rejected),
final AS (SELECT e.* REPLACE (round(CASE WHEN l.document_id IS NOT NULL THEN 0.35 WHEN s.document_id IS NOT NULL THEN 0.45 ELSE confidence END, 9) AS confidence) FROM everything e LEFT JOIN late l ON l.document_id = e.document_id AND l.target = e.field_name LEFT JOIN sums s ON s.document_id = e.document_id AND e.field_name IN ('total_amount', 'tax_amount'))
SELECT document_id, field_name, field_type, normalized_value, confidence, is_rejected, {band_sql('confidence')} AS confidence_level FROM final""", "fields"))
def field_quality_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new extraction of all documents through every step in the order of the platform, rejected fields kept."""
    rows = Y.field_quality_pipeline(E.fields(spark, sf_dir), _extracted(spark, sf_dir), _field_blocks(spark, sf_dir), ["seq"])
    return rows.select("document_id", "field_name", "field_type", "normalized_value", "confidence", "is_rejected", "confidence_level")


def _raw_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey")
    kinds = F.array(*map(F.lit, ["date", " id number", "Money", "string", "weird", "", "bool", "Address"]))
    names = F.array(*map(F.lit, ["due_date", " total_amount ", "pan", "holder", "notes", " ", "postal address"]))
    return E.table(spark, sf_dir, "lineitem").select(
        k.alias("document_id"), F.get(names, ((k + F.col("l_linenumber")) % 7).cast("int")).alias("field_name"), F.get(kinds, (k % 8).cast("int")).alias("field_type"),
        F.when(k % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("l_partkey").cast("string"))).alias("raw_value"),
        F.when(k % 4 == 0, None).otherwise(F.col("l_discount") * 20 - 0.3).alias("confidence"), (F.col("l_quantity") - 3.5).alias("source_page"),
        F.col("l_partkey").alias("seq"), F.col("l_suppkey").alias("seq2"),
    )


_RAW = """raw AS (SELECT l_orderkey AS document_id, ['due_date', ' total_amount ', 'pan', 'holder', 'notes', ' ', 'postal address'][(l_orderkey + l_linenumber) % 7 + 1] AS field_name,
  ['date', ' id number', 'Money', 'string', 'weird', '', 'bool', 'Address'][l_orderkey % 8 + 1] AS field_type, CASE WHEN l_orderkey % 9 = 0 THEN '  ' ELSE ' ' || l_partkey END AS raw_value,
  CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_discount * 20 - 0.3 END AS confidence, l_quantity - 3.5 AS source_page, l_partkey AS seq, l_suppkey AS seq2 FROM lineitem)"""
_CONFORMED = f"""conformed AS (SELECT document_id, {trim_sql('field_name')} AS field_name, {type_sql('field_type', trim_sql('field_name'))} AS field_type, {trim_sql('raw_value')} AS raw_value,
  least(greatest(coalesce(confidence, 0.85), 0.0), 1.0) AS confidence, CASE WHEN source_page >= 1 THEN CAST(floor(source_page) AS BIGINT) ELSE 1 END AS source_page, seq, seq2 FROM raw WHERE {trim_sql('field_name')} <> '' AND {trim_sql('raw_value')} <> '')"""


@query(f"WITH {_RAW}, {_CONFORMED} SELECT * FROM conformed")
def conform_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.conform_extractions(_raw_extractions(spark, sf_dir))


@query(f"WITH {_RAW} SELECT document_id, field_name, {type_sql('field_type', 'field_name')} AS conformed_type FROM raw")
def conform_field_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_extractions(spark, sf_dir).select("document_id", "field_name", P.field_type(F.col("field_type"), F.col("field_name")).alias("conformed_type"))


@query(oracle(f"""WITH {_RAW}, {_CONFORMED}, kept AS (SELECT document_id, field_name, field_type, raw_value, confidence, is_verified, is_rejected FROM fields WHERE is_verified OR is_rejected),
fresh AS (SELECT *, row_number() OVER (PARTITION BY document_id, field_name ORDER BY seq, seq2, confidence, raw_value) AS n FROM conformed c WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.document_id = c.document_id AND k.field_name = c.field_name))
SELECT * FROM kept UNION ALL SELECT document_id, field_name, field_type, raw_value, confidence, false, false FROM fresh WHERE n = 1""", "fields"))
def merge_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = Y.conform_extractions(_raw_extractions(spark, sf_dir))
    return Y.merge_extractions(E.fields(spark, sf_dir), new, ["seq", "seq2", "confidence", "raw_value"])


@query(oracle("SELECT document_id, field_name FROM fields WHERE is_verified OR is_rejected", "fields"))
def preserved_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fields(spark, sf_dir).where("is_verified or is_rejected").select("document_id", "field_name").distinct()


@query(oracle("SELECT document_id, field_name, CASE WHEN confidence < 0.65 AND NOT is_verified AND NOT is_rejected THEN 'needs_review' WHEN is_verified AND NOT is_rejected THEN 'verified' WHEN is_rejected THEN 'rejected' ELSE 'other' END AS triage FROM fields", "fields"))
def field_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = (F.col("confidence") < 0.65) & ~F.col("is_verified") & ~F.col("is_rejected")
    triage = F.when(low, "needs_review").when(F.col("is_verified") & ~F.col("is_rejected"), "verified").when(F.col("is_rejected"), "rejected").otherwise("other")
    return E.fields(spark, sf_dir).select("document_id", "field_name", triage.alias("triage"))


@query(oracle("SELECT document_id, CASE WHEN document_id % 5 = 0 THEN category WHEN (document_id % 100) / 100 >= 0.5 THEN coalesce(category, 'UNKNOWN') ELSE 'UNKNOWN' END AS gated FROM documents_meta", "documents_meta"))
def category_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document carries a user's own category, which stays; else a category needs a confidence of 0.5."""
    key = F.col("document_id")
    gated = F.when(key % 5 == 0, F.col("category")).when((key % 100) / 100 >= 0.5, F.coalesce("category", F.lit("UNKNOWN"))).otherwise("UNKNOWN")
    return E.documents_meta(spark, sf_dir).select("document_id", gated.alias("gated"))
