"""File listings, media types, payloads of models, and the ways tables are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_PAGES = 52_428_800, 100
MIME_TYPES = ("application/pdf", "image/png", "image/jpeg", "image/webp")
BLOCK = "struct<id:string,text:string,confidence:double,bbox:array<double>,order:int,type:string>"


def ingest_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as rows: path, size, content, mime_type and why a file is rejected (null if it isn't)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.col("length").alias("size_bytes"), "content").withColumn("mime_type", sniff_mime(F.col("content")))
    return judge_manifest(rows, F.col("mime_type"))


def judge_manifest(rows: DataFrame, mime: Column) -> DataFrame:
    """Adds reject_reason: too large, or of a type that isn't taken; null for files that are."""
    known = F.coalesce(mime.isin(*MIME_TYPES), F.lit(False))
    return rows.withColumn("reject_reason", F.when(F.col("size_bytes") > MAX_BYTES, "FILE_TOO_LARGE").when(~known, "UNSUPPORTED_TYPE"))


def compare_mime(rows: DataFrame) -> DataFrame:
    """(declared_mime, content) -> with mime_type by the first bytes, and status: FAILED where the two differ."""
    rows = rows.withColumn("mime_type", sniff_mime(F.col("content")))
    return rows.withColumn("status", F.when(F.col("mime_type") == F.col("declared_mime"), "OK").otherwise("FAILED"))


def storage_key(user: Column, document: Column, version: Column, name: Column) -> Column:
    """The place of an original file: its name without folders, odd characters as one underscore, at most 100, small extension."""
    base = F.regexp_extract(F.regexp_replace(name, "/+$", ""), "[^/]*$", 0)
    extension = F.lower(F.regexp_extract(base, r".(\.[^.]*)$", 1))
    own = (extension != "") & (base != extension) & F.endswith(base, extension)
    stem = F.when(own, F.substring(base, F.lit(1), F.length(base) - F.length(extension))).otherwise(base)
    safe = F.substring(F.regexp_replace(F.regexp_replace(stem, "[^a-zA-Z0-9_-]", "_"), "_+", "_"), 1, 100)
    return F.concat(F.lit("documents/"), user, F.lit("/"), document, F.lit("/"), version, F.lit("/original/"), safe, extension)


def sniff_mime(content: Column) -> Column:
    """Media type by the first bytes; null for what isn't taken."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("25504446"), MIME_TYPES[0]).when(head.startswith("89504E47"), MIME_TYPES[1]).when(head.startswith("FFD8FF"), MIME_TYPES[2])
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), MIME_TYPES[3])
    )


def pdf_page_audit(files: DataFrame) -> DataFrame:
    """Adds page_count and page_error to files that are declared (``declared_mime``) or known (``mime_type``) as something.

    Of a PDF the pages are its page objects, else its first count, else 1; it is corrupt without its mark, too long
    beyond 100 pages. Anything else is one page without an error.
    """
    kind = F.col("declared_mime" if "declared_mime" in files.columns else "mime_type")
    is_pdf = F.coalesce(kind == MIME_TYPES[0], F.lit(False))
    text = F.decode("content", "ISO-8859-1")
    pages = F.regexp_count(text, F.lit(r"/Type\s*/Page[^s]"))
    count = F.when(pages > 0, pages).otherwise(F.coalesce(F.regexp_extract(text, r"/Count\s+(\d+)", 1).try_cast("int"), F.lit(1)))
    error = F.when(~text.startswith("%PDF"), "CORRUPT_PDF").when(count > MAX_PAGES, "TOO_MANY_PAGES")
    return files.withColumns({"page_count": F.when(is_pdf, count).otherwise(F.lit(1)), "page_error": F.when(is_pdf, error)})


def parse_ocr_payloads(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """(version_id, page_number, payload) -> one row a block, under our own page number; what a block lacks gets the defaults.

    A page without blocks, or with a reply that can't be read, stays as one row of nulls.
    """
    parsed = payloads.withColumn("p", F.from_json(json_col, f"blocks array<{BLOCK}>"))
    rows = parsed.select("version_id", "page_number", F.posexplode_outer("p.blocks").alias("i", "b"))
    name = F.concat(F.lit("paddle-"), F.col("page_number").cast("string"), F.lit("-"), F.col("i").cast("string"))
    there = lambda c: F.when(F.col("i").isNotNull(), c)
    return rows.select(
        "version_id", "page_number", F.coalesce("b.id", name).alias("block_id"), there(F.coalesce("b.text", F.lit(""))).alias("block_text"),
        there(F.coalesce("b.confidence", F.lit(0.0))).alias("confidence"), F.coalesce("b.order", "i").alias("block_order"), there(F.coalesce("b.type", F.lit("text"))).alias("block_type"), F.col("b.bbox").alias("bbox"),
    )


def parse_llm_payloads(replies: DataFrame, schema: str, reply_col: str = "reply") -> DataFrame:
    """Model replies with or without code fences -> ``parsed`` by the schema, and ``malformed``."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(reply_col, F.lit(""))), r"^```(json)?\s*|\s*```$", ""))
    valid = F.try_parse_json(bare).isNotNull() & bare.startswith("{")
    return replies.withColumns({"parsed": F.when(valid, F.from_json(bare, schema)), "malformed": ~F.coalesce(valid, F.lit(False))})


def upsert_by_key(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of both by key; of a row that both have, the given columns (all if none are) are the new one's.

    Write the result to a new path and swap.
    """
    values = [c for c in old.columns if c not in keys]
    updated = values if columns is None else columns
    joined = old.select(*keys, F.struct(*values).alias("_old")).join(new.select(*keys, F.struct(*values).alias("_new")), keys, "full_outer")

    def value(c: str) -> Column:
        own, fresh = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        keep = F.col("_new").isNull() | (F.col("_old").isNotNull() & F.lit(c not in updated))
        return F.when(keep, own).otherwise(fresh).alias(c)

    return joined.select(*keys, *(value(c) for c in values))


def replace_partitions(rows: DataFrame, path: str, partition: str = "version_id") -> None:
    """Overwrite just the partitions that ``rows`` hold: a job that runs again leaves the same table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
