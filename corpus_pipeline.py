"""From raw documents to token ids: the stages of a training-data pipeline, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.llm.common import checkpointed, named, numbered
from papyr.llm.exact_dedup import drop_copies
from papyr.llm.language_id import identify_languages
from papyr.llm.mixing import mix_sources
from papyr.llm.queries import model_bytes
from papyr.llm.sentencepiece_codec import encode_documents
from papyr.llm.simhash import drop_near_duplicates


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which a learned language is found; texts without letters (``und``) go.

    Null and letterless texts go, all texts where no language is learned (no ``lang``, an empty table). Every column of
    a document that stays is as it was, also one named like those that the operator adds.
    """
    plain, names = numbered(docs)
    found = identify_languages(plain, names["doc_id"], names["text"], names["lang"])
    return named(found.where(F.col("lang_pred") != "und"), names)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest id of each group of equal texts, all columns as they were.

    Null texts count as empty, null ids sort last; of rows that repeat id and text one stays. Empty stays empty.
    """
    return drop_copies(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each SimHash component, all columns as they were.

    Null and wordless texts have fingerprint zero and are linked like any other; null ids sort last. Empty stays empty.
    """
    return drop_near_duplicates(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of rare sources (at most twice) so that the sources meet their weights; none is dropped.

    A null source is one of its own; texts without words come once at least. All columns are as they were, also those
    named like the operator's own. Empty stays empty.
    """
    plain, names = numbered(docs)
    return named(mix_sources(plain, names["doc_id"], names["text"], names["source"]), names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, checked against the peer library and by decoding; a null text gives nulls, other columns go."""
    return encode_documents(docs, model_bytes()).select("doc_id", "ids", "parity", "round_trip")


STAGES = [
    ("language ID", known_language),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("source mixing", mix),
    ("SentencePiece encoding", encode),
]
#: Learned filters, fingerprints and a subword model are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is checkpointed before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
