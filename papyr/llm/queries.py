"""The operators of this subpackage applied to whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyr.llm import chat_format, license_scan, ranked_search
from papyr.llm import exact_dedup as dedup
from papyr.llm.alignment import align_documents, weigh_links
from papyr.llm.language_id import identify_languages
from papyr.llm.mixing import mix_sources
from papyr.llm.quality_cnn import classify_quality
from papyr.llm.quality_rules import quality_rules
from papyr.llm.sentencepiece_codec import SentencePieceModel, decode_documents, encode_documents
from papyr.llm.simhash import near_duplicates
from papyr.llm.toxicity import classify_toxicity
from papyr.llm.url_filter import Rule, judge_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "block_order")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


#: The rules of the page filter (fixed values).
URL_RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


#: The SentencePiece model that the queries use; another path can be put in its place.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def model_bytes(path: str | None = None) -> bytes:
    """A model file's content, read on the driver; the tasks get it as a broadcast."""
    return Path(path or MODEL_PATH).read_bytes()


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents"), model_bytes())
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "parity", "round_trip")


def sentencepiece_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the token ids of all documents decode to."""
    data = model_bytes()
    return decode_documents(encode_documents(table(spark, sf_dir, "documents"), data), data)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "share")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The byte-level tokenizer that op11 aligns with the model; another path can be put in its place.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.json"


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = model_bytes()
    aligned = align_documents(table(spark, sf_dir, "documents"), Path(TOKENIZER_PATH).read_bytes(), b)
    digest = F.when(F.col("groups").isNull(), "").otherwise(F.sha2("groups", 256))
    found = weigh_links(aligned.withColumn("groups_sha256", digest).drop("groups"), len(SentencePieceModel.parse(b).pieces))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Conversation -1 says what the template's own marks are (fixed values).
MARKS_SAID = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.conversation_digests(chat_format.format_conversations(given.unionByName(spark.createDataFrame(MARKS_SAID, given.schema))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_source_mixing, op3_license_scan, op4_url_filter, op5_sentencepiece, op6_quality_rules, op7_toxicity, op8_exact_dedup,
        op9_language_id, op10_quality_classifier, op11_tokenizer_alignment, op12_ranked_search, op13_chat_formatting, sentencepiece_decoding,
    )
}
ORACLES = {
    "op3_license_scan": license_scan.oracle(), "op8_exact_dedup": dedup.ORACLE, "op12_ranked_search": ranked_search.ORACLE, "op13_chat_formatting": chat_format.ORACLE,
    # The marker character itself can't be told from a space.
    "sentencepiece_decoding": "SELECT doc_id, replace(text, chr(9601), ' ') AS text FROM documents",
}
