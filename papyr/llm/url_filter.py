"""URL filter: host and path rules first, gradient-boosted trees on lexical features for every other URL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyr.llm.common import checkpointed, hash_share, join_by_hot_key, let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The fit takes at most about this many labelled URLs, chosen by hash.
SAMPLE_URLS = 20_000
#: A labelled URL's suffix statistics leave out the URLs of its own fold, of so many.
FOLDS = 8
#: Weight of the overall share of blocked URLs in a suffix's smoothed share.
PRIOR = 20.0
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "host_hyphens",
    "entropy", "host_entropy", "params", "query_length", "has_fragment", "longest_label", "suffix_share",
    "suffix_log", "segment_share", "segment_log",
)


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as text; null where none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.text)).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Bits a character of a text; 0 for the empty text."""

    def over(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
        return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(F.lit(0.0))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), over)


def _digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def lexical_features(urls: DataFrame) -> DataFrame:
    """Adds the features that a URL has by itself (columns url, host, path must be there), its suffix and segment."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n, hn = F.greatest(F.length(url), F.lit(1)), F.greatest(F.length("host"), F.lit(1))
    return urls.withColumns(
        {
            "length": F.length(url),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
            "labels": F.size(F.split("host", r"\.")),
            "digit_ratio": _digits(url) / n,
            "host_digit_ratio": _digits(F.col("host")) / hn,
            "host_hyphens": F.length("host") - F.length(F.translate("host", "-", "")),
            "entropy": _entropy(url),
            "host_entropy": _entropy(F.col("host")),
            "params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
            "query_length": F.length(query),
            "has_fragment": F.contains(url, F.lit("#")).cast("int"),
            "longest_label": F.array_max(F.transform(F.split("host", r"\."), F.length)),
            "suffix": F.regexp_extract("host", r"([^.]+?)(:\d+)?$", 1),
            "segment": F.regexp_extract("path", r"^/([^/]*)/", 1),
        }
    )


def with_shares(urls: DataFrame, key: str, total: int) -> DataFrame:
    """Adds, by suffix or segment: log of its count, and its share of blocked URLs, smoothed to the overall share.

    URLs without a label count too: what is hardly ever known to be bad has a low share. A labelled URL's own label
    must not tell on it: its statistics are those of the other folds alone (equal URLs are in one fold). ``total`` is
    the number of rows; hot keys are not shuffled.
    """
    bad = F.coalesce("label", F.lit(0.0))
    folds = urls.groupBy(key, "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("bad"))
    sums = checkpointed(folds.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bad").alias("all_bad"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "bad")))).alias("folds")))
    overall = F.lit(sums.agg(F.sum("all_bad") / F.sum("n")).first()[0] or 0.0)
    rows = join_by_hot_key(urls, sums.withColumn("all_n", F.col("n")), key, total)
    own = F.when(F.col("label").isNotNull(), F.element_at("folds", F.col("fold")))
    n = F.col("all_n") - F.coalesce(own["n"], F.lit(0))
    share = (F.col("all_bad") - F.coalesce(own["bad"], F.lit(0.0)) + PRIOR * overall) / (n + PRIOR)
    return rows.withColumns({f"{key}_log": F.log1p(n), f"{key}_share": share}).drop("all_n", "all_bad", "folds")


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", sample_urls: int = SAMPLE_URLS) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, block_score.

    A URL that a rule fits gets the longest rule's verdict. The trees learn from such labelled URLs (at most about
    ``sample_urls``, chosen by hash) and judge the others: block at a score of 0.5 or more. The suffix statistics
    cover all URLs, but a labelled URL's own fold. Null and ``://``-less URLs have empty host and path and are judged by the trees. Where the labels
    are missing or of one kind only, no trees are grown: score null, and that verdict (allow if none) for all.
    Repeated rows get equal results; other columns are ignored; an empty table gives an empty result.
    """
    urls = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    urls = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for rule in rules:
        said = F.when(F.col("rule") == rule.text, F.lit(rule.verdict)).otherwise(said)
    urls = lexical_features(urls.withColumn("said", said)).withColumn("label", (F.col("said") == "block").cast("double"))
    urls = checkpointed(urls.withColumn("fold", F.pmod(F.xxhash64(F.lit(6), "url"), F.lit(FOLDS))))
    counts = {r["said"]: r["count"] for r in urls.groupBy("said").count().collect()}
    total = sum(counts.values())
    counts.pop(None, None)
    if len(counts) < 2:
        verdict = F.coalesce("said", F.lit(next(iter(counts), "allow")))
        return urls.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    full = checkpointed(with_shares(with_shares(urls, "suffix", total), "segment", total))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(full)
    share = min(1.0, sample_urls / sum(counts.values()))
    labelled = checkpointed(vectors.where(F.col("label").isNotNull() & hash_share(F.col("url"), share, 4)).select("features", "label"))
    trees = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=7, checkpointInterval=-1).fit(labelled)
    scored = trees.transform(vectors).withColumn("block_score", vector_to_array("probability")[1])
    by_trees = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", by_trees).alias("verdict"), "block_score")
