"""Quality rules with risk-controlled cutoffs, on DataFrame functions alone.

Each rule rejects a text whose statistic exceeds a cutoff. Per stratum and rule the lowest cutoff of a fixed grid is
taken for which an exact binomial test on labelled good documents shows that the rule falsely rejects at most its
part of the risk; the level of the tests is divided over all strata, rules and cutoffs (Bonferroni).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyr.llm.common import SPACES, checkpointed, let, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
RULES = ("symbol_share", "bare_share", "dup_line_share", "repeat_share")
CUTOFFS = (0.002, 0.005, 0.01, 0.02, 0.035, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5, 0.7)
#: Falsely rejected share of good documents of a stratum, over all rules, and the chance that any bound fails.
RISK, DELTA = 0.04, 0.05
#: So many strata at most have their cutoffs broadcast; beyond that Spark chooses the join.
BROADCAST_STRATA = 10_000


def _repeat_words(words: Column) -> Column:
    """Words that lie in a ``WINDOW``-word window that comes twice or more in the text."""

    def covered(hashes: Column) -> Column:
        def positions(pairs: Column) -> Column:
            n = F.size(pairs)

            def twin(pair: Column, i: Column) -> Column:
                left = (i > 0) & (F.get(pairs, i - 1)["h"] == pair["h"])
                return left | ((i < n - 1) & (F.get(pairs, i + 1)["h"] == pair["h"]))

            return F.transform(F.filter(pairs, twin), lambda pair: pair["at"])

        def union(at: Column) -> Column:
            step = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(step, F.lit(0), lambda acc, x: acc + x)

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(pairs, lambda p: F.sort_array(positions(p))), union)
        )

    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))))
    return F.when(F.size(words) > WINDOW, let(hashes, covered)).otherwise(F.lit(0))


def text_counts(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_bare_words, n_lines, n_dup_lines, n_repeat_words (all long)."""
    full = F.coalesce(text, F.lit(""))
    solid = F.regexp_replace(full, SPACES, "")
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = docs.select(
        *keep,
        F.length(solid).alias("word_chars"),
        (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).alias("n_symbols"),
        let(
            words_of(text),
            lambda w: F.struct(
                F.size(w).alias("n_words"),
                F.size(F.filter(w, lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).alias("n_bare_words"),
                _repeat_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
    )
    names = {"word_chars": "word_chars", "n_symbols": "n_symbols", "w.n_words": "n_words", "w.n_bare_words": "n_bare_words", "w.n_repeat_words": "n_repeat_words", "l.n_lines": "n_lines", "l.n_dup_lines": "n_dup_lines"}
    kept = [c for c in counts.columns if c not in ("w", "l", "word_chars", "n_symbols")]
    return counts.select(*kept, *(F.col(k).cast("long").alias(v) for k, v in names.items()))


def rule_shares(counts: DataFrame) -> DataFrame:
    """Adds the statistics of ``RULES``, each 0 where there is nothing to count."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return counts.withColumns({"symbol_share": share("n_symbols", "word_chars"), "bare_share": share("n_bare_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")})


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p), summed exactly from log terms (about 1 is returned for k >= n p)."""
    start = F.struct((n * math.log1p(-p)).alias("term"), F.exp(n * math.log1p(-p)).alias("sum"))
    odds = math.log(p / (1 - p))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    exact = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda acc: acc["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(exact)


def risk_controlled_cutoffs(good: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum and the statistics of labelled good documents) -> stratum, rule, cutoff; no row where none is proven.

    ``good`` is only counted: to the tests go the strata times the grid. With probability 1 - ``delta``, in every
    stratum at once, all rules together reject at most ``risk`` of the good documents.
    """
    each = risk / len(RULES)
    stats = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("x")) for r in RULES)))
    over = sum((F.col("s.x") > c).cast("int") for c in CUTOFFS)
    cells = good.select("stratum", stats.alias("s")).groupBy("stratum", "s.rule", over.alias("over")).count()
    by = Window.partitionBy("stratum", "rule")
    grid = F.posexplode(F.array(*(F.lit(c) for c in CUTOFFS))).alias("i", "cutoff")
    cells = cells.groupBy("stratum", "rule").agg(F.collect_list(F.struct("over", "count")).alias("cells")).select("*", grid)
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["count"])
    lost = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["over"] > F.col("i"), c["count"]).otherwise(F.lit(0)))
    tests = cells.select("stratum", "rule", "cutoff", total.alias("n"), lost.alias("k"))
    strata = tests.select("stratum").distinct().agg((F.count(F.lit(1)) * len(RULES) * len(CUTOFFS)).alias("tests"))
    proven = tests.crossJoin(F.broadcast(strata)).where(binomial_tail(F.col("k"), F.col("n"), each) <= F.lit(delta) / F.col("tests"))
    first = F.row_number().over(by.orderBy("cutoff"))
    return proven.withColumn("first", first).where("first = 1").select("stratum", "rule", "cutoff")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, kept, failed_rule.

    base_failed: fewer than 20 words, or more than 30 % of the words in repeated windows. Otherwise a text is kept
    unless a statistic exceeds its stratum's proven cutoff; a stratum without proof (few labels) rejects nothing more.
    Null texts count as empty, null strata form one stratum. Good labels are rows with ``label_col`` 1 and an id that
    ``docs`` has; a null id matches none. Repeated rows get equal verdicts. Other columns are ignored.
    """
    keep = [docs[id_col].alias("doc_id"), F.coalesce(docs[stratum_col].cast("string"), F.lit("")).alias("stratum")]
    counts = checkpointed(text_counts(docs, docs[text_col], keep))
    stats = rule_shares(counts).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    good = labels.where(labels[label_col] == 1).select(labels[id_col].alias("_id")).distinct()
    passed = stats.where("not base_failed")
    cutoffs = risk_controlled_cutoffs(passed.join(good, passed["doc_id"] == good["_id"], "left_semi"), risk, delta)
    wide = cutoffs.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in RULES))
    wide = checkpointed(wide)
    wide = F.broadcast(wide) if wide.count() <= BROADCAST_STRATA else wide
    judged = stats.join(wide, "stratum", "left")
    failed = F.coalesce(*(F.when(F.col(r) > F.col(f"_{r}"), F.lit(r)) for r in RULES))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & failed.isNull()).alias("kept"),
        F.when(F.col("base_failed"), F.lit("base")).otherwise(failed).alias("failed_rule"),
    )
