"""Mixing sources to target weights: tempered token shares, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected to the flattest
mix that meets a limit on repetition, or to a target entropy. A source then fills its part of the budget with passes
over permutations of its documents, the last one cut where the part is full, and the mix is dealt in blocks that each
hold every source by its weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyr.llm.common import checkpointed, join_by_hot_key, named, numbered

#: Up to so many sources their totals are summed on the driver and their plan is broadcast; with more, Spark sums them
#: for each exponent tried and joins the plan by key.
FEW_SOURCES = 100_000
#: Exponents are looked for up to this one.
STEEPEST = 4096.0
#: Rows of a source that are ordered together.
BUCKET_ROWS = 4096
ADDED = ("n_tokens", "weight", "epoch", "block", "block_order")


def tempered(tokens: np.ndarray, exponent: float) -> np.ndarray:
    """Normalised shares to the power of ``exponent``; a source without tokens has weight 0."""
    log = np.log(np.maximum(tokens, 1) / max(tokens.max(initial=1), 1))
    powers = np.where(tokens > 0, np.exp(exponent * log), 0.0)
    return powers / max(powers.sum(), 1e-300)


def entropy(weights: np.ndarray) -> float:
    w = weights[weights > 0]
    return float(-(w * np.log(w)).sum())


@dataclass(frozen=True)
class Mix:
    """What a mix comes to: sum of the powers of tokens against the largest source's, entropy, least and most passes."""

    powers: float
    entropy: float
    least: float
    most: float


def mix_of(tokens: np.ndarray, exponent: float) -> Mix:
    """Of the sources' tokens; passes are a token's weight, to be multiplied by the budget."""
    w = tempered(tokens, exponent)
    rate = passes(tokens, w, 1.0)
    powers = np.exp(exponent * np.log(np.maximum(tokens, 1) / max(tokens.max(initial=1), 1)))[tokens > 0].sum()
    return Mix(float(powers), entropy(w), float(rate[rate > 0].min(initial=math.inf)), float(rate.max(initial=0)))


def mix_of_table(totals: DataFrame, largest: int, exponent: float) -> Mix:
    """The same of a table of sources, summed on Spark."""
    log = F.log(F.col("tokens") / F.lit(float(max(largest, 1))))
    power, rate = F.exp(F.lit(exponent) * log), F.exp(F.lit(exponent) * log) / F.col("tokens")
    r = totals.where("tokens > 0").agg(F.sum(power), F.sum(power * log), F.min(rate), F.max(rate)).first()
    if r[0] is None:
        return Mix(0.0, 0.0, math.inf, 0.0)
    return Mix(r[0], math.log(r[0]) - exponent * r[1] / r[0], r[2] / r[0], r[3] / r[0])


def solve_exponent(tokens: np.ndarray | Callable[[float], Mix], max_epochs: float | None = None, target_entropy: float | None = None, budget: float | None = None, steps: int = 60) -> float:
    """The smallest exponent at which no source is repeated beyond ``max_epochs`` nor entropy above the target.

    Repetition is least at an exponent of 1, entropy falls with the exponent; a target below that of the plain shares
    takes an exponent above 1. Raises ValueError where no exponent meets both.
    """
    mix = tokens if callable(tokens) else lambda exponent: mix_of(tokens, exponent)

    def fits(m: Mix) -> bool:
        scale = budget if budget is not None else 1 / m.least if 0 < m.least < math.inf else 0.0
        return max_epochs is None or m.most * scale <= max_epochs + 1e-9

    def calm(m: Mix) -> bool:
        return target_entropy is None or m.entropy <= target_entropy + 1e-12

    def met(exponent: float) -> bool:
        m = mix(exponent)
        return fits(m) and calm(m)

    low, high = 0.0, 1.0
    if met(low):
        return low
    if not fits(mix(1.0)):
        raise ValueError(f"a budget of {budget} tokens repeats sources more than {max_epochs} times in any mix")
    while not calm(mix(high)):
        low, high = high, high * 2
        if high > STEEPEST:
            raise ValueError(f"no exponent brings the entropy down to {target_entropy}")
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if (met(middle) if high <= 1 else calm(mix(middle))) else (middle, high)
    if not fits(mix(high)):
        raise ValueError(f"an entropy of {target_entropy} repeats sources more than {max_epochs} times")
    return high


def passes(tokens: np.ndarray, weights: np.ndarray, budget: float | None) -> np.ndarray:
    """How often each source is gone through. Without a budget it is the least at which every source is used once."""
    rate = np.divide(weights, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    if budget is None:
        least = rate[rate > 0].min(initial=math.inf)
        return rate / least if math.isfinite(least) else rate
    return rate * budget


def plan_sources(totals: DataFrame, max_epochs: float | None, target_entropy: float | None, budget: float | None) -> tuple[DataFrame, int]:
    """(_source, tokens, n rows) -> (_source, n, weight, _quota tokens to take, _epochs passes begun, _buckets of a pass), and how many sources."""
    r = totals.agg(F.count(F.lit(1)), F.coalesce(F.max("tokens"), F.lit(0))).first()
    sources, largest = r[0], r[1]
    if sources <= FEW_SOURCES:
        tokens = totals.select("tokens").toPandas()["tokens"].to_numpy(float)
        mix = lambda exponent: mix_of(tokens, exponent)
    else:
        mix = lambda exponent: mix_of_table(totals, largest, exponent)
    exponent = solve_exponent(mix, max_epochs, target_entropy, budget)
    m = mix(exponent)
    scale = budget if budget is not None else 1 / m.least if 0 < m.least < math.inf else 0.0
    some = F.col("tokens") > 0
    weight = F.when(some, F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(float(max(largest, 1))))) / F.lit(max(m.powers, 1e-300))).otherwise(F.lit(0.0))
    plan = totals.withColumn("weight", weight).withColumn("_quota", F.round(F.col("weight") * scale).cast("long"))
    epochs = F.when(some, F.greatest(F.ceil(F.col("_quota") / F.col("tokens")), F.lit(1))).otherwise(F.lit(1)).cast("int")
    return plan.select("_source", "n", "weight", "_quota", epochs.alias("_epochs"), F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("_buckets")), sources


def word_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: float | None = 2.0,
    target_entropy: float | None = None, budget_tokens: float | None = None, block_tokens: int = 1_000_000, seed: int = 2,
) -> DataFrame:
    """One row per use of a row of ``docs``: its columns, n_tokens, weight, epoch, block, block_order.

    Tokens are words. Without ``budget_tokens`` every document is used at least once and rarer sources up to
    ``max_epochs`` times; with it a source may be cut, too. A document is used where the tokens before it in its
    source's permutation are within the source's part, so that a part is overrun by less than one document. ``block``
    counts blocks of ``block_tokens``; within one, rows are ordered by ``block_order``, a hash. Targets that no
    exponent meets raise ValueError.

    A null source is a source of its own. Texts without words (null, empty) weigh nothing and come in every pass begun
    up to the cut, without ``budget_tokens`` at least once; a source of only such texts has weight 0 and comes once.
    The permutation goes by a hash of the id, of the text where the id is null; ties go by id (null first) and text.
    Rows that repeat both are separate rows. Columns of ``docs`` named like the five new ones are replaced, all others
    kept whatever their names. An empty table gives an empty result.
    """
    docs, names = numbered(docs)
    text = F.col(names[text_col])
    source = F.coalesce(F.concat(F.lit("="), F.col(names[source_col]).cast("string")), F.lit(""))
    own = {"_source": source, "_id": F.col(names[id_col]), "n_tokens": word_tokens(text), "_tie": F.xxhash64(text)}
    keyed = docs.withColumns(own)
    light = checkpointed(keyed.select(*own))
    totals = checkpointed(light.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    plan, sources = plan_sources(totals, max_epochs, target_entropy, budget_tokens)
    plan = checkpointed(plan)
    total = 0 if sources <= FEW_SOURCES else light.count()

    def dealt(rows: DataFrame) -> DataFrame:
        used = rows.join(F.broadcast(plan.drop("n")), "_source") if sources <= FEW_SOURCES else join_by_hot_key(rows, plan, "_source", total)
        used = used.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1)))
        own = F.when(F.col("_id").isNull(), F.col("_tie"))  # a null argument leaves the hash as it is
        used = used.withColumn("_at", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_source", "epoch", "_id", own), 11))
        return used.withColumn("_bucket", F.floor(F.col("_at") / F.lit(float(1 << 53)) * F.col("_buckets")))

    # Tokens before a document: of the passes before, of its pass's buckets before, and of its bucket.
    key = ("_source", "epoch", "_bucket")
    sums = dealt(light).groupBy(*key).agg(F.sum("n_tokens").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("epoch", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*key).orderBy("_at", "_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    used = dealt(keyed).join(sums, list(key))
    used = used.withColumn("_before", F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    always = F.col("epoch") == 0  # without a budget; with one only what weighs nothing at all
    used = used.where((F.col("_before") < F.col("_quota")) | (always if budget_tokens is None else always & (F.col("_quota") == 0)))
    share = F.col("weight") * block_tokens
    used = used.withColumn("block", F.when(share > 0, F.floor(F.col("_before") / share)).otherwise(F.lit(0)).cast("long"))
    used = used.withColumn("block_order", F.xxhash64(F.lit(seed + 1), "block", "epoch", "_id"))
    return named(used, {old: new for old, new in names.items() if old not in ADDED}, *ADDED)
