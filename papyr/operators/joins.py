"""Joins that keep hot keys out of the shuffle, and joins of parts of texts without looking at all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyr.operators.storage import shared_checkpoint

#: A key with more than one row in so many is hot: there are at most so many hot keys.
HOT_KEYS = 4096


def join_by_hot_key(rows: DataFrame, keyed: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has each key once and in ``n`` how many of the rows carry it.

    ``total`` is the number of rows or more. Keys with over ``total / HOT_KEYS`` rows, of which there are no more than
    ``HOT_KEYS``, are broadcast, so that their rows stay where they are; only the other keys are shuffled.
    """
    is_hot = F.col("n") * HOT_KEYS > F.lit(total)
    hot = F.broadcast(keyed.where(is_hot).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(keyed.where(~is_hot).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)


def holding(texts: DataFrame, values: DataFrame) -> DataFrame:
    """(raw, df) distinct texts x (value) -> (value, raw, df): the texts that hold each value, an empty value none.

    A value meets the texts that have its rarest three characters (all of a shorter one), and no others.
    """
    values = values.where("value <> ''").distinct()
    sizes = [r[0] for r in values.select(F.least(F.length("value"), F.lit(3)).alias("n")).distinct().collect()]  # 1 to 3

    def grams(text: Column) -> Column:
        def of_size(n: int) -> Column:
            own = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
            return F.when(F.length(text) >= n, own).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.flatten(F.array(*map(of_size, sizes))))

    if not sizes:
        return texts.select(F.col("raw").alias("value"), "raw", "df").limit(0)
    split = shared_checkpoint(texts.select("raw", "df", F.explode(grams(F.col("raw"))).alias("gram")))
    counts = split.groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    size = F.least(F.length("value"), F.lit(3))
    own = values.select("value", F.explode(F.filter(grams(F.col("value")), lambda g: F.length(g) == size)).alias("gram"))
    rarest = own.join(counts, "gram", "left").groupBy("value").agg(F.min_by("gram", F.coalesce("words", F.lit(0))).alias("gram"))
    return split.join(rarest, "gram").where(F.contains("raw", F.col("value"))).select("value", "raw", "df")
