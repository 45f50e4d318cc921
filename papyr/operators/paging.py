"""One page of each user's ordered rows, without ordering all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyr.operators.joins import join_by_hot_key
from papyr.operators.storage import shared_checkpoint

#: Buckets that a range of values is cut into; rows of a user up to which they are ordered as they are.
CUTS, ORDERED = 1024, 100_000


def pages(rows: DataFrame, requests: DataFrame, by: str, key: str, tie: str, *rest: str, cuts: int = CUTS, ordered: int = ORDERED) -> DataFrame:
    """The rows on the page that each request (``by``, page from 1, size) asks for, with place (from 1), total and total_pages.

    Rows are in the order of ``key`` and ``tie``, two numbers without nulls, then ``rest``. They are made once. The rows
    of a user with up to ``ordered`` of them are ordered in one shuffle. Those of a larger user are counted in buckets of
    the key, and only the buckets that the page touches are kept; those are cut again by the key, and where one key
    is left by the tie. What is ordered in the end is a few buckets' rows, also under a user with most rows. Bucket
    counts are as many as ``cuts`` a larger user. Requests without rows give none; one request a user.
    """
    asked = requests.select(by, ((F.col("page") - 1) * F.col("size")).alias("_first"), (F.col("page") * F.col("size")).alias("_last"), "size")
    rows = shared_checkpoint(rows)
    number = rows.count()
    totals = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total")).join(asked, by)
    totals = shared_checkpoint(totals.where("_first < total"))
    large = totals.where(F.col("total") > ordered)
    own = rows.join(F.broadcast(large.select(by)), by, "left_anti").join(totals.where(F.col("total") <= ordered), by)  # large users are few
    found = _sorted(own, [by], key, tie, *rest)
    return found if large.isEmpty() else found.unionByName(_large(rows, large, number, by, key, tie, *rest, cuts=cuts))


def _sorted(own: DataFrame, groups: list[str], key: str, tie: str, *rest: str) -> DataFrame:
    """The rows of the page, ordered in their groups, after the ``_before`` rows of earlier ones where there are any."""
    before = F.col("_before") if "_before" in own.columns else F.lit(0).cast("long")
    place = before + F.row_number().over(Window.partitionBy(*groups).orderBy(key, tie, *rest))
    own = own.withColumn("place", place).where("place > _first and place <= _last")
    return own.withColumn("total_pages", F.ceil(F.col("total") / F.col("size"))).drop("_before", "_first", "_last", "size", *groups[1:])


def _large(rows: DataFrame, totals: DataFrame, number: int, by: str, key: str, tie: str, *rest: str, cuts: int) -> DataFrame:
    """The pages of users whose rows are too many to be ordered."""
    own = shared_checkpoint(join_by_hot_key(rows, totals.withColumn("n", F.col("total")), [by], number).withColumn("_before", F.lit(0).cast("long")))
    groups = [by]
    for level, value in enumerate((key, key, tie)):
        bucket = f"_bucket_{level}"
        ends = own.groupBy(*groups).agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"), (F.min(key) == F.max(key)).alias("_one"), F.count(F.lit(1)).alias("n"))
        cut = F.least(F.floor((F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * cuts), F.lit(cuts - 1))
        may = F.col("_one") if value != key else F.lit(True)  # the tie counts between equal keys alone
        own = join_by_hot_key(own, shared_checkpoint(ends), groups, number).withColumn(bucket, F.coalesce(F.when(may, cut), F.lit(0))).drop("_low", "_high", "_one")
        counts = own.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("m"), *(F.first(c).alias(c) for c in ("_before", "_first", "_last")))
        earlier = F.coalesce(F.sum("m").over(Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("_before", F.col("_before") + earlier).where("_before < _last and _before + m > _first")
        groups = [*groups, bucket]
        kept = shared_checkpoint(counts.select(*groups, "_before", F.col("m").alias("n")))
        own = shared_checkpoint(join_by_hot_key(own.drop("_before"), kept, groups, number))
    return _sorted(own, groups, key, tie, *rest)
