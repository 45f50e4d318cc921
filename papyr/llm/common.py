"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words (and only this: other Unicode spaces are word characters).
SPACES = r"[\x20\x09-\x0D]+"


#: A key with more than one row in so many is hot: there are at most so many hot keys.
HOT_KEYS = 4096


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names; a local session without one gets a folder of its own.

    On a cluster the setting must be there: a folder of the driver alone would lose what executors write.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="papyr-checkpoint-")
    sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns numbered, so that none meets a column that an operator adds; and the new names by old."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named(rows: DataFrame, names: dict[str, str], *more: Column | str) -> DataFrame:
    """The numbered columns under their old names, and ``more``."""
    return rows.select(*(F.col(new).alias(old) for old, new in names.items()), *more)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` or its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text as an array: maximal runs of characters other than ``SPACES``; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id is held out (never learned from)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(True))


def hash_share(key: Column, share: float | Column, salt: int) -> Column:
    """True for about ``share`` of the keys, chosen by hash: the same rows on every run and any layout."""
    bound = share * 1_000_000_007 if isinstance(share, Column) else F.lit(round(share * 1_000_000_007))
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1_000_000_007)) < bound


def join_by_hot_key(rows: DataFrame, keyed: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has each key once and in ``n`` how many of the rows carry it.

    ``total`` is the number of rows or more. Keys with over ``total / HOT_KEYS`` rows, of which there are no more than
    ``HOT_KEYS``, are broadcast, so that their rows stay where they are; only the other keys are shuffled.
    """
    is_hot = F.col("n") * HOT_KEYS > F.lit(total)
    hot = F.broadcast(keyed.where(is_hot).drop("n"))
    cold = rows.join(hot.select(key), key, "left_anti").join(keyed.where(~is_hot).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)
