"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder that ``spark.checkpoint.dir`` names and go on from there; a local session may do without one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="papyr-checkpoint-"))
    return df.checkpoint(eager=True)
