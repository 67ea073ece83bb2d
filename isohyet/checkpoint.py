"""Reliable storage for rows that several branches or jobs read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def ensure_checkpoint_dir(spark) -> None:
    """Use the cluster's shared folder; only local sessions get one of their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="isohyet-checkpoint-")
    sc.setCheckpointDir(shared)


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage; a lost executor re-reads files instead of recomputing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
