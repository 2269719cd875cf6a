"""Rows computed once and kept where every executor can read them again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between stages: the context's, else the one that spark.checkpoint.dir names.

    A temporary folder of this machine only where neither is set and everything runs on this machine; on a cluster that is
    an error, since other machines couldn't read it."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if not own.isEmpty():
        return own.get()
    if named := sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", ""):
        return named
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def ensure_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))


def materialise(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, which outlives a lost executor."""
    ensure_folder(df.sparkSession)
    return df.checkpoint(eager=True)
