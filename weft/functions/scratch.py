"""Scratch files that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; where that is unset, as in tests, a folder of our own, in local mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or ""
    have = sc._jsc.sc().getCheckpointDir()
    if not named and have.isDefined():
        named = have.get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='weft-checkpoint-')}"
    if not have.isDefined():
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, lineage cut; survives lost executors."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)
