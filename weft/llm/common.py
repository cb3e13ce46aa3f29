"""What the operators of this subpackage share: scratch tables, size-checked broadcasts, word rules."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D, nothing else.
SPACE = "\\x20\\x09-\\x0D"
WORD_RE = f"[^{SPACE}]+"


def scratch(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; only where that is unset, as in tests, a folder of our own, in local mode."""
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


def table(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written once as Parquet under the shared folder and read back: for wide rows or several column subsets."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/weft-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Scratch tables written so far and not dropped yet.
_MADE: list[str] = []


def tables_made() -> list[str]:
    return list(_MADE)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Scratch tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in _MADE:
            _MADE.remove(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    _MADE.append(path)

    def drop() -> None:
        try:
            if path in _MADE:
                drop_tables(spark, [path])
        except Exception:  # the context may already be gone; the folder is scratch space either way
            pass

    atexit.register(drop)


def released(spark: SparkSession) -> None:
    """Lets the shuffle files of finished steps go now: Spark removes them once the driver has collected what refers to them, in a thread
    of its own that gets a moment before the next step writes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)


def small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """A materialised df, marked for broadcast if its counted rows are within the bound; else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= max_rows else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD_RE)).cast("long")

