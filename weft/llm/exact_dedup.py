"""Exact deduplication with a heavy-hitter split.

Digests that hold more than a 1/(k+1) share of the rows are found with mergeable Misra-Gries summaries of k counters
(one per task, merged in groups, so at most groups x k counters reach the driver), counted exactly, and their winners
are broadcast: rows of such a group are settled map-side and never shuffled. At most k winners exist, whatever the
input. All other digests go through an ordinary shuffle, where no group can be hot.

Defined results: a null text counts as empty; of equal texts the longest original stays, then the smallest doc_id (a
null doc_id comes last), then the first of repeated rows; every row comes back, exactly one of a group with kept=true.
An empty table gives an empty result. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import checkpointed, text_or_empty

COUNTERS = 1024
MERGE_GROUPS = 32


def _trim(counts: Counter, k: int) -> Counter:
    """The Misra-Gries step: at most k counters stay, each undercounting by at most total/(k+1)."""
    if len(counts) <= k:
        return counts
    cut = heapq.nlargest(k + 1, counts.values())[-1]
    return Counter({x: n - cut for x, n in counts.items() if n > cut})


def frequent_digests(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(digest): a superset, of at most k, of the digests that hold more than 1/(k+1) of the rows of digests(digest binary)."""

    def summaries(batches):
        kept = Counter()
        for batch in batches:
            for digest, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept[digest] += n
            kept = _trim(kept, k)
        yield pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.binary()), pa.array(kept.values(), pa.int64())], ["digest", "n"])

    schema = "digest binary, n long"
    per_task = digests.select("digest", F.lit(1).cast("long").alias("n")).mapInArrow(summaries, schema)
    merged = per_task.repartition(MERGE_GROUPS, F.spark_partition_id()).mapInArrow(summaries, schema)
    kept = Counter()
    for row in merged.collect():  # at most MERGE_GROUPS x k counters
        kept[bytes(row["digest"])] += row["n"]
    return digests.sparkSession.createDataFrame([(bytearray(x),) for x in _trim(kept, k)], "digest binary")


def dedup_exact(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text, ...)."""
    text = text_or_empty()
    rows = checkpointed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", ""), 256)).alias("digest"),
            F.length(text).alias("chars"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    # The complements of doc_id and rid turn "smallest" into "largest"; a null sorts below every value.
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("d"), F.bitwise_not("rid").alias("r")))
    aggs = [F.count(F.lit(1)).alias("group_size"), best.alias("best")]

    candidates = frequent_digests(rows, counters)
    total = rows.count()
    heavy = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*aggs).where(F.col("group_size") * (counters + 1) > total)
    heavy = checkpointed(heavy)  # at most `counters` rows
    ordinary = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    settled = rows.join(F.broadcast(heavy), "digest").unionByName(ordinary.join(ordinary.groupBy("digest").agg(*aggs), "digest"))
    return settled.select(
        "doc_id",
        F.bitwise_not("best.d").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.bitwise_not("best.r")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
