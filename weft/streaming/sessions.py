"""Sessions and windows, the same code for tables and streams."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """user_id, session_start, session_end (last event), n of events(user_id, ts timestamp); a gap of exactly `gap` still joins."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    by = events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("n")).drop("w")


def windows(events: DataFrame, length: str, slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """window_start, event_type, n, total of tumbling or sliding windows."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    w = F.window("ts", length, slide or length).alias("w")
    return events.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def idle(last_access: DataFrame, now, timeout_minutes: int = 30) -> DataFrame:
    """last_access(session_id, persona_id, last_access) with idle_seconds, expires_in_seconds (zero at least) and expired (idle for longer than the timeout)."""
    seconds = F.timestamp_diff("SECOND", "last_access", now)
    rows = last_access.withColumn("idle_seconds", seconds).withColumn("persona_id", F.coalesce("persona_id", F.lit("unknown")))
    return rows.withColumn("expires_in_seconds", F.greatest(F.lit(0), F.lit(timeout_minutes * 60) - seconds)).withColumn("expired", seconds > timeout_minutes * 60)


def oldest(last_access: DataFrame) -> DataFrame:
    """The session to evict: that of the least last access, then of the least id."""
    return last_access.agg(F.min_by("session_id", F.struct("last_access", "session_id")).alias("session_id"))


def capped(accesses: DataFrame, cap: int = 1000, shards: int = 8, timeout_minutes: int = 30) -> DataFrame:
    """session_id, opened, closed, accesses, reason of sessions that a service of `shards` instances holds, each `cap` / `shards` at most.

    accesses(session_id, ts timestamp). An access to an unknown session opens it; where an instance is full, the one unused for longest is
    evicted; one unused for longer than the timeout has expired. Sessions belong to instances by the hash of their id. A task reads its
    accesses in order and holds one entry for each open session, so its memory is bounded by the cap.
    """
    most, limit = max(1, cap // shards), timeout_minutes * 60_000_000

    def run(batches):
        open_: dict[int, OrderedDict] = {}
        out: list[tuple] = []

        def flush():
            cols = list(zip(*out)) if out else [[]] * 5
            out.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["session_id", "opened", "closed", "accesses", "reason"])

        for batch in batches:
            for shard, sid, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = open_.setdefault(shard, OrderedDict())
                while own and t - next(iter(own.values()))[1] > limit:  # the one unused for longest comes first
                    k, (a, b, n) = own.popitem(last=False)
                    out.append((k, a, b, n, "expired"))
                if sid not in own and len(own) >= most:
                    k, (a, b, n) = own.popitem(last=False)
                    out.append((k, a, b, n, "evicted"))
                a, _, n = own.pop(sid, (t, t, 0))
                own[sid] = (a, t, n + 1)
            yield flush()
        for own in open_.values():
            out += [(k, a, b, n, "open") for k, (a, b, n) in own.items()]
        yield flush()

    rows = accesses.select(F.pmod(F.xxhash64(F.col("session_id").cast("string")), F.lit(shards)).cast("int").alias("shard"), F.col("session_id").cast("string").alias("session_id"), F.unix_micros("ts").alias("t"))
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", "t", "session_id")
    found = dealt.mapInArrow(run, "session_id string, opened long, closed long, accesses long, reason string")
    return found.withColumn("opened", F.timestamp_micros("opened")).withColumn("closed", F.timestamp_micros("closed"))
