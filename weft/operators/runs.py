"""Run state as an append-only event history, folded to the present state."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.text import prefix_sums

STATES = ["pending", "running", "not_finished", "completed"]


def fold(events: DataFrame) -> DataFrame:
    """run_id, instance, status, started_at, completed_at, error of events(run_id, instance, seq, state, error[, thread_id]); thread_id if they have it.

    A state only moves up, so the status is the highest seen; started_at and thread_id are of the first running event before any end.
    """
    rank, threads = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state")), "thread_id" in events.columns
    first_end = F.min(F.when(rank >= 3, F.col("seq")))
    agg = events.groupBy("run_id", "instance").agg(
        F.max(rank).alias("r"), first_end.alias("e"), F.min(F.when(rank == 2, F.col("seq"))).alias("s"),
        F.max(F.when(F.col("state") == "completed", F.col("seq"))).alias("c"),
        F.min(F.when(F.col("state") == "not_finished", F.col("seq"))).alias("nf"),
        F.max_by("error", F.when(F.col("state") == "not_finished", F.col("seq"))).alias("err"),
        *([F.min_by("thread_id", F.when(rank == 2, F.col("seq"))).alias("t")] if threads else []),
    )
    started = F.col("e").isNull() | (F.col("s") < F.col("e"))
    return agg.select(
        "run_id", "instance", F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("r").cast("int")).alias("status"),
        F.when(started, F.col("s")).alias("started_at"),
        F.coalesce("c", "nf").alias("completed_at"), F.when(F.col("r") < 4, F.left("err", F.lit(1000))).alias("error"),
        *([F.when(started, F.col("t")).alias("thread_id")] if threads else []),
    )


def finalize(state: DataFrame) -> DataFrame:
    """run_id, active, status: a run is completed when nothing is pending or running, else interrupted."""
    active = F.count_if(F.col("status").isin("pending", "running"))
    return state.groupBy("run_id").agg(active.alias("active")).withColumn("run_status", F.when(F.col("active") == 0, "completed").otherwise("interrupted"))


def stale_to_not_finished(state: DataFrame, message: str) -> DataFrame:
    stale = F.col("status") == "running"
    return state.withColumn("error", F.when(stale, F.coalesce("error", F.lit(message))).otherwise(F.col("error"))).withColumn("status", F.when(stale, "not_finished").otherwise(F.col("status")))


def resumable(runs: DataFrame, file_hash: str, passes: int) -> DataFrame:
    """The newest run of the same file and passes that isn't completed; one row, or none."""
    same = (F.col("file_hash") == file_hash) & (F.col("passes") == passes) & (F.col("status") != "completed")
    return runs.where(same).orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(1)


def queue(items: DataFrame, passes: int, order: str) -> DataFrame:
    """instance_key, pass_index and queue_index of every item in every pass; `order` is a key of the items, and their place in it is a
    distributed prefix sum."""
    counted = items.groupBy(order).agg(F.count(F.lit(1)).alias("n"))
    n = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    placed = items.join(prefix_sums(counted, order, "n"), order).withColumn("pos", F.col("base") + 1)
    rows = placed.crossJoin(F.broadcast(n)).withColumn("pass_index", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(passes).cast("long"))))  # one row
    key = F.format_string("pass-%04d:simulation-%06d", "pass_index", "pos")
    return rows.withColumn("queue_index", (F.col("pass_index") - 1) * F.col("all") + F.col("pos")).withColumn("instance_key", key).drop("base", "all")


def create(run_id: str, file_hash: str, file_path: str, passes: int, items: DataFrame, args: dict, now: Column) -> tuple[DataFrame, DataFrame]:
    """(run, instances): a running run and its pending instances, of queued items(instance_key, simulation_id, pass_index, queue_index, persona_id)."""
    null = lambda name: F.lit(None).cast("string").alias(name)
    text = F.lit(json.dumps(args, ensure_ascii=False, sort_keys=True))
    run = items.agg(F.count(F.lit(1)).alias("total_instances")).select(
        F.lit(run_id).alias("run_id"), F.lit(file_hash).alias("prompts_file_hash"), F.lit(file_path).alias("prompts_file_path"), F.lit(passes).alias("passes"),
        "total_instances", F.lit("running").alias("status"), now.alias("created_at"), now.alias("updated_at"), text.alias("args_json"),
    )
    own = ["instance_key", "simulation_id", "pass_index", "queue_index", "persona_id"]
    times = [now.alias("created_at"), now.alias("updated_at")]
    instances = items.select(F.lit(run_id).alias("run_id"), *own, null("thread_id"), F.lit("pending").alias("status"), *times, null("started_at"), null("completed_at"), null("error"))
    return run, instances


SECRET_FREE_ARGS = ("prompts_file", "passes", "sequencial", "window_size", "api_url", "use_thinking", "break_probability", "break_min", "break_max", "no_simulate_delays")


def args_snapshot(args: dict) -> dict:
    """The arguments of a run that may be kept: those of the list, no others."""
    return {k: args[k] for k in SECRET_FREE_ARGS if k in args}


def pending(instances: DataFrame, run_id) -> DataFrame:
    """A run's pending instances, in the order of the queue. Only these are taken up again: work that was started is never repeated."""
    return instances.where((F.col("run_id") == run_id) & (F.col("status") == "pending")).orderBy("queue_index")


def interrupt(instances: DataFrame, runs: DataFrame, run_id, message: str) -> tuple[DataFrame, DataFrame]:
    """(instances, runs) with the run's running instances not finished and the run interrupted."""
    own = (F.col("run_id") == run_id) & (F.col("status") == "running")
    ends = instances.withColumn("error", F.when(own, F.coalesce("error", F.lit(message))).otherwise(F.col("error")))
    ends = ends.withColumn("status", F.when(own, "not_finished").otherwise(F.col("status")))
    return ends, runs.withColumn("status", F.when(F.col("run_id") == run_id, "interrupted").otherwise(F.col("status")))


def compatible(runs: DataFrame, file_hash: str, passes: int) -> DataFrame:
    """Runs of the same file and passes that aren't completed."""
    return runs.where((F.col("prompts_file_hash") == file_hash) & (F.col("passes") == passes) & (F.col("status") != "completed"))


class CompatibleRunExists(RuntimeError):
    pass


def refuse_second(runs: DataFrame, file_hash: str, passes: int) -> None:
    """Raises where a new run would stand beside a compatible one that isn't completed."""
    n = compatible(runs, file_hash, passes).count()
    if n:
        raise CompatibleRunExists(f"{n} compatible runs aren't completed")


def to_execute(open_: DataFrame, planned: DataFrame) -> DataFrame:
    """The planned items of pending instances, by instance_key; a pending one that isn't planned is an error."""
    missing = open_.join(planned, "instance_key", "left_anti").limit(1).collect()
    if missing:
        raise KeyError(f"{missing[0]['instance_key']} isn't in the plan")
    return planned.join(open_.select("instance_key"), "instance_key").orderBy("queue_index")


# Fixed values of the contract: what makes a queue stop.
ABORT_CLASSES = ["APIConnectionError", "APIStatusError", "APITimeoutError", "AuthenticationError", "RateLimitError"]
ABORT_STATUS = [401, 429, 502, 503, 504]
ABORT_MARKERS = ["incorrect api key", "invalid_api_key", "insufficient_quota", "rate limit", "quota", "billing", "429"]
CONNECTION_CLASSES = ["ConnectionError", "Timeout"]


def is_abort(error_class: Column, status: Column, response: Column, text: Column) -> Column:
    """Whether an error of a chain is the whole queue's: by its class, an HTTP status, the response's text, or a refused key."""
    low, said = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(response, F.lit("")))
    named = F.coalesce(error_class.isin(*ABORT_CLASSES, *CONNECTION_CLASSES), F.lit(False))
    http = F.coalesce((error_class == "HTTPError") & status.isin(*ABORT_STATUS), F.lit(False))
    marked = F.exists(F.array(*[F.lit(m) for m in ABORT_MARKERS]), lambda m: F.contains(said, m))
    key = low.contains("invalid_api_key") | low.contains("incorrect api key")
    return named | http | marked | (key & low.contains("401"))


def aborted(errors: DataFrame) -> DataFrame:
    """key, abort: whether any error of a chain (key, error_class, status, response, text) stops the queue."""
    return errors.groupBy("key").agg(F.bool_or(is_abort(F.col("error_class"), F.col("status"), F.col("response"), F.col("text"))).alias("abort"))


def severity(line: Column) -> Column:
    """By the contract's fixed words, errors before warnings."""
    low = F.lower(line)
    return F.when(low.rlike("error|exception|traceback|erro|failed|fatal"), "ERRO").when(low.rlike("warning|warn|aviso"), "AVISO").otherwise("INFO")


def paced(calls: DataFrame, key: str, max_calls: int = 10, seconds: int = 60) -> DataFrame:
    """calls(key, event_id, ts) with earlier (calls of the key in the `seconds` before), limited (none left), and wait: the seconds until the
    oldest leaves the window; three quarters of them where one or two calls are left; else zero."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-seconds * 1_000_000, -1)
    left = (F.min("_t").over(w) + seconds * 1_000_000 - F.col("_t")) / 1e6
    rows = calls.withColumn("_t", micros).withColumn("earlier", F.count(F.lit(1)).over(w)).withColumn("_left", F.greatest(left, F.lit(0.0)))
    wait = F.when(F.col("earlier") >= max_calls, F.col("_left")).when(F.col("earlier") >= max_calls - 2, F.col("_left") * 0.75).otherwise(0.0)
    return rows.withColumn("limited", F.col("earlier") >= max_calls).withColumn("wait", F.coalesce(wait, F.lit(0.0))).drop("_t", "_left")
