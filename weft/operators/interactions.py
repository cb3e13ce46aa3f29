"""Conversations kept as checkpoints: listing, simple and raw views, message rows, exports with an index, and their RAG logs.

checkpoints(thread_id, checkpoint_id, parent_checkpoint_id, type, checkpoint): the checkpoint is JSON text (type 'json') of the state
below; anything else is an error row of the flat export and no conversation elsewhere. Messages of kind human are the bank's, those of
kind ai the simulated user's: exports say ai and human the other way round, the simple view doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE = (
    "struct<kind:string,content:string,id:string,"
    "timing:struct<simulated_timestamp:string,thinking_time:double,typing_time:double,break_time:double,banco_generation_timestamp:string,banco_generation_elapsed_time:double>,"
    "response:struct<model_name:string,finish_reason:string,total_tokens:bigint,prompt_tokens:bigint,completion_tokens:bigint>>"
)
STATE = f"struct<ts:string,channel_values:struct<persona_id:string,messages:array<{MESSAGE}>>>"
FLAT = [
    "thread_id", "checkpoint_id", "parent_checkpoint_id", "timestamp", "message_index", "message_type", "message_id", "content", "model_name",
    "total_tokens", "prompt_tokens", "completion_tokens", "finish_reason",
]
EXPORT_VERSION = "2.1"
EXECUTION = ("run_id", "simulation_id", "pass_index", "queue_index")


def decoded(checkpoints: DataFrame) -> DataFrame:
    """checkpoints with state, and error where the checkpoint isn't readable."""
    state = F.from_json("checkpoint", STATE)
    whole = checkpoints.withColumn("state", F.when(F.col("type") == "json", state))
    broken = F.when(F.col("checkpoint").isNull(), "empty checkpoint").when(F.coalesce(F.col("type") != "json", F.lit(True)), F.concat(F.lit("unknown type "), F.coalesce("type", F.lit("null"))))
    broken = broken.when(F.try_parse_json("checkpoint").isNull() | F.col("state").isNull(), "malformed checkpoint")
    return whole.withColumn("error", broken)


def first_last(checkpoints: DataFrame) -> DataFrame:
    """thread_id, first, last: the rows of the least and the greatest checkpoint_id, by one partial aggregate; null checkpoints count."""
    row = F.struct("type", "checkpoint")
    return checkpoints.groupBy("thread_id").agg(F.min_by(row, "checkpoint_id").alias("first"), F.max_by(row, "checkpoint_id").alias("last"))


def listed(checkpoints: DataFrame) -> DataFrame:
    """thread_id, ts of each thread's first checkpoint, by ts as text; threads whose first checkpoint is null or has no ts are left out."""
    first = decoded(first_last(checkpoints).select("thread_id", "first.*"))
    return first.where(F.col("checkpoint").isNotNull() & F.col("state.ts").isNotNull()).select("thread_id", F.col("state.ts").alias("ts")).orderBy("ts", "thread_id")


def conversations(checkpoints: DataFrame) -> DataFrame:
    """thread_id, persona_id, ts, messages of each thread's last checkpoint; threads where that is null or unreadable are left out."""
    last = decoded(first_last(checkpoints).select("thread_id", "last.*")).where(F.col("error").isNull())
    values = F.col("state.channel_values")
    return last.select("thread_id", values["persona_id"].alias("persona_id"), F.col("state.ts").alias("ts"), F.coalesce(values["messages"], F.array().cast(f"array<{MESSAGE}>")).alias("messages"))


def raw(checkpoints: DataFrame, thread_id: str) -> DataFrame:
    """The last state of one thread as it is; no row if there is none."""
    return decoded(checkpoints.where(F.col("thread_id") == thread_id)).where("error IS NULL").groupBy("thread_id").agg(F.max_by("state", "checkpoint_id").alias("state"))


def simple(conv: DataFrame) -> DataFrame:
    """thread_id, messages array<struct<content, type>>, the kinds as they are stored."""
    kind = lambda m: F.when(m["kind"].isin("human", "ai"), m["kind"]).otherwise("other")
    return conv.select("thread_id", F.transform("messages", lambda m: F.struct(m["content"].alias("content"), kind(m).alias("type"))).alias("messages"))


def message_rows(conv: DataFrame) -> DataFrame:
    """A row a message: thread_id, persona_id, index, type (turned round), content, simulated_timestamp, elapsed_time, message_id (null if empty),
    ordinal (running number of the bank's messages after the greeting at index 0; null for others), timing."""
    each = conv.select("thread_id", "persona_id", F.posexplode("messages").alias("index", "m"))
    bank, user = F.col("m.kind") == "human", F.col("m.kind") == "ai"
    zero = lambda c: F.coalesce(F.col(f"m.timing.{c}"), F.lit(0.0))
    counted = bank & (F.col("index") > 0)
    run = Window.partitionBy("thread_id").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.select(
        "thread_id", "persona_id", "index", F.when(bank, "ai").when(user, "human").otherwise("other").alias("type"), F.coalesce("m.content", F.lit("")).alias("content"),
        F.coalesce(F.when(bank, F.col("m.timing.banco_generation_timestamp")).when(user, F.col("m.timing.simulated_timestamp")), F.lit("")).alias("simulated_timestamp"),
        F.when(bank, zero("banco_generation_elapsed_time")).when(user, zero("thinking_time") + zero("typing_time") + zero("break_time")).otherwise(0.0).alias("elapsed_time"),
        F.nullif("m.id", F.lit("")).alias("message_id"), F.when(counted, F.sum(counted.cast("long")).over(run)).alias("ordinal"), F.col("m.timing").alias("timing"),
    )


def flatten_all(checkpoints: DataFrame) -> DataFrame:
    """The 13 columns of every message of every checkpoint; a checkpoint without messages gives one row with empty ones, an unreadable one a
    row with index -1 and type error."""
    rows = decoded(checkpoints)
    message = F.explode_outer(F.arrays_zip(F.sequence(F.lit(0), F.greatest(F.size("state.channel_values.messages") - 1, F.lit(0))).alias("i"), F.col("state.channel_values.messages").alias("m")))
    each = rows.withColumn("e", message).withColumn("m", F.col("e.m"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    model = lambda c: F.when(F.col("m.kind") == "ai", text(f"m.response.{c}")).otherwise("")
    fine = F.col("error").isNull()
    has = F.col("m").isNotNull()
    values = {
        "parent_checkpoint_id": text("parent_checkpoint_id"), "timestamp": F.when(fine, text("state.ts")).otherwise(""),
        "message_index": F.when(~fine, "-1").when(has, F.col("e.i").cast("string")).otherwise(""),
        "message_type": F.when(~fine, "error").when(F.col("m.kind").isin("human", "ai"), F.col("m.kind")).otherwise(""),
        "message_id": text("m.id"), "content": F.when(~fine, F.concat(F.lit("Erro: "), F.col("error"))).otherwise(text("m.content")),
    }
    return each.select(*[(values[c] if c in values else F.col(c) if c in ("thread_id", "checkpoint_id") else model(c)).alias(c) for c in FLAT])


# ---- execution metadata and export -----------------------------------------------------------------------------------


def execution_fields(rows: DataFrame, status: str = "status") -> DataFrame:
    """rows with execution_status, finished, not_finished from a left-joined status: unknown and two nulls where there was no match."""
    s = F.col(status)
    return rows.withColumn("execution_status", F.coalesce(s, F.lit("unknown"))).withColumn("finished", s == "completed").withColumn("not_finished", s == "not_finished")


def of_threads(instances: DataFrame) -> DataFrame:
    """One row of metadata a thread, of instances(run_id, ..., queue_index, thread_id, status): of several the last one queued."""
    own = [*EXECUTION, "persona_id", "status"]
    by = instances.where("thread_id IS NOT NULL").groupBy("thread_id")
    return by.agg(F.max_by(F.struct(*own), F.struct("run_id", "queue_index")).alias("x")).select("thread_id", F.col("x.persona_id").alias("own_persona"), *[f"x.{c}" for c in own if c != "persona_id"])


def without_checkpoints(instances: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Instances that are not finished and whose thread is null or has no checkpoint but null ones. Null keys survive an anti join."""
    kept = checkpoints.where("checkpoint IS NOT NULL").select("thread_id").distinct()
    return instances.where("status = 'not_finished'").join(kept, "thread_id", "left_anti")


def placeholders(open_: DataFrame) -> DataFrame:
    """An empty conversation for each of them; an empty persona or thread counts as none."""
    own = F.concat_ws("_", F.lit("sem_checkpoint"), "run_id", "instance_key")
    persona, thread = F.coalesce(F.nullif("persona_id", F.lit("")), F.lit("unknown")), F.coalesce(F.nullif("thread_id", F.lit("")), own)
    rows = open_.select(thread.alias("thread_id"), persona.alias("persona_id"), F.lit(None).cast("string").alias("conversation_timestamp"), F.lit(0).alias("total_messages"), *EXECUTION, "status")
    return execution_fields(rows).drop("status").withColumn("filename", F.format_string("conversa_%s_%s.json", "persona_id", "thread_id"))


def export_index(conv: DataFrame, instances: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """A row for each exported conversation and placeholder: thread_id, persona_id, conversation_timestamp, total_messages, filename, execution."""
    rows = conv.join(of_threads(instances), "thread_id", "left")
    rows = rows.select("thread_id", "persona_id", F.col("ts").alias("conversation_timestamp"), F.size("messages").alias("total_messages"), *EXECUTION, "status")
    done = execution_fields(rows).drop("status").withColumn("filename", F.format_string("conversa_%s_%s.json", F.coalesce("persona_id", F.lit("None")), "thread_id"))
    return done.unionByName(placeholders(without_checkpoints(instances, checkpoints)))


def exported(conv: DataFrame, instances: DataFrame, checkpoints: DataFrame, sources: DataFrame | None, at: str) -> DataFrame:
    """thread_id, filename, body: the JSON of every conversation and placeholder; fields that are null stay, an empty message_id doesn't come.
    sources(thread_id, ordinal, datasources) are those of the bank's messages. A conversation is one document, so one row."""
    rows = message_rows(conv)
    if sources is not None:
        rows = rows.join(sources, ["thread_id", "ordinal"], "left")
    else:
        rows = rows.withColumn("datasources", F.lit(None).cast("array<string>"))
    used = F.when(F.col("type") == "ai", F.when(F.col("index") == 0, F.array().cast("array<string>")).otherwise(F.coalesce("datasources", F.array().cast("array<string>"))))
    message = F.struct("index", "type", "content", "simulated_timestamp", "elapsed_time", F.col("timing").alias("timing_metadata"), "message_id", used.alias("rag_datasources"))
    messages = rows.groupBy("thread_id").agg(F.sort_array(F.collect_list(message)).alias("messages"))
    out = export_index(conv, instances, checkpoints).join(messages, "thread_id", "left")
    meta = F.struct(F.lit(at).alias("export_timestamp"), F.lit(EXPORT_VERSION).alias("export_version")).alias("metadata")
    messages = F.coalesce("messages", F.array()).alias("messages")
    body = F.struct("thread_id", "persona_id", "conversation_timestamp", "total_messages", messages, meta, *EXECUTION, "execution_status", "finished", "not_finished")
    return out.select("thread_id", "filename", F.to_json(body, {"ignoreNullFields": "true"}).alias("body"))


# ---- RAG logs -------------------------------------------------------------------------------------------------------


def log_names(files: DataFrame, path: str = "path") -> DataFrame:
    """files with persona_id, log_thread and at, read off rag_logs_{persona}_{thread}_{YYYYMMDD}_{HHMMSS}.zip; null for other names."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.zip$", "")
    parts = F.split(name, "_")
    fit = name.startswith("rag_logs_") & (F.size(parts) >= 6)
    at = F.try_to_timestamp(F.concat(F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1)), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    persona = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 5, F.lit(0))), "_")
    return files.withColumn("persona_id", F.when(fit, persona)).withColumn("log_thread", F.when(fit, F.get(parts, F.size(parts) - 3))).withColumn("at", F.when(fit, at))


def nearest_logs(times: DataFrame, logs: DataFrame, width: int) -> DataFrame:
    """times(t, ...) with best (d, log_id) of the nearest of logs(lt, log_id) less than `width` away, ties to the least log_id; null without one.

    Nearest are the last log until t and the first one from t on. Both are in the time's bin of `width`, or are the last log of the bin before
    or the first one of the bin after, so each row goes through its own bin once and no pairs are made, however dense the times are."""
    at = lambda c: F.floor(F.col(c) / width)
    own = logs.groupBy("lt").agg(F.min("log_id").alias("log_id")).select(at("lt").alias("bin"), F.struct("lt", "log_id").alias("l"))
    ends = own.groupBy("bin").agg(F.min("l").alias("first"), F.max("l").alias("last"))
    ends = ends.select(F.explode(F.array(*[F.struct((F.col("bin") + d).alias("bin"), F.col(c).alias("l")) for d, c in ((-1, "first"), (1, "last"))])).alias("e")).select("e.*")
    marks = own.unionByName(ends).withColumn("t", F.col("l.lt"))
    rows = times.withColumn("bin", at("t")).withColumn("wanted", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    until = lambda *by: Window.partitionBy("bin").orderBy(*by).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("before", F.max("l").over(until("t"))).withColumn("after", F.min("l").over(until(F.desc("t")))).where("wanted")
    near = lambda c: F.struct(F.abs(F.col("t") - F.col(f"{c}.lt")).alias("d"), F.col(f"{c}.log_id").alias("log_id"))
    best = F.array_min(F.filter(F.array(near("before"), near("after")), lambda x: x["d"] < width))
    return rows.withColumn("best", best).select(*times.columns, "best")


def log_of(conv: DataFrame, logs: DataFrame, mapping: DataFrame | None = None, minutes: int = 30) -> DataFrame:
    """thread_id, log_id, via: each conversation's log by its (mapped) thread, else the newest of its persona, else the nearest within `minutes`.

    conv(thread_id, persona_id, ts timestamp_ntz), logs(log_id, log_thread, persona_id, at); ties go to the least log_id.
    """
    if mapping is not None:
        conv = conv.join(mapping.groupBy("thread_id").agg(F.max("mapped").alias("mapped")), "thread_id", "left").withColumn("key", F.coalesce("mapped", "thread_id"))
    else:
        conv = conv.withColumn("key", F.col("thread_id"))
    newest = lambda *by: logs.groupBy(*by).agg(F.max(F.struct("at", "log_id"))["log_id"].alias("l"))
    exact = newest("log_thread").select(F.col("log_thread").alias("key"), F.col("l").alias("by_thread"))
    # Conversations without a persona match nothing there; they are dealt out, as one key would take them all to one task.
    persona = newest("persona_id").where("persona_id IS NOT NULL").select("persona_id", F.lit(0).alias("salt"), F.col("l").alias("by_persona"))
    salt = F.when(F.col("persona_id").isNull(), F.pmod(F.hash("thread_id"), F.lit(1 << 16))).otherwise(0)
    width = minutes * 60_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    c = conv.join(exact, "key", "left").withColumn("salt", salt).join(persona, ["persona_id", "salt"], "left")
    left = c.where("by_thread IS NULL AND by_persona IS NULL AND ts IS NOT NULL").select("thread_id", micros("ts").alias("t"))
    near = logs.where("at IS NOT NULL").select("log_id", micros("at").alias("lt"))
    found = nearest_logs(left, near, width).where("best IS NOT NULL").groupBy("thread_id").agg(F.min("best")["log_id"].alias("by_time"))
    via = F.when(F.col("by_thread").isNotNull(), "thread").when(F.col("by_persona").isNotNull(), "persona").when(F.col("by_time").isNotNull(), "time").otherwise("none")
    return c.join(found, "thread_id", "left").select("thread_id", F.coalesce("by_thread", "by_persona", "by_time").alias("log_id"), via.alias("via"))


def datasources(lines: DataFrame) -> DataFrame:
    """log_id, ordinal, datasources of log lines(log_id, ordinal, message, selected): the sorted distinct selections of routing decisions, or
    ["none"] where a fallback answered and nothing was selected."""
    routed = F.when(F.col("message") == "Routing decision", F.nullif("selected", F.lit("")))
    fell = F.col("message").contains("Generating fallback response") | F.col("message").startswith("Starting FallbackFunction")
    by = lines.groupBy("log_id", "ordinal").agg(F.array_sort(F.collect_set(routed)).alias("s"), F.bool_or(F.coalesce(fell, F.lit(False))).alias("f"))
    return by.select("log_id", "ordinal", F.when(F.col("f") & (F.size("s") == 0), F.array(F.lit("none"))).otherwise(F.col("s")).alias("datasources"))


def mapping_counts(known: DataFrame, updates: DataFrame, checkpoints: DataFrame, logs: DataFrame) -> DataFrame:
    """updated, total mappings after an update (thread_id, mapped), and distinct threads of the store and of the logs."""
    one = lambda df, what, name: df.agg(what.alias(name))
    both = known.select("thread_id").unionByName(updates.select("thread_id"))
    parts = [one(updates, F.count(F.lit(1)), "updated"), one(both, F.count_distinct("thread_id"), "total"), one(checkpoints, F.count_distinct("thread_id"), "threads"), one(logs, F.count_distinct("log_thread"), "log_threads")]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.crossJoin(p)
    return out


def ended(conv: DataFrame) -> DataFrame:
    """thread_id, ended_at: the index of the first message that ends a conversation: the bank's is quit, or the user's contains it."""
    text = F.lower("content")
    ends = F.when(F.col("type") == "ai", F.trim(text) == "quit").when(F.col("type") == "human", text.contains("quit"))
    return message_rows(conv).groupBy("thread_id").agg(F.min(F.when(ends, F.col("index"))).alias("ended_at"))


def iso_timestamp(c: Column) -> Column:
    """ISO text as UTC time (Z and offsets too), else yyyy-MM-dd HH:mm:ss; null where neither fits, never the present."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")))
