"""Queries over stored conversations, their RAG logs, runs and sessions. The test tables stand for the store: a conversation is a thread of two
checkpoints, its first turn and all of it; a few are null, malformed or of an unknown type."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.scratch import scratch
from weft.functions.text import accepted_prompt, id_of_name, or_default, typing_seconds, underscored, words
from weft.operators import eventlog, interactions, runs
from weft.plans.catalog import _events, query, read
from weft.sources import files, sinks
from weft.streaming.sessions import capped, idle

# ---- the store ------------------------------------------------------------------------------------------------------


def _messages(spark, sf):
    role = F.col("role")
    bank, user = role == "assistant", role == "user"
    stamp = F.date_format(F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("conv_id") % 100_000).cast("int"), secs=F.col("turn").cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.coalesce("text", F.lit(""))
    timing = F.struct(
        F.when(user, stamp).alias("simulated_timestamp"), F.when(user, F.lit(1.5)).alias("thinking_time"), F.when(user, words(text) * 0.5).alias("typing_time"),
        F.when(bank, stamp).alias("banco_generation_timestamp"), F.when(bank, F.length(text) / 8).alias("banco_generation_elapsed_time"),
    )
    usage = F.struct(F.lit("m").alias("model_name"), F.lit("stop").alias("finish_reason"), F.length(text).cast("long").alias("total_tokens"))
    own_id = F.when(F.col("turn") % 2 == 0, F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).otherwise("")
    m = F.struct(F.when(bank, "human").when(user, "ai").otherwise("system").alias("kind"), text.alias("content"), own_id.alias("id"), timing.alias("timing"), F.when(user, usage).alias("response"))
    return read(spark, sf, "conversations").select("conv_id", "turn", m.alias("m"))


def checkpoints(spark, sf):
    by = _messages(spark, sf).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "m"))).alias("ms"))
    ms = F.transform("ms", lambda x: x["m"])
    c = F.col("conv_id")
    ts = F.date_format(F.lit("2026-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(c % 100_000).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    state = lambda messages: F.to_json(F.struct(ts.alias("ts"), F.struct(F.concat(F.lit("persona_"), (c % 7).cast("string")).alias("persona_id"), messages.alias("messages")).alias("channel_values")))
    first = by.select(F.concat(F.lit("t"), c.cast("string")).alias("thread_id"), F.lit("c0").alias("checkpoint_id"), F.lit(None).cast("string").alias("parent_checkpoint_id"), F.lit("json").alias("type"), state(F.slice(ms, 1, 1)).alias("checkpoint"))
    odd = F.when(c % 50 == 48, F.lit(None).cast("string")).when(c % 50 == 49, "{").otherwise(state(ms))
    kind = F.when(c % 50 == 47, "msgpack").otherwise("json")
    last = by.select(F.concat(F.lit("t"), c.cast("string")).alias("thread_id"), F.lit("c1").alias("checkpoint_id"), F.lit("c0").alias("parent_checkpoint_id"), kind.alias("type"), odd.alias("checkpoint"))
    return first.unionByName(last)


def instances(spark, sf):
    """An instance for each conversation; of every tenth the thread is null."""
    c = F.col("conv_id")
    status = F.element_at(F.array(*[F.lit(s) for s in runs.STATES]), ((c % 4) + 1).cast("int"))
    rows = read(spark, sf, "conversations").select("conv_id").distinct()
    return rows.select(
        F.concat(F.lit("r"), (c % 3).cast("string")).alias("run_id"), F.format_string("pass-0001:simulation-%06d", c).alias("instance_key"), c.alias("simulation_id"), F.lit(1).cast("long").alias("pass_index"),
        c.alias("queue_index"), F.when(c % 20 == 3, "").otherwise(F.concat(F.lit("persona_"), (c % 7).cast("string"))).alias("persona_id"),
        F.when(c % 10 != 3, F.concat(F.lit("t"), c.cast("string"))).alias("thread_id"), status.alias("status"), F.lit(None).cast("string").alias("error"),
    )


_MS = r"""m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx,
strftime(TIMESTAMP '2026-01-01 00:00:00' + to_minutes(conv_id % 100000) + to_seconds(turn), '%Y-%m-%dT%H:%M:%S') AS stamp,
len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+'))::BIGINT AS words, CASE WHEN turn % 2 = 0 THEN conv_id || '-' || turn ELSE '' END AS mid FROM conversations),
g AS (SELECT conv_id, 't' || conv_id AS thread_id, 'persona_' || conv_id % 7 AS persona_id, strftime(TIMESTAMP '2026-01-01 00:00:00' + to_minutes(conv_id % 100000), '%Y-%m-%dT%H:%M:%S') AS ts, count(*) AS n FROM m GROUP BY conv_id)"""
_INST = """i AS (SELECT 'r' || conv_id % 3 AS run_id, printf('pass-0001:simulation-%06d', conv_id) AS instance_key, conv_id AS simulation_id, 1::BIGINT AS pass_index, conv_id AS queue_index,
CASE WHEN conv_id % 20 = 3 THEN '' ELSE 'persona_' || conv_id % 7 END AS persona_id, CASE WHEN conv_id % 10 <> 3 THEN 't' || conv_id END AS thread_id,
['pending', 'running', 'not_finished', 'completed'][conv_id % 4 + 1] AS status FROM (SELECT DISTINCT conv_id FROM conversations))"""


@query(f"WITH {_MS} SELECT thread_id, ts FROM g")
def interactions_list(spark, sf):
    return interactions.listed(checkpoints(spark, sf))


@query(f"""WITH {_MS} SELECT thread_id, count(*) AS n, md5(string_agg(CASE role WHEN 'assistant' THEN 'human' WHEN 'user' THEN 'ai' ELSE 'other' END || ':' || text, '|' ORDER BY turn)) AS digest
FROM m JOIN g USING (conv_id) WHERE conv_id % 50 < 47 GROUP BY thread_id""")
def interactions_simple(spark, sf):
    rows = interactions.simple(interactions.conversations(checkpoints(spark, sf)))
    flat = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["type"], m["content"])), "|")
    return rows.select("thread_id", F.size("messages").cast("long").alias("n"), F.md5(flat).alias("digest"))


@query(f"""WITH {_MS} SELECT thread_id, persona_id, idx::INT AS "index", CASE role WHEN 'assistant' THEN 'ai' WHEN 'user' THEN 'human' ELSE 'other' END AS type, md5(text) AS content,
CASE WHEN role IN ('assistant', 'user') THEN stamp ELSE '' END AS simulated_timestamp, CASE role WHEN 'assistant' THEN length(text) / 8.0::DOUBLE WHEN 'user' THEN 1.5::DOUBLE + words * 0.5::DOUBLE ELSE 0.0::DOUBLE END AS elapsed_time,
nullif(mid, '') AS message_id, CASE WHEN role = 'assistant' AND idx > 0 THEN (sum(CASE WHEN role = 'assistant' AND idx > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT END AS ordinal
FROM m JOIN g USING (conv_id) WHERE conv_id % 50 < 47""")
def interactions_rows(spark, sf):
    rows = interactions.message_rows(interactions.conversations(checkpoints(spark, sf)))
    return rows.drop("timing").withColumn("content", F.md5("content"))


@query(f"""WITH {_MS}, r AS (SELECT *, 'c1' AS checkpoint_id, 'c0' AS parent FROM m WHERE conv_id % 50 < 47 UNION ALL SELECT *, 'c0', '' FROM m WHERE idx = 0)
SELECT 't' || conv_id AS thread_id, checkpoint_id, parent AS parent_checkpoint_id, ts AS "timestamp", idx::VARCHAR AS message_index, CASE role WHEN 'assistant' THEN 'human' WHEN 'user' THEN 'ai' ELSE '' END AS message_type,
mid AS message_id, md5(text) AS content, CASE role WHEN 'user' THEN 'm' ELSE '' END AS model_name, CASE role WHEN 'user' THEN length(text)::VARCHAR ELSE '' END AS total_tokens, '' AS prompt_tokens, '' AS completion_tokens,
CASE role WHEN 'user' THEN 'stop' ELSE '' END AS finish_reason FROM r JOIN g USING (conv_id)
UNION ALL SELECT thread_id, 'c1', 'c0', '', '-1', 'error', '', md5('Erro: ' || ['unknown type msgpack', 'empty checkpoint', 'malformed checkpoint'][conv_id % 50 - 46]), '', '', '', '', '' FROM g WHERE conv_id % 50 >= 47""")
def checkpoints_flat(spark, sf):
    return interactions.flatten_all(checkpoints(spark, sf)).withColumn("content", F.md5("content"))


@query(f"""WITH {_MS}, {_INST}
SELECT g.thread_id, g.persona_id, ts AS conversation_timestamp, n::INT AS total_messages, run_id, simulation_id, pass_index, queue_index, coalesce(status, 'unknown') AS execution_status,
status = 'completed' AS finished, status = 'not_finished' AS not_finished, 'conversa_' || g.persona_id || '_' || g.thread_id || '.json' AS filename
FROM g LEFT JOIN i ON i.thread_id = g.thread_id WHERE conv_id % 50 < 47
UNION ALL SELECT t, p, NULL, 0, run_id, simulation_id, pass_index, queue_index, status, false, true, 'conversa_' || p || '_' || t || '.json'
FROM (SELECT *, coalesce(thread_id, 'sem_checkpoint_' || run_id || '_' || instance_key) AS t, coalesce(nullif(persona_id, ''), 'unknown') AS p FROM i WHERE status = 'not_finished' AND thread_id IS NULL)""")
def export_index(spark, sf):
    """Exported conversations and placeholders of instances that are not finished and have no checkpoint."""
    c = checkpoints(spark, sf)
    return interactions.export_index(interactions.conversations(c), instances(spark, sf), c)


@query(f"""WITH {_MS} SELECT thread_id, min(idx) FILTER ((role = 'assistant' AND trim(lower(text)) = 'quit') OR (role = 'user' AND contains(lower(text), 'quit')))::INT AS ended_at
FROM m JOIN g USING (conv_id) WHERE conv_id % 50 < 47 GROUP BY thread_id""")
def conversation_end(spark, sf):
    return interactions.ended(interactions.conversations(checkpoints(spark, sf)))


@query(f"""WITH {_MS} SELECT 'conversa_' || persona_id || '_' || thread_id || '.csv' AS filename, count(*) AS lines, max(length(text))::INT AS longest FROM m JOIN g USING (conv_id) WHERE conv_id % 50 < 47 GROUP BY filename""")
def conversation_csvs(spark, sf):
    """The CSV of every conversation, read back: its messages and the longest one."""
    made = sinks.conversation_csvs(interactions.message_rows(interactions.conversations(checkpoints(spark, sf))))
    fields = F.from_csv("line", F.lit("type STRING, content STRING, simulated_timestamp STRING, elapsed_time DOUBLE"), {"escape": '"', "multiLine": "true"})
    # A record ends where its line does and no quote is open. Possessive, as the engine goes a call deeper for each repetition it may take back.
    whole = F.regexp_extract_all("body", F.lit('((?:[^"\\n]++|"[^"]*+")++)\\n'), F.lit(1))
    each = made.select("filename", F.explode(F.slice(whole, F.lit(2), F.size(whole))).alias("line"))
    return each.groupBy("filename").agg(F.count(F.lit(1)).alias("lines"), F.max(F.length(F.coalesce(fields["content"], F.lit("")))).alias("longest"))


# ---- RAG logs -------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT 'e' || event_id AS thread_id, 'p' || user_id AS persona_id, ts, CASE WHEN event_id % 5 = 0 THEN 'e' || (event_id + 1) ELSE 'e' || event_id END AS key FROM events WHERE event_type = 'purchase' AND user_id % 3 <> 2
UNION ALL SELECT 'e' || event_id, NULL, ts, 'e' || event_id FROM events WHERE event_type = 'purchase' AND user_id % 3 = 2),
l AS (SELECT 'l' || lpad(event_id::VARCHAR, 12, '0') AS log_id, 'e' || event_id AS log_thread, 'p' || user_id AS persona_id, date_trunc('second', ts) AS tm FROM events WHERE event_type = 'error'),
t AS (SELECT log_thread, arg_max(log_id, (tm, log_id)) AS x FROM l GROUP BY 1), p AS (SELECT persona_id, arg_max(log_id, (tm, log_id)) AS x FROM l GROUP BY 1),
o AS (SELECT c.*, t.x AS by_thread, p.x AS by_persona FROM c LEFT JOIN t ON t.log_thread = c.key LEFT JOIN p ON p.persona_id = c.persona_id),
n AS (SELECT thread_id, log_id, row_number() OVER (PARTITION BY thread_id ORDER BY abs(epoch_us(ts) - epoch_us(tm)), log_id) AS r FROM o JOIN l ON by_thread IS NULL AND by_persona IS NULL AND tm > ts - INTERVAL 30 MINUTE AND tm < ts + INTERVAL 30 MINUTE)
SELECT o.thread_id, coalesce(by_thread, by_persona, n.log_id) AS log_id, CASE WHEN by_thread IS NOT NULL THEN 'thread' WHEN by_persona IS NOT NULL THEN 'persona' WHEN n.log_id IS NOT NULL THEN 'time' ELSE 'none' END AS via
FROM o LEFT JOIN n ON n.thread_id = o.thread_id AND r = 1""")
def log_cascade_full(spark, sf):
    """The log of each conversation: by its mapped thread, its persona, or the nearest time."""
    ev = read(spark, sf, "events")
    e = lambda x: F.concat(F.lit("e"), x.cast("string"))
    bought = ev.where("event_type = 'purchase'")
    conv = bought.select(e(F.col("event_id")).alias("thread_id"), F.when(F.col("user_id") % 3 != 2, F.concat(F.lit("p"), F.col("user_id").cast("string"))).alias("persona_id"), "ts")
    mapping = bought.where("event_id % 5 = 0 and user_id % 3 <> 2").select(e(F.col("event_id")).alias("thread_id"), e(F.col("event_id") + 1).alias("mapped"))
    name = F.format_string("logs/rag_logs_p%d_e%d_%s.zip", "user_id", "event_id", F.date_format("ts", "yyyyMMdd_HHmmss"))
    logs = interactions.log_names(ev.where("event_type = 'error'").select(F.concat(F.lit("l"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("log_id"), name.alias("path")))
    return interactions.log_of(conv, logs, mapping)


@query("""SELECT 'u' || user_id AS log_id, event_id % 20 AS ordinal, CASE WHEN count(*) FILTER (event_type = 'click') = 0 AND bool_or(event_type = 'error') THEN 'none' ELSE coalesce(string_agg(DISTINCT 's' || event_id % 3, ',' ORDER BY 's' || event_id % 3) FILTER (event_type = 'click'), '') END AS datasources
FROM events GROUP BY 1, 2""")
def log_datasources(spark, sf):
    kind = F.col("event_type")
    message = F.when(kind == "click", "Routing decision").when(kind == "error", F.when(F.col("event_id") % 2 == 0, "Generating fallback response").otherwise("Starting FallbackFunction")).otherwise("Document retrieval")
    lines = read(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("log_id"), (F.col("event_id") % 20).alias("ordinal"), message.alias("message"), F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("selected"))
    return interactions.datasources(lines).withColumn("datasources", F.array_join("datasources", ","))


# ---- runs -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_INST} SELECT instance_key, queue_index, thread_id FROM i WHERE run_id = 'r1' AND status = 'pending'")
def run_pending(spark, sf):
    return runs.pending(instances(spark, sf), "r1").select("instance_key", "queue_index", "thread_id")


@query(f"""WITH {_INST} SELECT run_id, instance_key, CASE WHEN run_id = 'r1' AND status = 'running' THEN 'not_finished' ELSE status END AS status, CASE WHEN run_id = 'r1' AND status = 'running' THEN 'interrupted' END AS error FROM i""")
def run_interrupt(spark, sf):
    made = instances(spark, sf)
    out, _ = runs.interrupt(made, made.select("run_id", "status").distinct(), "r1", "interrupted")
    return out.select("run_id", "instance_key", "status", "error")


@query("""SELECT p_partkey AS simulation_id, x::BIGINT AS pass_index, 'new' AS run_id, 'pending' AS status, (x - 1) * count(*) OVER (PARTITION BY x) + row_number() OVER (PARTITION BY x ORDER BY p_partkey) AS queue_index FROM part, range(1, 3) r(x)""")
def run_create(spark, sf):
    """The pending instances of a new run of two passes."""
    items = runs.queue(read(spark, sf, "part").select(F.col("p_partkey").alias("simulation_id"), F.col("p_brand").alias("persona_id")), 2, "simulation_id")
    _, made = runs.create("new", "h", "p", 2, items, runs.args_snapshot({"passes": 2, "api_key": "x"}), F.lit("2026-01-01T00:00:00"))
    return made.select("simulation_id", "pass_index", "run_id", "status", "queue_index")


@query("""WITH e AS (SELECT user_id AS key, event_type, event_id % 700 AS status, 'refused ' || event_id AS body FROM events)
SELECT key, bool_or(event_type = 'purchase' AND status IN (401, 429, 502, 503, 504) OR contains(body, '429') OR event_type = 'error' AND status % 97 = 0) AS abort FROM e GROUP BY key""")
def queue_abort(spark, sf):
    kind, status = F.col("event_type"), F.col("event_id") % 700
    named = F.when((kind == "error") & (status % 97 == 0), "RateLimitError").when(kind == "purchase", "HTTPError").otherwise("ValueError")
    body = F.concat(F.lit("refused "), F.col("event_id").cast("string"))
    rows = read(spark, sf, "events").select(F.col("user_id").alias("key"), named.alias("error_class"), status.alias("status"), body.alias("response"), F.lit("401").alias("text"))
    return runs.aborted(rows)


@query("""WITH w AS (SELECT event_id, count(*) OVER r AS earlier, greatest((min(epoch_us(ts)) OVER r + 600000000 - epoch_us(ts)) / 1e6::DOUBLE, 0.0::DOUBLE) AS l FROM events
WINDOW r AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND 1 PRECEDING))
SELECT event_id, earlier, earlier >= 3 AS limited, round(coalesce(CASE WHEN earlier >= 3 THEN l WHEN earlier >= 1 THEN l * 0.75::DOUBLE ELSE 0.0::DOUBLE END, 0.0::DOUBLE), 5) AS wait FROM w""")
def paced_calls(spark, sf):
    return runs.paced(read(spark, sf, "events"), "user_id", 3, 600).select("event_id", "earlier", "limited", F.round("wait", 5).alias("wait"))


@query("""WITH s AS (SELECT user_id, max(ts) AS l FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id::VARCHAR AS session_id, 'unknown' AS persona_id, trunc((epoch_us(now) - epoch_us(l)) / 1e6)::BIGINT AS idle_seconds, greatest(0, 1800 - trunc((epoch_us(now) - epoch_us(l)) / 1e6))::BIGINT AS expires_in_seconds,
trunc((epoch_us(now) - epoch_us(l)) / 1e6) > 1800 AS expired FROM s, n""")
def idle_sessions(spark, sf):
    ev = read(spark, sf, "events")
    last = ev.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.max("ts").alias("last_access")).withColumn("persona_id", F.lit(None).cast("string"))
    now = ev.agg(F.max("ts").alias("now"))  # one row
    return idle(last.crossJoin(F.broadcast(now)), F.col("now")).drop("last_access", "now")


@query()
def capped_sessions(spark, sf):
    """Sessions of a service that holds 64 at most in 4 instances."""
    return capped(_events(spark, sf).select(F.col("user_id").alias("session_id"), "ts"), 64, 4)


# ---- event log of exported dialogues --------------------------------------------------------------------------------


class LengthModel:
    """Names a touchpoint by the length of the prompt's message."""

    def complete(self, kind: str, system: str, user: str) -> str:
        said = user.split("MENSAGEM:\n", 1)[1].rsplit("\n\nTOUCHPOINTS", 1)[0].split(": ", 1)[1]
        return ' "saudacao" ' if len(said) < 100 else "'Consulta'" if len(said) < 400 else "desconhecido"


@query(f"""WITH {_MS}, u AS (SELECT conv_id, 1 AS kind, idx, CASE role WHEN 'assistant' THEN 'ai' WHEN 'user' THEN 'human' ELSE 'other' END AS agent, text, CASE WHEN role IN ('assistant', 'user') THEN stamp END AS tm FROM m WHERE conv_id % 50 < 47),
f AS (SELECT conv_id, arg_min(tm, idx) FILTER (tm IS NOT NULL) AS a, arg_max(coalesce(tm, '-'), idx) AS z FROM u GROUP BY conv_id),
r AS (SELECT * FROM u UNION ALL SELECT conv_id, 0, -1, 'system', '', strftime(strptime(a, '%Y-%m-%dT%H:%M:%S') - INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S') FROM f WHERE a IS NOT NULL UNION ALL SELECT conv_id, 2, -1, 'system', '', z FROM f WHERE z <> '-'),
n AS (SELECT *, row_number() OVER (ORDER BY conv_id, kind, idx) - 1 AS event_id FROM r),
x AS (SELECT *, CASE kind WHEN 0 THEN 'START-DIALOGUE-SYTEM' WHEN 2 THEN 'END-DIALOGUE-SYSTEM' ELSE CASE WHEN length(text) < 100 THEN 'SAUDACAO' WHEN length(text) < 400 THEN 'CONSULTA' ELSE '' END END AS act FROM n)
SELECT 't' || conv_id AS "CASE_ID", event_id AS "EVENT_ID", act AS "ACTIVITY", CASE WHEN kind <> 1 THEN tm ELSE coalesce(lag(tm) OVER (PARTITION BY conv_id ORDER BY event_id), tm) END AS "START_TIMESTAMP", tm AS "END_TIMESTAMP",
CASE WHEN agent = 'ai' AND idx > 0 THEN 'contas, cartao' ELSE '' END AS "RECURSO", CASE WHEN kind <> 1 THEN 'syst' ELSE agent END AS "AGENTE" FROM x""")
def touchpoint_log(spark, sf):
    """The seven columns of the event log of exported dialogues, classified by a model that answers by length."""
    rows = interactions.message_rows(interactions.conversations(checkpoints(spark, sf)))
    used = F.when((F.col("type") == "ai") & (F.col("index") > 0), F.array(F.lit("contas"), F.lit("cartao")))
    m = rows.select(F.substr("thread_id", F.lit(2)).cast("long").alias("ord"), F.col("thread_id").alias("case_id"), "index", "type", "content", "simulated_timestamp", F.when(F.col("type") == "ai", F.col("simulated_timestamp")).alias("banco_timestamp"), used.alias("sources"))
    catalog = ["saudacao", "Consulta"]
    return eventlog.final_log(eventlog.classified(eventlog.dialogue_events(m), catalog, catalog, LengthModel()))


# ---- sources and functions ------------------------------------------------------------------------------------------


def _place(spark, name: str) -> str:
    import uuid

    return f"{scratch(spark).rstrip('/')}/weft-{name}-{uuid.uuid4().hex}"


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_sniff_roundtrip(spark, sf):
    path = _place(spark, "csv")
    sinks.write_csv(read(spark, sf, "nation"), path, ["n_nationkey", "n_name", "n_regionkey"])
    return files.read_csv(spark, path)


@query(f"WITH {_MS} SELECT thread_id, n AS messages FROM g WHERE conv_id % 50 < 47")
def zip_source(spark, sf):
    """Every conversation exported into ZIP archives with an index, read back from them."""
    path = _place(spark, "zip")
    c = checkpoints(spark, sf)
    made = interactions.exported(interactions.conversations(c), instances(spark, sf).limit(0), c, None, "2026-01-01T00:00:00")
    sinks.write_zips(made, path)
    body = files.read_zipped_json(spark, path).select(F.from_json("body", "struct<thread_id:string,messages:array<struct<index:int>>>").alias("d"))
    return body.select("d.thread_id", F.size("d.messages").cast("long").alias("messages"))


@query(r"""SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1)::BIGINT AS id, replace(c_mktsegment || ' x', ' ', '_') AS folder, CASE WHEN c_nationkey = 0 THEN -1 ELSE c_nationkey END AS nation,
(3 / CASE WHEN c_acctbal > 0 THEN 72.0::DOUBLE ELSE 18.0::DOUBLE END * 60) AS typing, c_custkey % 3 = 0 AS accepted FROM customer""")
def scalar_functions(spark, sf):
    text = F.concat(F.lit("Você é "), F.col("c_name"), F.lit(" [[ como agir ]] [[ missão ]] "), F.when(F.col("c_custkey") % 3 == 0, "quit").otherwise(""))
    return read(spark, sf, "customer").select(
        "c_custkey", id_of_name(F.col("c_name")).alias("id"), underscored(F.concat("c_mktsegment", F.lit(" x"))).alias("folder"), or_default(F.col("c_nationkey"), -1).alias("nation"),
        typing_seconds(F.lit("um dois tres"), F.when(F.col("c_acctbal") > 0, 72.0).otherwise(18.0)).alias("typing"), accepted_prompt(text).alias("accepted"),
    )
