"""The registered queries of the engine's own operators, each with the SQL that says the same."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.scratch import scratch
from weft.functions.text import compose, squeeze, truncate, words
from weft.operators import eventlog, planner, rag, runs
from weft.streaming.sessions import sessions, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def iso(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# ---- event log ------------------------------------------------------------------------------------------------------

_TIMED = r"""
m AS (SELECT conv_id, turn, role, text, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))::BIGINT AS words FROM conversations),
t AS (SELECT *, (sum(words * 400 + 1500) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS clock,
             CASE role WHEN 'assistant' THEN 'ai' WHEN 'user' THEN 'human' ELSE 'other' END AS agent FROM m)"""
_FLAT = f"""{_TIMED},
e AS (SELECT conv_id, min(clock) AS lo, max(clock) AS hi FROM t GROUP BY conv_id),
u AS (SELECT conv_id, 1 AS kind, turn, agent, text, clock FROM t
      UNION ALL SELECT conv_id, 0, -1, 'system', 'START-DIALOGUE-SYTEM', lo - 1000 FROM e
      UNION ALL SELECT conv_id, 2, -1, 'system', 'END-DIALOGUE-SYSTEM', hi FROM e),
f AS (SELECT *, row_number() OVER (ORDER BY conv_id, kind, turn) - 1 AS event_id FROM u)"""
_CLASSIFIED = f"""{_FLAT},
r AS (SELECT *, CASE WHEN contains(text, '?') THEN 'PERGUNTA' WHEN length(text) < 120 THEN 'RESPOSTA_CURTA' WHEN length(text) < 600 THEN 'RESPOSTA' ELSE '' END AS rule FROM f),
c AS (SELECT *, CASE WHEN agent = 'system' THEN text ELSE first_value(rule) OVER (PARTITION BY conv_id, agent, text ORDER BY event_id) END AS activity FROM r),
o AS (SELECT conv_id AS case_id, event_id, activity,
             CASE WHEN agent = 'system' THEN clock ELSE coalesce(lag(clock) OVER (PARTITION BY conv_id ORDER BY event_id), clock) END AS start_ms,
             clock AS end_ms, CASE WHEN agent = 'system' THEN 'syst' ELSE agent END AS agente FROM c)"""
CATALOG = ["PERGUNTA", "RESPOSTA_CURTA", "RESPOSTA"]


def _log(spark, sf):
    return eventlog.finish(eventlog.classify(eventlog.flatten(read(spark, sf, "conversations")), CATALOG))


@query(f"WITH {_FLAT} SELECT conv_id AS case_id, event_id, agent, clock AS end_ms, length(text)::BIGINT AS chars, md5(text) AS digest FROM f")
def eventlog_build(spark, sf):
    f = eventlog.flatten(read(spark, sf, "conversations"))
    return f.select(F.col("conv_id").alias("case_id"), "event_id", "agent", F.col("clock").alias("end_ms"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query(f"WITH {_CLASSIFIED} SELECT * FROM o")
def eventlog_classified(spark, sf):
    return _log(spark, sf)


@query(f"""WITH {_CLASSIFIED} SELECT case_id, count(*) AS events, count(*) FILTER (agente <> 'syst') AS real_events, count(*) FILTER (agente = 'syst') AS system_events,
min(event_id) AS first_event, max(event_id) AS last_event FROM o GROUP BY case_id ORDER BY events DESC, case_id LIMIT 10""")
def eventlog_case_summary(spark, sf):
    return eventlog.case_summary(_log(spark, sf))


# ---- interactions ---------------------------------------------------------------------------------------------------


@query("""SELECT conv_id, count(*) AS total_messages, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, arg_max(length(text), turn)::BIGINT AS last_chars,
min(turn) FILTER (text <> '') AS first_nonempty FROM conversations GROUP BY conv_id""")
def dialogue_first_last(spark, sf):
    last_chars = F.max_by(F.length("text").cast("long"), "turn")
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("total_messages"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), last_chars.alias("last_chars"), F.min(F.when(F.col("text") != "", F.col("turn"))).alias("first_nonempty"))


@query(f"""WITH {_TIMED} SELECT conv_id, turn, agent, clock AS at_ms, coalesce(lag(clock) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS before_ms,
(sum(CASE WHEN agent = 'human' THEN words * 400 ELSE 0 END) OVER (PARTITION BY conv_id))::BIGINT AS typing_ms FROM t""")
def dialogue_timing(spark, sf):
    t = eventlog.timed(read(spark, sf, "conversations")).withColumn("agent", eventlog.agent(F.col("role")))
    order = Window.partitionBy("conv_id").orderBy("turn")
    typing = F.sum(F.when(F.col("agent") == "human", F.col("words") * 400).otherwise(0)).over(Window.partitionBy("conv_id"))
    return t.select("conv_id", "turn", "agent", F.col("clock").alias("at_ms"), F.coalesce(F.lag("clock").over(order), F.lit(0).cast("long")).alias("before_ms"), typing.alias("typing_ms"))


@query(r"""SELECT conv_id, count(*) AS total_messages, string_agg(turn || ':' || CASE role WHEN 'assistant' THEN 'ai' WHEN 'user' THEN 'human' ELSE 'other' END || ':' || text, '|' ORDER BY turn) AS messages
FROM conversations GROUP BY conv_id""")
def dialogue_export(spark, sf):
    m = read(spark, sf, "conversations").select("conv_id", F.struct("turn", eventlog.agent(F.col("role")).alias("type"), "text").alias("m"))
    by = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    flat = F.array_join(F.transform("ms", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["type"], x["text"])), "|")
    return by.select("conv_id", F.size("ms").cast("long").alias("total_messages"), flat.alias("messages"))


@query("""WITH o AS (SELECT *, (sum(CASE WHEN role = 'assistant' AND turn > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS ordinal FROM conversations)
SELECT conv_id, turn, ordinal, item_id FROM o LEFT JOIN benchmark ON item_id = ordinal WHERE role = 'assistant' AND turn > 0""")
def bank_message_ordinal(spark, sf):
    bank = (F.col("role") == "assistant") & (F.col("turn") > 0)
    run = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = read(spark, sf, "conversations").withColumn("ordinal", F.sum(bank.cast("long")).over(run)).where(bank)
    return rows.join(read(spark, sf, "benchmark").select("item_id"), F.col("item_id") == F.col("ordinal"), "left").select("conv_id", "turn", "ordinal", "item_id")


@query("""WITH c AS (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey AS instance, 'sem_checkpoint_' || c_mktsegment || '_' || c_custkey AS thread_id, 0::BIGINT AS total_messages, 'not_finished' AS execution_status, true AS not_finished
FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM c)""")
def not_finished_anti(spark, sf):
    """Placeholders of instances that aren't finished and have no checkpoint."""
    done = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    open_ = read(spark, sf, "customer").where("c_acctbal < 0").join(done, "c_custkey", "left_anti")
    return open_.select(F.col("c_custkey").alias("instance"), F.concat_ws("_", F.lit("sem_checkpoint"), "c_mktsegment", F.col("c_custkey").cast("string")).alias("thread_id"), F.lit(0).cast("long").alias("total_messages"), F.lit("not_finished").alias("execution_status"), F.lit(True).alias("not_finished"))


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), e AS (SELECT * FROM events WHERE event_type = 'error'),
j AS (SELECT p.event_id, e.event_id AS log_id, abs(epoch_us(p.ts) - epoch_us(e.ts)) AS us,
             row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(e.ts)), e.event_id) AS r
      FROM p JOIN e ON p.user_id = e.user_id AND abs(epoch_us(p.ts) - epoch_us(e.ts)) < 1800000000)
SELECT event_id, log_id, us FROM j WHERE r = 1""")
def asof_nearest_30min(spark, sf):
    """The nearest log within 30 minutes: an equi-join on half-hour bins and their neighbours, then the least distance."""
    ev = read(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("bin", F.floor(F.col("t") / 1800000000))
    p = ev.where("event_type = 'purchase'").select("event_id", "user_id", "t", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    e = ev.where("event_type = 'error'").select(F.col("event_id").alias("log_id"), "user_id", F.col("t").alias("lt"), "bin")
    near = p.join(e, ["user_id", "bin"]).withColumn("us", F.abs(F.col("t") - F.col("lt"))).where("us < 1800000000")
    return near.groupBy("event_id").agg(F.min(F.struct("us", "log_id")).alias("b")).select("event_id", F.col("b.log_id").alias("log_id"), F.col("b.us").alias("us"))


@query("""WITH l AS (SELECT user_id, max(event_id) AS newest FROM events WHERE event_type = 'error' GROUP BY user_id),
x AS (SELECT event_id AS log_id, user_id FROM events WHERE event_type = 'error')
SELECT v.event_id, coalesce(x.log_id, l.newest, -1) AS log_id, CASE WHEN x.log_id IS NOT NULL THEN 'thread' WHEN l.newest IS NOT NULL THEN 'persona' ELSE 'none' END AS via
FROM events v LEFT JOIN x ON x.log_id = v.event_id + 1 AND x.user_id = v.user_id LEFT JOIN l ON l.user_id = v.user_id WHERE v.event_type = 'purchase'""")
def log_cascade(spark, sf):
    """Exact log, else the newest of the same persona, else none."""
    ev = read(spark, sf, "events")
    logs = ev.where("event_type = 'error'")
    exact = logs.select(F.col("event_id").alias("exact"), (F.col("event_id") - 1).alias("event_id"), "user_id")
    newest = logs.groupBy("user_id").agg(F.max("event_id").alias("newest"))
    rows = ev.where("event_type = 'purchase'").select("event_id", "user_id").join(exact, ["event_id", "user_id"], "left").join(newest, "user_id", "left")
    via = F.when(F.col("exact").isNotNull(), "thread").when(F.col("newest").isNotNull(), "persona").otherwise("none")
    return rows.select("event_id", F.coalesce("exact", "newest", F.lit(-1).cast("long")).alias("log_id"), via.alias("via"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'error') AS erro, count(*) FILTER (event_type <> 'error' AND value < 10) AS aviso, count(*) FILTER (event_type <> 'error' AND (value >= 10 OR value IS NULL)) AS info,
count(*) AS total FROM events GROUP BY user_id""")
def log_levels(spark, sf):
    line = F.when(F.col("event_type") == "error", "Fatal error").when(F.col("value") < 10, "WARN low").otherwise("ok")
    rows = read(spark, sf, "events").withColumn("level", runs.severity(line))
    return rows.groupBy("user_id").agg(*[F.count_if(F.col("level") == x).alias(x.lower()) for x in ("ERRO", "AVISO", "INFO")], F.count(F.lit(1)).alias("total"))


@query("""SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, bool_or(n_chars > 20000) AS fallback FROM documents GROUP BY lang""")
def datasource_sets(spark, sf):
    return read(spark, sf, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.bool_or(F.col("n_chars") > 20000).alias("fallback"))


# ---- planner --------------------------------------------------------------------------------------------------------

_CAL = """c AS (SELECT i::BIGINT AS day_idx, printf('d%02d', i) AS day_id, (i - 1) // 30 + 1 AS month_idx, (i - 1) // 7 + 1 AS week_idx,
['segunda', 'terca', 'quarta', 'quinta', 'sexta', 'sabado', 'domingo'][(i - 1) % 7 + 1] AS dow, (i - 1) % 30 + 1 AS dom, (i - 1) % 7 >= 5 AS weekend FROM range(1, 91) r(i))"""
_WEIGHTS = f"""{_CAL}, w AS (SELECT *, [1.06, 1.10, 1.05, 1.00, 0.95, 0.76, 0.61][(day_idx - 1) % 7 + 1]::DOUBLE
* [0.92, 1.00, 1.08, 0.97, 1.12, 0.95, 1.03, 0.98, 0.90, 1.15, 0.94, 0.99, 1.07][week_idx]::DOUBLE
* (0.82::DOUBLE + 0.28::DOUBLE * exp(-pow(dom - 14, 2) / (2 * 3.2::DOUBLE * 3.2::DOUBLE)) + 0.16::DOUBLE * exp(-pow(dom - 27, 2) / (2 * 2.4::DOUBLE * 2.4::DOUBLE)))
* (CASE day_idx WHEN 18 THEN 1.22 WHEN 47 THEN 1.30 WHEN 73 THEN 1.18 ELSE 1.0 END)::DOUBLE AS weight FROM c)"""
_DAYS = f"""{_WEIGHTS}, i AS (SELECT *, 6000 * weight / sum(weight) OVER () AS ideal FROM w),
dq AS (SELECT day_id, day_idx, floor(ideal)::BIGINT + CASE WHEN row_number() OVER (ORDER BY ideal - floor(ideal) DESC, day_id DESC) <= 6000 - sum(floor(ideal)) OVER () THEN 1 ELSE 0 END AS quota FROM i)"""


@query(f"WITH {_CAL} SELECT day_id, day_idx, month_idx::BIGINT AS month_idx, week_idx::BIGINT AS week_idx, dow, dom::BIGINT AS dom, weekend FROM c")
def calendar_90d(spark, sf):
    return planner.calendar(spark)


@query(f"WITH {_WEIGHTS} SELECT day_id, round(weight, 6) AS weight, round(100 * weight / sum(weight) OVER (), 4) AS percent FROM w")
def day_weights_percent(spark, sf):
    return planner.day_weights(planner.calendar(spark)).select("day_id", F.round("weight", 6).alias("weight"), "percent")


@query(f"WITH {_DAYS} SELECT day_id, quota FROM dq")
def apportion_days_float(spark, sf):
    return planner.apportion_days(planner.day_weights(planner.calendar(spark)), 6000).select("day_id", "quota")


def _personas(spark, sf):
    seg = read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("persona")).agg(F.count(F.lit(1)).alias("w"))
    return seg.withColumn("ord", F.row_number().over(Window.orderBy("persona")))


_PERSONAS = """s AS (SELECT c_mktsegment AS persona, count(*) AS w, row_number() OVER (ORDER BY c_mktsegment) AS ord FROM customer GROUP BY 1),
pq AS (SELECT persona, ord, w, w * 6000 // tot + CASE WHEN row_number() OVER (ORDER BY w * 6000 % tot DESC, ord) <= 6000 - sum(w * 6000 // tot) OVER () THEN 1 ELSE 0 END AS quota
       FROM (SELECT *, (sum(w) OVER ())::BIGINT AS tot FROM s))"""
_MISSIONS = """mw AS (SELECT c_mktsegment AS persona, o_orderpriority AS mission, count(*) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
mo AS (SELECT mw.*, row_number() OVER (PARTITION BY mw.persona ORDER BY mission) AS ord, quota AS n, (sum(mw.w) OVER (PARTITION BY mw.persona))::BIGINT AS tot FROM mw JOIN pq USING (persona)),
mq AS (SELECT persona, mission, ord, w, w * n // tot + CASE WHEN row_number() OVER (PARTITION BY persona ORDER BY w * n % tot DESC, ord) <= n - sum(w * n // tot) OVER (PARTITION BY persona) THEN 1 ELSE 0 END AS quota FROM mo)"""


@query(f"WITH {_PERSONAS} SELECT persona, w, quota::BIGINT AS quota FROM pq")
def apportion_exact(spark, sf):
    return planner.apportion(_personas(spark, sf), F.lit(6000), ["persona"]).select("persona", "w", "quota")


def _missions(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = o.groupBy(F.col("c_mktsegment").alias("persona"), F.col("o_orderpriority").alias("mission")).agg(F.count(F.lit(1)).alias("w"))
    return w.withColumn("ord", F.row_number().over(Window.partitionBy("persona").orderBy("mission")))


def _quotas(spark, sf):
    personas = planner.apportion(_personas(spark, sf), F.lit(6000), ["persona"])
    sized = _missions(spark, sf).join(F.broadcast(personas.select("persona", F.col("quota").alias("n"))), "persona")  # a row a persona
    return planner.apportion(sized, F.col("n"), ["mission"], by=("persona",))


@query(f"WITH {_PERSONAS}, {_MISSIONS} SELECT persona, mission, quota::BIGINT AS quota FROM mq")
def quota_plan(spark, sf):
    return _quotas(spark, sf).select("persona", "mission", "quota")


_BALANCED = """pb AS (SELECT persona, row_number() OVER (ORDER BY round, ord) AS pos FROM (SELECT persona, ord, unnest(range(1, (quota + 1)::BIGINT)) AS round FROM pq))"""


@query(f"WITH {_PERSONAS}, {_BALANCED} SELECT pos, persona FROM pb")
def balanced_sequence(spark, sf):
    return planner.balanced(planner.apportion(_personas(spark, sf), F.lit(6000), ["persona"]), "persona")


_ZIP = f"""{_DAYS}, {_PERSONAS}, {_BALANCED},
db AS (SELECT day_id, day_idx, row_number() OVER (ORDER BY round, day_idx) AS pos FROM (SELECT *, unnest(range(1, (quota + 1)::BIGINT)) AS round FROM dq)),
z AS (SELECT pos, day_id, day_idx, persona, row_number() OVER (PARTITION BY persona ORDER BY day_idx, pos) AS k FROM db JOIN pb USING (pos))"""
_SIMS = f"""{_ZIP}, {_MISSIONS},
mb AS (SELECT persona, mission, row_number() OVER (PARTITION BY persona ORDER BY round, ord) AS k FROM (SELECT *, unnest(range(1, (quota + 1)::BIGINT)) AS round FROM mq WHERE quota > 0)),
sim AS (SELECT pos, day_id, day_idx, persona, mission FROM z JOIN mb USING (persona, k))"""


def _days(spark):
    return planner.apportion_days(planner.day_weights(planner.calendar(spark)), 6000)


@query(f"WITH {_ZIP} SELECT pos, day_id, persona FROM z")
def positional_zip(spark, sf):
    days = planner.balanced(_days(spark).withColumn("ord", F.col("day_idx")), "day_id")
    return planner.zip_positions(days, balanced_sequence(spark, sf)).select("pos", "day_id", "persona")


def _simulations(spark, sf):
    return planner.simulations(_days(spark), planner.apportion(_personas(spark, sf), F.lit(6000), ["persona"]), _missions(spark, sf))


@query(f"WITH {_SIMS} SELECT pos, day_id, persona, mission FROM sim")
def simulations_plan(spark, sf):
    return _simulations(spark, sf).select("pos", "day_id", "persona", "mission")


def _permutation(n: int, seed: int) -> list[int]:
    order = list(range(1, n + 1))
    random.Random(seed).shuffle(order)
    return order


@query(f"WITH {_SIMS}, ids AS (SELECT unnest({_permutation(6000, 44)}) AS pos, unnest(range(1, 6001)) AS id) SELECT id, day_id, persona, mission FROM sim JOIN ids USING (pos)")
def simulations_shuffled(spark, sf):
    """The plan in the seeded order, ids 1..n."""
    return _simulations(spark, sf).join(planner.shuffled_ids(spark, 6000, 44), "pos").select("id", "day_id", "persona", "mission")


@query(f"""WITH {_SIMS}, g AS (SELECT persona, mission, count(*) AS observed FROM sim GROUP BY 1, 2)
SELECT persona, mission, quota::BIGINT AS planned, coalesce(observed, 0) AS observed, quota = coalesce(observed, 0) AS ok FROM mq LEFT JOIN g USING (persona, mission)""")
def audit_plan(spark, sf):
    seen = _simulations(spark, sf).groupBy("persona", "mission").agg(F.count(F.lit(1)).alias("observed"))
    return planner.audit(_quotas(spark, sf).select("persona", "mission", F.col("quota").alias("planned")), seen, ["persona", "mission"])


@query("""SELECT grouping_id(o_orderpriority, o_orderstatus) AS gid, o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers
FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus), ())""")
def audit_counts(spark, sf):
    sets = [[F.col("o_orderpriority")], [F.col("o_orderstatus")], [F.col("o_orderpriority"), F.col("o_orderstatus")], []]
    by = read(spark, sf, "orders").groupingSets(sets, "o_orderpriority", "o_orderstatus")
    out = by.agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))
    return out.select("gid", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), "n", "customers")


@query("""SELECT 'V1_quantity' AS rule, l_orderkey::VARCHAR AS key, count(*) AS n FROM lineitem WHERE l_quantity <= 0 OR l_quantity > 45 GROUP BY 2
UNION ALL SELECT 'V2_part', p_partkey::VARCHAR, 1 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'V3_duplicate', sha256(text), count(*) FROM documents GROUP BY text HAVING count(*) > 1
UNION ALL SELECT 'V4_label', doc_id::VARCHAR, 1 FROM labels WHERE quality NOT IN (0, 1) OR toxic = 1""")
def validate_rules(spark, sf):
    """Violations (rule, key, n) of range, reference, uniqueness and domain rules."""
    line = read(spark, sf, "lineitem")
    v = lambda df, rule, key, n=F.lit(1).cast("long"): df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), n.alias("n"))
    out = v(line.where("l_quantity <= 0 or l_quantity > 45").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c")), "V1_quantity", "l_orderkey", F.col("c"))
    out = out.unionByName(v(read(spark, sf, "part").join(line.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti"), "V2_part", "p_partkey"))
    texts = read(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    out = out.unionByName(v(texts, "V3_duplicate", "h", F.col("c")))
    return out.unionByName(v(read(spark, sf, "labels").where("quality not in (0, 1) or toxic = 1"), "V4_label", "doc_id"))


@query(r"""SELECT c_custkey AS id, coalesce(n_name, '') AS identidade, CASE WHEN c_acctbal > 5000 THEN 72.0 WHEN c_acctbal < 0 THEN 18.0 ELSE 42.0 END::DOUBLE AS typing_speed_wpm,
CASE WHEN length(p) <= 40 THEN p ELSE rtrim(left(p, 37)) || '...' END AS prompt_preview FROM (
SELECT *, trim(regexp_replace('Você é ' || c_name || ' [[ ' || n_name || ' ]]  {missao} ' || r_name || E'\n' || c_mktsegment || ' quit', '[ \t\n]+', ' ', 'g')) AS p
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
def prompt_projection(spark, sf):
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    prompt = compose("Você é {a} [[ {b} ]]  {{missao}} {c}\n{d} quit", a=F.col("c_name"), b=F.col("n_name"), c=F.col("r_name"), d=F.col("c_mktsegment"))
    rhythm = F.when(F.col("c_acctbal") > 5000, "rapido").when(F.col("c_acctbal") < 0, "lento").otherwise("?")
    table = spark.createDataFrame([(k, v[0]) for k, v in planner.RHYTHMS.items()], "ritmo string, speed double")
    rows = c.withColumn("ritmo", rhythm).join(F.broadcast(table), "ritmo", "left")
    return rows.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("identidade"), F.coalesce("speed", F.lit(planner.RHYTHMS["medio"][0])).alias("typing_speed_wpm"), truncate(squeeze(prompt), 40).alias("prompt_preview"))


@query("""WITH e AS (SELECT event_id, ts, ['03:00', '09:00', '15:00', '19:30', '23:00', NULL][event_id % 6 + 1] AS anchor, event_id % 90 + 1 AS day_idx FROM events),
a AS (SELECT *, (date_trunc('day', ts)::DATE + ((7 - (isodow(ts) - 1)) % 7 + day_idx - 1)::INT) + (anchor || ':00')::TIME AS tm FROM e)
SELECT event_id, strftime(CASE WHEN tm <= ts THEN tm + INTERVAL 7 DAY ELSE tm END, '%Y-%m-%d %H:%M:%S') AS target FROM a""")
def target_datetime(spark, sf):
    anchors = F.array(*[F.lit(x) for x in planner.OFFSET_ANCHORS.values()], F.lit(None).cast("string"))
    e = read(spark, sf, "events").withColumn("anchor", F.get(anchors, (F.col("event_id") % 6).cast("int")))
    return e.select("event_id", iso(planner.target_datetime(F.col("ts"), F.col("event_id") % 90 + 1, F.col("anchor"))).alias("target"))


@query("""SELECT r_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n FROM region CROSS JOIN nation
WHERE (r_regionkey, n_nationkey) NOT IN (SELECT (n_regionkey, n_nationkey) FROM nation JOIN supplier ON s_nationkey = n_nationkey)""")
def pairs_cross_anti(spark, sf):
    """All pairs of two small dimensions that aren't taken yet."""
    nation = read(spark, sf, "nation")
    taken = nation.join(read(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey").distinct()
    pairs = read(spark, sf, "region").select("r_regionkey").crossJoin(nation.select("n_nationkey"))
    return pairs.join(taken, ["r_regionkey", "n_nationkey"], "left_anti").select(F.col("r_regionkey").cast("long").alias("r"), F.col("n_nationkey").cast("long").alias("n"))


# ---- run state ------------------------------------------------------------------------------------------------------

_STATES = """h AS (SELECT user_id % 10 AS run_id, user_id AS instance, event_id AS seq,
CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'error' THEN 'not_finished' WHEN 'purchase' THEN CASE WHEN user_id % 3 = 0 THEN 'completed' ELSE 'running' END ELSE 'pending' END AS state,
CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error FROM events)"""


def _history(spark, sf):
    kind = F.col("event_type")
    state = F.when(kind == "click", "running").when(kind == "error", "not_finished").when(kind == "purchase", F.when(F.col("user_id") % 3 == 0, "completed").otherwise("running")).otherwise("pending")
    return read(spark, sf, "events").select((F.col("user_id") % 10).alias("run_id"), F.col("user_id").alias("instance"), F.col("event_id").alias("seq"), state.alias("state"), F.when(kind == "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("error"))


_FOLD = f"""WITH {_STATES}, a AS (SELECT run_id, instance, max(list_position(['pending', 'running', 'not_finished', 'completed'], state)) AS r,
min(seq) FILTER (state IN ('not_finished', 'completed')) AS e, min(seq) FILTER (state = 'running') AS s, max(seq) FILTER (state = 'completed') AS c, min(seq) FILTER (state = 'not_finished') AS nf,
arg_max(error, seq) FILTER (state = 'not_finished') AS err FROM h GROUP BY 1, 2),
st AS (SELECT run_id, instance, ['pending', 'running', 'not_finished', 'completed'][r] AS status, CASE WHEN e IS NULL OR s < e THEN s END AS started_at, coalesce(c, nf) AS completed_at, CASE WHEN r < 4 THEN err END AS error FROM a)"""


@query(f"{_FOLD} SELECT * FROM st")
def run_state_fold(spark, sf):
    return runs.fold(_history(spark, sf))


@query(f"{_FOLD} SELECT run_id, count(*) FILTER (status IN ('pending', 'running')) AS active, CASE WHEN count(*) FILTER (status IN ('pending', 'running')) = 0 THEN 'completed' ELSE 'interrupted' END AS run_status FROM st GROUP BY run_id")
def run_finalize(spark, sf):
    return runs.finalize(runs.fold(_history(spark, sf)))


@query(f"{_FOLD} SELECT run_id, instance, CASE status WHEN 'running' THEN 'not_finished' ELSE status END AS status, CASE status WHEN 'running' THEN coalesce(error, 'stale') ELSE error END AS error FROM st")
def run_stale(spark, sf):
    return runs.stale_to_not_finished(runs.fold(_history(spark, sf)), "stale").select("run_id", "instance", "status", "error")


@query("""SELECT event_id AS run_id, user_id AS file_hash, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events WHERE user_id = 7 AND event_id % 2 = 0 AND event_type <> 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 1""")
def latest_run(spark, sf):
    ev = read(spark, sf, "events")
    r = ev.select(F.col("event_id").alias("run_id"), F.col("user_id").alias("file_hash"), (F.col("event_id") % 2).alias("passes"), F.when(F.col("event_type") == "purchase", "completed").otherwise("interrupted").alias("status"), F.col("ts").alias("created_at"))
    return runs.resumable(r, 7, 0).select("run_id", "file_hash", iso("created_at").alias("created_at"))


@query("""WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS pos, count(*) OVER () AS n FROM part)
SELECT p_partkey, x::BIGINT AS pass_index, (x - 1) * n + pos AS queue_index, printf('pass-%04d:simulation-%06d', x, pos) AS instance_key FROM p, range(1, 4) r(x)""")
def run_queue(spark, sf):
    return runs.queue(read(spark, sf, "part").select("p_partkey"), 3, "p_partkey").select("p_partkey", "pass_index", "queue_index", "instance_key")


# ---- sessions and windows -------------------------------------------------------------------------------------------


def _events(spark, sf):
    return read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_SESSIONS = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY user_id, sid"""
#: After any event time.
_LAST = "2200-01-01 00:00:00"


@query(_SESSIONS)
def sessions_30m(spark, sf):
    s = sessions(_events(spark, sf))
    return s.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS calls,
count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) > 10 AS limited FROM events""")
def rate_window_60s(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-60_000_000, 0)
    calls = F.count(F.lit(1)).over(w)
    return _events(spark, sf).select("event_id", calls.alias("calls"), (calls > 10).alias("limited"))


@query("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, sf):
    return windows(_events(spark, sf), "1 hour").select(F.unix_micros("window_start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) - k * 1800000000 AS start_us, event_type, count(*) AS n FROM events, range(0, 2) r(k) GROUP BY 1, 2""")
def sliding_windows(spark, sf):
    return windows(_events(spark, sf), "1 hour", "30 minutes").select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


@query(_SESSIONS)
def streaming_sessions(spark, sf):
    """The sessions of a stream, those still open at its end included: the same rows as the table's.

    In append mode each session that the watermark closes is written once, to files in the shared folder; a record of the far future then
    closes the others and is left out.
    """
    import uuid

    at = f"{scratch(spark).rstrip('/')}/weft-stream-{uuid.uuid4().hex}"
    schema = read(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(_LAST).cast("timestamp").alias("ts"))
    closing.write.parquet(f"{at}/closing")

    def run(rows):
        writer = sessions(rows, watermark="10 minutes").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    last = spark.readStream.schema(closing.schema).parquet(f"{at}/closing")
    run(source.unionByName(last))
    s = spark.read.parquet(f"{at}/out").where("user_id <> -1")
    return s.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


# ---- retrieval and documents ----------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS qvec, label AS ds FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, vec_id AS cid, round(list_dot_product(qvec::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(qvec::DOUBLE[], qvec::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS score
      FROM embeddings JOIN q ON label = ds)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS rank FROM s) WHERE rank <= 3""")
def knn_topk(spark, sf):
    e = read(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("ds"))
    return rag.knn(q, e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("cvec"), F.col("label").alias("ds")))


@query()
def knn_mmr(spark, sf):
    e = read(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("ds"))
    near = rag.knn(q, e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("cvec"), F.col("label").alias("ds")), k=20)
    return rag.mmr(near.join(q, "qid").join(e.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("cvec")), "cid"))


@query(r"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')) AS terms FROM benchmark),
qt AS (SELECT item_id, unnest(terms) AS term FROM q),
dt AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS term FROM documents),
s AS (SELECT item_id, doc_id, count(*) AS hits FROM qt JOIN dt USING (term) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS rank FROM s),
g AS (SELECT item_id, count(*) FILTER (hits >= 5 AND coalesce(quality, 1) = 1) AS relevant, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (hits >= 5 AND coalesce(quality, 1) = 1) AS context
      FROM k LEFT JOIN labels USING (doc_id) WHERE rank <= 3 GROUP BY item_id)
SELECT q.item_id, coalesce(relevant, 0) AS relevant, CASE WHEN coalesce(relevant, 0) > 0 THEN 'answer' ELSE 'fallback' END AS branch, context FROM q LEFT JOIN g USING (item_id)""")
def rag_retrieve_grade_branch(spark, sf):
    """Lexical retrieval of three documents a question, a grade for each, and the branch."""
    terms = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{6,}"), F.lit(0))))
    q = read(spark, sf, "benchmark")
    hits = q.select("item_id", terms("text").alias("term")).join(read(spark, sf, "documents").select("doc_id", terms("text").alias("term")), "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("hits"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("hits").desc(), "doc_id"))).where("rank <= 3")
    graded = ranked.join(read(spark, sf, "labels"), "doc_id", "left").withColumn("yes", (F.col("hits") >= 5) & (F.coalesce("quality", F.lit(1)) == 1))
    kept = F.transform(F.sort_array(F.collect_list(F.when(F.col("yes"), F.struct("rank", "doc_id")))), lambda x: x["doc_id"].cast("string"))
    by = graded.groupBy("item_id").agg(F.count_if("yes").alias("relevant"), kept.alias("ids"))
    out = q.select("item_id").join(by, "item_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0).cast("long")))
    return out.select("item_id", "relevant", F.when(F.col("relevant") > 0, "answer").otherwise("fallback").alias("branch"), F.when(F.size("ids") > 0, F.array_join("ids", ",")).alias("context"))


@query("""SELECT doc_id, (pos // 900)::INT AS chunk_idx, length(substr(text, pos::INT + 1, 1000))::BIGINT AS chars, md5(substr(text, pos::INT + 1, 1000)) AS digest
FROM (SELECT doc_id, text, unnest(range(0, greatest(0, length(text) - 101) + 1, 900)) AS pos FROM documents)""")
def doc_chunk_fixed(spark, sf):
    return rag.fixed_chunks(read(spark, sf, "documents")).select("doc_id", "chunk_idx", F.length("chunk").cast("long").alias("chars"), F.md5("chunk").alias("digest"))


@query()
def doc_chunk_recursive(spark, sf):
    return rag.recursive_chunks(read(spark, sf, "documents")).select("doc_id", "chunk_idx", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def doc_dedup_first(spark, sf):
    return rag.first_occurrences(read(spark, sf, "documents"), "text", "doc_id")


@query("SELECT source, lang, count(*) AS docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def docs_per_source(spark, sf):
    return read(spark, sf, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@query("SELECT page_id, lower(split_part(url, '/', 3)) AS host, length(regexp_replace(html, '<[^>]*>', '', 'g'))::BIGINT AS text_chars, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS digest FROM pages")
def page_text(spark, sf):
    text = F.regexp_replace("html", "<[^>]*>", "")
    return read(spark, sf, "pages").select("page_id", F.lower(F.split_part("url", F.lit("/"), F.lit(3))).alias("host"), F.length(text).cast("long").alias("text_chars"), F.md5(text).alias("digest"))


@query(r"""SELECT doc_id, upper(trim(replace(replace(replace(text, '"', ''), '''', ''), 'ß', 'ss'))) AS label, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS cut,
len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))::BIGINT AS words FROM documents""")
def quote_clean_truncate(spark, sf):
    clean = F.upper(F.trim(F.replace(F.translate("text", "\"'", ""), F.lit("ß"), F.lit("ss"))))
    cut = F.when(F.length("text") > 1000, F.concat(F.left("text", F.lit(1000)), F.lit("..."))).otherwise(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", clean.alias("label"), cut.alias("cut"), words(F.col("text")).alias("words"))
