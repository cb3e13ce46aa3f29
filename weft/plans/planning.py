"""Queries of the planner's whole contract: config rules, six-grain plan, generated rows, projection and audit, from a config made by rule."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weft.operators import config, missions, planner, validation
from weft.plans.catalog import _WEIGHTS, QUERIES, query, read

N, SEED = 6000, 44
CONFIG = config.synthetic(N, SEED)
_V = CONFIG["amostragem"]["variaveis"]


def _values(rows, names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names}))"


def _ranked(weights: dict) -> list[tuple]:
    return [(k, i, w) for i, (k, w) in enumerate(config.whole_weights(weights).items(), 1)]


_ORDER = {o: i for i, o in enumerate(_V["offset"]["categorias"], 1)}
_OFFSETS = [(p, w == "true", o, _ORDER[o], x) for p, by in _V["offset"]["pesos_condicionais"].items() for w, row in by.items() for o, x in config.whole_weights(row).items()]


def _by_persona(name: str) -> list[tuple]:
    return [(p, *r) for p, row in _V[name]["pesos_condicionais"].items() for r in _ranked(row)]


def _largest(name: str, source: str, by: str) -> str:
    """CTE `name`: quotas of source(by..., value, ord, w, n) by largest remainders in each group."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""{name} AS (SELECT *, (w * n // tot + CASE WHEN row_number() OVER ({part} ORDER BY w * n % tot DESC, ord) <= n - sum(w * n // tot) OVER ({part}) THEN 1 ELSE 0 END)::BIGINT AS quota
FROM (SELECT *, (sum(w) OVER ({part}))::HUGEINT AS tot FROM {source}))"""


def _dealt(name: str, source: str, by: str, key: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""{name} AS (SELECT {cols}{key}, row_number() OVER ({part} ORDER BY round, ord) AS pos
FROM (SELECT {cols}{key}, ord, unnest(range(1, quota + 1)) AS round FROM {source} WHERE quota > 0))"""


_PLAN = f"""{_WEIGHTS}, i AS (SELECT *, {N} * weight / sum(weight) OVER () AS ideal FROM w),
dq AS (SELECT day_id, day_idx, day_idx AS ord, weekend, (floor(ideal) + CASE WHEN row_number() OVER (ORDER BY ideal - floor(ideal) DESC, day_id DESC) <= {N} - sum(floor(ideal)) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM i),
{_largest("pq", f"(SELECT *, {N}::BIGINT AS n FROM {_values(_ranked(_V['persona_id']['composicao_pesos']['peso_final']), 'persona, ord, w')})", "")},
{_dealt("db", "dq", "", "day_id")}, {_dealt("pb", "pq", "", "persona")},
z AS (SELECT pos, day_id, day_idx, weekend, persona FROM db JOIN pb USING (pos) JOIN dq USING (day_id)),
pw AS (SELECT persona, weekend, count(z.pos) AS n FROM (SELECT persona, f AS weekend FROM pq, (VALUES (false), (true)) AS b(f)) LEFT JOIN z USING (persona, weekend) GROUP BY persona, weekend),
{_largest("oq", f"(SELECT * FROM {_values(_OFFSETS, 'persona, weekend, value, ord, w')} JOIN pw USING (persona, weekend))", "persona, weekend")},
{_largest("rq", f"(SELECT v.*, quota AS n FROM {_values(_by_persona('ritmo'), 'persona, value, ord, w')} AS v JOIN pq USING (persona))", "persona")},
{_largest("mq", f"(SELECT v.*, quota AS n FROM {_values(_by_persona('missao_id'), 'persona, value, ord, w')} AS v JOIN pq USING (persona))", "persona")},
plan AS (SELECT 'dia_relativo' AS grain, NULL::VARCHAR AS persona, NULL::BOOLEAN AS weekend, day_id AS value, quota FROM dq
UNION ALL SELECT 'persona_id', persona, NULL, NULL, quota FROM pq
UNION ALL SELECT 'persona_weekend', persona, weekend, NULL, n FROM pw
UNION ALL SELECT 'offset', persona, weekend, value, quota FROM oq
UNION ALL SELECT 'ritmo', persona, NULL, value, quota FROM rq
UNION ALL SELECT 'missao_id', persona, NULL, value, quota FROM mq)"""


def _shuffled() -> list[int]:
    order = list(range(1, N + 1))
    random.Random(SEED).shuffle(order)
    return order


_SIMS = f"""{_PLAN},
k AS (SELECT *, row_number() OVER (PARTITION BY persona ORDER BY day_idx, pos) AS k, row_number() OVER (PARTITION BY persona, weekend ORDER BY day_idx, pos) AS kw FROM z),
{_dealt("ob", "oq", "persona, weekend", "value")}, {_dealt("rb", "rq", "persona", "value")}, {_dealt("mb", "mq", "persona", "value")},
ids AS (SELECT unnest({_shuffled()}) AS pos, unnest(range(1, {N + 1})) AS id),
sim AS (SELECT id, day_id AS dia_relativo, k.persona AS persona_id, k.weekend, ob.value AS offset_, rb.value AS ritmo, mb.value AS missao_id, day_idx FROM k JOIN ids USING (pos)
JOIN ob ON ob.persona = k.persona AND ob.weekend = k.weekend AND ob.pos = kw JOIN rb ON rb.persona = k.persona AND rb.pos = k.k JOIN mb ON mb.persona = k.persona AND mb.pos = k.k)"""


def _tables(spark):
    return config.Tables(spark, CONFIG)


@query(f"WITH {_PLAN} SELECT * FROM plan")
def quota_plan_full(spark, sf):
    return planner.Plan(_tables(spark)).rows()


@query(f"WITH {_SIMS} SELECT id, dia_relativo, persona_id, weekend, offset_ AS \"offset\", ritmo, missao_id FROM sim")
def simulations_full(spark, sf):
    return planner.full_simulations(_tables(spark))


@query(f"""WITH {_SIMS}, o AS (SELECT 'dia_relativo' AS grain, NULL::VARCHAR AS persona, NULL::BOOLEAN AS weekend, dia_relativo AS value, count(*) AS n FROM sim GROUP BY dia_relativo
UNION ALL SELECT 'persona_id', persona_id, NULL, NULL, count(*) FROM sim GROUP BY persona_id
UNION ALL SELECT 'persona_weekend', persona_id, weekend, NULL, count(*) FROM sim GROUP BY persona_id, weekend
UNION ALL SELECT 'offset', persona_id, weekend, offset_, count(*) FROM sim GROUP BY persona_id, weekend, offset_
UNION ALL SELECT 'ritmo', persona_id, NULL, ritmo, count(*) FROM sim GROUP BY persona_id, ritmo
UNION ALL SELECT 'missao_id', persona_id, NULL, missao_id, count(*) FROM sim GROUP BY persona_id, missao_id)
SELECT coalesce(p.grain, o.grain) AS grain, coalesce(p.persona, o.persona) AS persona, coalesce(p.weekend, o.weekend) AS weekend, coalesce(p.value, o.value) AS value,
coalesce(quota, 0) AS planned, coalesce(n, 0) AS observed, coalesce(quota, 0) = coalesce(n, 0) AS ok
FROM plan p FULL JOIN o ON p.grain = o.grain AND p.persona IS NOT DISTINCT FROM o.persona AND p.weekend IS NOT DISTINCT FROM o.weekend AND p.value IS NOT DISTINCT FROM o.value""")
def audit_six_grains(spark, sf):
    t = _tables(spark)
    plan = planner.Plan(t)
    return planner.audit_grains(plan.rows(), planner.observed(planner.full_simulations(t, plan)))


_NOW = "2026-04-20 08:00:00"
_MISSIONS = [(m, x["titulo"], x["categoria"], x["urgencia"], x["complexidade"], x["missao"]) for m, x in CONFIG["missoes"].items()]
_RHYTHMS = [(k, *v) for k, v in planner.RHYTHMS.items()]
_PIECES = CONFIG["template_prompt"].replace("'", "''").replace("{identidade}", "' || identidade || '").replace("{como_agir}", "' || como_agir || '").replace("{missao}", "' || missao || '")


@query(f"""WITH {_SIMS},
t AS (SELECT sim.*, (DATE '2026-04-20' + (sim.day_idx - 1)::INT) + (anchor || ':00')::TIME AS tm FROM sim JOIN {_values(list(planner.OFFSET_ANCHORS.items()), 'offset_, anchor')} USING (offset_)),
u AS (SELECT *, CASE WHEN tm <= TIMESTAMP '{_NOW}' THEN tm + INTERVAL 7 DAY ELSE tm END AS target FROM t),
x AS (SELECT *, trim(regexp_replace('{_PIECES}', '[ \\t\\n]+', ' ', 'g')) AS p FROM u JOIN c ON c.day_id = dia_relativo
JOIN {_values([(p, v['identidade'], v['como_agir']) for p, v in CONFIG['personas'].items()], 'persona_id, identidade, como_agir')} USING (persona_id)
JOIN {_values(_MISSIONS, 'missao_id, missao_titulo, missao_categoria, missao_urgencia, missao_complexidade, missao')} USING (missao_id)
JOIN {_values(_RHYTHMS, 'ritmo, wpm, tmin, tmax')} USING (ritmo))
SELECT id, dia_relativo, c_idx AS dia_indice, month_idx::BIGINT AS mes_relativo, week_idx::BIGINT AS semana_relativa, dow AS dia_da_semana, dom::BIGINT AS dia_do_mes_sintetico, weekend,
persona_id, missao_id, offset_ AS "offset", ritmo, missao_titulo, missao_categoria, missao_urgencia, missao_complexidade, wpm::DOUBLE AS typing_speed_wpm, tmin::DOUBLE AS thinking_min_seconds, tmax::DOUBLE AS thinking_max_seconds,
strftime(target, '%Y-%m-%dT%H:%M:%S') AS target_local_datetime, epoch(target - TIMESTAMP '{_NOW}')::BIGINT AS temporal_offset_seconds,
CASE WHEN length(p) <= 60 THEN p ELSE rtrim(left(p, 57)) || '...' END AS prompt_preview
FROM (SELECT id, dia_relativo, x.day_idx AS c_idx, month_idx, week_idx, dow, dom, x.weekend, persona_id, missao_id, offset_, ritmo, missao_titulo, missao_categoria, missao_urgencia, missao_complexidade, wpm, tmin, tmax, target, p FROM x)""")
def projection_22(spark, sf):
    t = _tables(spark)
    return planner.project(planner.full_simulations(t), t, F.lit(_NOW).cast("timestamp_ntz"), 60).drop("prompt")


@query(f"""WITH {_SIMS} SELECT 'persona' AS kind, persona_id AS value, count(*) AS n FROM sim GROUP BY persona_id UNION ALL SELECT 'mission', missao_id, count(*) FROM sim GROUP BY missao_id
UNION ALL SELECT 'weekend', 'true', count(*) FILTER (weekend) FROM sim""")
def preview_counts(spark, sf):
    t = _tables(spark)
    return planner.preview_counts(planner.full_simulations(t))


#: A config with a violation of each kind of rule.
def broken_config() -> dict:
    import copy

    bad = copy.deepcopy(CONFIG)
    v = bad["amostragem"]["variaveis"]
    bad["template_prompt"] = "{identidade} {missao}"
    bad["amostragem"]["dag_ordem"] = ["persona_id", "offset", "dia_relativo", "weekend", "ritmo", "missao_id"]
    v["persona_id"]["composicao_pesos"]["peso_final"]["persona_01"] = 999
    v["offset"]["pesos_condicionais"]["persona_02"]["true"].pop("tarde")
    v["ritmo"]["pesos_condicionais"]["persona_03"] = {"lento": 1, "medio": 1, "rapido": 1}
    v["missao_id"]["missoes_elegiveis_por_persona"]["persona_04"]["H"].append("m99_inexistente")
    v["dia_relativo"]["composicao_pesos"]["fatores_semana_relativa"]["1"] = 0.5
    return bad


@query("""SELECT * FROM (VALUES ('template', 'template_prompt'), ('dag_order', 'offset'), ('calendar_factors', 'dia_relativo.composicao_pesos.fatores_semana_relativa'), ('persona_id_mean', 'persona_id.peso_final.persona_01'),
('offset_row', 'offset.persona_02.true'), ('rhythm_row', 'ritmo.persona_03'), ('mission_unknown', 'missao_id.persona_04'), ('mission_weights', 'missao_id.persona_04')) AS t("rule", path)""")
def validate_config(spark, sf):
    """The violations of a config that breaks a rule of each kind."""
    return validation.violation_rows(spark, validation.violations(broken_config())).select("rule", "path")


@query(f"""WITH {_SIMS}, b AS (SELECT * REPLACE (CASE WHEN id = 5 THEN 'd99' ELSE dia_relativo END AS dia_relativo, CASE WHEN id = 6 THEN NOT weekend ELSE weekend END AS weekend, CASE WHEN id = 7 THEN 'veloz' ELSE ritmo END AS ritmo) FROM sim)
SELECT 'unknown_dia_relativo' AS "rule", '5' AS key UNION ALL SELECT 'weekend', '6' UNION ALL SELECT 'rhythm_domain', '7'""")
def validate_generated(spark, sf):
    """The violations of single rows where three of the generated ones are broken."""
    t = _tables(spark)
    plan = planner.Plan(t)
    put = lambda i, c, x: F.when(F.col("id") == i, x).otherwise(F.col(c))
    rows = planner.full_simulations(t, plan).withColumn("dia_relativo", put(5, "dia_relativo", F.lit("d99"))).withColumn("weekend", put(6, "weekend", ~F.col("weekend"))).withColumn("ritmo", put(7, "ritmo", F.lit("veloz")))
    found = validation.generated_violations(rows, t, plan.rows())
    return found.where(~F.col("rule").startswith("quota_")).select("rule", "key")


@query("""SELECT o_orderkey AS missao_id, o_custkey AS persona_id, n_nationkey::BIGINT AS cenario_id, c_name AS dados_persona, n_name AS dados_cenario
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = o_orderkey % 30
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 5)""")
def missions_pending(spark, sf):
    """Missions with their personas and scenarios (a sixth have an unknown one) that have no template."""
    made = read(spark, sf, "orders").select(F.col("o_orderkey").alias("missao_id"), F.col("o_custkey").alias("persona_id"), (F.col("o_orderkey") % 30).alias("cenario_id"))
    people = read(spark, sf, "customer").select(F.col("c_custkey").alias("persona_id"), F.col("c_name").alias("dados"))
    scenarios = read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("cenario_id"), F.col("n_name").alias("dados_cenario"))
    templates = read(spark, sf, "lineitem").where("l_linenumber >= 5").select(F.col("l_orderkey").alias("missao_id")).distinct()
    return missions.pending(missions.detailed(made, people, scenarios), templates).select("missao_id", "persona_id", "cenario_id", "dados_persona", "dados_cenario")


__all__ = ["QUERIES"]
