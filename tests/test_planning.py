"""Config, validation, the whole plan and its projection, against a plain Python model of the contract."""

import copy
import json
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weft.operators import config, missions, planner, validation
from weft.plans import planning

BIG = config.synthetic(600, 44, 6, 8)


def apportioned(weights, n):
    exact = {k: Decimal(str(w)) for k, w in weights.items()}
    total = sum(exact.values())
    quota = {k: int(w * n / total) for k, w in exact.items()}
    rest = sorted(exact, key=lambda k: quota[k] - exact[k] * n / total)
    for k in rest[: n - sum(quota.values())]:
        quota[k] += 1
    return quota


def dealt(quota):
    out, r = [], 1
    while len(out) < sum(quota.values()):
        out += [k for k, q in quota.items() if q >= r]
        r += 1
    return out


def model(cfg):
    """The generated rows, row by row."""
    v, n = cfg["amostragem"]["variaveis"], cfg["amostragem"]["n"]
    days = [(f"d{i:02d}", (i - 1) % 7) for i in range(1, 91)]
    comp = v["dia_relativo"]["composicao_pesos"]
    raw = {}
    for i, (d, dow) in enumerate(days):
        dom = i % 30 + 1
        cycle = comp["ciclo_mensal_sintetico"]["base"] + sum(p["amplitude"] * math.exp(-((dom - p["centro_dia_mes"]) ** 2) / (2 * p["sigma"] ** 2)) for p in comp["ciclo_mensal_sintetico"]["picos_gaussianos"])
        raw[d] = comp["fatores_dia_semana"][planner.DAYS[dow]] * comp["fatores_semana_relativa"][str(i // 7 + 1)] * cycle * comp["multiplicadores_pico"].get(d, 1.0)
    total = sum(raw.values())
    quota = {d: math.floor(n * w / total) for d, w in raw.items()}
    for d in sorted(raw, key=lambda d: (n * raw[d] / total - quota[d], d), reverse=True)[: n - sum(quota.values())]:
        quota[d] += 1
    personas = apportioned(v["persona_id"]["composicao_pesos"]["peso_final"], n)
    rows = [{"dia_relativo": d, "persona_id": p, "weekend": dict(days)[d] >= 5} for d, p in zip(dealt(quota), dealt(personas), strict=True)]
    for p in personas:
        own = sorted((i for i, r in enumerate(rows) if r["persona_id"] == p), key=lambda i: (int(rows[i]["dia_relativo"][1:]), i))
        for w in (False, True):
            part = [i for i in own if rows[i]["weekend"] is w]
            for i, o in zip(part, dealt(apportioned(v["offset"]["pesos_condicionais"][p][str(w).lower()], len(part))), strict=True):
                rows[i]["offset"] = o
        for name in ("ritmo", "missao_id"):
            for i, x in zip(own, dealt(apportioned(v[name]["pesos_condicionais"][p], len(own))), strict=True):
                rows[i][name] = x
    random.Random(cfg["amostragem"]["seed"]).shuffle(rows)
    return [r | {"id": i} for i, r in enumerate(rows, 1)]


@pytest.fixture(scope="module")
def generated(spark):
    t = config.Tables(spark, BIG)
    plan = planner.Plan(t)
    return t, plan.rows().cache(), planner.full_simulations(t, plan).cache()


def test_rows_are_the_models(generated):
    key = lambda r: tuple(r[f] for f in validation.FIELDS)
    assert sorted(map(key, generated[2].collect())) == sorted(map(key, model(BIG)))


@pytest.mark.parametrize("n", [1, 7, 90])
def test_small_plans(spark, n):
    cfg = config.synthetic(n, 3, 3, 5)
    t = config.Tables(spark, cfg)
    got = planner.full_simulations(t).collect()
    key = lambda r: tuple(r[f] for f in validation.FIELDS)
    assert sorted(map(key, got)) == sorted(map(key, model(cfg)))


def test_plan_is_audited_at_six_grains(generated):
    t, plan, sims = generated
    checks = planner.audit_checks(planner.audit_grains(plan, planner.observed(sims))).collect()
    assert {r["grain"] for r in checks} == set(planner.GRAINS) and all(r["ok"] and r["total"] == 600 for r in checks)
    moved = sims.withColumn("offset", F.when(F.col("id") == 1, "tarde").otherwise(F.col("offset")))
    moved = moved.withColumn("offset", F.when(F.col("id") == 2, "manha").otherwise(F.col("offset")))
    off = {r["grain"] for r in planner.audit_checks(planner.audit_grains(plan, planner.observed(moved))).collect() if not r["ok"]}
    assert off <= {"offset"}
    assert sum(r["n"] for r in planner.observed(sims).where("grain = 'persona_weekend'").collect()) == 600


def test_generated_rows_that_break_a_rule(spark, generated):
    t, plan, sims = generated
    rules = lambda df: {r["rule"] for r in validation.generated_violations(df, t, plan).collect()}
    assert rules(sims) == set()
    one = lambda column, value: sims.withColumn(column, F.when(F.col("id") == 5, F.lit(value)).otherwise(F.col(column)))
    assert "unknown_dia_relativo" in rules(one("dia_relativo", "d99"))
    assert {"unknown_persona_id"} <= rules(one("persona_id", "nobody"))
    assert {"unknown_missao_id", "eligible"} <= rules(one("missao_id", "m99"))
    assert "weekend" in rules(sims.withColumn("weekend", ~F.col("weekend")))
    assert {"rhythm_domain", "quota_ritmo"} <= rules(one("ritmo", "veloz"))
    assert "offset_domain" in rules(one("offset", "noite"))
    assert {"id", "total"} <= rules(sims.where("id <> 600").unionByName(sims.where("id = 1")).unionByName(sims.where("id = 1")))
    assert rules(sims.drop("ritmo")) == {"fields"}
    assert "weekend" in rules(one("weekend", None))


def broken(path, value):
    cfg = copy.deepcopy(BIG)
    at = cfg
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return cfg


V = ("amostragem", "variaveis")


@pytest.mark.parametrize(
    "path, value, rule",
    [
        (("versao",), "4.3", "version"),
        (("personas",), [], "shape"),
        (("personas", "persona_01", "identidade"), "", "shape"),
        (("missoes", "m01", "urgencia"), "urgente", "shape"),
        (("amostragem", "n"), 0, "shape"),
        (("amostragem", "n"), True, "shape"),
        (("janela_temporal", "duracao"), 91, "shape"),
        (("janela_temporal", "dia_inicio"), "feriado", "shape"),
        (("janela_temporal", "calendario_sintetico"), False, "shape"),
        ((*V, "dia_relativo", "calendario"), {}, "shape"),
        ((*V, "dia_relativo", "composicao_pesos", "pesos"), {"d01": 1}, "shape"),
        ((*V, "persona_id", "composicao_pesos", "cotas_planejadas_n_6000"), {"persona_01": 1}, "shape"),
        ((*V, "ritmo", "pesos_condicionais", "persona_01", "_default"), 1, "no_default"),
        (("template_prompt",), "{identidade} {missao}", "template"),
        (("template_prompt",), "{identidade", "template"),
        (("amostragem", "dag_ordem"), ["persona_id", "dia_relativo", "offset", "weekend", "ritmo", "missao_id"], "dag_order"),
        (("amostragem", "dag_ordem"), ["persona_id", "dia_relativo", "weekend", "offset", "ritmo", "outra"], "dag_variables"),
        ((*V, "offset", "depende_de"), ["persona_id", "variavel_fantasma"], "dag_parent"),
        (("contexto_negocio",), "outro", "contract"),
        (("amostragem", "alocacao_controlada", "embaralhamento_final"), False, "contract"),
        (("amostragem", "alocacao_controlada", "etapas"), ["6000"] * 8, "steps"),
        ((*V, "dia_relativo", "composicao_pesos", "fatores_dia_semana", "segunda"), 2.0, "calendar_factors"),
        ((*V, "persona_id", "composicao_pesos", "peso_final", "persona_01"), 999, "persona_id_mean"),
        ((*V, "persona_id", "composicao_pesos", "peso_final"), {"persona_01": 1}, "persona_id_keys"),
        ((*V, "offset", "pesos_condicionais", "persona_01", "true"), {"manha": 1}, "offset_row"),
        ((*V, "ritmo", "pesos_condicionais", "persona_02"), {"lento": 1, "medio": 1, "rapido": 1}, "rhythm_row"),
        ((*V, "missao_id", "pesos_por_nivel"), {"H": 3, "M": 1}, "mission_contract"),
        ((*V, "missao_id", "missoes_elegiveis_por_persona", "persona_01", "H"), ["m99_inexistente"], "mission_unknown"),
        ((*V, "missao_id", "missoes_elegiveis_por_persona", "persona_01"), {"H": [], "M": []}, "mission_none"),
        (("missoes", "m99"), {"titulo": "t", "categoria": "c", "urgencia": "alta", "complexidade": "alta", "missao": "m"}, "mission_unused"),
    ],
)
def test_config_rules(path, value, rule):
    found = validation.violations(broken(path, value))
    assert rule in {f[0] for f in found}
    with pytest.raises(validation.ConfigError):
        validation.check(broken(path, value))


def test_valid_configs(spark, tmp_path):
    for args in ((6000, 44, 24, 26), (1, 1, 2, 2), (90, 5, 1, 1)):
        assert validation.violations(config.synthetic(*args)) == []
    (tmp_path / "c.json").write_text(json.dumps(BIG))
    assert config.load(spark, str(tmp_path / "c.json")) == BIG
    (tmp_path / "bad.json").write_text(json.dumps(broken(("versao",), "1")))
    with pytest.raises(validation.ConfigError, match="version"):
        config.load(spark, str(tmp_path / "bad.json"))


def test_conditional_weights():
    spec = {"depende_de": ["persona_id", "weekend"], "pesos_condicionais": {"ana": {"false": {"manha": 3, "tarde": 1}, "true": {"manha": 1, "tarde": 2}}}}
    assert config.conditional(spec, {"persona_id": "ana", "weekend": True}) == {"manha": 1, "tarde": 2}
    for instance in ({"persona_id": "ana"}, {"persona_id": "bia", "weekend": False}):
        with pytest.raises(validation.ConfigError):
            config.conditional(spec, instance)
    assert config.whole_weights({"a": 0.25, "b": 1.5, "c": 2}) == {"a": 25, "b": 150, "c": 200}


def test_calendar_start(spark):
    with pytest.raises(ValueError):
        planner.calendar(spark, start="feriado")
    assert planner.calendar(spark, start="sabado").orderBy("day_idx").first()["weekend"]


def test_projection(spark, generated):
    t, _, sims = generated
    now = F.lit("2026-04-20 08:00:00").cast("timestamp_ntz")
    out = planner.project(sims, t, now)
    assert out.columns == [*planner.PREVIEW, "prompt"] and out.count() == 600
    r = out.where("dia_relativo = 'd01' AND offset = 'manha'").first()
    assert r["target_local_datetime"] == "2026-04-20T09:00:00" and r["temporal_offset_seconds"] == 3600
    assert r["prompt_preview"].startswith("Você é pessoa") and "\n" not in r["prompt_preview"]
    speeds = {x["ritmo"]: (x["typing_speed_wpm"], x["thinking_min_seconds"], x["thinking_max_seconds"]) for x in out.collect()}
    assert speeds == planner.RHYTHMS
    odd = planner.project(sims.limit(1).withColumn("ritmo", F.lit("?")).withColumn("offset", F.lit("?")), t, now).first()
    assert (odd["typing_speed_wpm"], odd["target_local_datetime"], odd["temporal_offset_seconds"]) == (42.0, "", 0)
    counts = {(x["kind"], x["value"]): x["n"] for x in planner.preview_counts(out).collect()}
    assert sum(n for (k, _), n in counts.items() if k == "persona") == 600


def test_unequal_sequences_raise(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "pos long, a string")
    b = spark.createDataFrame([(1, "z")], "pos long, b string")
    with pytest.raises(planner.UnequalLengths):
        planner.zip_positions(a, b)


def test_shuffle_is_the_contracts(spark):
    order = list(range(1, 5001))
    random.Random(9).shuffle(order)
    assert {r["id"]: r["pos"] for r in planner.shuffled_ids(spark, 5000, 9).collect()} == dict(enumerate(order, 1))


def test_planning_queries_are_registered():
    assert {"quota_plan_full", "simulations_full", "projection_22", "audit_six_grains", "validate_config", "validate_generated"} <= set(planning.QUERIES)


def test_missions(spark):
    people = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "persona_id long, dados string")
    places = spark.createDataFrame([("x", "dx"), ("y", "dy")], "cenario_id string, dados_cenario string")
    have = spark.createDataFrame([(1, "x")], "persona_id long, cenario_id string")
    assert sorted(map(tuple, missions.pairs(people, places, have).collect())) == [(1, "y"), (2, "x"), (2, "y")]
    made = spark.createDataFrame([(10, 1, "x"), (11, 1, "y"), (12, 9, "x")], "missao_id long, persona_id long, cenario_id string")
    details = missions.detailed(made, people.distinct(), places)
    assert sorted(r["missao_id"] for r in details.collect()) == [10, 11]
    templates = spark.createDataFrame([(10,), (None,)], "missao_id long")
    assert [r["dados_cenario"] for r in missions.pending(details, templates).collect()] == ["dy"]
    assert [r for r, _ in missions.few_shot("s", [("q", "a")], "x")] == ["system", "user", "assistant", "user"]
