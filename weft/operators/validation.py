"""Declarative validation: of a config (on the driver, where it lives) and of generated rows (by joins with its tables).

A violation is a row (rule, path, detail). A config's rules come in the order of the contract: its shape first, sorted by
path, and nothing else if that is wrong; check() raises the first violation.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.scratch import checkpointed
from weft.operators import config as c
from weft.operators import planner

TOLERANCE = Decimal("0.0001")
FIELDS = ["id", "dia_relativo", "persona_id", "weekend", "offset", "ritmo", "missao_id"]
Violation = tuple[str, str, str]


class ConfigError(ValueError):
    def __init__(self, rule: str, path: str, detail: str) -> None:
        super().__init__(f"{rule} at {path}: {detail}")
        self.rule, self.path, self.detail = rule, path, detail


# ---- shape: dict = object with exactly these keys, Each = any keys, list = items, else a predicate with its name -----


class Each:
    """An object with any keys, `least` or more, whose values have one shape."""

    def __init__(self, shape, least: int = 0, fixed: dict | None = None) -> None:
        self.shape, self.least, self.fixed = shape, least, fixed or {}


class Items:
    def __init__(self, shape, least: int = 0, most: int | None = None, distinct: bool = False) -> None:
        self.shape, self.least, self.most, self.distinct = shape, least, most, distinct


def is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def named(name: str, test: Callable) -> Callable:
    test.__name__ = name
    return test


TEXT = named("a text that isn't empty", lambda v: isinstance(v, str) and v != "")
WEIGHT = named("a number above zero", lambda v: is_number(v) and v > 0)
NUMBER = named("a number", is_number)
FLAG = named("a boolean", lambda v: isinstance(v, bool))
WHOLE = named("a whole number", lambda v: is_number(v) and v == int(v))
COUNT = named("a whole number above zero", lambda v: is_number(v) and v == int(v) and v >= 1)


def just(*values) -> Callable:
    return named(f"one of {values}", lambda v: any(v == x and isinstance(v, bool) == isinstance(x, bool) for x in values))


_WEIGHTS = Each(WEIGHT, 1)
_LEVEL = just("baixa", "media", "alta")


def _variable(kind: str, on, **more) -> dict:
    return {"descricao": TEXT, "tipo": just(kind), "depende_de": on, **more}


SHAPE = {
    "versao": just(c.VERSION),
    "contexto_negocio": TEXT,
    "canal": TEXT,
    "personas": Each({"identidade": TEXT, "como_agir": TEXT}),
    "missoes": Each({"titulo": TEXT, "categoria": TEXT, "urgencia": _LEVEL, "complexidade": _LEVEL, "missao": TEXT}),
    "template_prompt": TEXT,
    "janela_temporal": {"unidade": just("dias"), "duracao": just(90), "calendario_sintetico": just(True), "dia_inicio": just(*planner.DAYS), "dias_por_mes_sintetico": just(30), "descricao": TEXT},
    "amostragem": {
        "n": COUNT,
        "seed": WHOLE,
        "metodo": TEXT,
        "dag_ordem": Items(named("a text", lambda v: isinstance(v, str)), 6, distinct=True),
        "formula_conjunta": TEXT,
        "variaveis": {
            "dia_relativo": _variable(
                "categorica",
                just(None),
                composicao_pesos={
                    "tipo": just(c.DAY_TYPE),
                    "formula": TEXT,
                    "fatores_dia_semana": {d: WEIGHT for d in planner.DAYS},
                    "fatores_semana_relativa": {str(i): WEIGHT for i in range(1, 14)},
                    "ciclo_mensal_sintetico": {"base": WEIGHT, "picos_gaussianos": Items({"centro_dia_mes": NUMBER, "amplitude": NUMBER, "sigma": NUMBER}, 2, 2)},
                    "multiplicadores_pico": Each(WEIGHT),
                },
            ),
            "persona_id": _variable("categorica", just(None), composicao_pesos={"formula": TEXT, "prevalencia_operacional": _WEIGHTS, "cobertura_experimental": _WEIGHTS, "peso_final": _WEIGHTS}),
            "weekend": _variable("derivada", TEXT, regra=TEXT),
            "offset": _variable("categorica", Items(TEXT, 2), categorias=Each(TEXT, 1), pesos_condicionais=Each(Each(_WEIGHTS, 1), 1)),
            "ritmo": _variable("categorica", TEXT, pesos_condicionais=Each(_WEIGHTS, 1)),
            "missao_id": _variable(
                "categorica_restrita",
                TEXT,
                compatibilidade_utilizada=Items(TEXT, 1),
                compatibilidade_excluida=Items(TEXT, 1),
                pesos_por_nivel=_WEIGHTS,
                composicao_pesos_base=Each(named("anything", lambda v: True), 4, {"formula": TEXT, "prevalencia_operacional": _WEIGHTS, "cobertura_experimental": _WEIGHTS, "peso_final_base": _WEIGHTS}),
                missoes_elegiveis_por_persona=Each({"H": Items(TEXT), "M": Items(TEXT)}, 1),
                pesos_condicionais=Each(_WEIGHTS, 1),
            ),
        },
        "alocacao_controlada": {"descricao": TEXT, "etapas": Items(TEXT, 8), "embaralhamento_final": FLAG},
        "restricoes": {"duracao_nao_amostrada": FLAG, "descricao_duracao": TEXT, "compatibilidade_minima_para_cruzamento": TEXT, "texto_canal": TEXT, "descricao": TEXT},
    },
}


def shape_violations(value, shape, path: tuple = ()) -> Iterator[tuple[tuple, str]]:
    """(path, detail) of all that departs from the shape."""
    if isinstance(shape, (dict, Each)):
        if not isinstance(value, dict):
            yield path, "not an object"
            return
        known = shape if isinstance(shape, dict) else shape.fixed
        yield from ((path, f"{k} is missing") for k in known if k not in value)
        if isinstance(shape, Each) and len(value) < shape.least:
            yield path, f"fewer than {shape.least} entries"
        for k, v in value.items():
            if k in known:
                yield from shape_violations(v, known[k], (*path, k))
            elif isinstance(shape, Each):
                yield from shape_violations(v, shape.shape, (*path, k))
            else:
                yield path, f"{k} isn't allowed"
    elif isinstance(shape, Items):
        if not isinstance(value, list):
            yield path, "not a list"
            return
        if len(value) < shape.least or (shape.most is not None and len(value) > shape.most):
            yield path, f"{len(value)} items"
        if shape.distinct and any(v in value[:i] for i, v in enumerate(value)):
            yield path, "repeated items"
        for i, v in enumerate(value):
            yield from shape_violations(v, shape.shape, (*path, i))
    elif not shape(value):
        yield path, f"not {shape.__name__}"


# ---- rules ----------------------------------------------------------------------------------------------------------


def no_defaults(node, path: str = "$") -> Iterator[Violation]:
    if isinstance(node, dict):
        if "_default" in node:
            yield "no_default", path, "_default isn't allowed"
        for k, v in node.items():
            yield from no_defaults(v, f"{path}.{k}")
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from no_defaults(v, f"{path}[{i}]")


def template_rules(template: str) -> Iterator[Violation]:
    try:
        names = {n for _, n, _, _ in string.Formatter().parse(template) if n is not None}
    except ValueError as e:
        yield "template", "template_prompt", str(e)
        return
    if names != {"identidade", "como_agir", "missao"}:
        yield "template", "template_prompt", f"placeholders {sorted(names)}"


def dag_rules(order: list[str], parents: dict[str, object]) -> Iterator[Violation]:
    """Variables once each, all of them, and every parent before its children."""
    at = {v: i for i, v in reversed(list(enumerate(order)))}
    if len(at) != len(order):
        yield "dag_duplicates", "dag_ordem", "repeated variables"
    if set(at) != set(parents):
        yield "dag_variables", "dag_ordem", f"differs by {sorted(set(at) ^ set(parents))}"
    for v in order:
        own = parents.get(v)
        for parent in [] if own is None else [own] if isinstance(own, str) else own:
            if parent not in at:
                yield "dag_parent", v, f"{parent} não está em dag_ordem"
            elif at[parent] >= at[v]:
                yield "dag_order", v, f"{parent} isn't before it"


def weight_rules(path: str, weights: dict) -> Iterator[Violation]:
    if not weights:
        yield "weights", path, "empty"
    for k, w in weights.items():
        if not is_number(w) or w <= 0:
            yield "weights", f"{path}.{k}", f"{w!r} isn't above zero"


def same_keys(rule: str, path: str, got, want) -> Iterator[Violation]:
    if set(got) != set(want):
        yield rule, path, f"differs by {sorted(set(got) ^ set(want))}"


def equal(rule: str, path: str, got, want) -> Iterator[Violation]:
    if got != want or isinstance(got, bool) != isinstance(want, bool):
        yield rule, path, f"{got!r} instead of {want!r}"


def calendar_rules(window: dict, day: dict) -> Iterator[Violation]:
    for name, want in (("unidade", "dias"), ("duracao", 90), ("calendario_sintetico", True), ("dias_por_mes_sintetico", 30)):
        yield from equal("window", f"janela_temporal.{name}", window[name], want)
    if "calendario" in day:
        yield "calendar", "dia_relativo.calendario", "a calendar isn't allowed here"
    own = day["composicao_pesos"]
    if "pesos" in own:
        yield "calendar", "dia_relativo.composicao_pesos.pesos", "explicit weights aren't allowed"
    for name, want in c.day_composition().items():
        yield from equal("calendar_factors", f"dia_relativo.composicao_pesos.{name}", own[name], want)


def composed_rules(rule: str, own: dict, keys, last: str, formula: str, held: bool) -> Iterator[Violation]:
    """Weights for exactly these keys; where `held`, the last ones are the mean of the two others."""
    yield from equal(f"{rule}_formula", f"{rule}.formula", own["formula"], formula)
    for name in ("prevalencia_operacional", "cobertura_experimental", last):
        yield from same_keys(f"{rule}_keys", f"{rule}.{name}", own[name], keys)
        yield from weight_rules(f"{rule}.{name}", own[name])
    exact = lambda name, k: Decimal(str(own[name][k]))
    for k in keys if held else ():
        if all(k in own[x] for x in ("prevalencia_operacional", "cobertura_experimental", last)):
            want = (exact("prevalencia_operacional", k) + exact("cobertura_experimental", k)) / 2
            if abs(exact(last, k) - want) > TOLERANCE:
                yield f"{rule}_mean", f"{rule}.{last}.{k}", f"{last} of {k} is {own[last][k]} instead of {want}"


def offset_rules(personas, own: dict) -> Iterator[Violation]:
    yield from equal("offset_parents", "offset.depende_de", own["depende_de"], ["persona_id", "weekend"])
    yield from equal("offset_categories", "offset.categorias", list(own["categorias"]), list(planner.OFFSET_ANCHORS))
    yield from same_keys("offset_personas", "offset.pesos_condicionais", own["pesos_condicionais"], personas)
    for p, by in own["pesos_condicionais"].items():
        yield from same_keys("offset_weekend", f"offset.{p}", by, ("false", "true"))
        for w, row in by.items():
            yield from same_keys("offset_row", f"offset.{p}.{w}", row, own["categorias"])
            yield from weight_rules(f"offset.{p}.{w}", row)


def rhythm_rules(personas, own: dict) -> Iterator[Violation]:
    yield from equal("rhythm_parents", "ritmo.depende_de", own["depende_de"], "persona_id")
    yield from same_keys("rhythm_personas", "ritmo.pesos_condicionais", own["pesos_condicionais"], personas)
    for p, row in own["pesos_condicionais"].items():
        yield from equal("rhythm_row", f"ritmo.{p}", list(row), c.RHYTHM_ORDER)
        yield from weight_rules(f"ritmo.{p}", row)


def mission_rules(personas, missions, own: dict) -> Iterator[Violation]:
    for name, want in (("depende_de", "persona_id"), ("compatibilidade_utilizada", ["H", "M"]), ("compatibilidade_excluida", ["L", "N"]), ("pesos_por_nivel", {"H": 2, "M": 1})):
        yield from equal("mission_contract", f"missao_id.{name}", own[name], want)
    yield from composed_rules("missao_id", own["composicao_pesos_base"], missions, "peso_final_base", c.MISSION_FORMULA, held=False)
    open_, weights = own["missoes_elegiveis_por_persona"], own["pesos_condicionais"]
    yield from same_keys("mission_personas", "missao_id.missoes_elegiveis_por_persona", open_, personas)
    yield from same_keys("mission_personas", "missao_id.pesos_condicionais", weights, personas)
    for p in (p for p in personas if p in open_):
        yield from same_keys("mission_levels", f"missao_id.{p}", open_[p], ("H", "M"))
        listed = [m for level in ("H", "M") for m in open_[p].get(level, ())]
        if not listed:
            yield "mission_none", f"missao_id.{p}", "no mission"
        if len(set(listed)) != len(listed):
            yield "mission_duplicates", f"missao_id.{p}", "repeated missions"
        if unknown := sorted(set(listed) - set(missions)):
            yield "mission_unknown", f"missao_id.{p}", f"missões inexistentes: {unknown}"
        if p in weights:
            yield from same_keys("mission_weights", f"missao_id.{p}", weights[p], listed)
            yield from weight_rules(f"missao_id.{p}", weights[p])
    used = {m for by in open_.values() for ms in by.values() for m in ms}
    if unused := sorted(set(missions) - used):
        yield "mission_unused", "missao_id", f"never eligible: {unused}"


def violations(config) -> list[Violation]:
    """All violations of a config, in the order of the contract."""
    if not isinstance(config, dict):
        return [("shape", "$", "not an object")]
    if config.get("versao") != c.VERSION:
        return [("version", "versao", f"{config.get('versao')!r} instead of {c.VERSION!r}")]
    found = sorted(shape_violations(config, SHAPE), key=lambda x: [str(p) for p in x[0]])
    if found:
        return [("shape", ".".join(map(str, path)) or "$", detail) for path, detail in found] + list(no_defaults(config))
    sampling = config["amostragem"]
    v, personas, missions = sampling["variaveis"], config["personas"], config["missoes"]
    out = [*no_defaults(config), *template_rules(config["template_prompt"]), *dag_rules(sampling["dag_ordem"], {k: x.get("depende_de") for k, x in v.items()})]
    plain = [
        ("contexto_negocio", config["contexto_negocio"], c.CONTEXT),
        ("canal", config["canal"], c.CHANNEL),
        ("amostragem.metodo", sampling["metodo"], c.METHOD),
        ("amostragem.formula_conjunta", sampling["formula_conjunta"], c.JOINT_FORMULA),
        ("amostragem.alocacao_controlada.embaralhamento_final", sampling["alocacao_controlada"]["embaralhamento_final"], True),
        ("amostragem.alocacao_controlada.etapas", len(sampling["alocacao_controlada"]["etapas"]), c.STEPS),
        ("amostragem.restricoes.duracao_nao_amostrada", sampling["restricoes"]["duracao_nao_amostrada"], True),
        ("amostragem.restricoes.compatibilidade_minima_para_cruzamento", sampling["restricoes"]["compatibilidade_minima_para_cruzamento"], "M"),
        ("amostragem.variaveis.weekend.depende_de", v["weekend"]["depende_de"], "dia_relativo"),
        ("amostragem.variaveis.weekend.regra", v["weekend"]["regra"], c.WEEKEND_RULE),
    ]
    for path, got, want in plain:
        out += equal("contract", path, got, want)
    out += [("steps", "amostragem.alocacao_controlada.etapas", "names a fixed n") for step in sampling["alocacao_controlada"]["etapas"] if "6000" in step]
    out += [*calendar_rules(config["janela_temporal"], v["dia_relativo"]), *composed_rules("persona_id", v["persona_id"]["composicao_pesos"], personas, "peso_final", c.PERSONA_FORMULA, held=True)]
    return out + [*offset_rules(personas, v["offset"]), *rhythm_rules(personas, v["ritmo"]), *mission_rules(personas, missions, v["missao_id"])]


def check(config) -> None:
    for first in violations(config):
        raise ConfigError(*first)


def violation_rows(spark: SparkSession, found: list[Violation]) -> DataFrame:
    return spark.createDataFrame(found, "rule string, path string, detail string")


# ---- generated rows -------------------------------------------------------------------------------------------------


def generated_violations(rows: DataFrame, t: c.Tables, plan: DataFrame) -> DataFrame:
    """(rule, key, detail) of generated rows(id, dia_relativo, ...) against the config's tables and its plan of quotas."""
    if set(rows.columns) != set(FIELDS):
        return violation_rows(rows.sparkSession, [("fields", ",".join(sorted(rows.columns)), "")]).withColumnRenamed("path", "key")
    rows, plan = checkpointed(rows), checkpointed(plan)  # every rule reads them
    v = lambda df, rule, key, detail: df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col(detail).cast("string").alias("detail"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != t.n).withColumn("want", F.lit(t.n))
    out = v(total, "total", "n", "want")
    bad_ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("id").isNull() | (F.col("id") < 1) | (F.col("id") > t.n))
    out = out.unionByName(v(bad_ids, "id", "id", "n"))
    day = t.calendar.select(F.col("day_id").alias("dia_relativo"), F.col("weekend").alias("weekend_of_day"))
    domains = [("dia_relativo", day), ("persona_id", t.personas.select(F.col("persona").alias("persona_id"))), ("missao_id", t.missions.select(F.col("mission").alias("missao_id")))]
    for name, known in domains:
        out = out.unionByName(v(rows.join(F.broadcast(known.select(name)), name, "left_anti"), f"unknown_{name}", "id", name))
    out = out.unionByName(v(rows.join(F.broadcast(day), "dia_relativo").where(~F.col("weekend").eqNullSafe(F.col("weekend_of_day"))), "weekend", "id", "dia_relativo"))
    named = lambda df, *pairs: df.select(*[F.col(a).alias(b) for a, b in pairs])
    tables = [
        ("offset_domain", named(t.offset_weights, ("persona", "persona_id"), ("weekend", "weekend"), ("offset", "offset")), "offset"),
        ("rhythm_domain", named(t.rhythm_weights, ("persona", "persona_id"), ("rhythm", "ritmo")), "ritmo"),
        ("eligible", named(t.eligible, ("persona", "persona_id"), ("mission", "missao_id")), "missao_id"),
    ]
    for rule, known, detail in tables:
        out = out.unionByName(v(rows.join(F.broadcast(known), known.columns, "left_anti"), rule, "id", detail))
    compared = planner.audit_grains(plan, planner.observed(rows))
    key = F.concat_ws("/", "persona", F.col("weekend").cast("string"), "value").alias("key")
    return out.unionByName(compared.where(~F.col("ok")).select(F.concat(F.lit("quota_"), F.col("grain")).alias("rule"), key, F.concat_ws("/", F.col("planned").cast("string"), F.col("observed").cast("string")).alias("detail")))
