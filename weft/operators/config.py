"""The sampling config: a synthetic one by rule, reading one, and its weights as tables.

A config is a bounded document that lives on the driver; what depends on it at the size of the plan is a join with its tables.
"""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import planner

# Fixed values of the contract.
VERSION = "4.4"
CONTEXT = "cartao_de_credito"
CHANNEL = "chatbot textual em app/site"
METHOD = "cotas_controladas_com_maiores_restos"
JOINT_FORMULA = "P(dia_relativo) × P(persona) × P(offset | persona, weekend(dia_relativo)) × P(ritmo | persona) × P(missao | persona, compatibilidade ∈ {H,M})"
PERSONA_FORMULA = "peso_final = 0.5 * prevalencia_operacional + 0.5 * cobertura_experimental"
MISSION_FORMULA = "peso_final_base = 0.5 * prevalencia_operacional + 0.5 * cobertura_experimental"
WEEKEND_RULE = "weekend = true quando dia_da_semana ∈ {sabado, domingo}; caso contrário, false."
DAY_TYPE = "fatores_temporais_parametricos_90d"
DAY_FORMULA = "peso_bruto = fator_dia_semana * fator_semana_relativa * ciclo_mensal_sintetico * multiplicador_pico"
RHYTHM_ORDER = ["rapido", "medio", "lento"]
STEPS = 8


def day_composition() -> dict:
    peaks = [{"centro_dia_mes": c, "amplitude": a, "sigma": s} for c, a, s in planner.CYCLE_PEAKS]
    return {
        "tipo": DAY_TYPE,
        "formula": DAY_FORMULA,
        "fatores_dia_semana": dict(zip(planner.DAYS, planner.DAY_FACTORS)),
        "fatores_semana_relativa": {str(i): w for i, w in enumerate(planner.WEEK_FACTORS, 1)},
        "ciclo_mensal_sintetico": {"base": planner.CYCLE_BASE, "picos_gaussianos": peaks},
        "multiplicadores_pico": {f"d{d:02d}": m for d, m in planner.PEAK_DAYS.items()},
    }


def synthetic(n: int = 6000, seed: int = 44, personas: int = 24, missions: int = 26) -> dict:
    """A valid config made by rule: weights of small decimals, every mission open to some persona."""
    ps, ms = [f"persona_{i:02d}" for i in range(1, personas + 1)], [f"m{i:02d}" for i in range(1, missions + 1)]
    weight = lambda i, k: (i * k) % 17 + 1

    def composed(keys: list[str], last: str, formula: str) -> dict:
        a, b = ({x: weight(i, k) for i, x in enumerate(keys, 1)} for k in (3, 7))
        return {"formula": formula, "prevalencia_operacional": a, "cobertura_experimental": b, last: {x: (a[x] + b[x]) / 2 for x in keys}}

    def eligible(i: int) -> dict:
        own = [m for j, m in enumerate(ms) if (j - i) % min(4, missions, personas) == 0]
        return {"H": own[::2], "M": own[1::2]}

    open_ = {p: eligible(i) for i, p in enumerate(ps)}
    dependent = lambda text, on, **more: {"descricao": text, "tipo": "categorica", "depende_de": on, **more}
    variables = {
        "dia_relativo": dependent("dia", None, composicao_pesos=day_composition()),
        "persona_id": dependent("persona", None, composicao_pesos=composed(ps, "peso_final", PERSONA_FORMULA)),
        "weekend": {"descricao": "fim de semana", "tipo": "derivada", "depende_de": "dia_relativo", "regra": WEEKEND_RULE},
        "offset": dependent(
            "faixa", ["persona_id", "weekend"],
            categorias={o: o for o in planner.OFFSET_ANCHORS},
            pesos_condicionais={p: {w: {o: weight(i + j + k, 5) for j, o in enumerate(planner.OFFSET_ANCHORS)} for k, w in enumerate(("false", "true"))} for i, p in enumerate(ps)},
        ),
        "ritmo": dependent("ritmo", "persona_id", pesos_condicionais={p: {r: weight(i + j, 4) / 4 for j, r in enumerate(RHYTHM_ORDER)} for i, p in enumerate(ps)}),
        "missao_id": {
            "descricao": "missao", "tipo": "categorica_restrita", "depende_de": "persona_id",
            "compatibilidade_utilizada": ["H", "M"], "compatibilidade_excluida": ["L", "N"], "pesos_por_nivel": {"H": 2, "M": 1},
            "composicao_pesos_base": composed(ms, "peso_final_base", MISSION_FORMULA),
            "missoes_elegiveis_por_persona": open_,
            "pesos_condicionais": {p: {m: weight(ms.index(m) + 1, 3) * (2 if m in x["H"] else 1) for m in x["H"] + x["M"]} for p, x in open_.items()},
        },
    }
    return {
        "versao": VERSION, "contexto_negocio": CONTEXT, "canal": CHANNEL,
        "template_prompt": "Você é {identidade}\n[[ como agir ]] {como_agir}\n[[ missão ]]   {missao} quit",
        "personas": {p: {"identidade": f"pessoa {p}", "como_agir": f"age como {p}"} for p in ps},
        "missoes": {m: {"titulo": f"Missão {m}", "categoria": ("limite", "fatura", "cartao")[i % 3], "urgencia": ("baixa", "media", "alta")[i % 3], "complexidade": ("alta", "baixa", "media")[i % 3], "missao": f"resolver {m}"} for i, m in enumerate(ms)},
        "janela_temporal": {"unidade": "dias", "duracao": 90, "calendario_sintetico": True, "dia_inicio": "segunda", "dias_por_mes_sintetico": 30, "descricao": "janela"},
        "amostragem": {
            "n": n, "seed": seed, "metodo": METHOD, "dag_ordem": ["dia_relativo", "persona_id", "weekend", "offset", "ritmo", "missao_id"], "formula_conjunta": JOINT_FORMULA,
            "variaveis": variables,
            "alocacao_controlada": {"descricao": "alocação", "etapas": [f"etapa {i}" for i in range(1, STEPS + 1)], "embaralhamento_final": True},
            "restricoes": {"duracao_nao_amostrada": True, "descricao_duracao": "d", "compatibilidade_minima_para_cruzamento": "M", "texto_canal": "t", "descricao": "r"},
        },
    }


def load(spark: SparkSession, path: str) -> dict:
    """The config in a JSON file of any store that Spark reads; raises ConfigError with the first violation."""
    from weft.operators.validation import check

    config = json.loads(spark.read.text(path, wholetext=True).first()[0])
    check(config)
    return config


def whole_weights(weights: dict) -> dict[str, int]:
    """Weights in the same proportions as whole numbers, exactly: apportionment needs no decimals then."""
    exact = {k: Decimal(str(w)) for k, w in weights.items()}
    places = max((max(0, -d.as_tuple().exponent) for d in exact.values()), default=0)
    return {k: int(d.scaleb(places)) for k, d in exact.items()}


def conditional(spec: dict, instance: dict) -> dict:
    """The weights that hold for the values of the variable's parents; booleans stand as false and true."""
    from weft.operators.validation import ConfigError

    parents = spec.get("depende_de")
    if parents is None:
        raise ConfigError("conditional", "$", "no depende_de")
    at, path = spec["pesos_condicionais"], []
    for parent in [parents] if isinstance(parents, str) else parents:
        if parent not in instance:
            raise ConfigError("conditional", "$", f"the instance has no {parent}")
        value = instance[parent]
        path.append(str(value).lower() if isinstance(value, bool) else str(value))
        if path[-1] not in at:
            raise ConfigError("conditional", "$", f"no weights for {' -> '.join(path)}")
        at = at[path[-1]]
    return at


class Tables:
    """The config's dimensions and weights, a few rows for each of its entries."""

    def __init__(self, spark: SparkSession, config: dict) -> None:
        v = config["amostragem"]["variaveis"]
        window = config["janela_temporal"]
        self.n, self.seed, self.template = config["amostragem"]["n"], config["amostragem"]["seed"], config["template_prompt"]
        make = spark.createDataFrame
        self.calendar = planner.calendar(spark, window["duracao"], window["dias_por_mes_sintetico"], window["dia_inicio"])
        ranked = lambda w: [(k, i, x) for i, (k, x) in enumerate(whole_weights(w).items(), 1)]
        self.persona_weights = make(ranked(v["persona_id"]["composicao_pesos"]["peso_final"]), "persona string, ord int, w long")
        order = {o: i for i, o in enumerate(v["offset"]["categorias"], 1)}
        offsets = [(p, w == "true", o, order[o], x) for p, by in v["offset"]["pesos_condicionais"].items() for w, row in by.items() for o, x in whole_weights(row).items()]
        self.offset_weights = make(offsets, "persona string, weekend boolean, offset string, ord int, w long")
        by_persona = lambda name, spec: make([(p, *r) for p, row in spec["pesos_condicionais"].items() for r in ranked(row)], f"persona string, {name} string, ord int, w long")
        self.rhythm_weights, self.mission_weights = by_persona("rhythm", v["ritmo"]), by_persona("mission", v["missao_id"])
        self.eligible = make([(p, m, level) for p, by in v["missao_id"]["missoes_elegiveis_por_persona"].items() for level, ms in by.items() for m in ms], "persona string, mission string, level string")
        self.personas = make([(p, x["identidade"], x["como_agir"]) for p, x in config["personas"].items()], "persona string, identidade string, como_agir string")
        fields = ("titulo", "categoria", "urgencia", "complexidade", "missao")
        self.missions = make([(m, *(x[f] for f in fields)) for m, x in config["missoes"].items()], "mission string, " + ", ".join(f"{f} string" for f in fields))
        self.rhythms = make([(k, *planner.RHYTHMS[k]) for k in RHYTHM_ORDER], "rhythm string, wpm double, thinking_min double, thinking_max double")
        self.anchors = make(list(planner.OFFSET_ANCHORS.items()), "offset string, anchor string")

    def days(self) -> DataFrame:
        return planner.apportion_days(planner.day_weights(self.calendar), self.n)

    def persona_quotas(self) -> DataFrame:
        return planner.apportion(self.persona_weights, F.lit(self.n), ["persona"])
