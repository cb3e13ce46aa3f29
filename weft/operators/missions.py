"""Missions: pairs of personas and scenarios, and which of them still need a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.planner import dimension


def pairs(personas: DataFrame, scenarios: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """persona_id, cenario_id of every pair of the two dimensions that isn't there yet, once each. The cross of dimensions is the feature."""
    every = personas.select("persona_id").distinct().crossJoin(scenarios.select("cenario_id").distinct())
    return every if existing is None else every.join(existing.select("persona_id", "cenario_id"), ["persona_id", "cenario_id"], "left_anti")


def detailed(missions: DataFrame, personas: DataFrame, scenarios: DataFrame) -> DataFrame:
    """missions(missao_id, persona_id, cenario_id) with dados_persona and dados_cenario; those of unknown personas or scenarios are left out."""
    who = dimension(personas.select("persona_id", F.col("dados").alias("dados_persona")))
    return missions.join(who, "persona_id").join(dimension(scenarios.select("cenario_id", "dados_cenario")), "cenario_id")


def pending(details: DataFrame, templates: DataFrame) -> DataFrame:
    """Detailed missions without a template; a template without a mission stands for none."""
    return details.join(templates.where("missao_id IS NOT NULL").select("missao_id"), "missao_id", "left_anti")


def few_shot(system: str, examples: list[tuple[str, str]], ask: str) -> list[tuple[str, str]]:
    """The messages of a few-shot prompt: the system's, a user's and an assistant's for each example, and the question."""
    return [("system", system), *(m for q, a in examples for m in (("user", q), ("assistant", a))), ("user", ask)]
