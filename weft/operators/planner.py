"""Population planning: calendar, day weights, apportionment, balanced sequences, quotas, simulations, audit."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions.scratch import checkpointed
from weft.functions.text import compose, squeeze, truncate

# Fixed values of the planning contract.
DAYS = ["segunda", "terca", "quarta", "quinta", "sexta", "sabado", "domingo"]
DAY_FACTORS = [1.06, 1.10, 1.05, 1.00, 0.95, 0.76, 0.61]
WEEK_FACTORS = [0.92, 1.00, 1.08, 0.97, 1.12, 0.95, 1.03, 0.98, 0.90, 1.15, 0.94, 0.99, 1.07]
CYCLE_BASE = 0.82
CYCLE_PEAKS = [(14, 0.28, 3.2), (27, 0.16, 2.4)]
PEAK_DAYS = {18: 1.22, 47: 1.30, 73: 1.18}
OFFSET_ANCHORS = {"madrugada": "03:00", "manha": "09:00", "tarde": "15:00", "noite_inicial": "19:30", "noite_tardia": "23:00"}
RHYTHMS = {"rapido": (72.0, 1.5, 5.0), "medio": (42.0, 4.0, 11.0), "lento": (18.0, 12.0, 28.0)}
DEFAULT_RHYTHM = "medio"

#: A plan's dimensions (days, personas, missions and their weights) are broadcast up to this number of rows, else joined by a shuffle.
DIMENSION_ROWS = 100_000


def dimension(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= DIMENSION_ROWS else df


def _pick(values: list, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def calendar(spark: SparkSession, days: int = 90, month: int = 30, start: str = DAYS[0]) -> DataFrame:
    """day_id, day_idx, month_idx, week_idx, dow, dom, weekend; `start` is the weekday of the first day, an unknown one an error."""
    if start not in DAYS:
        raise ValueError(f"no weekday {start!r}")
    d = spark.range(1, days + 1).select(F.col("id").alias("day_idx"))
    dow = F.pmod(F.col("day_idx") - 1 + DAYS.index(start), F.lit(7)) + 1
    return d.select(
        F.format_string("d%02d", "day_idx").alias("day_id"), "day_idx",
        (F.floor((F.col("day_idx") - 1) / month) + 1).alias("month_idx"),
        (F.floor((F.col("day_idx") - 1) / 7) + 1).alias("week_idx"),
        _pick(DAYS, dow).alias("dow"),
        (F.pmod(F.col("day_idx") - 1, F.lit(month)) + 1).alias("dom"),
        (dow >= 6).alias("weekend"),
    )


def day_weights(cal: DataFrame) -> DataFrame:
    """The calendar with weight (raw) and percent (of the sum, 4 places)."""
    cycle = F.lit(CYCLE_BASE)
    for centre, height, sigma in CYCLE_PEAKS:
        cycle = cycle + F.lit(height) * F.exp(-F.pow(F.col("dom") - F.lit(float(centre)), F.lit(2.0)) / F.lit(2 * sigma**2))
    peak = F.lit(1.0)
    for day, times in PEAK_DAYS.items():
        peak = F.when(F.col("day_idx") == day, times).otherwise(peak)
    weight = _pick(DAY_FACTORS, F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.col("dow"))) * _pick(WEEK_FACTORS, F.col("week_idx")) * cycle * peak
    return cal.withColumn("weight", weight).withColumn("percent", F.round(100 * F.col("weight") / F.sum("weight").over(Window.partitionBy()), 4))


def apportion(weights: DataFrame, n: Column, keys: list[str], ord_: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """Largest remainders in integers: adds quota, summing to n in each group `by`; ties go to the declared order."""
    group = Window.partitionBy(*by)
    total = F.sum("w").over(group)
    base = weights.withColumn("_n", n.cast("long")).withColumn("_t", total)
    base = base.withColumn("_q", F.expr("w * _n div _t")).withColumn("_r", F.expr("w * _n % _t"))
    left = F.col("_n") - F.sum("_q").over(group)
    rank = F.row_number().over(group.orderBy(F.col("_r").desc(), ord_))
    return base.withColumn("quota", F.col("_q") + (rank <= left).cast("long")).select(*by, *keys, ord_, "w", "quota")


def apportion_days(weighted: DataFrame, n: int) -> DataFrame:
    """Largest remainders in doubles over days: ties go to the later day."""
    every = Window.partitionBy()
    ideal = n * F.col("weight") / F.sum("weight").over(every)
    base = weighted.withColumn("_i", ideal).withColumn("_q", F.floor("_i"))
    rank = F.row_number().over(every.orderBy((F.col("_i") - F.col("_q")).desc(), F.col("day_id").desc()))
    return base.select("day_id", "day_idx", "weight", (F.col("_q") + (rank <= n - F.sum("_q").over(every)).cast("long")).alias("quota"))


def balanced(quotas: DataFrame, key: str, by: tuple[str, ...] = (), ord_: str = "ord") -> DataFrame:
    """Quotas dealt out in rounds: pos (from 1), key. In every round each key with quota left comes once, in order.

    A row's place is arithmetic over its group's quotas, which travel as one array: all keys are dealt out in the rounds before, those
    no later in order in its own. So nothing is sorted, and a group may be as large as the plan.
    """
    rows = quotas.where("quota > 0").withColumn("_o", F.col(ord_).cast("long"))
    every = F.collect_list(F.struct("_o", F.col("quota").cast("long").alias("_q"))).alias("_all")
    together = rows.groupBy(*by).agg(every) if by else rows.agg(every)
    own = rows.select(*by, key, "_o", "quota")
    own = own.join(dimension(together), list(by)) if by else own.crossJoin(F.broadcast(together))  # one row
    each = own.select(*by, key, "_o", "_all", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota").cast("long"))).alias("_r"))
    before = lambda x: F.least(x["_q"], F.col("_r") - 1) + F.when((x["_q"] >= F.col("_r")) & (x["_o"] <= F.col("_o")), 1).otherwise(0)
    return each.select(*by, F.aggregate("_all", F.lit(0).cast("long"), lambda s, x: s + before(x)).alias("pos"), key)


def shuffled_ids(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """pos, id: the seeded permutation of 1..n; what is shuffled is the positions, so it is as large as the plan.

    The contract's shuffle is one sequential generator, so it runs once, on the driver, over n numbers, and is sent in blocks.
    """
    order = list(range(1, n + 1))
    random.Random(seed).shuffle(order)
    blocks = [(a + 1, order[a : a + 4096]) for a in range(0, n, 4096)]
    rows = spark.createDataFrame(blocks, "base long, block array<long>").select("base", F.posexplode("block").alias("i", "pos"))
    return rows.select("pos", (F.col("base") + F.col("i")).alias("id"))


def ranked_by_day(rows: DataFrame, group: str, name: str, also: str | None = None) -> DataFrame:
    """rows(pos, day_idx, group, ...) with their place (from 1) in the group by day, then pos; `also` splits groups further by a column
    of the day. A window sorts one day of a group at most; what is counted before it is a row for each group and day."""
    keys = [group, also] if also else [group]
    own = F.row_number().over(Window.partitionBy(group, "day_idx").orderBy("pos"))
    counts = rows.groupBy(*keys, "day_idx").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("day_idx").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(group, "day_idx", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    return rows.withColumn("_own", own).join(base, [group, "day_idx"]).withColumn(name, (F.col("_b") + F.col("_own")).cast("long")).drop("_b", "_own")


class UnequalLengths(ValueError):
    pass


def zip_positions(a: DataFrame, b: DataFrame) -> DataFrame:
    """a and b joined by pos; sequences of unequal length are an error, as positions would vanish."""
    n, m = (x.agg(F.count(F.lit(1)).alias("n")).first()["n"] for x in (a, b))
    if n != m:
        raise UnequalLengths(f"{n} and {m} positions")
    return a.join(b, "pos")


def base_grid(days: DataFrame, personas: DataFrame) -> DataFrame:
    """pos, day_id, day_idx, persona, weekend if days have it: days(day_id, day_idx, quota[, weekend]) and personas(persona, ord, quota) zipped."""
    named = days.select("day_id", "day_idx", *[x for x in ("weekend",) if x in days.columns])
    rows = balanced(days.withColumn("ord", F.col("day_idx")), "day_id").join(dimension(named), "day_id")
    return zip_positions(rows, balanced(personas, "persona"))


def simulations(days: DataFrame, personas: DataFrame, missions: DataFrame) -> DataFrame:
    """One row a dialogue: days and personas zipped by position, missions dealt within a persona by day.

    days(day_id, day_idx, quota), personas(persona, ord, quota), missions(persona, mission, ord, w).
    """
    ranked = ranked_by_day(base_grid(days, personas), "persona", "k")
    sized = missions.join(dimension(personas.select("persona", F.col("quota").alias("n"))), "persona")
    dealt = balanced(apportion(sized, F.col("n"), ["mission"], by=("persona",)), "mission", by=("persona",)).withColumnRenamed("pos", "k")
    return ranked.join(dealt, ["persona", "k"]).select("pos", "day_id", "day_idx", "persona", "mission")


# ---- the whole plan: t is a config.Tables ---------------------------------------------------------------------------

GRAINS = ["dia_relativo", "persona_id", "persona_weekend", "offset", "ritmo", "missao_id"]


class Plan:
    """The quotas of a config, at all grains, and the base grid that they rest on."""

    def __init__(self, t) -> None:
        # Each is read by several grains: computed once, so their plans stay small.
        self.days = checkpointed(t.days().join(dimension(t.calendar.select("day_id", "weekend")), "day_id"))
        self.personas = checkpointed(t.persona_quotas())
        self.grid = checkpointed(base_grid(self.days, self.personas))
        n = F.count(F.lit(1)).alias("n")
        split = self.grid.groupBy("persona", "weekend").agg(n)
        both = t.persona_weights.select("persona").crossJoin(t.calendar.select("weekend").distinct())  # two rows a persona
        self.weekends = checkpointed(both.join(split, ["persona", "weekend"], "left").select("persona", "weekend", F.coalesce("n", F.lit(0)).alias("n")))
        own = dimension(self.personas.select("persona", F.col("quota").alias("n")))
        self.offsets = apportion(t.offset_weights.join(dimension(self.weekends), ["persona", "weekend"]), F.col("n"), ["offset"], by=("persona", "weekend"))
        self.rhythms = apportion(t.rhythm_weights.join(own, "persona"), F.col("n"), ["rhythm"], by=("persona",))
        self.missions = apportion(t.mission_weights.join(own, "persona"), F.col("n"), ["mission"], by=("persona",))

    def rows(self) -> DataFrame:
        """grain, persona, weekend, value, quota; what a grain doesn't have is null."""
        none, flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
        row = lambda df, grain, quota, persona=none, weekend=flag, value=none: df.select(F.lit(grain).alias("grain"), persona.alias("persona"), weekend.alias("weekend"), value.alias("value"), quota.cast("long").alias("quota"))
        p, w, q = F.col("persona"), F.col("weekend"), F.col("quota")
        parts = [
            row(self.days, "dia_relativo", q, value=F.col("day_id")),
            row(self.personas, "persona_id", q, persona=p),
            row(self.weekends, "persona_weekend", F.col("n"), persona=p, weekend=w),
            row(self.offsets, "offset", q, persona=p, weekend=w, value=F.col("offset")),
            row(self.rhythms, "ritmo", q, persona=p, value=F.col("rhythm")),
            row(self.missions, "missao_id", q, persona=p, value=F.col("mission")),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def full_simulations(t, plan: Plan | None = None, shuffled: bool = True) -> DataFrame:
    """id, dia_relativo, persona_id, weekend, offset, ritmo, missao_id: conditional quotas dealt over each persona's rows by day, then the seeded order."""
    plan = plan or Plan(t)
    rows = ranked_by_day(ranked_by_day(plan.grid, "persona", "k"), "persona", "kw", also="weekend")
    at = lambda df, key, name, *by: balanced(df, key, by=("persona", *by)).withColumnRenamed("pos", name)
    rows = rows.join(at(plan.offsets, "offset", "kw", "weekend"), ["persona", "weekend", "kw"])
    rows = rows.join(at(plan.rhythms, "rhythm", "k"), ["persona", "k"]).join(at(plan.missions, "mission", "k"), ["persona", "k"])
    rows = rows.join(shuffled_ids(rows.sparkSession, t.n, t.seed), "pos") if shuffled else rows.withColumn("id", F.col("pos"))
    return rows.select("id", F.col("day_id").alias("dia_relativo"), F.col("persona").alias("persona_id"), "weekend", "offset", F.col("rhythm").alias("ritmo"), F.col("mission").alias("missao_id"))


def observed(rows: DataFrame) -> DataFrame:
    """grain, persona, weekend, value, n of generated rows: all six grains in one aggregate over grouping sets."""
    cols = ["dia_relativo", "persona_id", "weekend", "offset", "ritmo", "missao_id"]
    sets = [["dia_relativo"], ["persona_id"], ["persona_id", "weekend"], ["persona_id", "weekend", "offset"], ["persona_id", "ritmo"], ["persona_id", "missao_id"]]
    by = rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    bits = lambda s: sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s)
    grain = F.coalesce(*[F.when(F.col("g") == bits(s), name) for s, name in zip(sets, GRAINS)])
    return by.select(grain.alias("grain"), F.col("persona_id").alias("persona"), "weekend", F.coalesce("dia_relativo", "offset", "ritmo", "missao_id").alias("value"), "n")


def audit_grains(plan: DataFrame, seen: DataFrame) -> DataFrame:
    """grain, persona, weekend, value, planned, observed, ok; absent counts are zero."""
    keys = ["grain", "persona", "weekend", "value"]
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    both = plan.alias("p").join(seen.alias("o"), on, "full_outer")
    p, o = F.coalesce("p.quota", F.lit(0)), F.coalesce("o.n", F.lit(0))
    return both.select(*[F.coalesce(f"p.{k}", f"o.{k}").alias(k) for k in keys], p.alias("planned"), o.alias("observed"), (p == o).alias("ok"))


def audit_checks(compared: DataFrame) -> DataFrame:
    """grain, cells, total, ok: whether planned and observed agree at each of the six grains."""
    return compared.groupBy("grain").agg(F.count(F.lit(1)).alias("cells"), F.sum("observed").alias("total"), F.bool_and("ok").alias("ok"))


PREVIEW = [
    "id", "dia_relativo", "dia_indice", "mes_relativo", "semana_relativa", "dia_da_semana", "dia_do_mes_sintetico", "weekend", "persona_id", "missao_id", "offset",
    "ritmo", "missao_titulo", "missao_categoria", "missao_urgencia", "missao_complexidade", "typing_speed_wpm", "thinking_min_seconds", "thinking_max_seconds",
    "target_local_datetime", "temporal_offset_seconds", "prompt_preview",
]


def project(rows: DataFrame, t, now: Column, preview_chars: int = 180) -> DataFrame:
    """The 22 preview columns and prompt of generated rows: joins with the dimensions, the target time from `now` (a timestamp_ntz).

    An unknown rhythm is the default one; an unknown offset gives an empty target and no seconds. Rows of unknown day, persona or mission
    have no projection and are left out: validation.generated_violations reports them.
    """
    day = t.calendar.select(
        F.col("day_id").alias("dia_relativo"), F.col("day_idx").alias("dia_indice"), F.col("month_idx").alias("mes_relativo"), F.col("week_idx").alias("semana_relativa"),
        F.col("dow").alias("dia_da_semana"), F.col("dom").alias("dia_do_mes_sintetico"),
    )
    persona = t.personas.withColumnRenamed("persona", "persona_id")
    mission = t.missions.select(F.col("mission").alias("missao_id"), "missao", *[F.col(c).alias(f"missao_{c}") for c in ("titulo", "categoria", "urgencia", "complexidade")])
    out = rows.join(dimension(day), "dia_relativo").join(dimension(persona), "persona_id").join(dimension(mission), "missao_id")
    known = F.when(F.col("ritmo").isin(*RHYTHMS), F.col("ritmo")).otherwise(DEFAULT_RHYTHM)
    out = out.withColumn("rhythm", known).join(F.broadcast(t.rhythms), "rhythm").join(F.broadcast(t.anchors), "offset", "left")  # three and five rows
    prompt = compose(t.template, identidade=F.col("identidade"), como_agir=F.col("como_agir"), missao=F.col("missao"))
    target = target_datetime(now, F.col("dia_indice"), F.col("anchor"))
    out = out.withColumn("prompt", prompt).withColumn("_t", target)
    values = {
        "weekend": F.col("weekend").cast("boolean"), "typing_speed_wpm": F.col("wpm"), "thinking_min_seconds": F.col("thinking_min"), "thinking_max_seconds": F.col("thinking_max"),
        "target_local_datetime": F.coalesce(F.date_format("_t", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")),
        "temporal_offset_seconds": F.coalesce(F.timestamp_diff("SECOND", now, F.col("_t")), F.lit(0)),
        "prompt_preview": truncate(squeeze(F.col("prompt")), preview_chars),
    }
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in PREVIEW], "prompt")


def preview_counts(preview: DataFrame) -> DataFrame:
    """kind, value, n: rows by persona, by mission, and on weekends."""
    by = lambda kind, key: preview.groupBy(F.lit(kind).alias("kind"), F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    weekend = preview.agg(F.lit("weekend").alias("kind"), F.lit("true").alias("value"), F.count_if("weekend").alias("n"))
    return by("persona", "persona_id").unionByName(by("mission", "missao_id")).unionByName(weekend)


def target_datetime(now: Column, day_idx: Column, anchor: Column) -> Column:
    """Next Monday of `now` (today if Monday) plus day_idx - 1 days at the anchor's clock time; a week later if not after now; null for no anchor."""
    day = F.date_add(F.to_date(now), (F.pmod(7 - F.weekday(now), F.lit(7)) + day_idx - 1).cast("int"))
    at = F.try_to_timestamp(F.concat_ws(" ", day.cast("string"), F.concat(anchor, F.lit(":00")))).cast("timestamp_ntz")
    at = F.when(anchor.isNotNull(), at)
    return F.when(at <= now, at + F.expr("INTERVAL 7 DAYS")).otherwise(at)


def audit(planned: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, planned, observed, ok: full outer, absent counts are zero."""
    joined = planned.join(observed, keys, "full_outer")
    p, o = F.coalesce("planned", F.lit(0)), F.coalesce("observed", F.lit(0))
    return joined.select(*keys, p.alias("planned"), o.alias("observed"), (p == o).alias("ok"))
