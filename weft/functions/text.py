"""Text and ordering helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.scratch import checkpointed


def squeeze(c: Column) -> Column:
    """White space runs, Unicode's and U+001C to U+001F included, as one space; ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def truncate(c: Column, limit: int) -> Column:
    """At most `limit` characters, the last three of them dots where something is cut."""
    if limit < 4:
        return F.left(c, F.lit(limit))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(limit - 3))), F.lit("...")))


def words(c: Column) -> Column:
    """Number of space-separated words."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")).cast("long")


def or_default(c: Column, default) -> Column:
    """x or default: null, an empty text and zero all give the default."""
    return F.when(c.isNull() | (c.cast("string") == "") | F.coalesce(c.cast("string").try_cast("double") == 0, F.lit(False)), F.lit(default)).otherwise(c)


def id_of_name(c: Column) -> Column:
    """The number in a file's name, null without one."""
    return F.nullif(F.regexp_extract(c, r"([0-9]+)", 1), F.lit("")).try_cast("bigint")


def underscored(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def uniform(lo: float, hi: float, *key: Column, seed: int = 0) -> Column:
    """A number in [lo, hi) by the hash of a key and seed: the same on every run and layout."""
    return F.lit(lo) + F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(1 << 53)) * F.lit(hi - lo)


def bernoulli(p: float, *key: Column, seed: int = 0) -> Column:
    return uniform(0.0, 1.0, *key, seed=seed) < p


def typing_seconds(text: Column, wpm: Column, *key: Column, seed: int = 0, spread: float = 0.2) -> Column:
    """Seconds that typing a text takes at so many words a minute, give or take `spread` by the hash of a key (none: exactly)."""
    exact = words(text) / wpm * 60
    return exact * uniform(1 - spread, 1 + spread, *key, seed=seed) if key else exact


def backoff(spark, top_k: int = 64, temperature: float = 1.0, factor: int = 2, cooling: float = 0.75, least: int = 8) -> DataFrame:
    """attempt, top_k, temperature of repeated calls: top_k divided, temperature cooled, until top_k falls below `least`."""
    rows = []
    while top_k >= least:
        rows.append((len(rows) + 1, top_k, temperature))
        top_k, temperature = top_k // factor, temperature * cooling
    return spark.createDataFrame(rows, "attempt int, top_k int, temperature double")


def accepted_prompt(c: Column) -> Column:
    """Whether a generated prompt has the contract's parts."""
    return F.coalesce(c.startswith("Você é ") & c.contains("[[ como agir ]]") & c.contains("[[ missão ]]") & c.contains("quit"), F.lit(False))


def compose(template: str, **columns: Column) -> Column:
    """The template with {name} placeholders filled in one pass: what is filled in is not looked at again."""
    import string

    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(literal)] * bool(literal) + ([columns[name]] if name else [])
    return F.concat(*parts)


def prefix_sums(groups: DataFrame, key: str, n: str) -> DataFrame:
    """key, base: for each of the distinct keys, the sum of n over all lesser keys.

    Keys are range-partitioned; sums run inside partitions, and only a row for each partition goes through one window.
    """
    dealt = checkpointed(groups.repartitionByRange(key).withColumn("_p", F.spark_partition_id()))  # a lost executor must not deal them anew
    inner = Window.partitionBy("_p").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_p").agg(F.sum(n).alias("_t")).withColumn("_o", F.coalesce(F.sum("_t").over(outer), F.lit(0)))  # a row a partition
    local = dealt.withColumn("_l", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    return local.join(F.broadcast(offsets.select("_p", "_o")), "_p").select(key, (F.col("_o") + F.col("_l")).alias("base"))
