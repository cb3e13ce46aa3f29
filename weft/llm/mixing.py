"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources share all words by weight, a source's target stopping at `cap` times its size and the excess going to the others.
Within a source a document is expected e copies, cap at most, in proportion to its weight (64 less the bits of its size:
long documents repeat a little less), so that the expected words make the target. floor(e) copies are certain; the
rest of the target is a Pareto sample: documents are ranked by the random odds u/(1-u) over the odds of inclusion of
the remaining fraction of e, and taken in that order until the words suffice (to the nearest document). u comes from
the MD5 of doc_id (of the text where that is null) and seed, so reruns agree, on any layout.

The cut in the ranking is found by digits of a key: sums of words by source and digit (256 at most), three times, so a hot source is
never sorted in one task. The key is the rank's RANK_BITS bits, and then TIE_BITS of a hash that tells rows of one rank apart; further
digits are taken while more than WINDOW_ROWS documents of a source share those so far, and only what is left is ordered by a window.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents without words,
and those of sources without any, take 0; equal ranks go by a hash; repeated rows count as documents of
their own, of equal ones any may be taken. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import checkpointed, small, text_or_empty, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 7
RANK_BITS, TIE_BITS, DIGIT = 32, 24, 8
WINDOW_ROWS = 100_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target for sizes(source, source_size): the shares, capped. One row per source goes through one window."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("w", w.cast("long"))
    # Sources reach their cap in the order of size over weight: all before the first that stays below are capped.
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = ranked.select(
        "source", "source_size", "w",
        (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("words"),
        F.sum("w").over(after).alias("sum_w"),
    )
    below = F.col("words") * F.col("w") < cap * F.col("source_size") * F.col("sum_w")
    open_ = F.min(F.when(below, F.struct(F.col("sum_w") * -1, "words"))).over(everything)
    share = open_["words"] * F.col("w") / -open_["col1"]
    return left.select("source", "source_size", F.coalesce(F.when(F.col("sum_w") <= -open_["col1"], share), F.lit(float(cap)) * F.col("source_size")).alias("target"))


def expected_copies(levels: DataFrame, cap: int = CAP) -> DataFrame:
    """source, w, e for levels(source, w, words, target): e is in proportion to w, cap at most, and sums to the target."""
    order = Window.partitionBy("source").orderBy(F.col("w").desc())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = levels.select(
        "source", "w",
        (F.col("target") - cap * F.coalesce(F.sum("words").over(before), F.lit(0))).alias("rem"),
        F.sum(F.col("w") * F.col("words")).over(after).alias("ww"),
    )
    open_ = F.min(F.when(F.col("rem") * F.col("w") < cap * F.col("ww"), F.struct(F.col("w") * -1, "rem", "ww"))).over(everything)
    e = F.when(F.col("w") <= -open_["col1"], open_["rem"] * F.col("w") / open_["ww"])
    return left.select("source", "w", F.coalesce(e, F.lit(float(cap))).alias("e"))


def _uniform(seed: int) -> Column:
    """(0, 1), from the first 48 bits of an MD5."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.md5(text_or_empty())), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs(doc_id, text, source, ...), with the columns `keep` of it besides."""
    size = word_count().alias("size")
    rid = F.monotonically_increasing_id().alias("rid")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size, _uniform(seed).alias("u"), rid, *keep)
    base = base.withColumn("w", F.lit(64) - F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)).withColumn("w", F.col("w").cast("long"))
    lean = checkpointed(base.drop(*keep))
    sums = checkpointed(lean.groupBy("source", "w").agg(F.sum("size").alias("words")))
    targets = checkpointed(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap))
    same = lambda a, b, *more: [F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")), *(F.col(f"{a}.{m}") == F.col(f"{b}.{m}") for m in more)]
    levels = sums.where("words > 0").alias("l").join(targets.alias("t"), same("l", "t")).select("l.*", "target")
    plan = expected_copies(levels, cap)
    plan = plan.withColumn("certain", F.floor("e")).withColumn("part", F.col("e") - F.floor("e"))
    plan = plan.alias("p").join(sums.alias("s"), same("p", "s", "w")).select("p.*", "words")
    rest = plan.groupBy("source").agg(F.sum(F.col("certain") * F.col("words")).alias("certain_words"))
    rest = rest.alias("r").join(targets.alias("t"), same("r", "t")).select("t.source", (F.col("target") - F.col("certain_words")).alias("rest"))
    settings = checkpointed(plan.alias("p").join(rest.alias("r"), same("p", "r")).select("p.source", "p.w", "certain", "part", "rest"))  # 64 rows a source at most

    odds = F.col("u") / (1 - F.col("u"))
    rank = odds / (F.col("part") / (1 - F.col("part")))
    top = F.least(F.floor(rank / (1 + rank) * (1 << RANK_BITS)), F.lit((1 << RANK_BITS) - 1)).cast("long")
    tie = F.xxhash64("doc_id", "rid").bitwiseAND(F.lit((1 << TIE_BITS) - 1))

    def settled(rows: DataFrame) -> DataFrame:
        of = rows.alias("d").join(small(settings).alias("s"), same("d", "s", "w"), "left").select("d.*", "certain", "part", "rest")
        of = of.withColumn("rank", F.when((F.col("part") > 0) & (F.col("size") > 0), rank))
        return of.withColumn("key", F.when(F.col("rank").isNotNull(), F.shiftleft(top, TIE_BITS).bitwiseOR(tie)))

    ranked = settled(lean).where(F.col("rank").isNotNull()).select("source", "size", "rest", "key", "rid")
    digits = (RANK_BITS + TIE_BITS) // DIGIT
    head_of = lambda key, depth: F.shiftright(key, (digits - depth) * DIGIT)
    found, depth, most = None, 0, 0
    while depth < 3 or (most > WINDOW_ROWS and depth < digits):
        if found is not None:  # only what shares the digits so far
            at = ranked.alias("d").join(small(found).alias("f"), [*same("d", "f"), head_of("d.key", depth) == F.col("f.head")]).select("d.*", "f.below", "f.head")
        else:
            at = ranked.withColumn("below", F.lit(0).cast("long")).withColumn("head", F.lit(0).cast("long"))
        depth += 1
        bins = at.groupBy("source", "rest", "head", "below", head_of("key", depth).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("bin")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("through", F.col("below") + F.sum("words").over(order)).where(F.col("through") >= F.col("rest"))
        first = bins.groupBy("source").agg(F.min(F.struct("bin", "through", "words", "head", "rows")).alias("x"))
        found = checkpointed(first.select("source", (F.shiftleft("x.head", DIGIT) + F.col("x.bin")).alias("head"), (F.col("x.through") - F.col("x.words")).alias("below"), F.col("x.rows").alias("rows")))
        most = found.agg(F.max("rows")).first()[0] or 0
    last = ranked.alias("d").join(small(found).alias("f"), [*same("d", "f"), head_of("d.key", depth) == F.col("f.head")]).select("d.*", "f.below")
    order = Window.partitionBy("source").orderBy("key", "rid").rowsBetween(Window.unboundedPreceding, -1)
    close = last.withColumn("before", F.col("below") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # The cut itself: the last document taken. Where a source has none, nothing of these digits is taken.
    cut = close.where(F.col("before") + F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("key", "rid")).alias("cut"))
    cuts = checkpointed(found.alias("f").join(cut.alias("c"), same("f", "c"), "left").select("f.source", "head", "cut"))

    out = settled(base if keep else lean).alias("d").join(small(targets).alias("t"), same("d", "t")).join(small(cuts).alias("c"), same("d", "c"), "left")
    own = head_of("key", depth)
    extra = F.when(F.col("rank").isNull(), False).when(F.col("head").isNull(), True).when(own != F.col("head"), own < F.col("head")).otherwise(F.coalesce(F.struct("key", "rid") <= F.col("cut"), F.lit(False)))
    copies = (F.coalesce("certain", F.lit(0)) + extra.cast("long")).cast("long").alias("copies")
    out = out.select("d.doc_id", "d.source", "d.size", "source_size", "target", copies, *[f"d.{k}" for k in keep])
    return out.withColumn("taken", F.col("copies") * F.col("size"))
