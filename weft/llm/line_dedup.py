"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its lower-cased words. Its tokens are ordered by rarity: a sketch of 2^rarity_bits counters, one byte
each, holds the order of magnitude of every token's frequency over all lines (of the tokens that share a counter the
sum: any fixed order is right, a rarer one only quicker). Two lines of Jaccard similarity t or more share a token
within short prefixes of that order; entries meet by token, and the length filter, the positional filter, the number of tokens common
to the prefixes and a parity bitmap (its bits differ in no more places than the sets in tokens) leave few pairs, which are verified on the
whole token sets. A token whose counter is one is in no other line and is left out of the join.

A line is removed if an earlier one (by doc_id, then line number) is equal as a set or similar; the earlier one need not
stay itself. Equal sets are settled by one aggregate, and the distinct sets numbered in the order of their first lines. Crowds of
variants of one line are thinned before the join: lines of equal size that share the first or the last frequent token of their prefixes are
compared with a few representatives only, and what that removes joins no further as the later line. So a crowd costs its size times the
lines left in it that resemble none of these; all other lines go through the whole join. Tokens of more than SPLIT entries are dealt
over salted keys.

Defined results: a null or empty text is one line without words; lines without words always stay; a null doc_id comes
first; rows with equal doc_id and text are one document and give equal results; of texts that share a doc_id the order is
that of their hashes; an empty table gives an empty result. Other columns are ignored, or kept by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import SPACE, WORD_RE, checkpointed, released, small, table, text_or_empty

SIMILARITY = 0.8
RARITY_BITS = 20
#: Entries of a token that one salted key takes.
SPLIT = 1 << 14
#: Lines of a group from which it is a crowd, and those of them that the others are compared with before the whole join; a larger number
#: costs more pairs there and leaves fewer lines of a crowd to the join. Results don't depend on these.
CROWD, REPRESENTATIVES = 16, 8
FILTER_BITS = 25
#: Tables of a line number (or as narrow) a row are broadcast up to this number of rows, some 40 MB, else joined by a shuffle.
SETTLED_ROWS = 1_000_000
#: And tables of places of lines, up to this number.
PLACES = SETTLED_ROWS // 4
#: In a token's level, and in an entry's token, the marks of one that occurs SPLIT or CROWD times or more: only these can have that many entries or lines.
_SPLIT, _CROWD = 1 << 6, 1 << 5
_SPLIT_TOKEN, _CROWD_TOKEN = _SPLIT << 24, _CROWD << 24
#: Up to so many pairs a line, all are verified at once.
FEW = 8
_PLACE = ("doc_id", "line_no", "th")
#: Counters of the rarity sketch that are counted as one row: 2 to the power of this.
_ROW_BITS = 4


def _hashes(line: Column) -> Column:
    """64-bit hashes of the distinct words of a line that is lower-cased and has no white space but the space."""
    hashes = F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))
    # Few lines have an empty word, and seeing whether one has is cheaper than looking through its hashes.
    empty = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | (line == "")
    return F.when(empty, F.array_remove(hashes, F.xxhash64(F.lit("")))).otherwise(hashes)


def _plain(text: Column) -> Column:
    """Lower-cased; of white space only spaces and line ends remain. Splitting at a space is far quicker than at a pattern."""
    low = F.lower(text)
    other = low.contains("\t") | low.contains("\v") | low.contains("\f") | low.contains("\r")
    return F.when(other, F.regexp_replace(low, "[\\x09\\x0B-\\x0D]", " ")).otherwise(low)


def lines_of(docs: DataFrame, plain: bool = False) -> DataFrame:
    """doc_id, th (hash of the text), line_no, line (plain, if said so)."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), (_plain(text) if plain else text).alias("text"))
    # The split stands in the generator: of a column of its own Spark would infer that it is not null and not empty, and split each text again for
    # that. Nothing else does: in a generator Spark computes a common subexpression as often as it occurs.
    return rows.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def rarity_sketch(docs: DataFrame, bits: int) -> DataFrame:
    """One row, an array of 2^bits longs, by the first bits (8 or more) of a token's hash: in the first byte that of such hashes xor the counter's level, which is
    its number of occurrences up to one, else 2 and more by half powers of two, with the marks of those from CROWD and SPLIT on; zeros behind. So a hash xor
    its entry has the level in the place of its first byte, in the fewest steps for a lambda."""
    if bits < 8:
        raise ValueError("a sketch has 8 bits at least")
    word = lines_of(docs, plain=True).select(F.explode(F.split("line", " ")).alias("w")).where("w <> ''")
    # Sixteen counters are one row of the aggregate: so many fewer keys are kept and shuffled, which costs far more than counting.
    b, cell = F.shiftrightunsigned(F.xxhash64("w"), 64 - bits), range(1 << _ROW_BITS)
    at = word.select(b.alias("b")).select(F.shiftright("b", _ROW_BITS).alias("r"), F.col("b").bitwiseAND(F.lit(len(cell) - 1)).cast("int").alias("i"))
    counted = at.groupBy("r").agg(*[F.count(F.when(F.col("i") == i, 1)).alias(f"n{i}") for i in cell])
    zero = docs.sparkSession.range(1 << bits - _ROW_BITS).select(F.col("id").alias("r"), *[F.lit(0).cast("long").alias(f"n{i}") for i in cell])
    per = counted.unionByName(zero).groupBy("r").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in cell])

    def entry(i: int) -> Column:
        n = F.col(f"n{i}")
        halves = lambda least: F.greatest(F.lit(0).cast("long"), F.floor(F.log2(n / least) * 2).cast("long"))
        from_split = _SPLIT + _CROWD + F.least(F.lit(31).cast("long"), halves(SPLIT))
        level = F.when(n < 2, n).when(n < CROWD, 2 + halves(2)).when(n < SPLIT, _CROWD + halves(CROWD)).otherwise(from_split)
        of = F.shiftleft("r", _ROW_BITS).bitwiseOR(F.lit(i).cast("long"))
        return F.coalesce(F.shiftleft(F.shiftright(of, bits - 8).bitwiseXOR(level.cast("long")), 56), F.lit(0).cast("long"))

    rows = per.select("r", F.array(*[entry(i) for i in cell]).alias("c"))
    piece = min(8, bits - _ROW_BITS)
    in_order = lambda key: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(key, "c"))), lambda x: x["c"]))
    pieces = rows.groupBy(F.shiftright("r", piece).alias("p")).agg(in_order("r").alias("c"))
    return checkpointed(pieces.agg(in_order("p").alias("c")))


def _prefix(n: Column, t: float) -> Column:
    """Tokens of a prefix such that lines with t * n tokens or more in common share one."""
    return n - F.ceil(F.lit(t) * n - 1e-9).cast("int") + 1


def _joins(t: float) -> Column:
    """Whether a set of n tokens can be similar to another one at all."""
    return F.col("n") * (1 - t) >= t - 1e-9


def signed_lines(docs: DataFrame, sketch: DataFrame, bits: int, t: float) -> DataFrame:
    """doc_id, th, line_no, k1, k2 (the set's identity), n, parity, prefix (rarest first, levels in the first byte); lines with words only."""
    # A subquery may not stand in a lambda, but as a column that is used once it is folded into the lambda's projection.
    lines = lines_of(docs, plain=True).where(F.trim("line") != "").withColumn("sketch", sketch.scalar())
    # Without nulls, as far as Spark can know, or the array would be sorted as objects.
    leveled = lambda h: F.coalesce(F.col("sketch")[F.shiftrightunsigned(h, 64 - bits)].bitwiseXOR(h), F.lit(0).cast("long"))
    keyed = F.sort_array(F.transform(_hashes(F.col("line")), leveled))
    parity = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))
    prefix = F.slice("ids", F.lit(1), F.when(_joins(t), _prefix(F.col("n"), t)).otherwise(0))
    return (
        lines.select("doc_id", "th", "line_no", keyed.alias("ids"))
        .withColumn("n", F.size("ids"))
        .select("doc_id", "th", "line_no", F.xxhash64("ids").alias("k1"), F.xxhash64(F.lit(1), "ids").alias("k2"), "n", parity.alias("parity"), prefix.alias("prefix"))
    )


def distinct_lines(signed: DataFrame) -> DataFrame:
    """The first line of each set: lid (numbers in the order of the places), k1, k2, c (lines), doc_id, line_no, th, n, parity, prefix."""
    first = F.min(F.struct(*_PLACE, "n", "parity", "prefix")).alias("f")
    firsts = signed.groupBy("k1", "k2").agg(first, F.count(F.lit(1)).alias("c")).select("k1", "k2", "c", "f.*")
    ordered = firsts.repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE)
    return table(ordered.select(F.monotonically_increasing_id().alias("lid"), "*"))


def _token(x: str) -> Column:
    """Of an element of a prefix, the marks and 29 bits of the hash; lines that share a token by chance are told apart later."""
    return F.shiftright(x, 32).bitwiseAND(F.lit(_SPLIT_TOKEN | _CROWD_TOKEN)).bitwiseOR(F.col(x).bitwiseAND(F.lit(_CROWD_TOKEN - 1))).cast("int")


def _lid(s: str) -> Column:
    return F.shiftright(f"{s}.at", 1)


def _n(s: str) -> Column:
    return F.shiftright(f"{s}.size", 32).cast("int")


def _pos(s: str) -> Column:
    return F.col(f"{s}.size").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _close(t: float) -> Column:
    """Length and bitmap filters for entries x and y of one token, x being the earlier line; nothing is near a settled line as the later one.
    (That stands within a comparison of both sides, or it would be taken into one of them and there would be two shuffles.)"""
    nx, ny = _n("x"), _n("y")
    need = F.ceil((nx + ny) * (t / (1 + t)) - 1e-9)
    lengths = (nx >= F.lit(t) * ny - 1e-9) & (ny >= F.lit(t) * nx - 1e-9)
    apart = F.bit_count(F.col("x.parity").bitwiseXOR(F.col("y.parity")))
    earlier = F.col("x.at") < F.col("y.at") * F.col("y.at").bitwiseAND(F.lit(1))
    # The second condition follows from the last; it is the cheapest and leaves few pairs for the others.
    return earlier & (apart <= (nx + ny) * ((1 - t) / (1 + t)) + 1e-6) & lengths & (nx + ny - apart >= 2 * need)


def _first(t: float) -> Column:
    """Whether a token of x and y may be the first that similar lines have in common: enough is left behind it, and for the shorter line it is within the
    prefix for equal sizes."""
    nx, ny, px, py = _n("x"), _n("y"), _pos("x"), _pos("y")
    need = F.ceil((nx + ny) * (t / (1 + t)) - 1e-9)
    within = lambda n, p: p < _prefix(n, 2 * t / (1 + t))
    return (F.least(nx - px, ny - py) >= need) & F.when(nx <= ny, within(nx, px)).otherwise(within(ny, py))


def counted_pairs(joined: list[DataFrame], t: float) -> DataFrame:
    """(lx, ly, apart: differing bits) of joined entries x and y whose prefixes have as many tokens in common as those of similar lines have at least:
    what is common after the prefix that ends first is no more than what that line has left. It leaves out nearly all pairs of long lines,
    whose bitmaps say little."""
    apart = F.bit_count(F.col("x.parity").bitwiseXOR(F.col("y.parity")))
    # The sizes and apart are those of the pair, in every row of it.
    facts = [F.count(F.lit(1)).alias("common"), F.max("first").alias("first"), F.max("nx").alias("nx"), F.max("ny").alias("ny"), F.max("apart").alias("apart")]
    own = [_lid("x").alias("lx"), _lid("y").alias("ly"), _n("x").alias("nx"), _n("y").alias("ny"), apart.alias("apart"), _first(t).alias("first")]
    each = reduce(DataFrame.unionByName, [j.select(own) for j in joined])
    nx, ny = F.col("nx"), F.col("ny")
    need = F.ceil((nx + ny) * (t / (1 + t)) - 1e-9)
    enough = F.col("common") >= need - F.greatest(nx - _prefix(nx, t), ny - _prefix(ny, t))
    return each.groupBy("lx", "ly").agg(*facts).where(F.col("first") & enough).select("lx", "ly", "apart")


def entries(firsts: DataFrame, t: float) -> DataFrame:
    """An entry for each prefix token, in few and narrow columns, as all of them are shuffled: token, at (lid, and whether an earlier
    similar line is still sought), size (n and position), parity. firsts has a column open."""
    wide = lambda c: F.col(c).cast("long")
    each = firsts.where(_joins(t)).select("lid", "n", "parity", "open", F.posexplode("prefix").alias("pos", "id")).where(F.shiftright("id", 56) != 1)
    at, size = F.shiftleft("lid", 1).bitwiseOR(wide("open")), F.shiftleft(wide("n"), 32).bitwiseOR(wide("pos"))
    return each.select(_token("id").alias("token"), at.alias("at"), size.alias("size"), "parity")


def similar_pairs(firsts: DataFrame, t: float) -> DataFrame:
    """Pairs (lx, ly, apart: differing bits), lx before ly, that share prefix tokens and pass the filters, ly being open. Both sides are the
    same rows in the same columns, so one shuffle serves both; tokens of more than SPLIT entries are salted besides."""
    each = entries(firsts, t)
    both = (F.col("x.token") == F.col("y.token")) & _close(t)
    marked = each.where(F.col("token").bitwiseAND(F.lit(_SPLIT_TOKEN)) != 0)
    crowded = checkpointed(marked.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SPLIT).select("token", F.ceil(F.col("c") / SPLIT).cast("int").alias("salts")))
    if crowded.isEmpty():
        return counted_pairs([each.alias("x").join(each.alias("y"), both)], t)
    table_ = small(crowded, SETTLED_ROWS)  # entries / SPLIT rows at most
    rest = each.join(table_, "token", "left_anti")
    dealt = each.join(table_, "token")
    x = dealt.withColumn("salt", F.pmod(F.xxhash64("at"), F.col("salts")).cast("int")).alias("x")
    y = dealt.where(F.col("at").bitwiseAND(F.lit(1)) == 1).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("y")
    return counted_pairs([rest.alias("x").join(rest.alias("y"), both), x.join(y, both & (F.col("x.salt") == F.col("y.salt")))], t)


def thinning_pairs(firsts: DataFrame, t: float) -> DataFrame | None:
    """Pairs (lx, ly) of equal size: each line of a crowd with the first line of each of REPRESENTATIVES hash classes of its crowds; None if
    there are none. A crowd is a (token, size) group, the token being the first or the last of those of the prefix that occur CROWD
    times or more. Counts and first lines come
    from partial aggregates, so no task holds a crowd."""
    # Most tokens have no mark and so are in fewer than CROWD lines; counting those would cost more than all the rest here. A mark sorted in among
    # the ordered tokens says where the marked ones begin, without a lambda.
    mark = F.lit(_CROWD << 56)
    begun = firsts.where(_joins(t) & (F.try_element_at("prefix", F.lit(-1)) > mark)).select("lid", "n", "parity", "prefix", F.array_position(F.sort_array(F.array_append("prefix", mark)), mark).cast("int").alias("unmarked"))
    ends = begun.select("lid", "n", "parity", F.try_element_at("prefix", F.col("unmarked")).alias("first"), F.try_element_at("prefix", F.lit(-1)).alias("last"))
    each = F.explode(F.when(F.col("first") == F.col("last"), F.array("first")).otherwise(F.array("first", "last"))).alias("token")
    lines = ends.select("lid", "n", "parity", each)
    crowds = checkpointed(lines.groupBy("token", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= CROWD).select("token", "n"))
    if crowds.isEmpty():
        return None
    own = lines.join(small(crowds, SETTLED_ROWS), ["token", "n"])
    first = own.groupBy("token", "n", F.pmod(F.xxhash64("lid"), F.lit(REPRESENTATIVES)).alias("class")).agg(F.min(F.struct("lid", "parity")).alias("m"))
    leads = checkpointed(first.select("token", "n", "m.*"))
    x, y, n = small(leads, SETTLED_ROWS).alias("x"), own.alias("y"), F.col("y.n")
    need = F.ceil(n * (2 * t / (1 + t)) - 1e-9)
    apart = F.bit_count(F.col("x.parity").bitwiseXOR(F.col("y.parity")))
    close = (F.col("x.token") == F.col("y.token")) & (F.col("x.n") == n) & (apart <= 2 * (n - need)) & (F.col("x.lid") < F.col("y.lid"))
    return y.join(x, close).select(F.col("x.lid").alias("lx"), F.col("y.lid").alias("ly"))


def _spot(*of: str) -> Column:
    """A row's bit among 2^FILTER_BITS."""
    return F.xxhash64(*of).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def bitmap(spots: DataFrame) -> DataFrame:
    """One row, one binary: a bit for each spot of spots(s), of a fixed size."""
    pieces = spots.groupBy(F.shiftright("s", 15).alias("p")).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(F.lit((1 << 15) - 1))).alias("b"))
    none = spots.sparkSession.range(1 << FILTER_BITS - 15).select(F.col("id").alias("p"), F.unhex(F.lit("00" * 4096)).alias("b"))
    whole = pieces.unionByName(none).groupBy("p").agg(F.bitmap_or_agg("b").alias("b"))
    hexed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", F.hex("b").alias("h")))), lambda x: x["h"]), "")
    return checkpointed(whole.agg(F.unhex(hexed).alias("b")))


def maybe_in(rows: DataFrame, some: DataFrame, *on: str) -> DataFrame:
    """rows without most of those that match none of some(on): what is left of a large side before it is shuffled for a join."""
    spot = _spot(*on)
    bits = bitmap(some.select(spot.alias("s"))).scalar()
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(spot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.where(F.call_function("shiftright", byte, spot.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1)


def verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, t: float) -> DataFrame:
    """lid of the later lines of those pairs (lx before ly) that are similar on their whole token sets."""
    pairs = checkpointed(pairs.distinct())
    wanted = checkpointed(pairs.select(F.col("lx").alias("lid")).unionByName(pairs.select(F.col("ly").alias("lid"))).distinct())
    places = checkpointed(firsts.select("lid", *_PLACE).join(small(wanted, SETTLED_ROWS), "lid", "left_semi"))
    released(docs.sparkSession)
    # Only texts with such lines are split, and only such lines tokenized.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text_or_empty()).alias("th"))
    if places.count() <= PLACES:
        own, places = F.broadcast(places.select("doc_id", "th").distinct()), F.broadcast(places)
        rows = lines_of(texts.alias("d").join(own.alias("o"), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.th") == F.col("o.th")), "left_semi"))
    else:
        # What has no bit set is left out before the shuffle; the join then settles which lines are wanted.
        rows = maybe_in(lines_of(maybe_in(texts, places, "th")), places, "line_no", "th")
    at = rows.alias("l").join(places.alias("p"), F.col("l.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("l.line_no") == F.col("p.line_no")) & (F.col("l.th") == F.col("p.th")))
    sets = at.select("p.lid", F.sort_array(_hashes(_plain(F.col("line")))).alias("set")).dropDuplicates(["lid"])
    both = pairs.join(sets.select(F.col("lid").alias("lx"), F.col("set").alias("sx")), "lx").join(sets.select(F.col("lid").alias("ly"), F.col("set").alias("sy")), "ly")
    common = F.size(F.array_intersect("sx", "sy"))
    similar = common >= F.lit(t) * (F.size("sx") + F.size("sy") - common) - 1e-9
    return checkpointed(both.where(similar).select(F.col("ly").alias("lid")).distinct())


def later_lines(firsts: DataFrame, docs: DataFrame, t: float) -> DataFrame:
    """lid of those of the distinct lines that have an earlier similar one."""
    spark, thin = firsts.sparkSession, thinning_pairs(firsts, t)
    found = []
    if thin is None:
        marked = firsts.withColumn("open", F.lit(True))
    else:
        found.append(verified(thin, firsts, docs, t))
        released(spark)
        marked = firsts.join(small(found[0].withColumn("hit", F.lit(True)), SETTLED_ROWS), "lid", "left").withColumn("open", F.col("hit").isNull())
    pairs = checkpointed(similar_pairs(marked, t))
    released(spark)
    best = pairs.groupBy("ly").agg(F.min(F.struct("apart", "lx")).alias("b")).select("b.lx", "ly")
    if pairs.count() <= FEW * best.count():
        found.append(verified(pairs.select("lx", "ly"), firsts, docs, t))
    else:
        # Most lines are settled by the pair that differs least; the others' pairs are verified, all of them, after that.
        found.append(verified(best, firsts, docs, t))
        rest = pairs.join(small(found[-1].withColumnRenamed("lid", "ly"), SETTLED_ROWS), "ly", "left_anti").join(best, ["lx", "ly"], "left_anti")
        found.append(verified(rest.select("lx", "ly"), firsts, docs, t))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY, rarity_bits: int | None = None) -> DataFrame:
    """doc_id, th, removed (sorted line numbers) of the documents that lose lines."""
    bits = RARITY_BITS if rarity_bits is None else rarity_bits
    signed = table(signed_lines(docs, rarity_sketch(docs, bits), bits, similarity))
    firsts = distinct_lines(signed)
    released(docs.sparkSession)
    later = later_lines(firsts, docs, similarity)
    released(docs.sparkSession)
    hit = firsts.select("lid", *_PLACE).join(small(checkpointed(later), SETTLED_ROWS), "lid", "left_semi").select(*_PLACE)
    # The other lines of a set go in any case.
    several = checkpointed(firsts.where("c > 1").select("k1", "k2", F.struct(*_PLACE).alias("f")))
    others = maybe_in(signed.select(*_PLACE, "k1", "k2"), several, "k1").join(several, ["k1", "k2"]).where(~F.struct(*_PLACE).eqNullSafe(F.col("f"))).select(*_PLACE)
    gone = hit.unionByName(others)
    return gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, keep: tuple[str, ...] = (), similarity: float = SIMILARITY, rarity_bits: int | None = None, with_text: bool = True) -> DataFrame:
    """doc_id, text (without the removed lines), n_lines, removed for every row of docs(doc_id, text, ...), with its columns `keep` besides."""
    gone = removed_lines(docs, similarity, rarity_bits)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), F.xxhash64(text_or_empty()).alias("th"), *keep)
    text = text_or_empty("_text")
    lines = F.split(text, "\n", -1)
    if not with_text:
        ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
        own = own.select("doc_id", "th", (ends + 1).alias("n_lines"), *keep)
    joined = own.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.th") == F.col("g.th")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    if not with_text:
        return joined.select("d.doc_id", "n_lines", removed.alias("removed"), *[f"d.{k}" for k in keep])
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("removed", i)), "\n")
    left = F.when(F.col("removed").isNull(), F.col("_text")).otherwise(kept)
    return joined.select("d.doc_id", left.alias("text"), F.size(lines).alias("n_lines"), removed.alias("removed"), *[f"d.{k}" for k in keep])
