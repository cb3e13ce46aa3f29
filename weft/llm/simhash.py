"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within `radius` bits agree, in at least one segment, up to
radius // segments bits. Every fingerprint enumerates, for each segment, the values reached by clearing at most that many
of its one bits (the downward part of the Hamming ball): two segment values a and b within the ball radius both reach
a & b, so they meet in that table entry. Whatever meets is verified by the complete distance. Identical fingerprints are
collapsed first, and a table entry yields a spanning forest of its verified links, never all its pairs; entries above
BLOCK fingerprints are dealt out as pairs of blocks, so no task holds an unbounded group. Components are found by
alternating large-star and small-star steps on the links, with a checkpoint per round.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and link like any other; fewer
words than a shingle has: the whole sequence is the one shingle; null doc_ids take part, but name no component unless
all ids of it are null (then null). Repeated rows each come back. An empty table gives an empty result. Other columns
of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import checkpointed, small

SEED = 42
BLOCK = 1 << 15
#: Copies from which a fingerprint's rows are not shuffled; the table of such fingerprints is broadcast if its counted size allows it.
HEAVY = 1000
#: Shingles whose bits are unpacked at once.
UNPACK = 1 << 17


def shingle_hashes(words: list[bytes], k: int) -> list[int]:
    """XXH64 of every k-word shingle, space-joined, repeats included."""
    if not words:
        return []
    n = len(words)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= k:
        return [digest(joined, SEED)]
    after = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], after[: n - k])).tolist()
    ends = (after[k - 1 :] - 1).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends)]


def simhashes(texts: list[bytes | None], k: int) -> np.ndarray:
    """uint64 fingerprints: a bit is 1 if set in over half of the shingles' hashes."""
    ones, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    owners: list[tuple[int, int]] = []  # (text, hashes of it in the buffer)

    def flush() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = 0
            for i, n in owners:
                ones[i] += bits[at : at + n].sum(axis=0, dtype=np.int64)
                at += n
        hashes.clear()
        owners.clear()

    for i, text in enumerate(texts):
        new = shingle_hashes(text.lower().split(), k) if text else []  # bytes: A-Z only, and exactly the contracts' white space
        totals[i] = len(new)
        for a in range(0, len(new), UNPACK):
            hashes += (part := new[a : a + UNPACK])
            owners.append((i, len(part)))
            if len(hashes) >= UNPACK:
                flush()
    flush()
    return np.packbits(ones * 2 > totals[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id long, fp long: the 64 bits) for every row of docs(doc_id, text, ...)."""

    def run(batches):
        for batch in batches:
            fps = simhashes(batch.column(1).cast(pa.large_binary()).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _masks(width: int, ball: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(ball + 1) for c in combinations(range(width), n)]


def _reach(value: Column, masks: Column) -> Column:
    """The value with the bits of each mask cleared that holds one bits of it only."""
    return F.transform(F.filter(masks, lambda m: m.bitwiseAND(value) == m), lambda m: value.bitwiseXOR(m))


def table_entries(fps: DataFrame, radius: int, segments: int) -> DataFrame:
    """(segment int, value long, fp long): the entries of every fingerprint in the tables of all segments."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    parts = []
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        value = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1))
        masks = F.array(*[F.lit(m).cast("long") for m in _masks(hi - lo, radius // segments)])
        parts.append(fps.select(F.lit(i).alias("segment"), F.explode(_reach(value, masks)).alias("value"), "fp"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forest(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what links within radius bits connect among distinct fps: (fp, linked fp), fewer than fps."""
    rest, out = fps, []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            head, front = front[:32], front[32:]
            hit, by = np.zeros(len(rest), bool), np.zeros(len(rest), np.uint64)
            for f in head:
                near = (np.bitwise_count(rest ^ f) <= radius) & ~hit
                hit |= near
                by[near] = f
            if hit.any():
                out.append((rest[hit], by[hit]))
                front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return out


def _links(radius: int):
    """mapInArrow over entries grouped and sorted by their leading columns, the last one being fp: verified links."""

    def found(keys: np.ndarray, fps: np.ndarray):
        """Links of complete runs of equal keys. Short runs go through offsets at once, long ones through forest()."""
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else np.array([], int)
        lengths = np.diff(np.concatenate((first, [len(keys)])))
        for at, n in zip(first[lengths > 8].tolist(), lengths[lengths > 8].tolist()):
            yield from forest(np.unique(fps[at : at + n]), radius)
        run = np.repeat(np.arange(len(first)), lengths)
        short = np.repeat(lengths <= 8, lengths)
        for d in range(1, 8):
            i = np.flatnonzero((run[:-d] == run[d:]) & short[:-d])
            i = i[(np.bitwise_count(fps[i] ^ fps[i + d]) <= radius) & (fps[i] != fps[i + d])]
            if len(i):
                yield fps[i], fps[i + d]

    def run(batches):
        held_keys = held_fps = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys, fps = np.stack(columns[:-1], axis=1).astype(np.int64), columns[-1].astype(np.int64).view(np.uint64)
            if held_keys is not None:
                keys, fps = np.concatenate([held_keys, keys]), np.concatenate([held_fps, fps])
            same = (keys == keys[-1]).all(axis=1)  # the last run may go on
            tail = len(keys) - int(np.argmin(same[::-1])) if not same.all() else 0
            held_keys, held_fps = keys[tail:], fps[tail:]
            yield from batch_of(found(keys[:tail], fps[:tail]))
        if held_keys is not None:
            yield from batch_of(found(held_keys, held_fps))

    def batch_of(links):
        for a, b in links:
            lo, hi = np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], ["u", "v"])

    return run


def links(fps: DataFrame, radius: int = 3, segments: int = 2) -> DataFrame:
    """(u long, v long, u > v): verified links that connect the distinct fingerprints fps(fp) as all links would."""
    entries = table_entries(fps, radius, segments)
    crowded = entries.groupBy("segment", "value").count().where(F.col("count") > BLOCK)
    crowded = checkpointed(crowded)
    keys = ["segment", "value"]
    if crowded.isEmpty():
        dealt = entries
    else:  # blocks of about BLOCK fingerprints, every pair of blocks a group of its own
        n = F.ceil(F.col("count") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.coalesce(n, F.lit(1))).cast("int")
        entries = entries.join(crowded, keys, "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)))
        keys = [*keys, "a", "b"]
        dealt = entries.select("segment", "value", F.least("own", "other").cast("long").alias("a"), F.greatest("own", "other").cast("long").alias("b"), "fp")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_links(radius), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root): for every node of edges(u > v) that isn't its component's smallest, that smallest one."""
    now = checkpointed(edges)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            return now.withColumnRenamed("v", "root")
        state = seen


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, segments: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) for every row of docs."""
    rows = checkpointed(fingerprints(docs, shingle))
    fps = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("c")))
    roots = components(links(fps.select("fp"), radius, segments))
    nodes = roots.select(F.col("u").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    linked = nodes.join(fps.select("fp", "first_id"), "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    of = checkpointed(fps.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "c"))
    # Rows of a fingerprint with many copies find their component where they are: there are few such fingerprints.
    heavy = small(of.where(F.col("c") >= HEAVY).select("fp", "component_id", F.lit(True).alias("heavy")))
    light = of.where(F.col("c") < HEAVY).select("fp", "component_id")
    marked = rows.join(heavy, "fp", "left")
    there = marked.where("heavy").select("doc_id", "fp", "component_id").unionByName(marked.where("heavy IS NULL").select("doc_id", "fp").join(light, "fp").select("doc_id", "fp", "component_id"))
    return there.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
