"""Benchmark decontamination by SimHash windows.

Every benchmark item has a 64-bit SimHash of its five-word shingles; every window of an item's word count in a document
has one too. Items are indexed by the eight bytes of their fingerprints: a window probes, for each byte, all values
within BALL bits of its own, so any item within RADIUS = 8 * (BALL + 1) - 1 bits is met (pigeonhole); its complete distance
is checked, and the weighted Jaccard of the shingle counts (sum of minima over sum of maxima) verifies the pair at
`similarity` or more. A window that shares no shingle with any item cannot be similar and is not fingerprinted, which
leaves out nothing. A pair at similarity 0.8 differs in 10 bits on average and in more than RADIUS practically never.

A document shorter than an item is one window, the whole of it.

Words are \\w+ runs of the lower-cased text. Items with fewer than five words: their whole word sequence is the shingle.
The benchmark is a stated query set: it is taken in blocks of at most `block` items and about BLOCK_CHARS characters, a pass over the
documents for each.

Defined results: null and empty texts, documents or items, match nothing; a null doc_id or item_id is an id like any other; repeated documents or items give repeated
pairs for their ids, equal pairs once; ties between windows go to the first one. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, SIMILARITY, BALL = 5, 0.8, 2
RADIUS = 8 * (BALL + 1) - 1
BLOCK, BLOCK_CHARS = 20_000, 1 << 24
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def _roll(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive word hashes."""
    out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ ids[j : j + len(out)]) * _MULTIPLY
            out ^= out >> np.uint64(29)
    return out


def word_ids(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def fingerprint(bits: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(bits * 2 > n, axis=-1, bitorder="little").view(np.uint64).ravel()


def unpack(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class Index:
    """The items of one block: their fingerprints by byte, their shingles, their word counts."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.ids, self.sizes, self.counts, fps = [], [], [], []
        vocabulary: set[str] = set()
        holders = defaultdict(set)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            vocabulary.update(words)
            k = min(SHINGLE, len(words))
            shingles = _roll(word_ids(words), k)
            for h in shingles.tolist():
                holders[k, h].add(len(words))
            self.ids.append(item_id)
            self.sizes.append(len(words))
            self.counts.append(Counter(shingles.tolist()))
            fps.append(fingerprint(unpack(shingles).sum(axis=0, dtype=np.int64), len(shingles))[0])
        self.fps = np.array(fps, np.uint64)
        self.vocabulary = {w: xxhash.xxh64_intdigest(w) for w in vocabulary}
        self.known = {k: np.array(sorted(h for kk, h in holders if kk == k), np.uint64) for k in {k for k, _ in holders}}
        self.widths = dict(holders)  # (k, shingle): the word counts of the items that hold it
        near = [[v ^ m for m in range(256) if m.bit_count() <= BALL] for v in range(256)]
        at = defaultdict(list)  # (word count, byte, value): items
        for i, fp in enumerate(fps):
            for b in range(8):
                for v in near[int(fp) >> 8 * b & 255]:
                    at[self.sizes[i], b, v].append(i)
        # A window can only be like an item of its own word count, so every count has tables of its own.
        self.tables = {key: np.array(items, np.int64) for key, items in at.items()}

    def meets(self, fp: int, size: int) -> np.ndarray:
        """Items of `size` words within RADIUS bits."""
        met = [t for b in range(8) if (t := self.tables.get((size, b, fp >> 8 * b & 255))) is not None]
        if not met:
            return np.zeros(0, np.int64)
        found = np.unique(np.concatenate(met))
        return found[np.bitwise_count(self.fps[found] ^ np.uint64(fp)) <= RADIUS]

    def matches(self, text: str | None, similarity: float):
        """item, similarity, first word, words, distance of the best window for each item that the text holds."""
        words = words_of(text)
        if not words:
            return
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        best: dict[int, tuple] = {}
        for k, known in self.known.items():
            if len(ids) < k:
                continue
            hashes = _roll(ids, k)
            at = np.searchsorted(known, hashes)
            hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == hashes)
            if not len(hit):
                continue
            hashes = _roll(word_ids(words), k)
            spans: dict[int, list[tuple[int, int]]] = defaultdict(list)  # word count: stretches of window starts
            longer: set[int] = set()
            for i in hit.tolist():
                for width in self.widths[k, int(hashes[i])]:
                    if width > len(words):
                        longer.add(width)
                        continue
                    lo, hi = max(0, i + k - width), min(i, len(words) - width)
                    if lo <= hi:
                        own = spans[width]
                        if own and lo <= own[-1][1] + 1:
                            own[-1] = (min(own[-1][0], lo), max(hi, own[-1][1]))
                        else:
                            own.append((lo, hi))
            n = len(hashes)
            if any(n + 1e-9 >= similarity * (width - k + 1) for width in longer):
                own = Counter(hashes.tolist())
                fp = int(fingerprint(unpack(hashes).sum(axis=0, dtype=np.int64), n)[0])
                for i in (i for size in longer for i in self.meets(fp, size).tolist()):
                    both = sum(min(c, self.counts[i].get(h, 0)) for h, c in own.items())
                    j = both / (n + self.sizes[i] - k + 1 - both)
                    if j >= similarity and j > best.get(i, (0,))[0]:
                        best[i] = (j, 0, len(words), int(np.bitwise_count(self.fps[i] ^ np.uint64(fp))))
            for width, stretches in spans.items():
                n = width - k + 1
                for lo, hi in stretches:
                    part = hashes[lo : hi + n]
                    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(unpack(part), axis=0, dtype=np.int32)))
                    fps = fingerprint(sums[n:] - sums[:-n], n)
                    for s, fp in enumerate(fps.tolist()):
                        items = self.meets(fp, width).tolist()
                        if not items:
                            continue
                        own = Counter(part[s : s + n].tolist())
                        for i in items:
                            both = sum(min(c, self.counts[i].get(h, 0)) for h, c in own.items())
                            j = both / (2 * n - both)
                            if j >= similarity and j > best.get(i, (0,))[0]:
                                best[i] = (j, lo + s, width, int(np.bitwise_count(self.fps[i] ^ np.uint64(fp))))
        for i, found in best.items():
            yield self.ids[i], *found


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words, distance: the best window for every (document, item) at `similarity` or more."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, start_word int, n_words int, distance int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], schema)
    kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("distance", pa.int32())])

    def pass_over(shared):
        def run(batches):
            index = Index(shared.value)
            for batch in batches:
                found = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in index.matches(t, similarity)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 6, kind)], schema=kind)

        return rows.mapInArrow(run, schema)

    items: list[tuple[int, str | None]] = []
    passes, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        items.append(tuple(row))
        held += len(row["text"] or "")
        if len(items) == block or held >= BLOCK_CHARS:
            passes.append(pass_over(spark.sparkContext.broadcast(items)))
            items, held = [], 0
    if items:
        passes.append(pass_over(spark.sparkContext.broadcast(items)))
    if not passes:
        return out
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    # Rows that repeat an item or document give equal pairs once; there are few pairs, and partial sums come first.
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("s"), "n_words", (-F.col("distance")).alias("d"))).alias("b")
    out = out.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", "b.similarity", (-F.col("b.s")).alias("start_word"), "b.n_words", (-F.col("b.d")).alias("distance"))
