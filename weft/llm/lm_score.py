"""Language-model scoring: exact unigram counts, and bigram counts in a log-frequency Bloom filter.

Documents are taken in chunks; a chunk's tokens are ranks in its own vocabulary, sorted by the 64-bit hash of the word. What
is counted over the corpus travels as sorted hash arrays, cut by hash ranges into buckets: one group a bucket sums the
counts of its range, a hash range can't be hot, and the work in the JVM is a few rows. Unigram counts return to the
chunks that asked; of bigram counts c, each bucket makes its piece of the filter, with entries (bigram, 1) to
(bigram, q) for the quantised count q = 1 + floor(log_BASE c). Pieces are broadcast in passes of at most `filter_mb`, each
pass scoring the bigrams of its hash range, so that what is broadcast is bounded whatever the corpus and nothing is left
out. Repeated probes (1, 2, ... until a miss) read q back; a bigram never reads below its count, and seldom above.

P(w | h) = (c(h, w) + K * P(w)) / (c(h) + K), P(w) = (c(w) + 1) / (N + V + 1): Dirichlet smoothing. The first word's h is
the beginning of the text; every text ends with one end token.

Defined results: a null text is empty: its one token is the end; a null doc_id is never learned from; repeated rows come
back each and count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import table

BASE, K, BITS, PROBES = 1.5, 5.0, 10, 5
CHUNK_BYTES, CHUNK_DOCS = 1 << 22, 4096
FILTER_MB = 128
END, BEGIN = b" end", b" begin"  # no word has a space
END_HASH, BEGIN_HASH = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (END, BEGIN))


def pack(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def mixed(a: np.ndarray, b) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (np.uint64(0x9E3779B97F4A7C15) * (b + np.uint64(1)))) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


def pair_hashes(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """48-bit hashes of bigrams, in the upper bits: they meet far seldomer than the filter errs."""
    return mixed(before, words) & ~np.uint64(0xFFFF)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The hash range, in order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pieces(hashes: np.ndarray, counts: np.ndarray, buckets: int):
    """bucket, packed hashes, packed counts of sorted hashes."""
    cuts = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
    for b, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        if lo < hi:
            yield b, pack_sorted(hashes[lo:hi]), pack(counts[lo:hi])


class Vocabulary(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Chunk:
    """Documents whose tokens are counted and scored together."""

    def __init__(self) -> None:
        self.words = Vocabulary({END: 0, BEGIN: 1})
        self.docs, self.held, self.lengths, self.tokens, self.bytes = [], [], [], [], 0

    def add(self, doc_id, held: bool, text: bytes) -> None:
        tokens = list(map(self.words.__getitem__, text.lower().split()))  # bytes: A-Z only, the contracts' white space
        tokens.append(0)
        self.docs.append(doc_id)
        self.held.append(held)
        self.lengths.append(len(tokens))
        self.tokens.append(np.array(tokens, np.int32))
        self.bytes += len(text)

    def rows(self, chunk: int, buckets: int):
        """kind, bucket, chunk, a, b: the documents, the vocabulary and the counted bigrams."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        tokens = rank[np.concatenate(self.tokens)]
        lengths = np.array(self.lengths)
        learned = ~np.array([h is not False for h in self.held])
        of = np.repeat(learned, lengths)
        counts = np.bincount(tokens[of], minlength=len(order))
        counts[rank[1]] = learned.sum()
        for b, h, c in pieces(hashes, counts, buckets):
            yield "word", b, chunk, h, c
        pairs = pair_hashes(hashes[history(tokens, lengths, rank[1])[of]], hashes[tokens[of]])
        pairs, n = np.unique(pairs, return_counts=True)
        for b, h, c in pieces(pairs, n, buckets):
            yield "pair", b, chunk, h, c
        ids = np.array([x if x is not None else 0 for x in self.docs], np.int64).view(np.uint64)
        flags = np.array([(x is None) + 2 * bool(h) for x, h in zip(self.docs, self.held)])
        yield "text", -1, chunk, pack(np.concatenate([[len(ids)], ids, flags, lengths]).astype(np.uint64) if len(ids) else ids), pack(tokens)


def history(tokens: np.ndarray, lengths: np.ndarray, begin: int) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = begin
    return before


def probes(pairs: np.ndarray, level: int, bits: np.ndarray) -> list[np.ndarray]:
    """Positions of (pair, level) in a filter piece of `bits` bits."""
    a = mixed(pairs, np.uint64(level))
    b = mixed(a, np.uint64(7)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [((a + np.uint64(i) * b) % bits).astype(np.int64) for i in range(PROBES)]


def filter_piece(pairs: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    levels = 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)
    bits = max(64, int(levels.sum()) * BITS + 7 & ~7)
    on = np.zeros(bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in probes(pairs[levels >= level], level, np.uint64(bits)):
            on[at] = True
    return bits, np.packbits(on, bitorder="little").tobytes()


class Filter:
    """The pieces of the buckets lo to hi - 1."""

    def __init__(self, lo: int, buckets: int, sizes: list[int], data: bytes) -> None:
        self.lo, self.buckets = lo, buckets
        self.sizes = np.array(sizes, np.uint64)
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        self.data = np.frombuffer(data, np.uint8)

    def levels(self, pairs: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        own = bucket - self.lo
        size, start = self.sizes[own], self.starts[own]
        out = np.zeros(len(pairs), np.int64)
        left, level = np.flatnonzero(size > 0), 0
        while len(left):
            level += 1
            spots = probes(pairs[left], level, size[left])
            alive = np.arange(len(left))
            for spot in spots:
                pos = spot[alive] + start[left[alive]]
                alive = alive[(self.data[pos >> 3] >> (pos & 7).astype(np.uint8) & 1) > 0]
            left = left[alive]
            out[left] = level
        return out


def score(docs: DataFrame, held_out, filter_mb: int = FILTER_MB, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs(doc_id, text, ...).

    held_out: a boolean column; where it is false the model learns from the row, where it is null it neither learns nor counts as held out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), "text")
    if buckets is None:  # more of them where there is more to count
        buckets = min(1 << 14, max(64, docs.count() // 4000))
    schema = "kind string, bucket int, chunk long, a binary, b binary"

    def batch_of(out, names=("kind", "bucket", "chunk", "a", "b"), types=(pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(types), types)], list(names))

    def cut(batches):
        n, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())):
                chunk.add(doc_id, held, text.as_py() or b"")
                if chunk.bytes >= CHUNK_BYTES or len(chunk.docs) >= CHUNK_DOCS:
                    yield batch_of(list(chunk.rows(n, buckets)))
                    n, chunk = n + 1, Chunk()
        if chunk.docs:
            yield batch_of(list(chunk.rows(n, buckets)))

    cuts = table(rows.mapInArrow(cut, schema), "kind")
    parts = max(64, min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def by(key):
        def grouped(batches):
            """Rows of one key, all of them, of partitions sorted by it."""
            held: list[dict] = []
            for batch in batches:
                for row in batch.to_pylist():
                    if held and held[0][key] != row[key]:
                        yield held
                        held = []
                    held.append(row)
            if held:
                yield held

        return grouped

    def sum_words(batches):
        for group in by("bucket")(batches):
            hashes = [unpack_sorted(r["a"]) for r in group]
            distinct, where = np.unique(np.concatenate(hashes), return_inverse=True)
            totals = np.bincount(where, weights=np.concatenate([unpack(r["b"]) for r in group])).astype(np.int64)
            words = distinct != BEGIN_HASH
            yield batch_of([("total", group[0]["bucket"], -1, None, pack(np.array([totals[words].sum(), (totals[words] > 0).sum()])))])
            at = 0
            for r, h in zip(group, hashes):
                yield batch_of([("word", r["bucket"], r["chunk"], r["a"], pack(totals[where[at : at + len(h)]]))])
                at += len(h)

    def sum_pairs(batches):
        for group in by("bucket")(batches):
            distinct, where = np.unique(np.concatenate([unpack_sorted(r["a"]) for r in group]), return_inverse=True)
            bits, data = filter_piece(distinct, np.bincount(where, weights=np.concatenate([unpack(r["b"]) for r in group])))
            yield batch_of([(group[0]["bucket"], bits, data)], ("bucket", "bits", "data"), (pa.int32(), pa.int64(), pa.binary()))

    def bucketed(kind):
        return cuts.where(F.col("kind") == kind).repartition(parts, "bucket").sortWithinPartitions("bucket")

    words = table(bucketed("word").mapInArrow(sum_words, schema), "kind")
    filters = table(bucketed("pair").mapInArrow(sum_pairs, "bucket int, bits long, data binary"))
    total = distinct = 0
    for r in words.where("kind = 'total'").select("b").collect():  # one row a bucket
        n, v = unpack(bytes(r["b"])).tolist()
        total, distinct = total + n, distinct + v

    chunks = cuts.where("kind = 'text'").unionByName(words.where("kind = 'word'")).repartition("chunk").sortWithinPartitions("chunk", "bucket")
    out_types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    out_names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "chunk", "at")

    def scoring(shared, lo, hi):
        def run(batches):
            model = Filter(lo, buckets, *shared.value)
            for group in by("chunk")(batches):
                head, vocabulary = unpack(group[0]["a"]), group[1:]
                n = int(head[0])
                ids, flags, lengths = head[1 : 1 + n].view(np.int64), head[1 + n : 1 + 2 * n], head[1 + 2 * n :].astype(np.int64)
                tokens = unpack(group[0]["b"]).astype(np.int64)
                hashes = np.concatenate([unpack_sorted(r["a"]) for r in vocabulary])
                counts = np.concatenate([unpack(r["b"]) for r in vocabulary]).astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                before = history(tokens, lengths, int(np.searchsorted(hashes, BEGIN_HASH)))
                single = (counts + 1) / (total + distinct + 1)
                pairs = pair_hashes(hashes[before], hashes[tokens])
                bucket = bucket_of(pairs, buckets)
                own = np.flatnonzero((bucket >= lo) & (bucket < hi))
                level = model.levels(pairs[own], bucket[own])
                ch = counts[before[own]]
                c = np.minimum(np.where(level > 0, BASE ** (level - 1.0), 0.0), ch)
                logs = np.zeros(len(tokens))
                logs[own] = np.log10((c + K * single[tokens[own]]) / (ch + K))
                sums = [np.add.reduceat(x, starts) for x in ((counts > 0)[tokens].astype(np.int64), np.log10(single)[tokens], logs)]
                doc = pa.array(ids, mask=(flags & np.uint64(1)).astype(bool))
                at = np.arange(n)
                cols = [doc, (flags & np.uint64(2)) > 0, lengths, sums[0], np.full(n, total), sums[1], sums[2], np.full(n, group[0]["chunk"]), at]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(cols, out_types)], list(out_names))

        return chunks.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, chunk long, at long")

    sizes = dict(filters.select("bucket", "bits").collect())  # one row a bucket
    passes, lo = [], 0
    while lo < buckets:
        hi, held = lo, 0
        while hi < buckets and (hi == lo or held + sizes.get(hi, 0) <= filter_mb << 23):
            held += sizes.get(hi, 0)
            hi += 1
        data = {r["bucket"]: bytes(r["data"]) for r in filters.where(F.col("bucket").between(lo, hi - 1)).toLocalIterator()}
        shared = spark.sparkContext.broadcast(([sizes.get(b, 0) for b in range(lo, hi)], b"".join(data.pop(b, b"") for b in range(lo, hi))))
        passes.append(scoring(shared, lo, hi))
        lo = hi
    if len(passes) == 1:
        return passes[0].drop("chunk", "at")
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    first = [F.first(c).alias(c) for c in out_names[:6]]
    return every.groupBy("chunk", "at").agg(*first, F.sum("score").alias("score")).drop("chunk", "at")
