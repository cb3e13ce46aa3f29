import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import lm_score
from weft.llm.lm_score import BASE, K, Filter, filter_piece, pack, pack_sorted, score, unpack, unpack_sorted

DATA = "/root/testdata/sf0.001/documents.parquet"


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows):
    learned = [words(t) for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    one, two = Counter(w for ws in learned for w in ws), Counter(p for ws in learned for p in zip(["<b>", *ws], ws))
    one["<b>"], n, v = len(learned), sum(one.values()), len(one)
    out = {}
    for d, t in rows:
        ws = words(t)
        single = [(one[w] + 1) / (n + v + 1) for w in ws]
        q = lambda c: BASE ** math.floor(math.log(c, BASE) + 1e-9) if c else 0
        p = [(min(q(two[h, w]), one[h]) + K * s) / (one[h] + K) for h, w, s in zip(["<b>", *ws], ws, single)]
        out[d] = (len(ws), sum(one[w] > 0 for w in ws), n, sum(map(math.log10, single)), sum(map(math.log10, p)))
    return out


@pytest.mark.parametrize("kw", [{}, {"filter_mb": 0, "buckets": 8}])
def test_against_exact_counts(spark, kw, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_DOCS", 37)
    docs = spark.read.parquet(DATA).select("doc_id", "text", F.lit(1).alias("score"))
    rows = [tuple(r)[:2] for r in docs.collect()] + [(10**9, None), (10**9 + 1, "The THE the unseenword"), (None, "the")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    got = score(df, held_out(), **kw).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    close = 0
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert r["base_score"] == pytest.approx(w[3])
        assert r["score"] >= w[4] - 1e-9  # a filter reads a count too high, if anything
        close += abs(r["score"] - w[4]) < 0.02 * abs(w[4])
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    assert close > 0.97 * len(rows)


def test_filter_reads_counts_back():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    counts = rng.integers(1, 60, len(pairs))
    bits, data = filter_piece(pairs, counts)
    read = Filter(0, 1, [bits], data)
    levels = read.levels(pairs, np.zeros(len(pairs), np.int64))
    want = 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9)
    assert (levels >= want).all() and (levels == want).mean() > 0.98
    others = rng.integers(0, 2**63, 5000).astype(np.uint64) | np.uint64(1 << 63)
    assert (read.levels(others, np.zeros(len(others), np.int64)) > 0).mean() < 0.03


def test_packing():
    x = np.unique(np.random.default_rng(2).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (unpack_sorted(pack_sorted(x)) == x).all() and (unpack(pack(x)) == x).all() and len(unpack(pack(x[:0]))) == 0


def test_nothing_to_learn_from_and_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    out = sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in score(df, held_out()).collect())
    assert out == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    assert score(df.limit(0), held_out()).collect() == []
