import random
import re

import numpy as np
import pytest
import xxhash

from weft.llm.simhash import components, forest, links, near_duplicates, simhashes, table_entries


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


def texts(rng, n):
    words = [f"w{i}É" if i % 7 == 0 else f"W{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out).split(" ")
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 200]))))
    return out


def test_fingerprints_match_brute_force():
    rows = [*texts(random.Random(1), 60), "", None, " \n", "a", "a b", "a b c d", "x y Z\u0085w", "l " * 150_000]
    assert simhashes([None if t is None else t.encode() for t in rows], 3).tolist() == [brute_fingerprint(t) for t in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_operator_against_brute_force(spark, seed):
    rows = [(i * 3, t, "x") for i, t in enumerate([*texts(random.Random(seed), 150), None, "", "  "])]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    want = brute_components(fps, [d for d, *_ in rows])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out} == {d: (f"{f:016x}", want[d]) for (d, *_), f in zip(rows, fps)}


def near_points(n, seed=0):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(4)]
    return sorted({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(n)})


@pytest.mark.parametrize(("radius", "segments"), [(3, 2), (3, 4), (5, 2)])
def test_links_connect_as_all_pairs_do(spark, radius, segments):
    points = near_points(120)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    found = components(links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, segments)).collect()
    got = {x: x for x in signed} | {r["u"]: r["root"] for r in found}
    want = brute_components(points, signed, radius)
    assert got == want


def test_table_entries_are_the_downward_balls(spark):
    fps = [0, -1, 0x00000003_80000001, 5]
    got = sorted(tuple(r) for r in table_entries(spark.createDataFrame([(x,) for x in fps], "fp long"), 3, 2).collect())
    want = []
    for x in fps:
        for i, v in enumerate((x & 0xFFFFFFFF, x >> 32 & 0xFFFFFFFF)):
            want += [(i, v, x)] + [(i, v ^ 1 << b, x) for b in range(32) if v >> b & 1]
    assert got == sorted(want)


def test_crowded_entries_are_dealt_in_blocks(spark, monkeypatch):
    import weft.llm.simhash as m

    monkeypatch.setattr(m, "BLOCK", 8)
    points = near_points(200, 5)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    found = components(links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    assert {x: x for x in signed} | {r["u"]: r["root"] for r in found} == brute_components(points, signed)


def test_forest_is_a_forest():
    points = np.array(near_points(300, 9), np.uint64)
    edges = forest(points, 3)
    assert sum(len(a) for a, _ in edges) < len(points)
    assert all((np.bitwise_count(a ^ b) <= 3).all() for a, b in edges)


def test_empty_table_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    out = near_duplicates(spark.createDataFrame([(None, "a"), (None, "b c d"), (4, "b c d")], schema)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in out) == [("4", "4"), ("None", "4"), ("None", "None")]
