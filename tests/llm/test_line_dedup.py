import random
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from weft.llm.line_dedup import dedup_lines, distinct_lines, lines_of, rarity_sketch, signed_lines, similar_pairs


def brute(rows, t=0.8):
    seen, gone = [], {}
    order = sorted(((d is not None, d or 0, i, line) for d, text in rows for i, line in enumerate((text or "").split("\n"))))
    for has, d, i, line in order:
        s = frozenset(w for w in "".join(" " if c in "\t\v\f\r" else c for c in line.lower()).split(" ") if w)
        if not s:
            continue
        if any(len(s & x) >= t * len(s | x) - 1e-9 for x in seen):
            gone.setdefault(d if has else None, []).append(i)
        seen.append(s)
    return gone


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["the", "of"] * 30
    lines = []
    for _ in range(150):
        w = rng.choice(lines).split() if lines and rng.random() < 0.6 else rng.choices(words, k=rng.choice([1, 2, 3, 4, 5, 6, 9, 14, 25]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w = [*w[:at], rng.choice(words), *w[at + rng.randrange(2) :]]
        lines.append(" ".join(w).upper() if rng.random() < 0.1 else "  ".join(w))
    rows = []
    for d in range(50):
        rows.append((d * 7 % 50, "\n".join(rng.choices([*lines, "", " \t"], k=rng.randrange(1, 7)))))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = [*corpus(seed), (100, None), (101, ""), (None, "w1 w2 w3 w4 w5")]
    df = spark.createDataFrame([(*r, 3, "s") for r in rows], "doc_id long, text string, n int, k1 string")
    out = dedup_lines(df, keep=("k1",), rarity_bits=10).collect()
    want = brute(rows)
    assert len(out) == len(rows) and sum(map(len, want.values())) > 50
    text = dict(rows)
    for r in out:
        gone = want.get(r["doc_id"], [])
        assert r["removed"] == gone
        lines = (text[r["doc_id"]] or "").split("\n")
        assert r["text"] == (text[r["doc_id"]] if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone))


def test_crowd_of_variants(spark):
    base = [f"b{i}" for i in range(30)]
    rows = [(i, " ".join([*base[: i % 30], f"x{i}", *base[i % 30 + 1 :]])) for i in range(120)] + [(500, " ".join(base))]
    out = {r["doc_id"]: r["removed"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), rarity_bits=10).collect()}
    want = brute(rows)
    assert {d for d, x in out.items() if x} == set(want) and len(want) == 120


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b\na b"), (1, "a b\na b"), (2, "a b")], "doc_id long, text string")
    out = sorted((r["doc_id"], r["text"]) for r in dedup_lines(df, rarity_bits=8).collect())
    assert out == [(1, "a b"), (1, "a b"), (2, "")]
    assert dedup_lines(df.limit(0), rarity_bits=8).collect() == []


def test_texts_are_split_once(spark):
    df = spark.createDataFrame([(1, "A b\n\nc")], "doc_id long, text string")
    lines = lines_of(df, plain=True).where("trim(line) <> ''")
    assert [(r["line_no"], r["line"]) for r in lines.collect()] == [(0, "a b"), (2, "c")]
    plan = lines._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum(x.count("split(") for x in plan) == 1
    assert not any("lower" in x for x in plan if "Generate" in x)


def test_sketch_levels_and_marks(spark):
    times = {"once": 1, "thrice": 3, "often": 20}
    df = spark.createDataFrame([(i, f" {w.upper()}\n") for w, n in times.items() for i in range(n)], "doc_id long, text string")
    sketch = rarity_sketch(df, 12).first()["c"]
    hashes = spark.createDataFrame([(w,) for w in times], "w string").selectExpr("w", "xxhash64(w) h").collect()
    level = {r["w"]: ((sketch[(r["h"] % (1 << 64)) >> 52] ^ r["h"]) % (1 << 64)) >> 56 for r in hashes}
    assert level == {"once": 1, "thrice": 3, "often": 32}


def test_pairs_have_enough_in_common(spark):
    words = {s: [f"{s}{i}" for i in range(299)] for s in "xy"}
    lines = [" ".join(["shared", *words["x"]]), " ".join(["shared", *words["y"]]), " ".join(["shared", *words["x"][:280]])]
    often = "\n".join(w for ws in words.values() for w in ws)  # of one word each, so similar to none, but then "shared" is the rarest
    df = spark.createDataFrame([*enumerate(lines), *((10 + i, often) for i in range(6))], "doc_id long, text string")
    firsts = distinct_lines(signed_lines(df, rarity_sketch(df, 18), 18, 0.8)).withColumn("open", F.lit(True))
    place = {r["lid"]: r["doc_id"] for r in firsts.select("lid", "doc_id").collect()}
    assert {(place[r["lx"]], place[r["ly"]]) for r in similar_pairs(firsts, 0.8).collect()} == {(0, 2)}


def test_native():
    source = Path(dedup_lines.__code__.co_filename).read_text()
    assert not any(x in source for x in ("udf", "mapIn", "applyIn", ".rdd", "toPandas", "import numpy"))
