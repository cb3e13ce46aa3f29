import random
from pathlib import Path

import duckdb

from weft.llm import mixing
from weft.llm.mixing import mix
from weft.llm.queries import SQL


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, size int, rank string")


def against_sql(spark, rows, tmp_path):
    out = [r.asDict() for r in mix(table(spark, rows)).collect()]
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    if rows:
        c.executemany("insert into documents values (?, ?, ?)", rows)
    want = sorted(c.execute(SQL["op4_mixing"]).fetchall(), key=str)
    got = sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in out), key=str)
    assert got == want
    return out


def test_targets_caps_and_sample_against_sql(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 50, 400])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(1000, None, "a"), (1001, "", "d"), (1002, " ".join(["x"] * 9000), "b")]
    out = against_sql(spark, rows, tmp_path)
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
        assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] for r in rs)
    assert abs(sum(rs[0]["target"] for rs in by.values()) - sum(r["size"] for r in out)) < 1e-6


def test_one_source_empty_and_repeats(spark, tmp_path):
    assert all(r["copies"] == 1 for r in against_sql(spark, [(1, "a b", "s"), (2, "c", "s")], tmp_path))
    assert against_sql(spark, [], tmp_path) == []
    out = mix(table(spark, [(1, "a b", "s")] * 5 + [(2, "a", "t")] * 5)).collect()
    assert len(out) == 10 and sum(r["taken"] for r in out) in range(13, 18)


def test_native():
    source = Path(mix.__code__.co_filename).read_text()
    assert not any(x in source for x in ("udf", "mapIn", "applyIn", ".rdd", "toPandas"))


def near_target(out):
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= max(r["size"] for r in rs)
        assert all(r["taken"] <= 3 * r["size"] for r in rs)


def test_ties_are_cut_inside(spark, monkeypatch):
    rows = [(None, f"a{i} b c d e f g h i j k l m n o p q r s t", "a") for i in range(400)]  # null ids, texts of their own
    rows += [(None, "x " * 20, "b")] * 300 + [(7, "y " * 20, "c")] * 300 + [(i, "z " * 10, "d") for i in range(50)]  # equal rows
    near_target(mix(table(spark, rows)).collect())
    near_target(mix(table(spark, rows), keep=("text",)).collect())
    monkeypatch.setattr(mixing, "WINDOW_ROWS", 5)  # all digits of the key
    near_target(mix(table(spark, rows)).collect())
