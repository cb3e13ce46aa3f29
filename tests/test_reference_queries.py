"""Every catalogue query with SQL agrees with DuckDB; goldens of the planner."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from weft.operators import planner
from weft.plans import catalog, interactions, planning, retrieval  # noqa: F401 - these add to the catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if isinstance(v, pd.Timestamp) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((repr([plain(v) for _, v in sorted(zip(names, row))]) for row in found.fetchall()))
    assert sorted(repr([plain(r[n]) for n in sorted(names)]) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["run_state_fold", "run_finalize", "run_stale"])
def test_run_state_takes_all_events(spark, duck, name):
    whole = duck.execute(catalog.SQL[name].replace(" WHERE event_id % 40 = user_id % 40", ""))
    names = [d[0] for d in whole.description]
    want = sorted(repr([plain(v) for v in row]) for row in whole.fetchall())
    assert sorted(repr([plain(r[n]) for n in names]) for r in catalog.QUERIES[name](spark, SF).collect()) == want


def test_searches_take_every_fiftieth_row(spark, duck):
    whole = duck.execute(catalog.SQL["knn_topk"].replace("vec_id < 5", "vec_id % 50 = 0"))
    names = [d[0] for d in whole.description]
    want = sorted(repr([plain(v) for v in row]) for row in whole.fetchall())
    assert sorted(repr([plain(r[n]) for n in names]) for r in catalog.knn_topk(spark, SF).collect()) == want
    ids = {r[0] for r in duck.execute("SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0").fetchall()}
    assert len(ids) > 5 and {r["qid"] for r in catalog.knn_mmr(spark, SF).collect()} == ids


@pytest.mark.parametrize("name, cut", [("dialogue_export", "left(text, 20)"), ("quote_clean_truncate", "'ss')), 12)")])
def test_whole_texts(spark, duck, name, cut):
    whole = duck.execute(catalog.SQL[name].replace(cut, cut.rpartition(" ")[0] + " 1000000000)"))
    names = [d[0] for d in whole.description]
    want = sorted(repr([plain(v) for v in row]) for row in whole.fetchall())
    assert sorted(repr([plain(r[n]) for n in names]) for r in catalog.QUERIES[name](spark, SF).collect()) == want


def test_streaming_sessions_are_those_of_the_table(spark):
    key = lambda df: sorted((r["user_id"], r["start_us"], r["end_us"], r["n"]) for r in df.collect())
    got = key(catalog.streaming_sessions(spark, SF))
    assert got == key(catalog.sessions_30m(spark, SF)) and len(got) > 100


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_planner_goldens(spark):
    weights = planner.day_weights(planner.calendar(spark))
    raw = {r["day_id"]: r["weight"] for r in weights.collect()}
    for day, w in {"d18": 1.249525871218401, "d36": 0.8381284578044559, "d47": 1.2726300802655561, "d62": 0.5610492704143042, "d73": 1.2655854181090418}.items():
        assert raw[day] == pytest.approx(w, rel=1e-12)
    quota = {r["day_id"]: r["quota"] for r in planner.apportion_days(weights, 6000).collect()}
    assert (quota["d36"], quota["d62"], sum(quota.values())) == (64, 42, 6000)
    dow = {r["day_id"]: (r["dow"], r["month_idx"], r["dom"]) for r in planner.calendar(spark).collect()}
    assert dow["d01"][0] == "segunda" and dow["d30"][0] == "terca" and dow["d31"][:2] == ("quarta", 2) and dow["d62"][::2] == ("sabado", 2) and dow["d90"][0] == "sabado"


def test_largest_remainder_ties_and_zero(spark):
    from pyspark.sql import functions as F

    w = spark.createDataFrame([("b", 1, 1), ("a", 2, 1), ("c", 3, 1)], "k string, ord int, w long")
    q = lambda n: {r["k"]: r["quota"] for r in planner.apportion(w, F.lit(n), ["k"]).collect()}
    assert q(2) == {"b": 1, "a": 1, "c": 0} and q(0) == {"a": 0, "b": 0, "c": 0}
