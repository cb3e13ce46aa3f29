import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from weft.functions.text import compose, prefix_sums, squeeze, truncate
from weft.operators import rag, ragflow, runs
from weft.sources import files, sinks


def one(spark, c, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(c).first()[0]


def test_text(spark):
    assert one(spark, squeeze(F.col("a")), a="  linha 1\n\nlinha\t2   linha3\x1c ") == "linha 1 linha 2 linha3"
    assert one(spark, truncate(F.col("a"), 5), a="abcdef") == "ab..." and one(spark, truncate(F.col("a"), 3), a="abcdef") == "abc"
    assert one(spark, compose("{x}-{{x}}-{y}", x=F.col("a"), y=F.col("b")), a="{y}", b="2") == "{y}-{x}-2"


def test_prefix_sums(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("k"), F.lit(3).cast("long").alias("n"))
    assert {r["k"]: r["base"] for r in prefix_sums(df, "k", "n").collect()} == {k: 3 * k for k in range(100)}


def test_fold_and_stale(spark):
    h = spark.createDataFrame([("r", "a", 1, "pending", None), ("r", "a", 2, "running", None), ("r", "b", 1, "running", None), ("r", "b", 2, "not_finished", "x" * 2000), ("r", "c", 1, "completed", None), ("r", "c", 5, "not_finished", "late")], "run_id string, instance string, seq int, state string, error string")
    out = {r["instance"]: r for r in runs.fold(h).collect()}
    assert (out["a"]["status"], out["a"]["started_at"]) == ("running", 2)
    assert (out["b"]["status"], len(out["b"]["error"])) == ("not_finished", 1000)
    assert (out["c"]["status"], out["c"]["error"]) == ("completed", None)
    assert {r["instance"]: r["status"] for r in runs.stale_to_not_finished(runs.fold(h), "m").collect()}["a"] == "not_finished"


def test_rewrites_and_chunks(spark):
    say = lambda t: one(spark, ragflow.parsed_rewrites(F.col("a")), a=t)
    assert say("1. um\n2. dois\n3. tres\n4. quatro") == ["um", "dois", "tres"] and say("- a\n- b") == ["a", "b"] and say("plain") == ["plain"]
    text = "word " * 700
    parts = rag.split_text(text, 1000, 100)
    assert all(len(p) <= 1000 for p in parts) and len(parts) == 4 and rag.split_text("x" * 2500, 1000, 0) == ["x" * 1000, "x" * 1000, "x" * 500]


def test_knn_in_blocks(spark):
    e = spark.range(60).select(F.col("id").alias("cid"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("cvec"), (F.col("id") % 2).alias("ds"))
    q = e.where("cid % 3 = 0").select(F.col("cid").alias("qid"), F.col("cvec").alias("qvec"), "ds")
    found = lambda block: sorted(map(tuple, rag.knn(q, e, block=block).collect()))
    assert len(found(7)) == 60 and found(7) == found(1000)


def test_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("name;age\nAlice;30\nBob;25\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "p.csv")).collect()] == [("Alice", "30"), ("Bob", "25")]
    (tmp_path / "bad.csv").write_text("name,age,city\nAlice,30\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "c.csv").write_text("cenario_id;dados_cenario\n1;a\n2\n")
    good, bad = files.read_scenarios(spark, str(tmp_path / "c.csv"))
    assert good.count() == 1 and bad.count() == 1
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("a.json", json.dumps({"messages": [], "thread_id": "t"}))
        z.writestr("b.json", json.dumps([{"messages": [1]}, {"x": 1}]))
        z.writestr("index.json", json.dumps({"n": 2}))
    assert [r["member"] for r in files.read_zipped_json(spark, str(tmp_path / "d.zip")).collect()] == ["a.json", "b.json"]
    db = sqlite3.connect(tmp_path / "s.db")
    db.execute("create table t (id integer primary key, name text, x real)")
    db.executemany("insert into t values (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(50)])
    db.commit()
    spark.dataSource.register(files.SqliteSource)
    got = spark.read.format("sqlite_ro").option("path", str(tmp_path / "s.db")).option("dbtable", "t").load()
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"n{i}", i / 2) for i in range(50)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    sinks.write_csv(df, str(tmp_path / "o"), ["v", "k"])
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "o")).columns == ["v", "k"]
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_csv(df, str(tmp_path / "o"), ["v", "k"])
    sinks.write_by_key(df, str(tmp_path / "j"), "k")
    sinks.write_audit(df, str(tmp_path / "a"))
    assert json.loads(spark.read.text(str(tmp_path / "a")).first()[0]) == {"k": 1, "v": "a"}
