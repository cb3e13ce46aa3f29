"""The question flow, stored conversations, runs, sessions, sources and sinks on small fixtures."""

import datetime
import json
import random
import re
import sqlite3
import zipfile
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import text
from weft.operators import eventlog, interactions, ragflow, runs
from weft.sources import files, sinks
from weft.streaming import sessions


class Scripted:
    """Answers by kind; an exception among them is raised."""

    def __init__(self, **answers):
        self.answers = answers

    def complete(self, kind, system, user):
        answer = self.answers[kind]
        answer = answer(system, user) if callable(answer) else answer
        if isinstance(answer, Exception):
            raise answer
        return answer


CONFIG = ragflow.config_of({"datasources": [{"name": "contas", "description": "contas e saldo", "rag_prompt": "C:{context}|Q:{question}", "top_k": 2}, {"name": "cartao", "top_k": 1}], "grader_prompt": "{document}"})


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("1", "contas", "saldo da conta corrente"), ("2", "contas", "abrir uma conta nova"), ("3", "contas", "saldo da conta corrente"), ("4", "cartao", "limite do cartao"), ("5", "contas", "   ")]
    return ragflow.embedded(spark.createDataFrame(rows, "cid string, ds string, chunk string"), "chunk", "cvec", ragflow.hashing).cache()


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, question string")


def test_rewrites(spark):
    say = lambda a: Scripted(rewrite=a)
    got = lambda model, q="saldo": ragflow.rewritten(questions(spark, q), CONFIG, model).first()["queries"]
    assert got(say("1. um\n2. dois\n3. tres\n4. quatro\n5. cinco")) == ["um", "dois", "tres"]
    assert got(say("- a\n- b\n- c\n- d")) == ["a", "b", "c"]
    assert got(say("texto livre")) == ["texto livre"]
    assert got(say("2 sem ponto")) == ["2 sem ponto"]
    assert got(say("1.\n2. dois")) == ["dois"]
    assert got(say(RuntimeError("down"))) == ["saldo"]
    assert got(say("1. x"), "") == [] and got(say("1. x"), None) == []


def test_variants_and_routes(spark):
    rows = ragflow.variants(ragflow.rewritten(questions(spark, "saldo", ""), CONFIG, Scripted(rewrite="1. a\n2. b")))
    assert sorted(map(tuple, rows.collect()), key=str) == [(0, 0, "a"), (0, 1, "b"), (1, 0, None)]
    route = lambda a: {r["ds"] for r in ragflow.routed(rows, CONFIG, Scripted(route=a)).collect()}
    assert route("cartao") == {"cartao", "contas"}  # the empty question goes to the first
    assert route("outra") == {"contas"} and route(ValueError()) == {"contas"}
    assert {r["ds"] for r in ragflow.routed(rows, ragflow.RagConfig(), Scripted(route="x")).collect()} == {None}
    assert "- 'contas': contas e saldo" in ragflow.router_prompt(CONFIG) and "Available datasources" in ragflow.router_prompt(CONFIG)
    marked = ragflow.RagConfig(CONFIG.datasources, router_prompt="<{datasource_descriptions}>")
    assert ragflow.router_prompt(marked).startswith("<- 'contas'")


def test_answers(spark, chunks):
    model = Scripted(rewrite="1. saldo da conta\n2. abrir conta", route="contas", grade=lambda d, q: "YES" if "conta" in d else "no", answer=lambda s, q: f"A[{s}]", fallback="F")
    parts = ragflow.answer(questions(spark, "saldo da conta", "", "nada"), chunks, CONFIG, model)
    out = {r["qid"]: r for r in parts["answers"].collect()}
    assert out[0]["documents_relevant"] and out[0]["datasource"] == "contas" and out[0]["branch"] == "answer"
    texts = out[0]["context"].split("\n\n")
    assert len(texts) == len(set(texts)) >= 1 and all("conta" in t for t in texts)
    assert out[0]["response"] == f"A[C:{out[0]['context']}|Q:saldo da conta]"
    assert out[1]["response"] == ragflow.FALLBACK_NO_QUESTION and out[1]["branch"] == "fallback"
    logs = ragflow.log_rows(parts).collect()
    assert {r["message"] for r in logs} >= {"Query rewriting", "Routing decision", "Document retrieval", "Document grading completed", "Final response generated", "Generating fallback response"}
    assert json.loads(next(r["data"] for r in logs if r["qid"] == 0 and r["message"] == "Final response generated"))["response_type"] == "rag"


def test_failures_become_the_contracts_texts(spark, chunks):
    base = {"rewrite": "1. saldo da conta", "route": "contas", "grade": "yes", "answer": "A", "fallback": "F"}
    said = lambda **more: {r["qid"]: r["response"] for r in ragflow.answer(questions(spark, "saldo da conta"), chunks, CONFIG, Scripted(**(base | more)))["answers"].collect()}[0]
    assert said() == "A"
    assert said(answer=RuntimeError()) == ragflow.FAILED
    assert said(grade="no") == "F" and said(grade=RuntimeError()) == "F"
    assert said(grade="no", fallback=RuntimeError()) == ragflow.FALLBACK_FAILED


def test_retrieval_against_brute_force(spark, chunks):
    rows = spark.createDataFrame([(0, 0, "saldo da conta", "contas"), (0, 1, "limite", "cartao"), (1, 0, "abrir", "desconhecida")], "qid long, i int, query string, ds string")
    got = {(r["qid"], r["i"], r["rank"]): r["cid"] for r in ragflow.retrieved(rows, chunks, CONFIG).collect()}
    own = [(r["cid"], r["ds"], np.array(r["cvec"], float)) for r in chunks.collect()]
    for qid, i, q, ds in [(0, 0, "saldo da conta", "contas"), (0, 1, "limite", "cartao"), (1, 0, "abrir", "contas")]:
        v = ragflow.hashing([q])[0]
        best = sorted((-round(float(v.astype(np.float32).astype(float) @ c / (np.linalg.norm(v) * np.linalg.norm(c))), 6), cid) for cid, d, c in own if d == ds)
        k = {"contas": 2, "cartao": 1}[ds]
        assert [got[qid, i, n + 1] for n in range(k)] == [cid for _, cid in best[:k]]
    assert ragflow.retrieved(rows, chunks, CONFIG, threshold=1.1).count() == 0


def test_aggregation_keeps_the_first(spark):
    found = spark.createDataFrame([(0, 0, 1, "b"), (0, 0, 2, "a"), (0, 1, 1, "a"), (0, 1, 2, "c")], "qid long, i int, rank int, chunk string")
    assert [r["chunk"] for r in ragflow.aggregated(found).orderBy("pos").collect()] == ["b", "a", "c"]


def test_index_is_opened_or_built(spark, tmp_path):
    docs = spark.createDataFrame([(1, "contas", "um texto " * 300)], "doc_id long, ds string, text string")
    path = str(tmp_path / "index")
    assert ragflow.open_index(spark, path, docs.limit(0), CONFIG) is None
    built = ragflow.open_index(spark, path, docs, CONFIG)
    assert built.count() > 1 and ragflow.open_index(spark, path, docs.limit(0), CONFIG).count() == built.count()
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("x")
    assert ragflow.open_index(spark, str(tmp_path / "broken"), docs, CONFIG).count() == built.count()
    with pytest.raises(ValueError):
        ragflow.embedder("openai")


def test_rag_config(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"datasources": [{"name": "a"}], "chunk_size": 10, "chunk_overlap": 2}))
    assert ragflow.load_config(spark, str(tmp_path / "c.json")).chunk_size == 10
    with pytest.raises(ValueError):
        ragflow.config_of({"datasources": [{"name": "a"}, {"name": "a"}]})
    with pytest.raises(TypeError):
        ragflow.config_of({"unknown": 1})
    with pytest.raises(ValueError):
        ragflow.system_prompt("custom", "")
    assert ragflow.system_prompt("custom", "x") == "x" and ragflow.system_prompt("aggressive") != ragflow.system_prompt("default")


def test_summary_and_sanitising(spark):
    messages = spark.createDataFrame([("t", "p", "s", None, 1, "q" * 120, "m1"), ("t", "p", "s", None, 2, "oi", "m2")], "thread_id string, persona_id string, start_time string, end_time string, index int, query string, message_start string")
    logs = spark.createDataFrame([("t", 1, "INFO"), ("t", 1, "INFO"), ("t", 1, "ERROR")], "thread_id string, index int, level string")
    s = ragflow.session_summary(messages, logs).first()["summary"]
    assert "End Time: N/A" in s and "Total Messages: 2" in s and "  Query: " + "q" * 100 + "..." in s and "  Total Logs: 3" in s and "{'ERROR': 1, 'INFO': 2}" in s and "  Total Logs: 0" in s
    df = spark.createDataFrame([("x" * 1500, ["a", "b", "c"], [1, 2, 3, 4, 5, 6])], "question string, context array<string>, messages array<int>")
    r = df.select(ragflow.sanitised({c: F.col(c) for c in df.columns}, kinds={"messages": "messages"}).alias("s")).first()["s"]
    assert (len(r["question"]), r["context"]["count"], r["context"]["preview"], r["messages"]) == (1003, 3, ["a", "b"], [1, 2, 3, 4, 5])


# ---- conversations --------------------------------------------------------------------------------------------------


def state(ts, *messages, persona="p1"):
    return json.dumps({"ts": ts, "channel_values": {"persona_id": persona, "messages": list(messages)}})


HUMAN = {"kind": "human", "content": "olá", "id": "m0", "timing": {"banco_generation_timestamp": "b0", "banco_generation_elapsed_time": 2.5}}
AI = {"kind": "ai", "content": "quero quit, agora", "id": "", "timing": {"simulated_timestamp": "s1", "thinking_time": 1, "typing_time": 2}, "response": {"model_name": "m", "total_tokens": 7}}


@pytest.fixture(scope="module")
def store(spark):
    rows = [
        ("a", "1", None, "json", state("2026-01-02", HUMAN)), ("a", "2", "1", "json", state("2026-01-03", HUMAN, AI, {"kind": "tool", "content": None})),
        ("b", "1", None, "json", None), ("b", "2", "1", "json", state("2026-01-01", HUMAN)),
        ("c", "1", None, "json", state(None, HUMAN)), ("c", "2", "1", "json", None),
        ("d", "1", None, "json", state("2026-01-01")), ("e", "1", None, "msgpack", "x"), ("f", "1", None, "json", "{broken"),
    ]
    return spark.createDataFrame(rows, "thread_id string, checkpoint_id string, parent_checkpoint_id string, type string, checkpoint string")


def test_listing_filters_after_the_pick(store):
    assert [tuple(r) for r in interactions.listed(store).collect()] == [("d", "2026-01-01"), ("a", "2026-01-02")]
    assert {r["thread_id"] for r in interactions.conversations(store).collect()} == {"a", "b", "d"}
    assert interactions.raw(store, "a").first()["state"]["ts"] == "2026-01-03" and interactions.raw(store, "z").count() == 0


def test_views(store):
    conv = interactions.conversations(store)
    simple = {r["thread_id"]: [(m["content"], m["type"]) for m in r["messages"]] for r in interactions.simple(conv).collect()}
    assert simple["a"] == [("olá", "human"), ("quero quit, agora", "ai"), (None, "other")] and simple["d"] == []
    rows = [tuple(r)[:9] for r in interactions.message_rows(conv).where("thread_id = 'a'").orderBy("index").collect()]
    assert rows == [("a", "p1", 0, "ai", "olá", "b0", 2.5, "m0", None), ("a", "p1", 1, "human", "quero quit, agora", "s1", 3.0, None, None), ("a", "p1", 2, "other", "", "", 0.0, None, None)]
    assert {r["thread_id"]: r["ended_at"] for r in interactions.ended(conv).collect()} == {"a": 1, "b": None}
    made = {r["filename"]: r["body"] for r in sinks.conversation_csvs(interactions.message_rows(conv)).collect()}
    assert made["conversa_p1_a.csv"].splitlines()[2] == 'human,"quero quit, agora",s1,3.0'


def test_flat_export_has_error_rows(store):
    rows = {(r["thread_id"], r["checkpoint_id"], r["message_index"]): r for r in interactions.flatten_all(store).collect()}
    assert rows["a", "2", "1"]["total_tokens"] == "7" and rows["a", "2", "2"]["message_type"] == "" and rows["a", "1", "0"]["parent_checkpoint_id"] == ""
    assert rows["d", "1", ""]["content"] == "" and rows["d", "1", ""]["timestamp"] == "2026-01-01"
    for t in ("b", "e", "f"):
        assert (rows[t, "1", "-1"]["message_type"], rows[t, "1", "-1"]["content"][:6]) == ("error", "Erro: ")
    assert all(list(r.asDict()) == interactions.FLAT for r in rows.values())


def test_export_with_placeholders(spark, store, tmp_path):
    schema = "run_id string, instance_key string, simulation_id long, pass_index long, queue_index long, persona_id string, thread_id string, status string"
    rows = [("r", "k1", 1, 1, 1, "p1", "a", "completed"), ("r", "k0", 9, 1, 0, "p1", "a", "running"), ("r", "k2", 2, 1, 2, "", None, "not_finished"), ("r", "k3", 3, 1, 3, "p3", "c", "not_finished"), ("r", "k4", 4, 1, 4, "p3", "nowhere", "not_finished"), ("r", "k5", 5, 1, 5, "p3", None, "pending")]
    inst = spark.createDataFrame(rows, schema)
    conv = interactions.conversations(store)
    index = {r["thread_id"]: r for r in interactions.export_index(conv, inst, store).collect()}
    assert set(index) == {"a", "b", "d", "sem_checkpoint_r_k2", "nowhere"}
    assert (index["a"]["simulation_id"], index["a"]["execution_status"], index["a"]["finished"], index["a"]["not_finished"]) == (1, "completed", True, False)
    assert (index["b"]["execution_status"], index["b"]["finished"]) == ("unknown", None)
    p = index["sem_checkpoint_r_k2"]
    assert (p["persona_id"], p["total_messages"], p["filename"], p["not_finished"]) == ("unknown", 0, "conversa_unknown_sem_checkpoint_r_k2.json", True)
    sources = spark.createDataFrame([("a", 1, ["x"])], "thread_id string, ordinal long, datasources array<string>")
    made = interactions.exported(conv, inst, store, sources, "now")
    assert sinks.write_zip(made, str(tmp_path / "x.zip"), interactions.export_index(conv, inst, store)) == 5
    with pytest.raises(FileExistsError):
        sinks.write_zip(made, str(tmp_path / "x.zip"))
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert len(z.namelist()) == 6
        body = json.loads(z.read("conversa_p1_a.json"))
        assert body["total_messages"] == 3 and body["messages"][0]["rag_datasources"] == [] and "message_id" not in body["messages"][1] and body["metadata"]["export_version"] == "2.1"
        assert json.loads(z.read("conversa_unknown_sem_checkpoint_r_k2.json"))["messages"] == []
        assert json.loads(z.read("index.json"))["total_conversations"] == 5
    names = [r["member"] for r in files.read_zipped_json(spark, str(tmp_path / "x.zip")).collect()]
    assert "index.json" not in names and len(names) == 5


def test_log_names(spark):
    df = spark.createDataFrame([("d/rag_logs_persona_7_abc_20260102_030405.zip",), ("rag_logs_x_1.zip",), ("other_a_b_c_20260102_030405.zip",), ("rag_logs_p_t_2026_99.zip",)], "path string")
    out = [(r["persona_id"], r["log_thread"], r["at"]) for r in interactions.log_names(df).collect()]
    assert out[0] == ("persona_7", "abc", datetime.datetime(2026, 1, 2, 3, 4, 5)) and out[1] == out[2] == (None, None, None) and out[3][2] is None


def test_mapping_counts_and_iso(spark, store):
    m = lambda *x: spark.createDataFrame([(a, "y") for a in x], "thread_id string, mapped string")
    logs = spark.createDataFrame([("q",), ("q",)], "log_thread string")
    assert tuple(interactions.mapping_counts(m("a"), m("a", "b"), store, logs).first()) == (2, 2, 6, 1)
    df = spark.createDataFrame([("2026-01-02T03:04:05Z",), ("2026-01-02T03:04:05+01:00",), ("2026-01-02 03:04:05",), ("nope",), (None,)], "t string")
    got = [None if r[0] is None else r[0] for r in df.select(F.date_format(interactions.iso_timestamp(F.col("t")), "HH:mm:ss")).collect()]
    assert got == ["03:04:05", "02:04:05", "03:04:05", None, None]


# ---- runs and sessions ----------------------------------------------------------------------------------------------


def test_runs(spark):
    items = runs.queue(spark.createDataFrame([(30, "c"), (10, "a"), (20, "b")], "simulation_id long, persona_id string"), 2, "simulation_id")
    assert sorted((r["queue_index"], r["instance_key"]) for r in items.collect())[3] == (4, "pass-0002:simulation-000001")
    args = runs.args_snapshot({"passes": 2, "api_key": "secret"})
    run, inst = runs.create("r1", "h", "f", 2, items, args, F.lit("now"))
    r = run.first()
    assert (r["total_instances"], r["status"], json.loads(r["args_json"])) == (6, "running", {"passes": 2})
    assert inst.count() == 6 and {x["status"] for x in inst.collect()} == {"pending"}
    inst = inst.withColumn("status", F.when(F.col("queue_index") == 1, "running").when(F.col("queue_index") == 2, "completed").otherwise(F.col("status")))
    assert [x["queue_index"] for x in runs.pending(inst, "r1").collect()] == [3, 4, 5, 6]
    ended, after = runs.interrupt(inst, run, "r1", "gone")
    assert {x["queue_index"]: (x["status"], x["error"]) for x in ended.collect()}[1] == ("not_finished", "gone") and after.first()["status"] == "interrupted"
    with pytest.raises(runs.CompatibleRunExists):
        runs.refuse_second(run, "h", 2)
    runs.refuse_second(run, "other", 2)
    assert runs.to_execute(runs.pending(inst, "r1"), items).count() == 4
    with pytest.raises(KeyError):
        runs.to_execute(runs.pending(inst, "r1"), items.where("pass_index = 1"))


@pytest.mark.parametrize("cls, status, body, said, want", [("ConnectionError", None, None, None, True), ("AuthenticationError", None, None, None, True), ("HTTPError", 503, None, None, True), ("HTTPError", 404, None, None, False), ("ValueError", 503, None, None, False), ("ValueError", None, "Rate Limit reached", None, True), ("ValueError", None, None, "Incorrect API key, 401", True), ("ValueError", None, None, "invalid_api_key", False), (None, None, None, None, False)])
def test_abort(spark, cls, status, body, said, want):
    df = spark.createDataFrame([("k", cls, status, body, said), ("k", "ValueError", None, None, None)], "key string, error_class string, status int, response string, text string")
    assert runs.aborted(df).first()["abort"] is want


def test_thread_of_the_first_start(spark):
    h = spark.createDataFrame([("r", "a", 1, "running", None, "t1"), ("r", "a", 2, "running", None, "t2"), ("r", "b", 1, "not_finished", "x", None), ("r", "b", 2, "running", None, "t3")], "run_id string, instance string, seq int, state string, error string, thread_id string")
    assert {r["instance"]: r["thread_id"] for r in runs.fold(h).collect()} == {"a": "t1", "b": None}


def test_capped_sessions_against_brute_force(spark):
    rng = random.Random(5)
    t0 = datetime.datetime(2026, 1, 1)
    rows, at = [], 0
    for _ in range(600):
        at += rng.choice([1, 30, 60, 400, 2400])
        rows.append((f"s{rng.randrange(12)}", t0 + datetime.timedelta(seconds=at)))
    df = spark.createDataFrame(rows, "session_id string, ts timestamp")
    shard = {r["s"]: r["h"] for r in df.select("session_id").distinct().select(F.col("session_id").alias("s"), F.pmod(F.xxhash64("session_id"), F.lit(2)).alias("h")).collect()}
    want, open_ = [], {0: OrderedDict(), 1: OrderedDict()}
    for sid, t in rows:
        own = open_[shard[sid]]
        for k in [k for k, v in own.items() if t - v[1] > datetime.timedelta(minutes=30)]:
            want.append((k, own[k][0], own.pop(k)[2], "expired"))
        if sid not in own and len(own) >= 3:
            k = min(own, key=lambda k: own[k][1])
            want.append((k, own[k][0], own.pop(k)[2], "evicted"))
        first, _, n = own.pop(sid, (t, t, 0))
        own[sid] = (first, t, n + 1)
    want += [(k, v[0], v[2], "open") for own in open_.values() for k, v in own.items()]
    got = [(r["session_id"], r["opened"], r["accesses"], r["reason"]) for r in sessions.capped(df, 6, 2).collect()]
    assert sorted(got) == sorted(want) and {"evicted", "expired"} <= {w[3] for w in want}


def test_idle_and_oldest(spark):
    df = spark.createDataFrame([("a", None, datetime.datetime(2026, 1, 1, 0, 0)), ("b", "p", datetime.datetime(2026, 1, 1, 0, 10))], "session_id string, persona_id string, last_access timestamp")
    out = {r["session_id"]: r for r in sessions.idle(df, F.lit("2026-01-01 00:40:00").cast("timestamp")).collect()}
    assert (out["a"]["expired"], out["a"]["expires_in_seconds"], out["a"]["persona_id"]) == (True, 0, "unknown") and (out["b"]["expired"], out["b"]["expires_in_seconds"]) == (False, 0)
    assert sessions.oldest(df).first()["session_id"] == "a"


# ---- event log of dialogues -----------------------------------------------------------------------------------------


def test_dialogue_events(spark, tmp_path):
    dialogues = [
        {"thread_id": "x", "messages": [{"index": 1, "type": "human", "content": "oi", "simulated_timestamp": "2026-01-01T00:00:10"}, {"index": 0, "type": "ai", "content": "olá", "timing_metadata": {"banco_generation_timestamp": "2026-01-01T00:00:05"}, "rag_datasources": ["a", "b"]}]},
        {"thread_id": "y", "messages": [{"index": 0, "type": "human", "content": "oi", "simulated_timestamp": ""}]},
        {"thread_id": "z", "messages": []}, {"other": 1},
    ]
    (tmp_path / "d.json").write_text(json.dumps(dialogues))
    d = files.read_dialogues(spark, str(tmp_path / "d.json")).select("dialogue.*").withColumn("ord", F.monotonically_increasing_id())
    assert d.count() == 3
    m = d.select("ord", F.col("thread_id").alias("case_id"), F.explode("messages").alias("m")).select("ord", "case_id", "m.index", "m.type", "m.content", "m.simulated_timestamp", F.col("m.timing_metadata.banco_generation_timestamp").alias("banco_timestamp"), F.col("m.rag_datasources").alias("sources"))
    model = Scripted(touchpoint=lambda s, u: '"saudacao"' if ": oi" in u else "nada disso")
    log = eventlog.final_log(eventlog.classified(eventlog.dialogue_events(m), ["CONSULTA"], ["Saudacao"], model))
    got = [tuple(r) for r in log.orderBy("EVENT_ID").collect()]
    assert got == [
        ("x", 0, "START-DIALOGUE-SYTEM", "2026-01-01T00:00:04", "2026-01-01T00:00:04", "", "syst"),
        ("x", 1, "", "2026-01-01T00:00:04", "2026-01-01T00:00:05", "a, b", "ai"),
        ("x", 2, "SAUDACAO", "2026-01-01T00:00:05", "2026-01-01T00:00:10", "", "human"),
        ("x", 3, "END-DIALOGUE-SYSTEM", "2026-01-01T00:00:10", "2026-01-01T00:00:10", "", "syst"),
        ("y", 4, "SAUDACAO", None, None, "", "human"),
    ]
    sinks.write_event_log(log, str(tmp_path / "log.csv"))
    raw = (tmp_path / "log.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfCASE_ID;EVENT_ID;") and len(raw.decode("utf-8-sig").splitlines()) == 6
    sinks.write_event_log(log.limit(0), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_text("utf-8-sig").strip() == ";".join(sinks.EVENT_LOG)


def test_touchpoint_catalogs(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"subtipo": "Saldo"}, {"subtipo": "saldo"}, {"descricao": "x"}]))
    (tmp_path / "b.json").write_text(json.dumps({"um": [{"subtipo": "A"}], "dois": [{"subtipo": "B"}]}))
    read = lambda n: sorted(r[0] for r in files.read_touchpoints(spark, str(tmp_path / n)).collect())
    assert read("a.json") == ["SALDO"] and read("b.json") == ["A", "B"]


# ---- sources and sinks ----------------------------------------------------------------------------------------------


def test_csv_records(spark, tmp_path):
    (tmp_path / "p.csv").write_text('"name","age","city"\n"Alice, B",30,New York\nBob,25,LA\n')
    assert files.record(spark, str(tmp_path / "p.csv"), 0) == {"name": "Alice, B", "age": "30", "city": "New York"}
    for i in (2, -1):
        with pytest.raises(IndexError):
            files.record(spark, str(tmp_path / "p.csv"), i)
    for row in ("Alice,30", "Alice,30,x,y"):
        (tmp_path / "bad.csv").write_text(f'"name","age","city"\n{row}\n')
        with pytest.raises(ValueError):
            files.read_csv(spark, str(tmp_path / "bad.csv"))


def test_scenarios_and_personas(spark, tmp_path):
    (tmp_path / "s.csv").write_text("cenario_id;dados_cenario\ncenario_id1;a\n2\n3;b;c\n")
    good, bad = files.read_scenarios(spark, str(tmp_path / "s.csv"))
    assert [tuple(r) for r in good.collect()] == [("cenario_id1", "a")] and bad.count() == 2
    folder = tmp_path / "people"
    folder.mkdir()
    (folder / "persona7.json").write_text('{"nome": "Ana"}')
    (folder / "person8.json").write_text("{}")
    (folder / "persona9.json").write_text("nada")
    people = files.read_personas(spark, str(folder))
    assert sorted(r["persona_id"] for r in people.collect()) == [7, 9]
    fields = {r["persona_id"]: r["fields"] for r in files.persona_fields(people).collect()}
    assert fields[7] == {"nome": "Ana"} and not fields[9]
    assert sinks.write_personas(people, str(tmp_path / "p.zip")) == 2
    with zipfile.ZipFile(tmp_path / "p.zip") as z:
        assert z.read("persona7.json") == b'{"nome": "Ana"}'


def test_rag_log_archives(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    meta = {"messages": [{"index": 1, "logs": [{"message": "Routing decision", "data": {"selected_datasource": "b"}}, {"message": "Routing decision", "data": {"selected_datasource": "a"}}]}, {"index": 2, "logs": [{"message": "Starting FallbackFunction"}]}, {"index": 3, "logs": []}]}
    with zipfile.ZipFile(logs / "rag_logs_persona_1_t1_20260102_030405.zip", "w") as z:
        z.writestr("session_metadata_x.json", json.dumps(meta))
    with zipfile.ZipFile(logs / "rag_logs_persona_1_t2_20260102_040405.zip", "w") as z:
        z.writestr("other.json", "{}")
    listed = files.list_rag_logs(spark, str(logs))
    assert sorted(r["log_thread"] for r in listed.collect()) == ["t1", "t2"]
    got = {r["ordinal"]: r["datasources"] for r in interactions.datasources(files.read_rag_sessions(spark, str(logs))).collect()}
    assert got == {1: ["a", "b"], 2: ["none"]}


def test_folder_of_documents(spark, tmp_path):
    sub = tmp_path / "docs" / "a"
    sub.mkdir(parents=True)
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(sub / "x.DOCX", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:p><w:t>um</w:t><w:t> dois</w:t></w:p><w:p><w:t>três</w:t></w:p></w:document>')
    (tmp_path / "docs" / "y.pdf").write_bytes(b"%PDF\nstream\nBT (Ol\\(a) Tj [(mun) 3 (do)] TJ ET\nendstream\n")
    (tmp_path / "docs" / "z.docx").write_bytes(b"no zip")
    (tmp_path / "docs" / "t.txt").write_text("left out")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_folder(spark, str(tmp_path / "docs")).collect()}
    assert set(got) == {"x.DOCX", "y.pdf", "z.docx"}
    assert (got["x.DOCX"]["text"], got["x.DOCX"]["subfolder"]) == ("um dois\ntrês", "a")
    assert got["y.pdf"]["text"] == "Ol(a\nmundo" and got["y.pdf"]["subfolder"] == "" and got["z.docx"]["error"]
    assert files.read_folder(spark, str(tmp_path / "none")).count() == 0


def test_sqlite_without_rowid(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "s.db")
    db.execute("create table t (k text primary key, v int) without rowid")
    db.executemany("insert into t values (?, ?)", [(f"k{i}", i) for i in range(9)])
    db.commit()
    spark.dataSource.register(files.SqliteSource)
    assert spark.read.format("sqlite_ro").option("path", str(tmp_path / "s.db")).option("dbtable", "t").load().count() == 9


def test_append_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    sinks.append(df, str(tmp_path / "t"), ["k"])
    sinks.append(df.unionByName(spark.createDataFrame([(3, "c")], "k long, v string")), str(tmp_path / "t"), ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]
    spark.sql("CREATE DATABASE IF NOT EXISTS weft_tables")
    names = sinks.ensure_tables(spark, "weft_tables.")
    assert sinks.ensure_tables(spark, "weft_tables.") == names and spark.table(names[1]).columns[-1] == "run_id"
    spark.sql("DROP DATABASE weft_tables CASCADE")


def test_session_archive(spark, tmp_path):
    messages = spark.createDataFrame([("t", "p", "s", "e", 1, "oi", "m")], "thread_id string, persona_id string, start_time string, end_time string, index int, query string, message_start string")
    logs = spark.createDataFrame([("t", 1, 2, '{"b":1}', "INFO"), ("t", 1, 1, '{"a":1}', "INFO")], "thread_id string, index int, step int, line string, level string")
    assert sinks.session_zip(messages, logs, ragflow.session_summary(messages, logs), str(tmp_path / "s.zip")) == 3
    with zipfile.ZipFile(tmp_path / "s.zip") as z:
        assert z.read("001_p_t.log") == b'{"a":1}\n{"b":1}\n' and "session_metadata_p_t.json" in z.namelist()


def test_scalars(spark):
    df = spark.createDataFrame([(0, "", "persona12.json"), (5, "x", "none"), (None, None, None)], "n int, s string, f string")
    assert [r[0] for r in df.select(text.or_default(F.col("n"), 9)).collect()] == [9, 5, 9]
    assert [r[0] for r in df.select(text.or_default(F.col("s"), "d")).collect()] == ["d", "x", "d"]
    assert [r[0] for r in df.select(text.id_of_name(F.col("f"))).collect()] == [12, None, None]
    u = [r[0] for r in spark.range(2000).select(text.uniform(2.0, 4.0, F.col("id"), seed=3)).collect()]
    assert 2 <= min(u) < 2.1 and 3.9 < max(u) < 4 and abs(sum(u) / len(u) - 3) < 0.05
    assert abs(spark.range(4000).where(text.bernoulli(0.25, F.col("id"))).count() - 1000) < 120
    assert [tuple(r) for r in text.backoff(spark).collect()] == [(1, 64, 1.0), (2, 32, 0.75), (3, 16, 0.5625), (4, 8, 0.421875)]
    t = [r[0] for r in spark.range(50).select(text.typing_seconds(F.lit("a b c d"), F.lit(60.0), F.col("id"))).collect()]
    assert all(3.2 <= x < 4.8 for x in t) and len(set(t)) > 40


def same_as_sql(spark, name, folder, **tables):
    """Whether a query's rows on tables(rows, schema) are those of its SQL."""
    import duckdb

    import __spark_entry__

    with duckdb.connect() as c:
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
        df = __spark_entry__.queries()[name](spark, str(folder))
        found = c.execute(__spark_entry__.oracle_sql()[name])
        names = [d[0] for d in found.description]
        want = sorted(repr(dict(sorted(zip(names, r)))) for r in found.fetchall())
    return sorted(repr(dict(sorted(r.asDict().items()))) for r in df.collect()) == want


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_conversation_csvs_of_long_and_empty_texts(spark, tmp_path):
    odd = ["x" * 300_000, 'a "quoted", text\n' * 20_000, '"' * 50_000, "\n" * 50_000, "\r\n, ", None, ""]
    rows = [(c, t, ("user", "assistant")[t % 2], text) for c, texts in enumerate([odd, [None, ""], odd[:1]]) for t, text in enumerate(texts)]
    assert same_as_sql(spark, "conversation_csvs", tmp_path, conversations=(rows, CONVERSATIONS))


def test_nearest_logs_against_all_pairs(spark):
    rng = random.Random(3)
    times = [(i, rng.randrange(-400, 2000)) for i in range(600)] + [(600, 10**6)]
    logs = [(rng.randrange(0, 1600, 7), f"l{i}") for i in rng.sample(range(1000), 120)]
    got = {r["id"]: tuple(r["best"]) if r["best"] else None for r in interactions.nearest_logs(spark.createDataFrame(times, "id long, t long"), spark.createDataFrame(logs, "lt long, log_id string"), 50).collect()}
    assert got == {i: min(((abs(t - lt), x) for lt, x in logs if abs(t - lt) < 50), default=None) for i, t in times}


def test_log_cascade_of_dense_times(spark, tmp_path):
    """Times at which everything is near everything; repeated conversations are one mapping each."""
    rng = random.Random(4)
    at = lambda: datetime.datetime(2026, 1, 1, 0, 0, rng.randrange(60))
    rows = [(i, rng.choice([2, 5, 8, 3 * i]), rng.choice(["purchase", "error"]), at()) for i in range(6000)]
    rows += rows[:50]
    assert same_as_sql(spark, "log_cascade_full", tmp_path, events=(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz"))
    empty = [spark.createDataFrame([], s) for s in ("thread_id string, persona_id string, ts timestamp_ntz", "log_id string, log_thread string, persona_id string, at timestamp_ntz")]
    assert not re.search(r"Join[^\n]*\bbin\b", interactions.log_of(*empty)._jdf.queryExecution().executedPlan().toString())


def test_zips_of_bounded_size(spark, tmp_path):
    bodies = {f"c{i}.json": json.dumps({"thread_id": f"t{i}", "messages": ["ação 日本\r\n" * (i * 7 % 40)] * i}, ensure_ascii=False) for i in range(60)}
    made = spark.createDataFrame([(n[1:-5], n, b) for n, b in bodies.items()], "thread_id string, filename string, body string").repartition(3)
    sinks.write_zips(made, str(tmp_path / "z"), limit=5000)
    archives = list((tmp_path / "z").glob("part-*"))
    assert len(archives) > 10
    found = {}
    for f in archives:
        with zipfile.ZipFile(f) as z:
            assert z.testzip() is None
            index = json.loads(z.read("index.json"))
            own = {n: z.read(n).decode() for n in z.namelist() if n != "index.json"}
            assert {c["filename"] for c in index["conversations"]} == set(own) and index["total_conversations"] == len(own)
            assert sum(len(b.encode()) for b in list(own.values())[:-1]) < 5000
            found |= own
    assert found == bodies
    read = files.read_zipped_json(spark, str(tmp_path / "z")).collect()
    assert {r["member"]: json.loads(r["body"]) for r in read} == {n: json.loads(b) for n, b in bodies.items()}
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_zips(made, str(tmp_path / "z"))
    sinks.write_zips(made.limit(0), str(tmp_path / "e"))
    assert files.read_zipped_json(spark, str(tmp_path / "e")).count() == 0


def test_zip_source_of_many_and_no_conversations(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], "x, " * (c * 997 % 3000)) for c in range(300) for t in range(3)]
    assert same_as_sql(spark, "zip_source", tmp_path / "a", conversations=(rows, CONVERSATIONS))
    assert same_as_sql(spark, "zip_source", tmp_path / "b", conversations=(rows[:0], CONVERSATIONS))
