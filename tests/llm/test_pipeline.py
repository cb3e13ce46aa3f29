import collections
import math
import random
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import brute as repeated
from tests.llm.test_shingle_groups import brute as brute_groups
from weft.llm import language, line_dedup
from weft.llm.queries import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    line_dedup.RARITY_BITS, line_dedup.FILTER_BITS = 12, 16  # sizes of sketches, not results
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [[r.asDict() for r in df.collect()] for df in out]


def test_columns(steps):
    for rows in steps[:-1]:
        assert set(rows[0]) == set(corpus_pipeline.COLUMNS)
    assert {"doc_id", "copies", "taken", "text"} <= set(steps[-1][0])


def test_language_stage_keeps_clean_documents(steps):
    before, after = {r["doc_id"]: r for r in steps[0]}, {r["doc_id"]: r for r in steps[1]}
    assert len(after) >= 0.97 * len(before)
    assert all(before[d]["text"] == r["text"] for d, r in after.items())


def test_line_stage_against_brute_force(steps):
    gone = repeated([(r["doc_id"], r["text"]) for r in steps[1]])
    want = {}
    for r in steps[1]:
        kept = [x for i, x in enumerate(r["text"].split("\n")) if i not in gone.get(r["doc_id"], [])]
        if r["doc_id"] not in gone or re.search(r"[^\s]", "\n".join(kept)):
            want[r["doc_id"]] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in steps[2]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2])


def test_near_dedup_stage_against_brute_force(steps):
    rows = steps[2]
    groups = {}
    for r, c in zip(rows, brute_groups([r["text"] for r in rows])):
        groups.setdefault(c, []).append((-len(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in steps[3]) == sorted(min(g)[1] for g in groups.values())


def test_decontamination_stage_against_brute_force(spark, steps):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {d for d, _ in leaks([(r["doc_id"], r["text"]) for r in steps[3]], items)}
    assert {r["doc_id"] for r in steps[4]} == {r["doc_id"] for r in steps[3]} - bad


def test_mixing_stage_against_sql(steps):
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in steps[4]])
    want = [r for r in c.execute(SQL["op4_mixing"]).fetchall() if r[4] > 0]
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in steps[5]) == sorted(want)


def grams_of(word):
    """The three hashed n-grams that end the contexts of every letter, in plain integers."""
    cps, out, m = [0, *map(ord, word), 0], [], (1 << 32) - 1
    for before, one, after in zip(cps, cps[1:], cps[2:]):
        mix = one * 0x9E3779B1 & m
        two = ((mix ^ before * 0x85EBCA6B & m) * 0xC2B2AE35) & m
        three = ((two ^ after * 0x27D4EB2F & m) * 0x165667B1) & m
        out.append([(mix >> 16) & 0xFFFF, ((two >> 16) ^ 1) & 0xFFFF, ((three >> 16) ^ 2) & 0xFFFF])
    return out


def test_language_stage_against_brute_force(steps):
    words_of = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    script = lambda w: language.SCRIPT_NAMES[max(i for i, s in enumerate(language.SCRIPT_STARTS) if s <= ord(w[0]))]
    counts, scripts = {}, {}
    for r in steps[0]:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            for w in words_of(r["text"]):
                scripts.setdefault(r["lang"], collections.Counter())[script(w)] += 1
                for gs in grams_of(w):
                    counts.setdefault(r["lang"], collections.Counter()).update(gs)
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) + 0.1 * 65536 for x in langs}
    logs = {x: {g: math.log((n + 0.1) / total[x]) for g, n in counts[x].items()} for x in langs}
    least = {x: math.log(0.1 / total[x]) for x in langs}
    allowed = {s: [x for x in langs if scripts[x][s] >= 0.01 * sum(scripts[x].values())] or langs for s in language.SCRIPTS}
    known = {}

    def score(w):
        if w not in known:
            gs = [g for three in grams_of(w) for g in three]
            known[w] = [sum(logs[x].get(g, least[x]) for g in gs) / 3 - 1e6 * (x not in allowed[script(w)]) for x in langs]
        return known[w]

    want, unsure = {}, set()
    for r in steps[0]:
        words = words_of(r["text"] or "")
        if not words:
            continue
        now, back = list(score(words[0])), []
        for w in words[1:]:
            top = max(range(len(langs)), key=lambda i: now[i])
            froms = [top if now[top] - language.PENALTY > now[i] else i for i in range(len(langs))]
            back.append(froms)
            now = [now[f] - language.PENALTY * (f != i) + x for i, (f, x) in enumerate(zip(froms, score(w)))]
        at = max(range(len(langs)), key=lambda i: now[i])
        labels = [at]
        for froms in reversed(back):
            labels.append(at := froms[at])
        share = collections.Counter()
        for w, x in zip(words, reversed(labels)):
            share[langs[x]] += len(w)
        lang = max(langs, key=lambda x: share[x])
        if abs(share[lang] / sum(share.values()) - 0.5) < 0.01:
            unsure.add(r["doc_id"])
        if share[lang] / sum(share.values()) >= corpus_pipeline.MIN_LANGUAGE_SHARE:
            want[r["doc_id"]] = lang
    got = {r["doc_id"]: r["lang"] for r in steps[1]}
    # Sums in single precision may settle another way where two labellings are all but equal.
    assert len({d for d in got.keys() | want.keys() if got.get(d) != want.get(d)} - unsure) <= 1 and len(want) > 150


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, rid long, size int, row int, lid string"


def test_odd_tables_pass_through_all_stages(spark, tmp_path):
    rng = random.Random(1)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    item = prose(40)
    same, twin = prose(60), prose(80)
    texts = [(None, same), (None, same), (1, same), (2, None), (3, ""), (4, " \t\n"), (None, None), (5, f"{prose(30)}\n{item}\n{prose(30)}"), (None, item), (6, twin), (6, twin), (7, prose(60_000)), (8, "x" * 100_000), (9, prose(5))]
    texts += [(20 + i, prose(50)) for i in range(20)]
    docs = spark.createDataFrame([(d, t, "en", None if i % 3 else "s", len(t or ""), "k", 1, 2, 3, "l") for i, (d, t) in enumerate(texts)], COLUMNS)
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/t/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/t/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/t").collect()
    kept = [r["text"] for r in out]
    assert kept.count(same) + kept.count(twin) <= 2 and not any(item in t for t in kept) and None not in kept and "" not in kept
    assert {r["doc_id"] for r in out} <= {d for d, _ in texts} and all(0 < r["copies"] <= 3 for r in out)
    docs.limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").collect() == []


def test_run_gives_the_same(spark, steps):
    out = {(r["doc_id"], r["copies"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert out == {(r["doc_id"], r["copies"]) for r in steps[5]}
