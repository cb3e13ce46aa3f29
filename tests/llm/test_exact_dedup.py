from weft.llm.exact_dedup import COUNTERS, dedup_exact, frequent_digests

SCHEMA = "doc_id long, text string, digest string, n long"


def run(spark, rows, **kw):
    return [r.asDict() for r in dedup_exact(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **kw).collect()]


def expected(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\v\f\r"), []).append((-len(t or ""), d is None, d))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


def check(spark, rows, **kw):
    out, want = run(spark, rows, **kw), expected(rows)
    assert len(out) == len(rows)
    text = {d: "".join(c for c in t or "" if c not in " \t\n\v\f\r") for d, t in rows}
    for r in out:
        assert (r["keep_id"], r["group_size"]) == want[text[r["doc_id"]]]
    assert sum(r["kept"] for r in out) == len(want)


def test_ties_nulls_and_white_space(spark):
    check(spark, [(5, "a b"), (3, "ab"), (9, "a  b"), (1, "a\tb\n"), (2, None), (7, ""), (8, " \n"), (4, "a b"), (None, "zz"), (11, "zz")])


def test_repeated_rows_keep_one(spark):
    out = run(spark, [(1, "a"), (1, "a"), (1, "a")])
    assert [r["group_size"] for r in out] == [3, 3, 3] and sum(r["kept"] for r in out) == 1


def test_empty_table(spark):
    assert run(spark, []) == []


def test_hot_and_ordinary_groups_agree(spark):
    rows = [(i, "hot text") for i in range(300)] + [(1000 + i, f"t{i % 90}") for i in range(200)]
    check(spark, rows, counters=4)
    check(spark, rows)


def test_summary_holds_every_frequent_digest(spark):
    df = spark.createDataFrame([(bytearray(b"%032d" % (i % 3 if i % 2 else i)),) for i in range(600)], "digest binary")
    found = {bytes(r[0]) for r in frequent_digests(df, 20).collect()}
    assert {b"%032d" % i for i in range(3)} <= found and len(found) <= 20 < COUNTERS
