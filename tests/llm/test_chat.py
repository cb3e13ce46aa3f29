import hashlib

from hypothesis import given
from hypothesis import strategies as st

from weft.llm.chat import CLOSE, PART, Reader, Visitor, assemble, escape, escape_role, format_conversations, read_back, unescape


@given(st.text(alphabet="<\\/s>[INT]a\n", max_size=40))
def test_escaping_is_reversible_and_hides_controls(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in ("<s>", "</s>", "<turn", "</turn>", "<image"))


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_round_trip_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "assistant", "b</s>\\<x"), (1, 0, "user", "[INST]\n</turn><turn user>"), (1, 1, "assistant", "b</s>\\<x"), (2, 0, None, None), (3, 5, "assistant", "é😀"), (3, 5, "assistant", None), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    out = {r["conv_id"]: r.asDict() for r in read_back(format_conversations(df)).collect()}
    by = {c: sorted((t, r or "", x or "") for cc, t, r, x in rows if cc == c) for c in {r[0] for r in rows}}
    assert set(out) == set(by)
    for c, turns in by.items():
        assert out[c]["n_turns"] == len(turns) and out[c]["turns_sha256"] == digest([x[1:] for x in turns])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert out[c]["loss_chars"] == len(loss) and out[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    whole = {r["conv_id"]: r["formatted"] for r in assemble(format_conversations(df)).collect()}
    assert {c: len(t) for c, t in whole.items()} == {c: r["formatted_chars"] for c, r in out.items()}
    assert all(t.endswith(CLOSE) and t.count(CLOSE) == 1 for t in whole.values())


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "look <here>"}, {"type": "image", "ref": "a.png", "width": 900, "height": 400}, {"type": "audio", "ref": "b.wav", "seconds": 2.5}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "video"}, None]
    full = [None if p is None else {k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in parts]
    df = spark.createDataFrame([(1, 0, "user", full), (1, 1, "assistant", [full[1]])], f"conv_id long, turn long, role string, parts array<{PART}>")
    rows = format_conversations(df).orderBy("seq").collect()
    assert [(a["n"], a["type"], a["ref"], a["tokens"]) for r in rows for a in r["attachments"]] == [(1, "image", "a.png", 3 * 256), (2, "audio", "b.wav", 63), (3, "document", "c.pdf", 1500), (4, "image", "a.png", 768)]
    assert rows[0]["segment"] == "<s><turn user>\nlook <\\here><image 1><audio 2><document 3>\n</turn>"
    assert rows[0]["tokens"] == 2 + 768 + 63 + 1500
    (m,) = rows[1]["mask"]
    assert rows[1]["segment"][m["start"] : m["end"]] == "<image 4>"


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_conversations(df)).collect() == []


def test_reader_and_visitor_alone():
    reader = Reader(1)
    content, _, _ = Visitor().turn([{"type": "text", "text": "x" * 200_000 + "<"}])
    reader.read(f"<s><turn u>\n{content}\n</turn>", [])
    assert reader.row()["turns_sha256"] == digest([("u", "x" * 200_000 + "<")])


@given(st.text(alphabet="<\\/s>a\n ", max_size=30), st.text(alphabet="<\\/>\n[INST]", max_size=30))
def test_any_role_is_reversible(role, text):
    segment = f"<s><turn {escape_role(role)}>\n{escape(text)}\n</turn>"
    reader = Reader(1)
    reader.read(segment, [])
    assert reader.row()["turns_sha256"] == digest([(role, text)]) and reader.row()["n_turns"] == 1


def test_roles_through_spark(spark):
    rows = [(1, 0, "a>\nb", "x"), (1, 1, "</turn>\\>", ">\n"), (1, 2, ">", "")]
    out = read_back(format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert out["turns_sha256"] == digest([(r, t) for _, _, r, t in rows])


def test_long_conversation(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i}<" * 50) for i in range(12_000)]
    out = read_back(format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [(r["n_turns"], r["turns_sha256"]) for r in out] == [(12_000, digest([(r, t) for _, _, r, t in rows]))]
