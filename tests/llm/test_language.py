import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import language
from weft.llm.language import identify, identify_documents, learn, letter_table, viterbi

DATA = "/root/testdata/sf0.01/documents.parquet"


def brute_viterbi(scores, penalty):
    best = [(tuple([i]), s) for i, s in enumerate(scores[0])]
    for row in scores[1:]:
        best = [max(((p + (i,), s + row[i] - penalty * (p[-1] != i)) for p, s in best), key=lambda x: x[1]) for i in range(len(row))]
    return max(s for _, s in best)


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_is_optimal(seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(size=(rng.integers(1, 40), rng.integers(1, 5))) * rng.choice([0.5, 3])
    labels = viterbi(scores, 2.0)
    got = scores[np.arange(len(scores)), labels].sum() - 2.0 * (labels[1:] != labels[:-1]).sum()
    assert got == pytest.approx(brute_viterbi(scores.tolist(), 2.0))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    out = identify_documents(docs, learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def corpus(spark):
    rows = [(i, t, l, "x") for i, (t, l) in enumerate([("the cat and the dog went over there", "en"), ("der hund und die katze gingen dorthin", "de"), ("собака и кошка пошли туда", "ru")] * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_spans_of_mixed_text_and_scripts(spark):
    model, letters = learn(corpus(spark)), letter_table()
    text = "the cat and the dog went there. der hund und die katze gingen dorthin und собака пошли туда"
    lang, score, spans = identify(text, model, letters, 4.0)
    assert [s["lang"] for s in spans] == ["en", "de", "ru"] and 0 < score < 1
    assert text[spans[2]["start"] : spans[2]["end"]] == "собака пошли туда"
    assert identify("кошка", model, letters, 4.0)[0] == "ru"


def test_defined_results(spark, monkeypatch):
    docs = corpus(spark)
    model = learn(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 .. 3"), (None, "the dog"), (4, "the dog"), (4, "the dog")], "doc_id long, text string")
    out = identify_documents(odd, model).collect()
    assert [(r["doc_id"], r["lang_pred"], r["score"]) for r in out] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (None, "en", 1.0), (4, "en", 1.0), (4, "en", 1.0)]
    assert identify_documents(odd.limit(0), model).collect() == []
    nothing = learn(docs.limit(0))
    assert {r["lang_pred"] for r in identify_documents(odd, nothing).collect()} == {"und"}
    long = "the cat and the dog " * 300
    whole = identify(long, model, letter_table(), 4.0)
    monkeypatch.setattr(language, "SLICE", 64)
    assert identify(long, model, letter_table(), 4.0) == whole


@pytest.mark.parametrize("text", ["hello\n" * 300, "the\tcat\tand\tthe\tdog\t" * 60, "собака" * 200, "the cat " * 50 + "x" * 500 + " the dog" * 50, "猫犬" * 400 + "。the dog"])
def test_long_texts_without_spaces_are_whole(spark, monkeypatch, text):
    model, letters = learn(corpus(spark)), letter_table()
    whole = identify(text, model, letters, 4.0)
    monkeypatch.setattr(language, "SLICE", 64)
    assert "".join(part for _, part in language.slices(text)) == text
    cuts = [at for at, _ in language.slices(text)][1:]
    assert not any(c < len(text) and text[c - 1].isalpha() and text[c].isalpha() for c in cuts)
    got = identify(text, model, letters, 4.0)
    assert (got[0], got[2]) == (whole[0], whole[2]) and got[1] == pytest.approx(whole[1])
