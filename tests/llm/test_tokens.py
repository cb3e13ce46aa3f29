import random
import string

import pytest
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from weft.llm.tokens import MODEL, SPACE, Counter, count_tokens, vocabulary


def reference(pieces, byte_pieces):
    own = [("<unk>", 0.0), *pieces] if not byte_pieces else [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *pieces]
    # the library takes its lowest score over the whole vocabulary, so the extra pieces must not be the lowest
    t = Tokenizer(models.Unigram(own, 0, byte_pieces))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(SPACE), normalizers.Replace(" ", SPACE)])
    t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), "isolated")
    return t


def texts(seed):
    rng = random.Random(seed)
    out = ["a", " ", "  two  spaces ", "ünï çödé 😀😀 漢字", "x" * 300, "\n\n\t", "<s> </s> ▁"]
    return out + ["".join(rng.choices(string.ascii_letters + "   éß.,1239\n", k=rng.randrange(1, 120))) for _ in range(200)]


def test_counts_match_the_tokenizer_on_a_public_vocabulary():
    pieces, byte_pieces = vocabulary(MODEL)
    assert byte_pieces
    count, t = Counter(pieces, byte_pieces), reference(pieces, byte_pieces)
    for text in texts(1):
        assert count(text) == len(t.encode(text, add_special_tokens=False).ids), text


@pytest.mark.parametrize("seed", range(6))
def test_ties_and_unknown_runs_on_small_vocabularies(seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choices("abc", k=rng.randrange(1, 5))): float(rng.choice([-1, -2, -2, -3])) for _ in range(12)}
    pieces[SPACE] = -2.0
    pieces = list(pieces.items())
    count, t = Counter(pieces, False), reference(pieces, False)
    for _ in range(300):
        text = "".join(rng.choices("abcd ", k=rng.randrange(1, 30)))
        assert count(text) == len(t.encode(text, add_special_tokens=False).ids), (pieces, text)


def test_pieces_across_spaces_count_whole_texts():
    count = Counter([("a", -1.0), (SPACE, -1.0), (f"a{SPACE}a", -0.5)], False)
    assert not count.split and count("a a") == 2


def test_nulls_empty_repeats(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b", 5), (3, "a b", 5)], "doc_id long, text string, n_tokens int")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in count_tokens(df).collect()) == [(1, 0), (2, 0), (3, 2), (3, 2)]
    assert count_tokens(df.limit(0)).collect() == []
