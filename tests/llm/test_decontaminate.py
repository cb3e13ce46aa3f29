import random
from collections import Counter

from weft.llm.decontaminate import Index, contaminated, words_of


def shingles(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items, similarity=0.8):
    out = {}
    for d, t in docs:
        for i, x in items:
            iw, dw = words_of(x), words_of(t)
            if not iw or len(dw) < len(iw):
                continue
            k = min(5, len(iw))
            own = shingles(iw, k)
            for s in range(len(dw) - len(iw) + 1):
                w = shingles(dw[s : s + len(iw)], k)
                j = sum((own & w).values()) / sum((own | w).values())
                if j >= similarity:
                    out[d, i] = max(out.get((d, i), 0), j)
    return out


def cases(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 20, 20, 45])))) for i in range(25)] + [(90, None), (91, " .. ")]
    docs = []
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.choice([0, 3, 30, 120]))
        if d % 2:
            passage = words_of(rng.choice(items)[1])
            for _ in range(rng.randrange(3)):
                if passage:
                    passage[rng.choice([0, -1, rng.randrange(len(passage))])] = rng.choice(vocabulary)
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        docs.append((d, " ".join(w.upper() + "," if rng.random() < 0.2 else w for w in words)))
    return [*docs, (500, None)], items


def test_matches_brute_force(spark):
    docs, items = cases(3)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {k: round(v, 9) for k, v in brute(docs, items).items()}
    assert len(want) > 40
    for block in (20_000, 7):
        got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in contaminated(df, bench, block=block).collect()}
        assert got == want


def test_all_within_the_radius_are_met():
    rng = random.Random(1)
    index = Index([(i, " ".join(rng.choices("abcdefgh", k=12))) for i in range(50)])
    for _ in range(300):
        i = rng.randrange(50)
        fp = int(index.fps[i])
        for b in rng.sample(range(64), rng.randrange(24)):
            fp ^= 1 << b
        assert i in index.meets(fp, 12)


def test_repeats_and_empty_tables(spark):
    docs, items = [(1, "a b c d e f g")] * 3, [(7, "a b c d e f g")] * 2
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["similarity"]) for r in contaminated(df, bench).collect()] == [(1, 7, 1.0)]
    assert contaminated(df.limit(0), bench).collect() == [] and contaminated(df, bench.limit(0)).collect() == []


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"v{rng.randrange(200)}" for _ in range(n))) for i, n in enumerate([5, 6, 12, 39, 39, 60])]
    docs, want = [], {}
    for i, x in items:
        words = words_of(x)
        for cut in (0, 1, 2, 5, 9):
            docs += [(len(docs), " ".join(words[cut:])), (len(docs) + 1, " ".join(words[: len(words) - cut]))]
    for d, t in docs:
        for i, x in items:
            own, w = shingles(words_of(x), 5), shingles(words_of(t), 5)
            j = sum((own & w).values()) / max(1, sum((own | w).values()))
            if len(words_of(t)) <= len(words_of(x)) and j >= 0.8:
                want[d, i] = round(j, 9)
    assert sum(j < 1 for j in want.values()) > 10
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in contaminated(df, bench).collect()} == want


def test_null_ids_and_a_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"x{i % 977}" for i in range(200_000)) + " " + item + " " + "y " * 200_000
    df = spark.createDataFrame([(None, item, 1.5), (2, long, 0.0)], "doc_id long, text string, similarity double")
    got = {(r["doc_id"], r["item_id"], r["start_word"]) for r in contaminated(df, spark.createDataFrame([(None, item)], "item_id long, text string")).collect()}
    assert got == {(None, None, 0), (2, None, 200_000)}
