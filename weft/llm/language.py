"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

A word is a run of letters. Its script (of its first letter) narrows the candidates to languages seen in that script;
its score for a language is the log-probability of its letters' 1- to 3-grams, hashed to BUCKETS, under that language. Viterbi
over the words, with a penalty for every switch, labels spans of mixed-language text. Where no run of other words can
outweigh the penalty, by a maximum-subarray bound, the best single language is the optimum and no lattice is built.

The classifier learns from at most `per_language` documents of each language, picked by a hash of their ids, a bound that is a
parameter; its size is languages x BUCKETS, whatever the input, and that is all that is collected and broadcast.

Defined results: a null text, or one without a letter, is "und" with score 0 and no spans; without anything to learn from,
all is "und"; ties go to the language first in code-point order; a null doc_id is never learned from. Repeated rows come
back each. An empty table gives an empty result. Other columns, but lang for learning, are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
PER_LANGUAGE = 2000
PENALTY = 12.0
#: Characters of a text that are turned into arrays at once; results don't depend on it.
SLICE = 1 << 19
#: First code points of script blocks, and the script from there on (0: other letters).
SCRIPT_STARTS = (0x0000, 0x0250, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0980, 0x0E00, 0x0E80, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3130, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00)
SCRIPT_NAMES = ("latin", "other", "greek", "cyrillic", "other", "hebrew", "arabic", "devanagari", "other", "thai", "other", "hangul", "other", "latin", "greek", "other", "kana", "other", "hangul", "han", "other", "hangul", "other", "han", "other")
SCRIPTS = tuple(sorted(set(SCRIPT_NAMES)))


def letter_table() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Words:
    """Words of a text: start, end, script, and the hashed n-grams of their letters."""

    def __init__(self, text: str, letters: np.ndarray) -> None:
        cp = np.frombuffer(lowered(text).encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[cp]
        padded = np.zeros(len(cp) + 2, np.uint32)
        padded[1:-1] = np.where(is_letter, cp, 0)
        at = np.flatnonzero(is_letter)
        edge = np.diff(np.concatenate(([0], is_letter.view(np.int8), [0])))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        one, before, after = padded[at + 1], padded[at], padded[at + 2]
        mix = one * np.uint32(0x9E3779B1)
        two = (mix ^ before * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
        three = (two ^ after * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
        self.grams = np.stack([mix >> 16, (two >> 16) ^ np.uint32(1), (three >> 16) ^ np.uint32(2)], axis=1) & np.uint32(BUCKETS - 1)
        lengths = self.ends - self.starts
        self.offsets = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
        block = np.searchsorted(SCRIPT_STARTS, cp[self.starts], side="right") - 1
        self.scripts = np.array([SCRIPTS.index(n) for n in SCRIPT_NAMES])[block]


class Model:
    """languages; table: BUCKETS x languages of log-probabilities; allowed: scripts x languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.languages = languages
        grams = counts + 0.1
        self.table = np.log(grams / grams.sum(axis=0)).astype(np.float32)
        self.allowed = scripts >= 0.01 * np.maximum(1, scripts.sum(axis=0))
        self.allowed[~self.allowed.any(axis=1)] = True

    def scores(self, words: Words) -> np.ndarray:
        """words x languages"""
        per_letter = self.table[words.grams[:, 0]] + self.table[words.grams[:, 1]] + self.table[words.grams[:, 2]]
        out = np.add.reduceat(per_letter, words.offsets, axis=0, dtype=np.float64) / 3
        out[~self.allowed[words.scripts]] -= 1e6
        return out


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word, each switch costing `penalty`."""
    best = int(scores.sum(axis=0).argmax())
    if scores.shape[1] == 1:
        return np.zeros(len(scores), np.int64)
    others = np.delete(scores, best, axis=1).max(axis=1)
    gain = np.concatenate(([0.0], np.cumsum(others - scores[:, best])))
    if (gain - np.minimum.accumulate(gain)).max() <= penalty:
        return np.full(len(scores), best, np.int64)
    back = np.zeros(scores.shape, np.int32)
    now = scores[0].copy()
    for t in range(1, len(scores)):
        top = int(now.argmax())
        move = now[top] - penalty > now
        back[t] = np.where(move, top, np.arange(len(now)))
        now = np.where(move, now[top] - penalty, now) + scores[t]
    out = np.empty(len(scores), np.int64)
    out[-1] = now.argmax()
    for t in range(len(scores) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def slices(text: str):
    """(offset, part): long texts in parts that end at no letter, so no word is cut; a word longer than a part is a part of its own."""
    at = 0
    while len(text) - at > SLICE:
        cut = at + SLICE
        while cut > at and text[cut - 1].isalpha() and text[cut].isalpha():
            cut -= 1
        if cut == at:
            cut = at + SLICE
            while cut < len(text) and text[cut].isalpha():
                cut += 1
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


def identify(text: str | None, model: Model, letters: np.ndarray, penalty: float) -> tuple[str, float, list[dict]]:
    """language, score: the share of the letters in its spans, spans."""
    scores, starts, ends = [], [], []
    for offset, part in slices(text or ""):
        words = Words(part, letters)
        if len(words.starts):
            scores.append(model.scores(words))
            starts.append(words.starts + offset)
            ends.append(words.ends + offset)
    if not scores or not model.languages:
        return "und", 0.0, []
    scores, starts, ends = np.concatenate(scores), np.concatenate(starts), np.concatenate(ends)
    labels = viterbi(scores, penalty)
    share = np.bincount(labels, weights=ends - starts, minlength=len(model.languages))
    first = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1])))
    last = np.concatenate((first[1:], [len(labels)])) - 1
    spans = [{"start": int(starts[a]), "end": int(ends[b]), "lang": model.languages[labels[a]]} for a, b in zip(first, last)]
    pick = int(share.argmax())
    return model.languages[pick], float(share[pick] / share.sum()), spans


def _remainder(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """From text and lang of docs(doc_id, text, lang) whose crc32(doc_id) mod 4 is not 2."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_remainder(4) != 2))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    number = {x: i for i, x in enumerate(languages)}
    share = F.lit(0.0)
    for x, n in sizes.items():
        share = F.when(F.col("lang") == x, F.lit(min(1.0, per_language / n))).otherwise(share)
    sample = known.where((F.xxhash64("doc_id", F.lit("learn")) / 2.0**64 + 0.5) < share).select("lang", "text")
    width = BUCKETS + len(SCRIPTS)

    def count(batches):
        letters, sums = letter_table(), np.zeros((len(number), width), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for _, part in slices(text):
                    words = Words(part, letters)
                    sums[number[lang], :BUCKETS] += np.bincount(words.grams.ravel(), minlength=BUCKETS)
                    sums[number[lang], BUCKETS:] += np.bincount(words.scripts, minlength=len(SCRIPTS))
        lang, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[lang, at])], ["l", "b", "n"])

    totals = np.zeros((width, len(languages)))
    if languages:
        found = sample.mapInArrow(count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
        totals[found["b"].to_numpy(), found["l"].to_numpy()] = found["n"].to_numpy()
    return Model(languages, totals[:BUCKETS], totals[BUCKETS:])


def identify_documents(docs: DataFrame, model: Model, penalty: float = PENALTY, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans array<struct<start,end,lang>> for every row of docs(doc_id, text, ...), with its columns `keep` besides."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.allowed))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        own = Model.__new__(Model)
        own.languages, own.table, own.allowed = shared.value
        letters = letter_table()
        for batch in batches:
            rows = [identify(t, own, letters, penalty) for t in batch.column(2).to_pylist()]
            langs, scores, spans = zip(*rows) if rows else ([], [], [])
            extra = [batch.column(i) for i in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span), *extra], ["doc_id", "held_out", "lang_pred", "score", "spans", *keep])

    kept = [f.name + " " + f.dataType.simpleString() for f in docs.select(*keep).schema] if keep else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), F.col("text").alias("_text"), *keep)
    return rows.mapInArrow(run, ", ".join(["doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>", *kept]))
