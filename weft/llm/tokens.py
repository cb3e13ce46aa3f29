"""Token counts of a unigram tokenizer: the best segmentation's pieces are counted, never built.

An Aho-Corasick automaton enumerates the vocabulary's matches in a segment; dynamic programming over their ends carries
the best score and its number of pieces. Tie rules are the tokenizer's: candidates for an end are tried by ascending start,
a later one must be strictly better, and a character that is no piece of its own may be unknown, at the lowest score of
the vocabulary less 10, tried last. Unknown runs are one piece, or, with byte pieces for all 256 bytes, their UTF-8 bytes.

Spaces become U+2581, one more leads a text that isn't empty; a segment is a run of U+2581 with what follows it. No
piece may reach from another character over to a U+2581 (checked; such a vocabulary is counted over whole texts). Counts
of segments are kept in a bounded dictionary, as words repeat.

Defined results: null and empty texts have 0 tokens; repeated rows come back each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBER, REMEMBER_CHARS = 400_000, 48
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_CROSSES = re.compile(f"[^{SPACE}]{SPACE}")


def vocabulary(model: str = MODEL) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with scores, and whether all bytes have pieces, of a public vocabulary file; read on the driver only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(sp.get_piece_size())
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    return pieces, sum(sp.is_byte(i) for i in ids) == 256


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes, self.pieces = byte_pieces, bool(pieces)
        self.split = not any(_CROSSES.search(p) for p, _ in pieces)
        self.seen: dict[str, int] = {}

    def segment(self, text: str) -> int:
        """Pieces of the best segmentation."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        after_unknown = [False] * (n + 1)
        done, best, pieces, single = 0, None, 0, False  # of the end at `done`

        def close() -> None:
            nonlocal best, pieces
            unknown = False
            if not single and (best is None or score[done] + self.unknown > best):
                best, unknown = score[done] + self.unknown, True
                pieces = count[done] + (len(text[done].encode()) if self.bytes else not after_unknown[done])
            score[done + 1], count[done + 1], after_unknown[done + 1] = best, pieces, unknown

        # Matches come by end, the longest (of the earliest start) first.
        for end, (length, value) in self.automaton.iter(text) if self.pieces else ():
            while done < end:
                close()
                done, best, single = done + 1, None, False
            start = end + 1 - length
            if best is None or score[start] + value > best:
                best, pieces = score[start] + value, count[start] + 1
            if length == 1:
                single = True
        while done < n:
            close()
            done, best, single = done + 1, None, False
        return count[n]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.split:
            return self.segment(text)
        total, seen = 0, self.seen
        for s in _SEGMENT.findall(text):
            n = seen.get(s)
            if n is None:
                n = self.segment(s)
                if len(s) <= REMEMBER_CHARS:
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen[s] = n
            total += n
        return total


def count_tokens(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_chars for every row of docs(doc_id, text, ...)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model))  # the size of a vocabulary file

    def run(batches):
        count = Counter(*shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) for t in texts], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], ["doc_id", "n_tokens", "n_chars"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_chars long")
