"""Personal data: fixed base rules, and contextual extraction bootstrapped from what they find.

Base spans (email, ip, card, phone) are the seed entities. What patterns may propose beside them are all identifier-like fillers of any
shape: words with a digit, an at sign or a bracketed "at" or "dot" (which takes its neighbours in), and runs of such words; a label
before : or = is context. Every filler is an instance (its text without case, spaces, brackets, hyphens and plus signs), and the words
around an occurrence are its lexical patterns: the two before it, and its neighbours on both sides.

Spark scores the pattern-instance graph in rounds. A pattern's confidence for a kind is the sum of the scores of its instances of that kind
over the number of all its instances and one; it counts from `min_seeds` such instances and `reliable` on. An instance's score is a
noisy-or of its patterns; from `accept` on it is of its best kind and supports patterns in the next round as seeds do, so what one
pattern finds can raise another. Rounds end when they change nothing, after `rounds` at the latest. Occurrences of seeds and of accepted
instances that no base span covers become spans; of a run and its words, the run goes first. Texts are read once; the graph holds
distinct edges only, and all sums over a pattern or an instance are partial first, so a pattern that a third of all rows share makes no
hot task.

Defined results: a null text is empty; repeated rows come back each; a document without findings has zero counts and an
empty spans string; an empty table gives an empty result. Other columns are ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import checkpointed, small, table

KINDS = ("email", "ip", "card", "phone")
ROUNDS, ACCEPT, RELIABLE, MIN_SEEDS = 5, 0.6, 0.5, 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A digit run is entered at its first digit only: entering it later could not match where that fails.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_HINT = re.compile(r"[0-9@]|[(\[](?:at|AT|dot|DOT)[)\]]")
_GLUE = re.compile(r"[(\[](?:at|AT|dot|DOT)[)\]]")
_SPACE = re.compile(r"\s")
_WORD = re.compile(r"\S+")
_LABEL = re.compile(r"[^0-9@]*[:=](?=.*[0-9@])")
_NOT_WORD = re.compile(r"^\W+|\W+$")
_LOOSE = re.compile(r"[\s()\[\]+-]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), by kind, then start."""
    out = [(0, *s) for s in emails(text)]
    if _DIGIT.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 13 <= m.end() - m.start() <= 40 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _word_before(text: str, at: int) -> tuple[int, int]:
    """The span of the characters before `at` that have no space between them and it, or else of the word before; empty at the start."""
    e = at
    while e > 0 and text[e - 1].isspace():
        e -= 1
    s = e
    while s > 0 and not text[s - 1].isspace():
        s -= 1
    return s, e


def _word_after(text: str, at: int) -> tuple[int, int]:
    m = _WORD.search(text, at)
    return m.span() if m else (len(text), len(text))


def hinted_words(text: str) -> list[tuple[int, int]]:
    """Spans of the words that look like an identifier, or of several that a lone "(at)" or "(dot)" holds together."""
    out: list[tuple[int, int]] = []
    done = 0
    for m in _HINT.finditer(text):
        if m.start() < done:
            continue
        s = m.start()
        while s > done and not text[s - 1].isspace():
            s -= 1
        end = _SPACE.search(text, m.end())
        e = end.start() if end else len(text)
        if _GLUE.fullmatch(text, s, e):
            s, e = _word_before(text, s)[0], _word_after(text, e)[1]
            if out and s < out[-1][1]:
                s = out.pop()[0]
        out.append((s, e))
        done = e
    return out


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """Without punctuation at the ends, but for a plus sign or bracket that opens it."""
    while s < e and not (text[s].isalnum() or text[s] in "+("):
        s += 1
    while e > s and not text[e - 1].isalnum():
        e -= 1
    return s, e


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """(start, end, run, whole): identifier-like words, and whole runs of them, that no base span overlaps. Runs are cut by base spans."""
    ends, starts = [], []  # the base spans, merged where they touch
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def free(s: int, e: int) -> bool:
        i = bisect_right(ends, s)
        return i == len(ends) or e <= starts[i]

    found, run, last = [], [], None
    words = [w for w in hinted_words(text) if free(*w)]

    def close() -> None:
        if len(run) > 1:
            s, e = _trimmed(text, run[0][0], run[-1][1])
            if s < e:
                found.append((s, e, run[0][0], True))
        run.clear()

    for s, e in words:
        if run and (not text[last:s].isspace() or not free(run[0][0], e)):
            close()
        run.append((s, e))
        last = e
        label = _LABEL.match(text, s, e)
        a, b = _trimmed(text, label.end() if label else s, e)
        if a < b:
            found.append((a, b, run[0][0], False))
    close()
    return found


def _word(word: str) -> str:
    """A context word: without case and punctuation at its ends; any that has a digit is the same."""
    return "#" if _DIGIT.search(word) else _NOT_WORD.sub("", word.lower())


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of an occurrence: its two words before it, and its neighbours on both sides. ^ and $ are the text's ends."""
    s, e = _word_before(text, start)
    t, u = _word_before(text, s)
    last, one = (_word(text[s:e]) if s < e else "^"), (_word(text[t:u]) if t < u else "^")
    a, b = _word_after(text, end)
    if a == end and not any(map(str.isalnum, text[a:b])):  # punctuation that ends it
        a, b = _word_after(text, b)
    right = _word(text[a:b]) if a < b else "$"
    return [f"{one} {last} _", f"{last} _ {right}"]


def instance_of(filler: str) -> str:
    return _LOOSE.sub("", filler.lower())


def occurrences_of(text: str) -> list[dict]:
    """k (a seed's kind, else -1), s, e, run, whole, instance and patterns of the base spans and the other fillers."""
    base = base_spans(text)
    every = [(k, s, e, -1, False) for k, s, e in base] + [(-1, *c) for c in candidates(text, base)]
    return [{"k": k, "s": s, "e": e, "run": run, "whole": whole, "instance": instance_of(text[s:e]), "patterns": patterns(text, s, e)} for k, s, e, run, whole in every]


def _found(text: str | None) -> tuple:
    out = occurrences_of(text or "")
    base = [o for o in out if o["k"] >= 0]
    named = ",".join(f"{KINDS[o['k']]}:{o['s']}:{o['e']}" for o in base)
    counts = [sum(o["k"] == i for o in base) for i in range(4)]
    number = lambda t: xxhash.xxh64_intdigest(t) - (1 << 63)
    return *counts, hashlib.sha256(named.encode()).hexdigest(), [o | {"instance": number(o["instance"]), "patterns": [number(p) for p in o["patterns"]]} for o in out]


def scored(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, reliable: float = RELIABLE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(instance, k, score) of the seeds, scored 1, and of the instances accepted, of distinct edges(pattern, instance) and seeds(instance, k)."""
    seeds = checkpointed(seeds.withColumn("score", F.lit(1.0)))
    # A pattern of one instance has nothing to give to another one.
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = checkpointed(edges.join(sizes, "pattern"))
    open_ = checkpointed(edges.select("pattern", "instance").join(seeds.select("instance").distinct(), "instance", "left_anti"))
    known, before = seeds, -1
    for _ in range(rounds):
        by = edges.join(known, "instance").groupBy("pattern", "k").agg(F.count(F.lit(1)).alias("own"), F.sum("score").alias("sum"), F.first("n").alias("n"))
        good = by.where(F.col("own") >= min_seeds).select("pattern", "k", (F.col("sum") / (F.col("n") + 1)).alias("c")).where(F.col("c") >= reliable)
        doubt = F.sum(F.log1p(-F.least("c", F.lit(0.999999))))
        all_kinds = open_.join(small(checkpointed(good)), "pattern").groupBy("instance", "k").agg((1 - F.exp(doubt)).alias("score"))
        # Of equal scores the first kind; what belongs to one kind supports no other.
        best = all_kinds.where(F.col("score") >= accept).groupBy("instance").agg(F.max(F.struct("score", (-F.col("k")).alias("o"))).alias("b"))
        found = checkpointed(best.select("instance", (-F.col("b.o")).alias("k"), F.col("b.score").alias("score")))
        state = found.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("instance", "k")), F.round(F.sum("score"), 9)).first()
        known = seeds.unionByName(found)
        if state == before:
            break
        before = state
    return known


def extract(docs: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT, reliable: float = RELIABLE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found array<struct<k,s,e,seed>> for every row of docs(doc_id, text, ...).

    The counts and base_sha256 are of the base spans; spans holds all, as kind:start:end, and found says which are seeds.
    """
    occurrence = "struct<k:int,s:int,e:int,run:int,whole:boolean,instance:long,patterns:array<long>>"
    kind = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("run", pa.int32()), ("whole", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])
    counts = [f"n_{k}" for k in KINDS]
    names = ["doc_id", "rid", *counts, "base_sha256", "occurrences"]

    def run(batches):
        for batch in batches:
            rows = [_found(t) for t in batch.column(2).to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id long, rid long, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, occurrences array<{occurrence}>"
    rows = table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), "text").mapInArrow(run, schema))
    each = rows.select("rid", F.explode("occurrences").alias("o")).select("rid", "o.*")
    edges = each.select("instance", F.explode("patterns").alias("pattern")).distinct()
    # What is a seed of several kinds is one of the first.
    seeds = each.where("k >= 0").groupBy("instance").agg(F.min("k").alias("k"))
    known = scored(edges, seeds, rounds, accept, reliable, min_seeds).select("instance", F.col("k").alias("kind"))

    taken = checkpointed(each.where("k < 0").select("rid", "s", "e", "run", "whole", "instance").join(known, "instance").select("rid", "s", "e", "run", "whole", "kind").distinct())
    runs = taken.where("whole")
    kept = runs.unionByName(taken.where(~F.col("whole")).join(runs.select("rid", "run").distinct(), ["rid", "run"], "left_anti"))
    span = F.struct(F.col("kind").alias("k"), "s", "e", F.lit(False).alias("seed"))
    added = kept.groupBy("rid").agg(F.collect_list(span).alias("added"))
    own = F.transform(F.filter("occurrences", lambda o: o["k"] >= 0), lambda o: F.struct(o["k"].alias("k"), o["s"].alias("s"), o["e"].alias("e"), F.lit(True).alias("seed")))
    out = rows.join(added, "rid", "left").withColumn("found", F.sort_array(F.when(F.col("added").isNull(), own).otherwise(F.concat(own, "added"))))
    name = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform("found", lambda o: F.concat_ws(":", F.get(name, o["k"]), o["s"].cast("string"), o["e"].cast("string"))), ",")
    return out.select("doc_id", *counts, "base_sha256", spans.alias("spans"), "found")
