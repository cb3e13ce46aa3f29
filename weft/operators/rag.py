"""Retrieval over batches of questions: chunks, vector and lexical top-k, order-preserving dedup, grading, branches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def knn(queries: DataFrame, chunks: DataFrame, k: int = 3, block: int = 1000) -> DataFrame:
    """qid, cid, score, rank: the k nearest chunks by cosine within the query's datasource, a stated query set against all rows.

    queries(qid, qvec, ds), broadcast in blocks of about `block` rows, a pass over chunks(cid, cvec, ds) for each.
    """
    norm = lambda v: F.sqrt(dot(v, v))
    blocks = max(1, -(-queries.count() // block))
    q = queries.withColumn("qn", norm(F.col("qvec"))).withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    score = dot(F.col("qvec"), F.col("cvec")) / (F.col("qn") * norm(F.col("cvec")))
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "cid")
    out = None
    for i in range(blocks):
        scored = chunks.join(F.broadcast(q.where(F.col("block") == i)), "ds").select("qid", "cid", F.round(score, 6).alias("score"))
        # The plan keeps k best rows a query in each task before the shuffle.
        ranked = scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
        out = out.unionByName(ranked) if out else ranked
    return out


def mmr(candidates: DataFrame, k: int = 3, balance: float = 0.5) -> DataFrame:
    """qid, cid, rank: k of each query's candidates(qid, qvec, cid, cvec) by maximal marginal relevance."""

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cid")
        c = np.stack(g["cvec"].to_list()).astype(float)
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        q = np.asarray(g["qvec"].iloc[0], float)
        near, picked = c @ (q / np.linalg.norm(q)), []
        while len(picked) < min(k, len(c)):
            seen = (c @ c[picked].T).max(axis=1) if picked else np.zeros(len(c))
            value = balance * near - (1 - balance) * seen
            value[picked] = -np.inf
            picked.append(int(value.argmax()))
        return pd.DataFrame({"qid": g["qid"].iloc[0], "cid": g["cid"].to_numpy()[picked], "rank": range(1, len(picked) + 1)})

    return candidates.groupBy("qid").applyInPandas(pick, "qid long, cid long, rank long")


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """doc_id, chunk_idx, chunk: windows of `size` characters, `overlap` shared with the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - overlap - 1), F.lit(step))
    return docs.select("doc_id", "text", F.posexplode(starts).alias("chunk_idx", "at")).select("doc_id", "chunk_idx", F.substring("text", F.col("at") + 1, F.lit(size)).alias("chunk"))


def split_text(text: str, size: int, overlap: int, separators=SEPARATORS) -> list[str]:
    """Recursive splitting: at the coarsest separator that occurs, finer ones for parts that stay too long; pieces merge up to `size`, `overlap` carried over."""
    sep = next(s for s in separators if not s or s in text)
    finer = separators[separators.index(sep) + 1 :]
    out, held = [], []
    for part in text.split(sep) if sep else list(text):
        if not part and sep:
            continue
        if len(part) > size and finer:
            if held:
                out.append(sep.join(held))
                held = []
            out += split_text(part, size, overlap, finer)
            continue
        if held and sum(map(len, held)) + len(sep) * len(held) + len(part) > size:
            out.append(sep.join(held))
            while held and (sum(map(len, held)) + len(sep) * (len(held) - 1) > overlap or sum(map(len, held)) + len(sep) * len(held) + len(part) > size):
                held.pop(0)
        held.append(part)
    return out + ([sep.join(held)] if held else [])


def recursive_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = [(d, i, c) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, c in enumerate(split_text(t or "", size, overlap))]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["doc_id", "chunk_idx", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_idx int, chunk string")


def first_occurrences(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """One row for each distinct key: the first by pos, by partial aggregation."""
    return rows.groupBy(F.sha2(F.col(key), 256).alias("h")).agg(F.min(pos).alias(pos), F.count(F.lit(1)).alias("n")).select(pos, "n")
