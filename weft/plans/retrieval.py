"""Queries of the question-answering flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import ragflow
from weft.plans.catalog import query, read


def _config(spark, sf) -> ragflow.RagConfig:
    """A datasource for each language."""
    names = [r["lang"] for r in read(spark, sf, "documents").select("lang").where("lang IS NOT NULL").distinct().orderBy("lang").limit(100).collect()]
    return ragflow.RagConfig([ragflow.Datasource(n, f"texts in {n}", f"[{n}] {{context}}\n\n{{question}}") for n in names])


def _answers(spark, sf):
    config = _config(spark, sf)
    d = read(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    chunks = ragflow.embedded(d.select(F.col("doc_id").cast("string").alias("cid"), F.col("lang").alias("ds"), F.col("text").alias("chunk")), "chunk", "cvec", ragflow.hashing)
    asked = read(spark, sf, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return ragflow.answer(asked, chunks, config, ragflow.OfflineModel())


@query()
def rag_answer(spark, sf):
    """Answers to the questions whose id is divisible by 50, against all documents."""
    return _answers(spark, sf)["answers"]


@query()
def rag_logs(spark, sf):
    return ragflow.log_rows(_answers(spark, sf))


@query("""SELECT user_id, event_id % 20 AS ordinal, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type <> 'error') AS infos FROM events GROUP BY 1, 2""")
def rag_log_levels(spark, sf):
    lines = read(spark, sf, "events").select("user_id", (F.col("event_id") % 20).alias("ordinal"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"))
    by = ragflow.level_counts(lines, "user_id", "ordinal")
    n = lambda x: F.coalesce(F.try_element_at("levels", F.lit(x)), F.lit(0).cast("long"))
    return by.select("user_id", "ordinal", n("ERROR").alias("errors"), n("INFO").alias("infos"))


@query("""WITH f AS (SELECT user_id AS qid, floor(value)::BIGINT AS chunk, event_id FROM events WHERE value IS NOT NULL), d AS (SELECT qid, chunk, min(event_id) AS e FROM f GROUP BY qid, chunk)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY e) AS pos, chunk::VARCHAR AS chunk FROM d""")
def rag_aggregate(spark, sf):
    """Distinct texts of a question in the order in which they were found first."""
    found = read(spark, sf, "events").where("value IS NOT NULL").select(F.col("user_id").alias("qid"), F.col("event_id").alias("i"), F.lit(1).alias("rank"), F.floor("value").cast("string").alias("chunk"))
    return ragflow.aggregated(found).withColumn("pos", F.col("pos").cast("long"))
