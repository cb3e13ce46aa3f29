"""Question answering over datasources, set at a time: rewrite, route, retrieve, aggregate, grade, branch, answer.

A stage is a function from DataFrame to DataFrame; flow() chains them, so a graph of nodes is DataFrame.transform. Loops over rewritten
queries are rows. What a model says comes through asked(): any object with complete(kind, system, user) -> str; OfflineModel is a
deterministic one. A model's error never fails a batch: it becomes the contract's fallback of that stage.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from weft.functions.text import compose
from weft.operators import rag

Stage = Callable[[DataFrame], DataFrame]

# Fixed values of the contract: guarded answers.
NO_QUESTION = "Could not generate a response as the question is missing."
NO_SOURCE = "Could not generate a response as the data source is missing."
NO_CONTEXT = "I found no relevant information to answer your question based on the available documents."
NO_CONFIG = "Configuration error: Cannot generate response."
FAILED = "I encountered an error while formulating the response."
FALLBACK_NO_QUESTION = "I cannot provide an answer as the question is missing."
FALLBACK_FAILED = "I apologize, but I couldn't find relevant information to answer your question at this time."
MAX_REWRITES = 3


class Model(Protocol):
    def complete(self, kind: str, system: str, user: str) -> str: ...


class OfflineModel:
    """Deterministic answers by the words that texts share."""

    def complete(self, kind: str, system: str, user: str) -> str:
        words = lambda t: set(re.findall(r"\w{4,}", t.lower()))
        if kind == "rewrite":
            own = user.split()
            return "\n".join(f"{i}. {' '.join(w)}" for i, w in enumerate((own, own[::2], own[1::2], own[:3]), 1) if w)
        if kind == "route":
            named = re.findall(r"- '([^']*)': (.*)", system)
            return max(named, key=lambda x: len(words(x[0] + " " + x[1]) & words(user)))[0] if named else ""
        if kind == "grade":
            return "yes" if len(words(system) & words(user)) >= 3 else "no"
        return f"{kind}: {user} [{xxhash.xxh64_hexdigest(system)}]"


@dataclass
class Datasource:
    name: str
    description: str = "No description available."
    rag_prompt: str = "{context}\n\n{question}"
    top_k: int = 3
    folder: str = ""


@dataclass
class RagConfig:
    datasources: list[Datasource] = field(default_factory=list)
    rewrite_prompt: str = "Rewrite the question."
    router_prompt: str = "Route the question."
    grader_prompt: str = "{document}"
    fallback_prompt: str = "Answer without documents."
    chunk_size: int = 1000
    chunk_overlap: int = 100
    embedding: str = "hashing"

    def __post_init__(self) -> None:
        names = [d.name for d in self.datasources]
        if len(set(names)) != len(names):
            raise ValueError("repeated datasources")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("the overlap must be less than the chunk size")


def config_of(spec: dict) -> RagConfig:
    """A config of a parsed JSON or YAML document; unknown keys are an error."""
    spec = dict(spec)
    return RagConfig(datasources=[Datasource(**d) for d in spec.pop("datasources", [])], **spec)


def load_config(spark: SparkSession, path: str) -> RagConfig:
    """The config in a .json file, or in a .yaml or .yml one where a YAML parser is installed."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        import json

        return config_of(json.loads(text))
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("no YAML parser is installed; use JSON") from e
    return config_of(yaml.safe_load(text))


def router_prompt(config: RagConfig) -> str:
    """The router's system text: descriptions at their placeholder, or after the text if it has none."""
    listed = "\n".join(f"- '{d.name}': {d.description}" for d in config.datasources)
    mark = "{datasource_descriptions}"
    text = config.router_prompt if mark in config.router_prompt else f"{config.router_prompt}\n\nAvailable datasources:\n{mark}"
    return text.replace(mark, listed)


def system_prompt(strategy: str, custom: str | None = None, templates: dict[str, str] | None = None) -> str:
    """The user bot's system text by strategy: default, aggressive, or custom, which must not be empty."""
    if strategy == "custom":
        if not custom:
            raise ValueError("the custom template is empty")
        return custom
    known = templates or {"default": "Você é um cliente que esqueceu a senha do cartão.", "aggressive": "Você é um cliente irritado que esqueceu a senha do cartão."}
    if strategy not in known:
        raise ValueError(f"no strategy {strategy!r}")
    return known[strategy]


def asked(rows: DataFrame, model: Model, kind: str, system: Column, user: Column, out: str) -> DataFrame:
    """rows with the model's answer as `out`, null where it failed or where the user's text is null."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            answers = []
            for s, u in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                try:
                    answers.append(None if u is None else model.complete(kind, s or "", u))
                except Exception:  # the model is a remote service: its errors are data here
                    answers.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(answers, pa.string())], [*names, out])

    with_texts = rows.select(*names, system.alias("_system"), user.alias("_user"))
    return with_texts.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))


# ---- stages ---------------------------------------------------------------------------------------------------------


def parsed_rewrites(answer: Column, cap: int = MAX_REWRITES) -> Column:
    """Queries out of a list whose items start with a digit (cut after the first dot, if any) or with '- ', `cap` at most; a text without items is one query."""
    lines = F.filter(F.transform(F.split(F.trim(answer), "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^([0-9]|- )"))
    clean = F.transform(lines, lambda x: F.when(x.startswith("- "), F.trim(F.substr(x, F.lit(3)))).when(x.contains("."), F.trim(F.regexp_replace(x, r"(?s)^[^.]*\.", ""))).otherwise(x))
    kept = F.filter(clean, lambda x: x != "")
    return F.when(F.size(kept) > 0, F.slice(kept, 1, cap)).otherwise(F.array(F.trim(answer)))


def rewritten(questions: DataFrame, config: RagConfig, model: Model) -> DataFrame:
    """questions(qid, question) with queries: none for an empty question, the question itself where the model fails."""
    q = F.nullif("question", F.lit(""))
    answered = asked(questions, model, "rewrite", F.lit(config.rewrite_prompt), q, "_a")
    queries = F.when(q.isNull(), F.array().cast("array<string>")).when(F.col("_a").isNull(), F.array("question")).otherwise(parsed_rewrites(F.col("_a")))
    return answered.withColumn("queries", queries).drop("_a")


def variants(questions: DataFrame) -> DataFrame:
    """A row a query: qid, i, query; a question without queries is its own one, null if it is empty."""
    each = questions.select("qid", "question", F.posexplode_outer("queries").alias("i", "query"))
    return each.select("qid", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("query", F.nullif("question", F.lit(""))).alias("query"))


def routed(rows: DataFrame, config: RagConfig, model: Model) -> DataFrame:
    """rows(qid, i, query) with ds: the model's choice if there is such a datasource, else the first one, null if there is none."""
    names = [d.name for d in config.datasources]
    if not names:
        return rows.withColumn("ds", F.lit(None).cast("string"))
    answered = asked(rows, model, "route", F.lit(router_prompt(config)), F.col("query"), "_a")
    return answered.withColumn("ds", F.when(F.col("_a").isin(*names), F.col("_a")).otherwise(names[0])).drop("_a")


#: Embedders by name; a provider of an application is registered here.
EMBEDDERS: dict[str, Callable[[list[str]], np.ndarray]] = {}


def embedder(name: str) -> Callable[[list[str]], np.ndarray]:
    if name not in EMBEDDERS:
        raise ValueError(f"no embedding provider {name!r}; known: {sorted(EMBEDDERS)}")
    return EMBEDDERS[name]


def hashing(texts: list[str], width: int = 64) -> np.ndarray:
    """Signed counts of hashed words, scaled to length one; texts without words get the first axis."""
    out = np.zeros((len(texts), width))
    for row, text in zip(out, texts):
        for w in re.findall(r"\w+", text.lower()):
            h = xxhash.xxh64_intdigest(w)
            row[h % width] += 1 if h >> 63 else -1
        if not row.any():
            row[0] = 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


EMBEDDERS["hashing"] = hashing


def embedded(rows: DataFrame, text: str, out: str, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    names = rows.columns

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(names.index(text)).to_pylist()]
            vectors = embed(texts) if texts else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.astype(np.float32) for v in vectors], pa.list_(pa.float32()))], [*names, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, ArrayType(FloatType()))]))


def index(documents: DataFrame, config: RagConfig) -> DataFrame:
    """cid, ds, chunk, cvec of documents(doc_id, ds, text): recursive chunks and their vectors."""
    rows = rag.recursive_chunks(documents.select("doc_id", "text"), config.chunk_size, config.chunk_overlap).join(documents.select("doc_id", "ds"), "doc_id")
    return embedded(rows.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_idx").cast("string")).alias("cid"), "ds", "chunk"), "chunk", "cvec", embedder(config.embedding))


def open_index(spark: SparkSession, path: str, documents: DataFrame, config: RagConfig) -> DataFrame | None:
    """The index written at `path`; a missing, empty or unreadable one is built anew. None where there are no documents to build it from."""
    try:
        found = spark.read.parquet(path)
        if {"cid", "ds", "chunk", "cvec"} <= set(found.columns) and not found.isEmpty():
            return found
    except Exception:  # missing or broken: built anew below
        pass
    if documents.isEmpty():
        return None
    index(documents, config).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def retrieved(rows: DataFrame, chunks: DataFrame, config: RagConfig, threshold: float | None = None) -> DataFrame:
    """qid, i, ds, rank, cid, chunk, score: the top_k chunks of each query's datasource (of an unknown one, the first), by cosine, from `threshold` on."""
    names = [d.name for d in config.datasources]
    known = F.when(F.col("ds").isin(*names), F.col("ds")).otherwise(F.lit(names[0])) if names else F.col("ds")
    q = embedded(rows.where("query IS NOT NULL AND ds IS NOT NULL").withColumn("ds", known), "query", "qvec", embedder(config.embedding))
    keyed = q.withColumn("key", F.struct("qid", "i"))
    near = rag.knn(keyed.select(F.col("key").alias("qid"), "qvec", "ds"), chunks.select("cid", "cvec", "ds"), max([d.top_k for d in config.datasources], default=1))
    ks = F.create_map(*[F.lit(x) for d in config.datasources for x in (d.name, d.top_k)])
    out = near.select(F.col("qid.qid").alias("qid"), F.col("qid.i").alias("i"), "cid", "score", "rank").join(q.select("qid", "i", "ds"), ["qid", "i"])
    out = out.where(F.col("rank") <= F.element_at(ks, F.col("ds")))
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    return out.join(chunks.select("cid", "chunk"), "cid").select("qid", "i", "ds", "rank", "cid", "chunk", "score")


def aggregated(found: DataFrame) -> DataFrame:
    """qid, pos, chunk: the distinct texts of a question, in the order in which its queries found them first."""
    first = found.groupBy("qid", "chunk").agg(F.min(F.struct("i", "rank")).alias("at"))
    return first.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("at", "chunk")).alias("pos"), "chunk")


def graded(texts: DataFrame, questions: DataFrame, config: RagConfig, model: Model) -> DataFrame:
    """texts(qid, pos, chunk) with relevant: the model's yes, in any case, on the original question; blank texts are never relevant, and
    neither is any text of a question on which the model failed."""
    rows = texts.join(questions.select("qid", F.nullif("question", F.lit("")).alias("question")), "qid")
    blank = F.trim("chunk") == ""
    prompt = F.concat(F.lit(config.grader_prompt.split("{document}")[0]), F.col("chunk"))
    answered = asked(rows, model, "grade", prompt, F.when(~blank, F.col("question")), "_a")
    failed = F.max(~blank & F.col("_a").isNull()).over(Window.partitionBy("qid"))
    return answered.withColumn("relevant", ~blank & ~failed & (F.lower("_a") == "yes")).drop("_a", "question")


def answered(questions: DataFrame, last_route: DataFrame, grades: DataFrame, config: RagConfig, model: Model) -> DataFrame:
    """qid, question, datasource, documents_relevant, branch, context, response of every question. The template is that of the datasource of its last query."""
    kept = F.transform(F.sort_array(F.collect_list(F.when(F.col("relevant"), F.struct("pos", "chunk")))), lambda x: x["chunk"])
    context = grades.groupBy("qid").agg(kept.alias("texts"))
    rows = questions.select("qid", "question").join(last_route, "qid", "left").join(context, "qid", "left")
    rows = rows.withColumn("texts", F.coalesce("texts", F.array().cast("array<string>"))).withColumn("documents_relevant", F.size("texts") > 0)
    rows = rows.withColumn("context", F.array_join("texts", "\n\n")).drop("texts")
    rows = rows.withColumn("branch", F.when(F.col("documents_relevant"), "answer").otherwise("fallback"))
    q = F.nullif("question", F.lit(""))
    template = F.lit(None).cast("string")
    for d in config.datasources:
        template = F.when(F.col("datasource") == d.name, compose(d.rag_prompt, context=F.col("context"), question=F.coalesce(q, F.lit("")))).otherwise(template)
    rows = rows.withColumn("_t", template)
    relevant = F.col("documents_relevant")
    rows = asked(rows, model, "answer", F.col("_t"), F.when(relevant & F.col("_t").isNotNull(), q), "_a")
    rows = asked(rows, model, "fallback", F.lit(config.fallback_prompt), F.when(~relevant, q), "_f")
    full = F.when(q.isNull(), NO_QUESTION).when(F.col("datasource").isNull(), NO_SOURCE).when(F.col("context") == "", NO_CONTEXT).when(F.col("_t").isNull(), NO_CONFIG).otherwise(F.coalesce("_a", F.lit(FAILED)))
    none = F.when(q.isNull(), FALLBACK_NO_QUESTION).otherwise(F.coalesce("_f", F.lit(FALLBACK_FAILED)))
    return rows.withColumn("response", F.when(relevant, full).otherwise(none)).drop("_t", "_a", "_f")


def flow(df: DataFrame, *stages: Stage) -> DataFrame:
    for stage in stages:
        df = df.transform(stage)
    return df


def answer(questions: DataFrame, chunks: DataFrame, config: RagConfig, model: Model) -> dict[str, DataFrame]:
    """The whole flow over questions(qid, question): answers, and what log_rows() makes the session's log of."""
    own = rewritten(questions, config, model)
    route = flow(own, variants, lambda df: routed(df, config, model))
    found = retrieved(route, chunks, config)
    grades = graded(aggregated(found), questions, config, model)
    last = route.groupBy("qid").agg(F.max_by("ds", "i").alias("datasource"))
    return {"answers": answered(questions, last, grades, config, model), "rewritten": own, "routes": route, "retrieved": found, "grades": grades}


# ---- logs -----------------------------------------------------------------------------------------------------------


def preview(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)


def sanitised(state: dict[str, Column], documents: tuple[str, ...] = ("context", "relevant_context", "aggregated_docs"), kinds: dict[str, str] | None = None) -> Column:
    """A state as a struct fit for a log: texts cut at 1000, lists of documents as count and two of them, lists of messages as the first five.
    kinds names what isn't a text: documents, messages or plain."""
    kinds = kinds or {}
    out = []
    for k, c in state.items():
        kind = kinds.get(k, "documents" if k in documents else "text")
        if kind == "documents":
            out.append(F.struct(F.greatest(F.size(c), F.lit(0)).alias("count"), F.coalesce(F.slice(c, 1, 2), F.array().cast("array<string>")).alias("preview")).alias(k))
        else:
            out.append((F.slice(c, 1, 5) if kind == "messages" else preview(c, 1000) if kind == "text" else c).alias(k))
    return F.struct(*out)


def log_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """qid, step, level, message, data (JSON) of a batch's answers: one row for each start, rewriting, routing, retrieval, grading, answer and error."""
    def row(df: DataFrame, step: int, message, data: Column, level: str = "INFO") -> DataFrame:
        said = message if isinstance(message, Column) else F.lit(message)
        return df.select("qid", F.lit(step).alias("step"), F.lit(level).alias("level"), said.alias("message"), F.to_json(data).alias("data"))

    q, route, found, grades, done = (parts[k] for k in ("rewritten", "routes", "retrieved", "grades", "answers"))
    by = found.groupBy("qid", "i").agg(F.first("ds").alias("datasource"), F.count(F.lit(1)).alias("num_documents"), F.sort_array(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", F.left("chunk", F.lit(200)).alias("text"))))).alias("documents_preview"))
    marks = grades.groupBy("qid").agg(F.count(F.lit(1)).alias("total_documents"), F.count_if("relevant").alias("relevant_count"))
    kind = F.when(F.col("documents_relevant"), "rag").otherwise("fallback").alias("response_type")
    failed = done.where(F.col("response").isin(FAILED, FALLBACK_FAILED))
    out = [
        row(q, 0, "Starting processing", F.struct(F.col("question").alias("query"))),
        row(q, 1, "Query rewriting", F.struct(F.col("question").alias("original_query"), F.col("queries").alias("rewritten_queries"), F.size("queries").alias("num_rewrites"))),
        row(route, 2, "Routing decision", F.struct(F.col("ds").alias("selected_datasource"))),
        row(by, 3, "Document retrieval", F.struct("datasource", "num_documents", "documents_preview")),
        row(marks, 4, "Document grading completed", F.struct("total_documents", "relevant_count")),
        row(done.where("NOT documents_relevant"), 5, "Generating fallback response", F.struct("question")),
        row(failed, 6, F.lit("Error occurred: generation"), F.struct(F.col("response").alias("error_message")), "ERROR"),
        row(done, 7, "Final response generated", F.struct(kind, F.length("response").alias("response_length"), preview(F.col("response"), 500).alias("response_preview"))),
    ]
    rows = out[0]
    for r in out[1:]:
        rows = rows.unionByName(r)
    return rows


def level_counts(logs: DataFrame, *by: str) -> DataFrame:
    """by, levels: a map of the number of log rows of each level."""
    counts = logs.groupBy(*by, F.coalesce("level", F.lit("UNKNOWN")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "n")))).alias("levels"))


def session_summary(messages: DataFrame, logs: DataFrame) -> DataFrame:
    """thread_id, summary of messages(thread_id, persona_id, start_time, end_time, index, query, message_start) and logs(thread_id, index, level)."""
    levels = level_counts(logs, "thread_id", "index")
    total = F.aggregate(F.map_values("levels"), F.lit(0).cast("long"), lambda s, x: s + x)
    shown = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("levels"), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string"))), ", "), F.lit("}"))
    line = F.concat_ws(
        "\n", F.concat(F.lit("Message "), F.col("index").cast("string"), F.lit(":")), F.concat(F.lit("  Query: "), F.left("query", F.lit(100)), F.lit("...")),
        F.concat(F.lit("  Start Time: "), "message_start"), F.concat(F.lit("  Total Logs: "), F.coalesce(total, F.lit(0)).cast("string")),
        F.concat(F.lit("  Log Levels: "), F.coalesce(shown, F.lit("{}"))), F.lit(""),
    )
    rows = messages.join(levels, ["thread_id", "index"], "left").withColumn("line", line)
    by = rows.groupBy("thread_id").agg(*[F.first(c).alias(c) for c in ("persona_id", "start_time", "end_time")], F.sort_array(F.collect_list(F.struct("index", "line"))).alias("lines"))
    head = F.concat_ws(
        "\n", F.lit("RAG SESSION SUMMARY"), F.lit("=" * 50), F.concat(F.lit("Thread ID: "), "thread_id"), F.concat(F.lit("Persona ID: "), "persona_id"),
        F.concat(F.lit("Start Time: "), "start_time"), F.concat(F.lit("End Time: "), F.coalesce("end_time", F.lit("N/A"))), F.concat(F.lit("Total Messages: "), F.size("lines").cast("string")), F.lit(""),
    )
    return by.select("thread_id", F.concat_ws("\n", head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("summary"))
