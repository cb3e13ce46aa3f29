"""Sinks: delimited text, event logs, JSON by conversation, ZIP archives, tables; guarded against overwriting."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"
EVENT_LOG = ["CASE_ID", "EVENT_ID", "ACTIVITY", "START_TIMESTAMP", "END_TIMESTAMP", "RECURSO", "AGENTE"]


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_csv(df: DataFrame, path: str, columns: list[str], sep: str = ";", overwrite: bool = False, encoding: str = "UTF-8") -> None:
    """Columns in order, with a header; refuses an existing path unless told to overwrite."""
    df.select(*columns).write.mode(_mode(overwrite)).option("sep", sep).option("header", True).option("encoding", encoding).csv(path)


def _put(spark: SparkSession, local: str, path: str, overwrite: bool) -> None:
    """A local file moved to a path of any store; refuses an existing one unless told to overwrite."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at) and not overwrite:
        raise FileExistsError(f"{path} exists")
    fs.copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(f"file://{local}"), at)


def _local(suffix: str) -> str:
    fd, name = tempfile.mkstemp(suffix=suffix)
    os.close(fd)
    return name


def write_one_csv(df: DataFrame, path: str, columns: list[str], order: list[str], sep: str = ";", bom: bool = True, overwrite: bool = False) -> None:
    """One file in order, with a header even where df is empty. Rows pass through the driver one partition at a time."""
    name = _local(".csv")
    with open(name, "w", encoding="utf-8", newline="") as f:
        f.write(BOM * bom)
        out = csv.writer(f, delimiter=sep, lineterminator="\n")
        out.writerow(columns)
        for r in df.orderBy(*order).select(*columns).toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
    _put(df.sparkSession, name, path, overwrite)


def write_event_log(log: DataFrame, path: str, overwrite: bool = False) -> None:
    """The event log as one ;-separated file with a byte order mark, in the order of events."""
    write_one_csv(log, path, EVENT_LOG, ["EVENT_ID"], overwrite=overwrite)


def write_by_key(df: DataFrame, path: str, key: str, overwrite: bool = False) -> None:
    """JSON, a folder for each key; null fields are left out."""
    df.repartition(key).write.mode(_mode(overwrite)).partitionBy(key).json(path)


def write_audit(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON line a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(_mode(overwrite)).text(path)


def write_zip(files: DataFrame, path: str, index: DataFrame | None = None, overwrite: bool = False) -> int:
    """A ZIP of files(filename, body), and index.json of the rows of `index` if given; the number of files. Rows pass through the driver one
    partition at a time, and the archive is built on its disk."""
    name, n = _local(".zip"), 0
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for r in files.select("filename", "body").toLocalIterator():
            z.writestr(r["filename"], r["body"])
            n += 1
        if index is not None and n:
            with z.open("index.json", "w") as f:
                f.write(b'{"conversations": [')
                for i, r in enumerate(index.toLocalIterator()):
                    f.write((", " * (i > 0) + json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str)).encode())
                f.write(f'], "total_conversations": {n}}}'.encode())
    _put(files.sparkSession, name, path, overwrite)
    return n


#: Bytes of members, before compression, from which an archive of write_zips is closed, and what its tasks are dealt.
ARCHIVE_BYTES = 16 << 20


def _archives(limit: int):
    """mapInArrow over (thread_id, filename, body): content, a ZIP for every `limit` bytes of members, with an index of them."""

    def run(batches):
        buffer = z = None
        names, size = [], 0

        def closed():
            z.writestr("index.json", json.dumps({"conversations": names, "total_conversations": len(names)}, ensure_ascii=False))
            z.comment = b"\n"  # its last byte is the end of line that the text writer adds
            z.close()
            return pa.RecordBatch.from_arrays([pa.array([buffer.getvalue()[:-1]], pa.binary())], ["content"])

        for batch in batches:
            for i in range(batch.num_rows):
                thread, name, body = (c[i].as_py() for c in batch.columns)
                if z is None:
                    buffer, names, size = io.BytesIO(), [], 0
                    z = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
                body = body.encode()
                z.writestr(name, body)
                names.append({"thread_id": thread, "filename": name})
                size += len(body)
                if size >= limit:
                    yield closed()
                    z = None
        if z is not None:
            yield closed()

    return run


def write_zips(files: DataFrame, path: str, overwrite: bool = False, limit: int | None = None) -> None:
    """A folder of ZIPs of files(thread_id, filename, body), each of about `limit` bytes of members with an index.json of its own. Tasks build and
    write them, each in a file of its own, so nothing passes through the driver and no task holds more than one. A folder without files: no archive."""
    made = files.select("thread_id", "filename", "body").mapInArrow(_archives(limit or ARCHIVE_BYTES), "content binary")
    made.select(F.col("content").cast("string").alias("value")).write.mode(_mode(overwrite)).option("maxRecordsPerFile", 1).text(path)


def conversation_csvs(rows: DataFrame) -> DataFrame:
    """filename, body: a CSV for each conversation of interactions.message_rows. A conversation is one document, so one row."""
    field = lambda c: F.when(F.col(c).cast("string").rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    line = F.concat_ws(",", *[field(c) for c in ("type", "content", "simulated_timestamp", "elapsed_time")])
    by = rows.groupBy("thread_id", "persona_id").agg(F.sort_array(F.collect_list(F.struct("index", line.alias("line")))).alias("lines"))
    body = F.concat(F.lit("type,content,simulated_timestamp,elapsed_time\n"), F.array_join(F.transform("lines", lambda x: F.concat(x["line"], F.lit("\n"))), ""))
    return by.select("thread_id", F.format_string("conversa_%s_%s.csv", F.coalesce("persona_id", F.lit("None")), "thread_id").alias("filename"), body.alias("body"))


def write_personas(personas: DataFrame, path: str, overwrite: bool = False) -> int:
    """A ZIP of personaN.json files of personas(persona_id, dados)."""
    return write_zip(personas.select(F.format_string("persona%d.json", "persona_id").alias("filename"), F.col("dados").alias("body")), path, overwrite=overwrite)


def append(df: DataFrame, path: str, key: list[str] | None = None) -> None:
    """Rows added to a Parquet table; with a key, those that aren't there yet, once each."""
    spark = df.sparkSession
    if key:
        df = df.dropDuplicates(key)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            df = df.join(spark.read.parquet(path).select(*key), key, "left_anti")
    df.write.mode("append").parquet(path)


def session_zip(messages: DataFrame, logs: DataFrame, summaries: DataFrame, path: str, overwrite: bool = False) -> int:
    """A session's archive: NNN_persona_thread.log (JSON lines of logs(thread_id, index, step, line)) for every message, its metadata as JSON and its summary."""
    by = logs.groupBy("thread_id", "index").agg(F.sort_array(F.collect_list(F.struct("step", "line"))).alias("ls"))
    rows = messages.join(by, ["thread_id", "index"], "left")
    text = F.array_join(F.transform(F.coalesce("ls", F.array()), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    name = lambda pattern, *cols: F.format_string(pattern, *cols)
    files = rows.select(name("%03d_%s_%s.log", "index", "persona_id", "thread_id").alias("filename"), text.alias("body"))
    meta = F.struct(F.first("thread_id").alias("thread_id"), F.first("persona_id").alias("persona_id"), F.first("start_time").alias("start_time"), F.first("end_time").alias("end_time"), F.sort_array(F.collect_list(F.struct("index", "query"))).alias("messages"))
    metas = messages.groupBy("thread_id").agg(F.to_json(meta).alias("body"), F.first("persona_id").alias("p")).select(name("session_metadata_%s_%s.json", "p", "thread_id").alias("filename"), "body")
    texts = summaries.select(name("session_summary_%s.txt", "thread_id").alias("filename"), F.col("summary").alias("body"))
    return write_zip(files.unionByName(metas).unionByName(texts), path, overwrite=overwrite)


RUNS = "run_id STRING, prompts_file_hash STRING, prompts_file_path STRING, passes INT, total_instances BIGINT, status STRING, created_at STRING, updated_at STRING, args_json STRING"
INSTANCES = (
    "run_id STRING, instance_key STRING, simulation_id BIGINT, pass_index BIGINT, queue_index BIGINT, persona_id STRING, thread_id STRING, status STRING, "
    "created_at STRING, updated_at STRING, started_at STRING, completed_at STRING, error STRING"
)
SCENARIOS = {
    "persona": "persona_id BIGINT, dados STRING",
    "cenario": "cenario_id STRING, dados_cenario STRING",
    "missao": "missao_id BIGINT, persona_id BIGINT, cenario_id STRING",
    "template_prompt": "template_id BIGINT, missao_id BIGINT, prompt STRING",
}


def ensure_tables(spark: SparkSession, prefix: str = "") -> list[str]:
    """The engine's tables, created where they aren't there; run tables are partitioned by run, which stands for their indexes."""
    made = []
    for name, columns, by in [("simulation_runs", RUNS, ""), ("simulation_instances", INSTANCES, " PARTITIONED BY (run_id)"), *[(n, c, "") for n, c in SCENARIOS.items()]]:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet{by}")
        made.append(prefix + name)
    return made


def csv_text(rows: list[dict], columns: list[str]) -> str:
    """A few rows as CSV text with a header."""
    out = io.StringIO()
    w = csv.DictWriter(out, columns, extrasaction="ignore", lineterminator="\n")
    w.writeheader()
    w.writerows(rows)
    return out.getvalue()
