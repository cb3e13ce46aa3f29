"""Sources: sniffed CSV, dialogue JSON in files and ZIPs, SQLite tables."""

from __future__ import annotations

import csv
import io
import json
import re
import sqlite3
import zipfile
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-string CSV with a header; the delimiter , or ; by the first line; a row with fewer or more fields is an error."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path}: empty")
    sep = ";" if first[0].count(";") > first[0].count(",") else ","
    names = [n.strip() for n in next(csv.reader([first[0]], delimiter=sep))]
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = spark.read.option("sep", sep).option("header", True).schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", True).csv(path)
    rows = rows.cache()  # Spark can't read the column of bad rows alone
    if bad := rows.where("_bad IS NOT NULL").count():
        rows.unpersist()
        raise ValueError(f"{path}: {bad} rows without {len(names)} fields")
    rows.unpersist()
    return rows.drop("_bad")


def record(spark: SparkSession, path: str, i: int) -> dict:
    """One record of a CSV by its place (from 0)."""
    rows = read_csv(spark, path).limit(i + 1).collect() if i >= 0 else []
    if len(rows) <= i or i < 0:
        raise IndexError(f"no record {i} in {path}")
    return rows[i].asDict()


def read_scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of ;-separated files of two columns; the first line of each is its header."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "value")).where(F.col("value") != "").withColumn("parts", F.split("value", ";"))
    header = F.col("i") == 0
    good = lines.where((F.size("parts") == 2) & ~header).select(F.get("parts", F.lit(0)).alias("cenario_id"), F.get("parts", F.lit(1)).alias("dados_cenario"))
    return good, lines.where((F.size("parts") != 2) & ~header).select("value")


#: Bytes of dialogues from which a batch of read_zipped_json is passed on.
BATCH_BYTES = 8 << 20


def read_zipped_json(spark: SparkSession, path: str, member: str = r".*\.json") -> DataFrame:
    """file, member, body (JSON text) of the dialogues in ZIP files; lists are flattened, objects without messages left out. An archive is read
    as a whole, by one task; of what is in it a task holds one member and BATCH_BYTES of dialogues."""

    def dialogues(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.column(0)[i].as_py()
                with zipfile.ZipFile(pa.BufferReader(batch.column(1)[i].as_buffer())) as z:
                    for name in sorted(z.namelist()):
                        if re.fullmatch(member, name):
                            data = json.loads(z.read(name))
                            for d in data if isinstance(data, list) else [data]:
                                if isinstance(d, dict) and "messages" in d:
                                    yield file, name, json.dumps(d, ensure_ascii=False)

    def run(batches):
        rows, size = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["file", "member", "body"])
        for row in dialogues(batches):
            rows.append(row)
            size += len(row[2])
            if size >= BATCH_BYTES:
                yield made()
                rows, size = [], 0
        if rows:
            yield made()

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, member string, body string")


def read_personas(spark: SparkSession, folder: str) -> DataFrame:
    """persona_id (of personaN.json), dados (the text, whole); files of other names are left out."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^persona(\d+)\.json$", 1).alias("n"), "value")
    return files.where("n <> ''").select(F.try_to_number("n", F.lit("9" * 18)).cast("long").alias("persona_id"), F.col("value").alias("dados"))


def persona_fields(personas: DataFrame) -> DataFrame:
    """personas with fields: the record's string values, null where the text isn't an object."""
    return personas.withColumn("fields", F.from_json("dados", "map<string,string>"))


DIALOGUE = (
    "struct<thread_id:string,persona_id:string,messages:array<struct<index:int,type:string,content:string,simulated_timestamp:string,"
    "timing_metadata:struct<banco_generation_timestamp:string>,rag_datasources:array<string>>>>"
)


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """dialogue structs of JSON files that hold one object or a list; objects without messages are left out."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("body"))
    many = F.from_json("body", f"array<{DIALOGUE}>")
    rows = text.select(F.explode(F.when(F.col("body").startswith("["), many).otherwise(F.array(F.from_json("body", DIALOGUE)))).alias("dialogue"))
    return rows.where("dialogue.messages IS NOT NULL")


def read_touchpoints(spark: SparkSession, path: str) -> DataFrame:
    """touchpoint (upper case, distinct) of a catalog: a list of objects, or an object of such lists."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("body"))
    item = "struct<subtipo:string>"
    flat = F.flatten(F.map_values(F.from_json("body", f"map<string,array<{item}>>")))
    items = F.when(F.col("body").startswith("["), F.from_json("body", f"array<{item}>")).otherwise(flat)
    return text.select(F.explode(items).alias("t")).select(F.upper("t.subtipo").alias("touchpoint")).where("touchpoint IS NOT NULL").distinct()


def read_rag_sessions(spark: SparkSession, path: str) -> DataFrame:
    """log_id (file), ordinal, message, selected: the log lines of the session metadata in RAG-log ZIP files."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in [n for n in z.namelist() if n.startswith("session_metadata_")][:1]:
                        for m in json.loads(z.read(name)).get("messages", []):
                            for line in m.get("logs", []):
                                rows.append((file, m.get("index"), line.get("message", ""), (line.get("data") or {}).get("selected_datasource")))
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["log_id", "ordinal", "message", "selected"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "rag_logs_*.zip").load(path)
    return files.select("path", "content").mapInArrow(run, "log_id string, ordinal long, message string, selected string")


def list_rag_logs(spark: SparkSession, path: str) -> DataFrame:
    """log_id (file), modified, persona_id, log_thread, at of the RAG-log ZIP files of a folder, by their names."""
    from weft.operators.interactions import log_names

    files = spark.read.format("binaryFile").option("pathGlobFilter", "rag_logs_*.zip").load(path).select(F.col("path").alias("log_id"), F.col("modificationTime").alias("modified"))
    return log_names(files, "log_id")


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX, a line each."""
    import xml.etree.ElementTree as tree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = tree.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def pdf_text(content: bytes) -> str:
    """The literal strings that a PDF's plain or deflated streams show. No fonts are decoded: register another extractor for more."""
    out = []
    for raw in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        try:
            data = zlib.decompress(raw)
        except zlib.error:
            data = raw
        for shown in re.findall(rb"\[(.*?)\]\s*TJ|(\((?:\\.|[^\\()])*\))\s*Tj", data, re.S):
            parts = re.findall(rb"\(((?:\\.|[^\\()])*)\)", b"".join(shown))
            out.append(re.sub(rb"\\(.)", rb"\1", b"".join(parts)).decode("latin-1"))
    return "\n".join(out)


EXTRACTORS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".pdf": pdf_text}


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, subfolder (relative), text, error of the .pdf and .docx files below a folder; a file that can't be read has an error and no text. A
    missing folder gives no rows."""
    schema = "path string, subfolder string, text string, error string"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    root = fs.makeQualified(at).toString().rstrip("/")
    extractors = dict(EXTRACTORS)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = error = None
                try:
                    text = extractors["." + path.rsplit(".", 1)[-1].lower()](content)
                except Exception as e:  # one bad file is a row of its own
                    error = f"{type(e).__name__}: {e}"
                tail = re.sub(r"^[a-z0-9]+:/+", "/", path)[len(re.sub(r"^[a-z0-9]+:/+", "/", root)) :].strip("/")
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (path, tail.rpartition("/")[0], text, error)], ["path", "subfolder", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    ends = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    return files.where(ends.isin(*extractors)).mapInArrow(run, schema)


class _Rows(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        super().__init__((lo, hi))
        self.lo, self.hi = lo, hi


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema) -> None:
        self.path, self.table, self.names, self.parts = options["path"], options["dbtable"], schema.names, int(options.get("numpartitions", 4))

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            try:
                c.execute(f'SELECT rowid FROM "{self.table}" LIMIT 1')
            except sqlite3.OperationalError:  # a table WITHOUT ROWID is read by one task
                return [_Rows(None, None)]
            lo, hi = c.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [_Rows(a, min(hi, a + step - 1)) for a in range(lo, hi + 1, step)] or [_Rows(0, -1)]

    def read(self, partition):
        names = ", ".join(f'"{n}"' for n in self.names)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            if partition.lo is None:
                yield from c.execute(f'SELECT {names} FROM "{self.table}"')
            else:
                yield from c.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.lo, partition.hi))


class SqliteSource(DataSource):
    """spark.read.format("sqlite_ro").option("path", file).option("dbtable", table): rows by ranges of rowid, read only."""

    @classmethod
    def name(cls):
        return "sqlite_ro"

    def schema(self):
        kinds = {"INTEGER": "long", "INT": "long", "REAL": "double", "BLOB": "binary"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in c.execute(f'PRAGMA table_info("{self.options["dbtable"]}")'))

    def reader(self, schema):
        return _SqliteReader(self.options, schema)
