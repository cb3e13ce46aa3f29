"""The queries of the operators of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import chat, decontaminate, exact_dedup, language, line_dedup, lm_score, mixing, pii, simhash, tokens
from weft.llm.common import documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.extract(documents(spark, sf_dir)).drop("found")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(probe)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify_documents(docs, language.learn(docs)).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    return lm_score.score(documents(spark, sf_dir), held_out)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir), with_text=False)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_chat_format, op4_mixing, op5_exact_dedup, op6_token_counts, op7_language_id, op8_lm_score, op9_line_dedup, op10_simhash_near_dedup)}

SQL = {
    "op9_line_dedup": r"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM s),
t AS (SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) AS words FROM l),
w AS (SELECT * FROM t WHERE len(words) > 0),
f AS (SELECT words, min((doc_id, line_no)) AS place FROM w GROUP BY words),
r AS (SELECT row_number() OVER (ORDER BY place) AS id, words, len(words) AS n FROM f),
e AS (SELECT id, n, unnest(words) AS word FROM r),
p AS (
  SELECT y.id FROM e x JOIN e y ON x.word = y.word AND x.id < y.id AND x.n * 5 >= y.n * 4 AND y.n * 5 >= x.n * 4
  GROUP BY y.id, x.id, x.n, y.n HAVING count(*) * 5 >= 4 * (x.n + y.n - count(*))),
g AS (
  SELECT w.doc_id, w.line_no FROM w JOIN f USING (words) JOIN r USING (words)
  WHERE (w.doc_id, w.line_no) <> f.place OR r.id IN (SELECT id FROM p)),
a AS (SELECT doc_id, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS gone FROM g GROUP BY doc_id)
SELECT s.doc_id, len(lines)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(gone, '') AS removed_lines
FROM s LEFT JOIN a ON s.doc_id = a.doc_id""",
    "op3_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (7 + sum(16 + length(role) + length(regexp_replace(role, '[^<>\\]', '', 'g')) + length(text) + length(regexp_replace(text, '[^<\\]', '', 'g'))))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
sw AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::BIGINT AS w FROM s),
f AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS words,
         (sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS sum_w
  FROM sw),
o AS (SELECT max(sum_w) AS ow, arg_max(words, sum_w) AS owords FROM f WHERE words * w < 3 * source_size * sum_w),
t AS (SELECT source, source_size, CASE WHEN sum_w <= ow THEN (owords * w)::DOUBLE / ow ELSE 3.0::DOUBLE * source_size END AS target FROM f, o),
dl AS (SELECT *, (64 - CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END)::BIGINT AS w FROM d),
l AS (SELECT dl.source, w, sum(size)::BIGINT AS words, any_value(target) AS target FROM dl JOIN t ON dl.source IS NOT DISTINCT FROM t.source GROUP BY dl.source, w HAVING sum(size) > 0),
lf AS (
  SELECT *, target - 3 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rem,
         (sum(w * words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ww
  FROM l),
lo AS (SELECT source, max(w) AS ow, arg_max(rem, w) AS orem, arg_max(ww, w) AS oww FROM lf WHERE rem * w < 3 * ww GROUP BY source),
le AS (
  SELECT lf.source, lf.w, lf.words, lf.target, coalesce(CASE WHEN lf.w <= ow THEN orem * lf.w / oww END, 3.0::DOUBLE) AS e
  FROM lf LEFT JOIN lo ON lf.source IS NOT DISTINCT FROM lo.source),
r AS (SELECT source, any_value(target) - sum(floor(e)::BIGINT * words)::BIGINT AS rest FROM le GROUP BY source),
x AS (
  SELECT dl.doc_id, dl.source, dl.size, t.source_size, t.target, floor(coalesce(e, 0))::BIGINT AS certain, e - floor(e) AS part, rest,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':7'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM dl JOIN t ON dl.source IS NOT DISTINCT FROM t.source
  LEFT JOIN le ON dl.source IS NOT DISTINCT FROM le.source AND dl.w = le.w AND dl.size > 0
  LEFT JOIN r ON dl.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, CASE WHEN part > 0 AND size > 0 THEN u / (1 - u) / (part / (1 - part)) END AS rnk FROM x),
c AS (SELECT *, coalesce(sum(size) FILTER (rnk IS NOT NULL) OVER (PARTITION BY source ORDER BY rnk NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM k)
SELECT doc_id, size, source_size, target,
       size * (certain + CASE WHEN rnk IS NOT NULL AND bef + size / 2 <= rest THEN 1 ELSE 0 END) AS taken
FROM c""",
    "op5_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}
