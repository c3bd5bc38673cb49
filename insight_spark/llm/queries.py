"""Registered queries of the corpus operators: each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from insight_spark.llm import chat, credentials, decontamination, jaccard, lines, neardup, neighbours, packing, repair, substrings, tokencounts, toxicity, trie
from insight_spark.llm.common import prepare, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_benchmark_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10)


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_ngram_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), k=50)


LINES_SQL = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT doc_id, source, line, pos, trim(line, ' ' || chr(9) || chr(13)) AS k FROM lines),
common AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10),
marked AS (SELECT keyed.*, first IS NOT NULL AND doc_id > first AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""


@query("op9_line_dedup", LINES_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=10)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


@query("op4_approximate_nearest_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), k=10)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, x.turn, x.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(turn, role))
SELECT conv_id, count(*) AS n_turns, min(broken_at) AS broken_at,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<||>' || role) + CASE WHEN role IN ('system', 'user', 'assistant') THEN 0 ELSE length('role:') END
    + length('<|end|>') + 2 + length(text)
    + length(regexp_replace(text, '[^\\\\<\\[|]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t LEFT JOIN (
  SELECT conv_id, min(n) AS broken_at FROM (
    SELECT conv_id, role, row_number() OVER place - 1 AS n, lag(role, 1, '') OVER place AS state FROM t
    WINDOW place AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)) AS o
  WHERE (state, role) NOT IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))
  GROUP BY conv_id) AS b USING (conv_id)
GROUP BY conv_id
"""


@query("op8_chat_formatting", CHAT_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -1L AS conv_id, x.* FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(turn, role)")
    own = own.withColumn("text", F.lit("</s>[INST] ok [/INST]"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = chat.conversations(rows).withColumns(
        {"back": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("segments"))}
    )
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.col("broken_at").cast("long").alias("broken_at"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*credentials.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(kind) for kind in credentials.BASE),
        F.sha2(credentials.listed(base), 256).alias("base_sha256"),
        credentials.listed(F.col("spans")).alias("spans"),
    )


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = {"word_bpe_49k": "word_bpe_49k.json", "byte_bpe_50k": "byte_bpe_50k.tiktoken"}
    paths = {name: public_tokenizers.path(file) for name, file in versions.items()}
    return tokencounts.corpus_rollup(table(spark, sf_dir, "documents"), paths)


@query("op12_conversation_structure_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.repair_report(repair.damaged(rows), rows.select("conv_id"))


@query("op13_conversation_prefix_trie")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharing = F.crc32(F.col("conv_id").cast("string")) % 6
    base = F.col("conv_id") - F.col("conv_id") % 100
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), sharing, base)


@query("op11_embedding_near_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)
