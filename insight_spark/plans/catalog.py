"""Registered queries, each next to the SQL that gives the same rows.

Every query runs over its whole tables. Doubles that come out of sums are rounded on both sides,
since the order of additions differs between engines and runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from insight_spark.functions import fixed
from insight_spark.functions.scalars import (
    coerce_numeric,
    coerce_timestamp,
    decode_text,
    format_metric,
    lines_of,
    user_key,
)
from insight_spark.operators import (
    charts,
    cleaning,
    compare,
    forecast,
    kpis,
    metrics,
    outliers,
    profile,
    quality,
    reports,
    schema,
    users,
)
from insight_spark.plans.inputs import (
    DIRTY_SQL,
    PAYMENTS_SQL,
    PROFILES_SQL,
    REPORTS_SQL,
    RUNS_SQL,
    SALES_SQL,
    analysis_runs,
    conversation_reports,
    customer_profiles,
    dirty_orders,
    payment_payloads,
    sales_lines,
    table,
)
from insight_spark.session import shared_folder
from insight_spark.sources import csv, files, stores
from insight_spark.streaming import payments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 2) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def joined(df: DataFrame, *columns: str, sep: str = "|") -> DataFrame:
    """Lists as text, so that results compare by value."""
    return df.withColumns({c: F.array_join(c, sep) for c in columns})


DEDUPED_SQL = DIRTY_SQL + ", deduped AS (SELECT DISTINCT * FROM dirty)"
COUNTS_SQL = (
    DIRTY_SQL
    + """,
counts AS (
  SELECT count(*) AS n, count(o_orderstatus) AS s, count(o_totalprice) AS p,
    CAST(count(*) * 2 - count(o_orderstatus) - count(o_totalprice) AS BIGINT) AS missing,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS dups
  FROM dirty)"""
)
SCORE_SQL = (
    COUNTS_SQL
    + """,
scored AS (
  SELECT *, missing / (n * 7.0) AS missing_rate, dups / (n * 1.0) AS duplicate_rate,
    100 - least(35, CAST(floor(missing / CAST(n * 7 AS DOUBLE) * 100) AS INTEGER))
        - least(25, CAST(floor(dups / CAST(n AS DOUBLE) * 100) AS INTEGER)) - 4 AS score
  FROM counts)"""
)
CLEAN_SELECT = """o_orderkey, o_custkey, coalesce(o_orderstatus, 'Unknown') AS o_orderstatus,
  round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM deduped)), 4) AS o_totalprice,
  {date} AS o_orderdate, trim(o_orderpriority) AS o_orderpriority, channel"""
CLEANED_SQL = "WITH " + DEDUPED_SQL + " SELECT " + CLEAN_SELECT + " FROM deduped"


# --- Sources, sinks, stores ----------------------------------------------------------------


@query(
    "csv_ingest",
    f"""WITH {DIRTY_SQL} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority, channel FROM dirty""",
)
def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = csv.write_csv(dirty_orders(spark, sf_dir), shared_folder(spark, "csv_ingest"))
    return csv.read_csv(spark, path)


@query(
    "unique_columns",
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders",
)
def unique_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    repeated = orders.select(
        "o_orderkey", "o_custkey", F.col("o_custkey").alias("o_orderkey"), "o_totalprice", "o_orderdate",
        F.lit(0).alias("o_totalprice"),
    )
    return schema.unique_columns(repeated)


@query("text_ingest", "SELECT doc_id, text FROM documents")
def text_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    return docs.select("doc_id", decode_text(content).alias("text"))


@query(
    "text_lines",
    r"""WITH parts AS (
  SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0B\f\x1c\x1d\x1e\x85\x{2028}\x{2029}]') AS p FROM documents),
whole AS (
  SELECT doc_id, CASE WHEN len(p) > 1 AND p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM parts)
SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS line_no, unnest(p) AS text FROM whole""",
)
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.text_lines(table(spark, sf_dir, "documents"))


IMAGE_SHARES = 128


@query(
    "image_metadata",
    """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS image_width, label + 1 AS image_height
FROM embeddings""",
)
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a file with the header of a PNG for each vector, and reads their sizes back."""

    def field(value):
        return F.unhex(F.lpad(F.hex(value.cast("bigint")), 8, "0"))

    content = F.concat(
        F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), field(F.size("embedding")), field(F.col("label") + 1)
    )
    folder = shared_folder(spark, "image_metadata")
    # the text sink writes the bytes as they are, one folder for each vector; these lie in shares that are written,
    # committed and listed by a task each
    share = F.pmod(F.xxhash64("vec_id"), F.lit(IMAGE_SHARES)).alias("share")
    headers = table(spark, sf_dir, "embeddings").select(share, "vec_id", content.cast("string").alias("value"))
    dealt = headers.repartition(IMAGE_SHARES, "share")
    dealt.write.partitionBy("share", "vec_id").option("maxRecordsPerFile", 1).text(folder)
    images = files.read_image_metadata(spark, folder, "*.txt")
    number = F.regexp_extract("path", "vec_id=(-?[0-9]+)", 1).cast("bigint").alias("vec_id")
    return images.select(number, "image_width", "image_height")


SUFFIXES = ["csv", "XLSX", "xls", "txt", "docx", "pdf", "png", "jpg", "jpeg", "webp", "zip", "exe"]


@query(
    "file_inventory",
    f"""WITH named AS (
  SELECT page_id, {SUFFIXES}[CAST(page_id % 12 AS INTEGER) + 1] AS sfx,
    CAST(strlen(html) AS BIGINT) * 65536 AS length FROM pages),
routed AS (
  SELECT 'uploads/page_' || page_id || '.' || sfx AS path, length, lower(sfx) AS suffix,
    CASE WHEN lower(sfx) IN ('csv', 'xlsx', 'xls') THEN 'structured'
         WHEN lower(sfx) IN ('txt', 'docx', 'pdf', 'zip') THEN 'text'
         WHEN lower(sfx) IN ('png', 'jpg', 'jpeg', 'webp') THEN 'image' END AS mode FROM named)
SELECT path, length, suffix, mode, mode IS NOT NULL AS supported, length / 1048576.0 <= 200 AS size_ok,
  CASE WHEN length / 1048576.0 > 200
       THEN 'File is ' || format('{{:.1f}}', length / 1048576.0) || 'MB. Max allowed size is 200MB.'
       WHEN mode IS NULL THEN 'Unsupported file type.' ELSE '' END AS reason
FROM routed""",
)
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("page_id") % len(SUFFIXES)).cast("int"))
    name = F.concat(F.lit("uploads/page_"), F.col("page_id").cast("string"), F.lit("."), suffix)
    uploads = table(spark, sf_dir, "pages").select(
        name.alias("path"), (F.octet_length("html").cast("bigint") * 65536).alias("length")
    )
    return files.file_inventory(uploads)


@query("csv_export", CLEANED_SQL.format(date="strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"))
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = cleaning.apply_cleaning(dirty_orders(spark, sf_dir))
    path = csv.write_csv(cleaned, shared_folder(spark, "csv_export"))
    return rounded(csv.read_csv(spark, path), "o_totalprice", digits=4)


@query(
    "report_text_export",
    r"""SELECT unnest(CASE WHEN len(p) > 1 AND p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END) AS line
FROM (SELECT string_split_regex(text, '\r\n|\r|\n') AS p FROM conversations)""",
)
def report_text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "conversations").select(F.col("text").alias("report"))
    path = files.write_text(texts, shared_folder(spark, "report_text_export"))
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("report_records", f"WITH {REPORTS_SQL} SELECT * FROM records")
def report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.report_records(conversation_reports(spark, sf_dir), F.col("at"))


KEYED_SQL = (
    REPORTS_SQL
    + """,
stored AS (
  SELECT lower(trim(email)) AS email, report_id, file_name, analysis, translation, answer, doctor,
    created_at, substr(sha256(lower(trim(email))), 1, 20) AS user_key
  FROM records WHERE trim(email) <> '')"""
)


def stored_reports(spark: SparkSession, sf_dir: str, purpose: str) -> str:
    records = stores.report_records(conversation_reports(spark, sf_dir), F.col("at"))
    return stores.append_records(records, shared_folder(spark, purpose), "report_id")


def appended_again(spark: SparkSession, sf_dir: str, path: str) -> str:
    """The same job once more, which adds nothing."""
    records = stores.report_records(conversation_reports(spark, sf_dir), F.col("at"))
    return stores.append_records(records, path, "report_id")


@query("report_store", f"WITH {KEYED_SQL} SELECT * FROM stored")
def report_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = appended_again(spark, sf_dir, stored_reports(spark, sf_dir, "report_store"))
    return stores.list_records(spark, path, "report_id")


@query(
    "share_links",
    f"""WITH {REPORTS_SQL},
shared AS (
  SELECT substr(sha256(concat(file_name, chr(31), analysis, chr(31), chr(31), chr(31), email, chr(31), created_at)), 1, 16) AS share_id,
    file_name, analysis, '' AS translation, '' AS doctor, email AS shared_by, created_at
  FROM reports WHERE analysis <> '')
SELECT DISTINCT share_id, file_name, analysis, translation, doctor, lower(trim(shared_by)) AS shared_by, created_at,
  'https://reports.example.com?share=' || share_id AS link, substr(sha256(lower(trim(shared_by))), 1, 20) AS user_key
FROM shared WHERE trim(shared_by) <> ''""",
)
def share_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared records as their store has them."""
    links = stores.share_links(conversation_reports(spark, sf_dir), "https://reports.example.com", F.col("at"))
    path = stores.append_records(links, shared_folder(spark, "share_links"), "share_id", owner="shared_by")
    return stores.list_records(spark, path, "share_id")


SNAPSHOT_SQL = """SELECT '{email}' AS email,
  substr(sha256(concat_ws(chr(31), '{email}', '{file}', '2024-02-01T00:00:00Z', n, 7, missing, dups, 'Retail', score)), 1, 12) AS dashboard_id,
  '{file}' AS file_name, '2024-02-01T00:00:00Z' AS created_at, n AS "rows", CAST(7 AS BIGINT) AS columns,
  missing AS missing_values, dups AS duplicate_rows, 'Retail' AS industry_template,
  CAST(score AS BIGINT) AS data_quality_score FROM scored"""


def snapshot(spark: SparkSession, sf_dir: str, email: str, file_name: str) -> DataFrame:
    at = F.lit("2024-02-01").cast("timestamp_ntz")
    return stores.dashboard_snapshot(dirty_orders(spark, sf_dir), email, file_name, "Retail", at)


@query("dashboard_snapshot", f"WITH {SCORE_SQL} " + SNAPSHOT_SQL.format(email="ann@example.com", file="orders.csv"))
def dashboard_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir, "ann@example.com", "orders.csv")


@query(
    "snapshot_history",
    f"WITH {SCORE_SQL}, snaps AS ("
    + SNAPSHOT_SQL.format(email="ann@example.com", file="orders.csv")
    + " UNION ALL "
    + SNAPSHOT_SQL.format(email="local_user", file="orders_2.csv")
    + ") SELECT *, substr(sha256(email), 1, 20) AS user_key FROM snaps",
)
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "snapshot_history")
    for email, name in (("ann@example.com", "orders.csv"), ("", "orders_2.csv")):
        stores.append_records(snapshot(spark, sf_dir, email, name), path, "dashboard_id", keep_local=True)
    return stores.list_records(spark, path, "dashboard_id")


@query(
    "purge_user_data",
    f"""WITH {KEYED_SQL} SELECT * FROM stored WHERE email NOT IN (
  SELECT 'user' || c_custkey || '@example.com' FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def purge_user_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stored_reports(spark, sf_dir, "purge_user_data")
    requests = customer_profiles(spark, sf_dir).where("is_premium").select("email")
    stores.purge_store(spark, path, "report_id", requests)
    return stores.list_records(spark, path, "report_id")


# --- Projection, scalars, preview ----------------------------------------------------------


@query(
    "column_roles",
    f"""WITH {DIRTY_SQL}, n AS (SELECT count(*) AS n, count(o_orderstatus) AS s, count(o_totalprice) AS p FROM dirty)
SELECT * FROM (
  SELECT 0 AS ordinal, 'o_orderkey' AS "column", 'bigint' AS type, true AS is_numeric, false AS is_text, false AS is_date_like, CAST(0 AS BIGINT) AS missing FROM n
  UNION ALL SELECT 1, 'o_custkey', 'bigint', true, false, false, 0 FROM n
  UNION ALL SELECT 2, 'o_orderstatus', 'string', false, true, false, n - s FROM n
  UNION ALL SELECT 3, 'o_totalprice', 'double', true, false, false, n - p FROM n
  UNION ALL SELECT 4, 'o_orderdate', 'timestamp_ntz', false, false, true, 0 FROM n
  UNION ALL SELECT 5, 'o_orderpriority', 'string', false, true, false, 0 FROM n
  UNION ALL SELECT 6, 'channel', 'string', false, true, false, 0 FROM n)""",
)
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles with the missing count of each column."""
    data = dirty_orders(spark, sf_dir)
    stats = profile.column_stats(data).select("ordinal", "missing")
    return schema.column_roles(data).join(stats, "ordinal")


@query(
    "coerce_numeric",
    """WITH raw AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events),
written AS (
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN '$' || k WHEN 1 THEN k || 'd' WHEN 2 THEN ' ' || k || ' '
    WHEN 3 THEN k || 'e1' WHEN 4 THEN k || ',000' ELSE k END AS text FROM raw)
SELECT event_id, text, CASE WHEN event_id % 6 IN (0, 1, 4) THEN NULL ELSE CAST(trim(text) AS DOUBLE) END AS number
FROM written""",
)
def coerce_numeric_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, rule = F.get_json_object("props", "$.k"), F.col("event_id") % 6
    text = (
        F.when(rule == 0, F.concat(F.lit("$"), k))
        .when(rule == 1, F.concat(k, F.lit("d")))
        .when(rule == 2, F.concat(F.lit(" "), k, F.lit(" ")))
        .when(rule == 3, F.concat(k, F.lit("e1")))
        .when(rule == 4, F.concat(k, F.lit(",000")))
        .otherwise(k)
    )
    written = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return written.withColumn("number", coerce_numeric(F.col("text")))


@query(
    "coerce_datetime",
    """WITH written AS (
  SELECT o_orderkey, o_orderdate, CASE o_orderkey % 10 WHEN 0 THEN 'unknown'
    WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 4 THEN strftime(o_orderdate, ' %b %d, %Y ')
    WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.250Z') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS text
  FROM orders)
SELECT o_orderkey, text, CASE WHEN o_orderkey % 10 IN (0, 3) THEN NULL WHEN o_orderkey % 10 = 5 THEN o_orderdate + INTERVAL 250 MILLISECOND
  ELSE o_orderdate END AS order_time
FROM written""",
)
def coerce_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.col("o_orderkey") % 10
    text = (
        F.when(rule == 0, F.lit("unknown"))
        .when(rule == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(rule == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(rule == 3, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(rule == 4, F.date_format("o_orderdate", " MMM dd, yyyy "))
        .when(rule == 5, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.250'Z'"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    )
    written = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return written.withColumn("order_time", coerce_timestamp(F.col("text")))


@query("preview", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 50")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.preview(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], 50)


@query(
    "content_summary",
    """WITH shown AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 10),
lines AS (SELECT string_agg(CAST(to_json(s) AS VARCHAR), chr(10) ORDER BY s.c_custkey) AS p FROM shown s)
SELECT (SELECT count(*) FROM customer) AS "rows", 5 AS columns,
  'c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment' AS column_names, p AS preview,
  chr(10) || 'Structured dataset shape: ' || (SELECT count(*) FROM customer) || ' rows x 5 columns' || chr(10)
  || 'Columns: c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment' || chr(10)
  || 'Preview:' || chr(10) || p || chr(10) AS summary
FROM lines""",
)
def content_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(reports.content_summary(table(spark, sf_dir, "customer"), ["c_custkey"]), "preview", sep="\n")


@query(
    "text_summary",
    r"""WITH parts AS (
  SELECT doc_id, text, doc_id % 3 AS kind, string_split_regex(text, '\r\n|[\n\r\x0B\f\x1c\x1d\x1e\x85\x{2028}\x{2029}]') AS p FROM documents),
sized AS (SELECT *, CASE WHEN len(p) > 1 AND p[len(p)] = '' THEN len(p) - 1 ELSE len(p) END AS n FROM parts)
SELECT doc_id, CASE WHEN kind < 2
  THEN chr(10) || 'Text dataset shape: ' || n || ' rows x 1 columns' || chr(10) || 'Text preview:' || chr(10) || substr(text, 1, 5000) || chr(10)
  ELSE chr(10) || 'Image metadata table shape: 1 rows x 2 columns' || chr(10) || 'OCR preview:' || chr(10) || substr(text, 1, 3000) || chr(10)
  END AS summary FROM sized""",
)
def text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_text = F.col("doc_id") % 3 < 2
    summary = reports.text_summary(
        F.col("text"),
        F.when(is_text, "text").otherwise("image"),
        F.when(is_text, F.size(lines_of(F.col("text")))).otherwise(1),
        F.when(is_text, 1).otherwise(2),
    )
    return table(spark, sf_dir, "documents").select("doc_id", summary.alias("summary"))


@query(
    "format_metrics",
    """SELECT l_orderkey, l_linenumber,
  '$' || format('{:,.2f}', l_extendedprice) AS price, format('{:,.2f}', l_discount * 100) || '%' AS discount,
  format('{:,d}', CAST(round_even(l_quantity, 0) AS BIGINT)) AS quantity,
  format('{:,.2f}', l_tax) AS tax, CASE WHEN l_returnflag = 'R' THEN 'N/A' ELSE '$' || format('{:,.2f}', l_tax) END AS kept
FROM lineitem""",
)
def format_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shown(value, fmt):
        return format_metric(value, F.lit(fmt))

    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        shown(F.col("l_extendedprice"), "currency").alias("price"),
        shown(F.col("l_discount"), "percent").alias("discount"),
        shown(F.col("l_quantity"), "integer").alias("quantity"),
        shown(F.col("l_tax"), "number").alias("tax"),
        shown(F.when(F.col("l_returnflag") != "R", F.col("l_tax")), "currency").alias("kept"),
    )


@query(
    "user_keys",
    """SELECT c_custkey, ' ' || upper(c_name) || '@Example.com ' AS email,
  substr(sha256(lower(c_name) || '@example.com'), 1, 20) AS user_key FROM customer""",
)
def user_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    email = F.concat(F.lit(" "), F.upper("c_name"), F.lit("@Example.com "))
    named = table(spark, sf_dir, "customer").select("c_custkey", email.alias("email"))
    return named.withColumn("user_key", user_key(F.col("email")))


@query(
    "scenario",
    f"""WITH base AS (SELECT sum(o_totalprice) AS b FROM orders),
p AS (SELECT unnest([-100.0, -25.0, 0.0, 10.0, 100.0]) AS p)
SELECT round(b, 2) AS base_value, CAST(p AS DOUBLE) AS change_percent, round(b * (1 + p / 100), 2) AS adjusted_value,
  round(b * (1 + p / 100) - b, 2) AS difference,
  CASE WHEN p > 0 THEN '{fixed.SCENARIO_UP}' WHEN p < 0 THEN '{fixed.SCENARIO_DOWN}' ELSE '{fixed.SCENARIO_FLAT}' END AS meaning
FROM base, p""",
)
def scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = kpis.scenario(table(spark, sf_dir, "orders"), "o_totalprice", [-100, -25, 0, 10, 100])
    return rounded(outcome, "base_value", "adjusted_value", "difference")


# --- Profiling and quality -----------------------------------------------------------------


@query("profile_shape", f'WITH {DIRTY_SQL} SELECT count(*) AS "rows", CAST(7 AS BIGINT) AS columns FROM dirty')
def profile_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_shape(dirty_orders(spark, sf_dir))


@query(
    "missing_profile",
    f"""WITH {COUNTS_SQL}
SELECT ordinal, "column", CAST(missing AS BIGINT) AS missing, round(missing / CAST(cells AS DOUBLE), 8) AS missing_rate FROM (
  SELECT 0 AS ordinal, 'o_orderkey' AS "column", 0 AS missing, n AS cells FROM counts
  UNION ALL SELECT 1, 'o_custkey', 0, n FROM counts
  UNION ALL SELECT 2, 'o_orderstatus', n - s, n FROM counts
  UNION ALL SELECT 3, 'o_totalprice', n - p, n FROM counts
  UNION ALL SELECT 4, 'o_orderdate', 0, n FROM counts
  UNION ALL SELECT 5, 'o_orderpriority', 0, n FROM counts
  UNION ALL SELECT 6, 'channel', 0, n FROM counts
  UNION ALL SELECT 7, NULL, missing, n * 7 FROM counts)""",
)
def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.missing_profile(dirty_orders(spark, sf_dir)), "missing_rate", digits=8)


@query(
    "duplicate_profile",
    f"""WITH {COUNTS_SQL} SELECT n AS "rows", dups AS duplicate_rows,
  round(dups / CAST(n AS DOUBLE), 8) AS duplicate_rate FROM counts""",
)
def duplicate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.duplicate_profile(dirty_orders(spark, sf_dir)), "duplicate_rate", digits=8)


@query(
    "duplicate_profile_pruned",
    f"""WITH {COUNTS_SQL} SELECT n AS "rows", dups AS duplicate_rows,
  round(dups / CAST(n AS DOUBLE), 8) AS duplicate_rate FROM counts""",
)
def duplicate_profile_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.duplicate_profile(dirty_orders(spark, sf_dir)), "duplicate_rate", digits=8)


METRICS_SQL = (
    SALES_SQL
    + """,
m AS (
  SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sales)) AS d,
    sum(Sales) AS s, sum(Customers) AS c, sum(Returns) AS r FROM sales),
vals AS (
  SELECT 0 AS ordinal, 'record_count' AS key, CAST(n AS DOUBLE) AS v, format('{:,d}', n) AS f FROM m
  UNION ALL SELECT 1, 'column_count', 6.0, '6' FROM m
  UNION ALL SELECT 2, 'missing_value_rate', 0.0, '0.00%' FROM m
  UNION ALL SELECT 3, 'duplicate_rate', d / CAST(n AS DOUBLE), format('{:,.2f}', d / CAST(n AS DOUBLE) * 100) || '%' FROM m
  UNION ALL SELECT 4, 'revenue', s, '$' || format('{:,.2f}', s) FROM m
  UNION ALL SELECT 5, 'customers', c, format('{:,d}', CAST(round_even(c, 0) AS BIGINT)) FROM m
  UNION ALL SELECT 6, 'returns', CAST(r AS DOUBLE), format('{:,d}', CAST(r AS BIGINT)) FROM m)"""
)


@query(
    "metric_availability",
    f"""WITH {METRICS_SQL} SELECT ordinal, key,
  {[m[1] for m in fixed.METRICS]}[ordinal + 1] AS label, key <> 'returns' AS available,
  CASE WHEN key = 'returns' THEN 'Returns' ELSE '' END AS missing_columns,
  CASE WHEN key = 'returns' THEN NULL WHEN key = 'column_count' THEN 5.0 ELSE round(v, 2) END AS raw_value
FROM vals WHERE key <> 'duplicate_rate'
UNION ALL SELECT 3, 'duplicate_rate', 'Duplicate Rate', true, '',
  round((SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (Returns) FROM sales))) / CAST(count(*) AS DOUBLE) FROM sales), 2)""",
)
def metric_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability on line items without a returns column, with the value where there is one."""
    lines = sales_lines(spark, sf_dir).drop("Returns")
    values = metrics.semantic_metrics(lines).select("ordinal", F.round("raw_value", 2).alias("raw_value"))
    return joined(metrics.metric_availability(lines), "missing_columns").join(values, "ordinal", "left")


@query(
    "semantic_metrics",
    f"""WITH {METRICS_SQL} SELECT ordinal, key, {[m[1] for m in fixed.METRICS]}[ordinal + 1] AS label,
  {[m[2] for m in fixed.METRICS]}[ordinal + 1] AS description, round(v, 2) AS raw_value, f AS formatted_value,
  CASE WHEN ordinal < 2 THEN '' WHEN ordinal < 4 THEN 'Sales|Customers|Returns|l_orderkey|l_linenumber|l_shipdate'
    ELSE ['Sales', 'Customers', 'Returns'][ordinal - 3] END AS source_columns
FROM vals""",
)
def semantic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = metrics.semantic_metrics(sales_lines(spark, sf_dir))
    return joined(rounded(values, "raw_value"), "source_columns")


@query(
    "constant_columns",
    f"""WITH {DIRTY_SQL} SELECT 6 AS ordinal, 'channel' AS "column" FROM dirty HAVING count(DISTINCT channel) = 1
UNION ALL SELECT 1, 'o_custkey' FROM dirty HAVING count(DISTINCT o_custkey) <= 1
UNION ALL SELECT 2, 'o_orderstatus' FROM dirty HAVING count(DISTINCT coalesce(o_orderstatus, '?')) <= 1""",
)
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.constant_columns(dirty_orders(spark, sf_dir))


def _outlier_branch(i: int, c: str) -> str:
    return f"""SELECT {i} AS ordinal, '{c}' AS "column", count({c}) AS n, quantile_cont({c}, 0.25) AS q1,
    quantile_cont({c}, 0.75) AS q3, list({c}) AS vals FROM dirty"""


OUTLIERS_SQL = (
    DIRTY_SQL
    + ", q AS ("
    + " UNION ALL ".join(
        _outlier_branch(i, c).replace(f"list({c})", f"list(CAST({c} AS DOUBLE))")
        for i, c in enumerate(["o_orderkey", "o_custkey", "o_totalprice"])
    )
    + """),
fences AS (
  SELECT ordinal, "column", n, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, vals FROM q),
found AS (
  SELECT ordinal, "column", n AS "values", q1, q3, lower, upper,
    CAST(len(list_filter(vals, lambda x: x < lower OR x > upper)) AS BIGINT) AS outliers FROM fences)"""
)


@query(
    "iqr_outliers",
    f"""WITH {OUTLIERS_SQL} SELECT ordinal, "column", "values", round(q1, 4) AS q1, round(q3, 4) AS q3,
  round(lower, 4) AS lower, round(upper, 4) AS upper, outliers FROM found""",
)
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(outliers.iqr_outliers(dirty_orders(spark, sf_dir)), "q1", "q3", "lower", "upper", digits=4)


NOTES_SQL = """'Missing values affect ' || format('{:.1f}', missing / CAST(n * 7 AS DOUBLE) * 100) || '% of cells.|Duplicate rows affect '
  || format('{:.1f}', dups / CAST(n AS DOUBLE) * 100) || '% of records.|Constant columns detected: channel'"""


@query(
    "quality_score",
    f"""WITH {SCORE_SQL} SELECT n AS "rows", CAST(7 AS BIGINT) AS columns, missing AS missing_cells,
  round(missing / CAST(n * 7 AS DOUBLE), 8) AS missing_rate, dups AS duplicate_rows,
  round(dups / CAST(n AS DOUBLE), 8) AS duplicate_rate, 'channel' AS constant_columns, score, {NOTES_SQL} AS notes
FROM scored""",
)
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_score(dirty_orders(spark, sf_dir)).drop("stats")
    return joined(rounded(scored, "missing_rate", "duplicate_rate", digits=8), "constant_columns", "notes")


@query(
    "readiness",
    f"""WITH {SCORE_SQL} SELECT score,
  CASE WHEN score >= 85 THEN 'ready' WHEN score >= 65 THEN 'cleaning_recommended' ELSE 'needs_cleaning' END AS band,
  CASE WHEN score >= 85 THEN '{fixed.READY}' WHEN score >= 65 THEN '{fixed.CLEANING_RECOMMENDED}'
    ELSE '{fixed.NEEDS_CLEANING}' END AS message,
  3 AS numeric_fields, 3 AS text_fields, 1 AS date_fields, {NOTES_SQL} AS notes FROM scored""",
)
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(quality.readiness(dirty_orders(spark, sf_dir)), "notes")


@query(
    "executive_dashboard",
    f"""WITH {COUNTS_SQL} SELECT n AS "rows", CAST(7 AS BIGINT) AS columns, missing, dups AS duplicates,
  '{fixed.INSIGHT_MISSING}|{fixed.INSIGHT_DUPLICATES}' AS insights FROM counts""",
)
def executive_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(reports.executive_dashboard(dirty_orders(spark, sf_dir)), "insights")


@query(
    "executive_metrics",
    f"""WITH {METRICS_SQL} SELECT ordinal, key, f AS formatted_value FROM vals""",
)
def executive_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.executive_metrics(sales_lines(spark, sf_dir)).select("ordinal", "key", "formatted_value")


@query(
    "industry_kpis",
    f"""WITH {SALES_SQL}, k AS (
  SELECT count(*) AS n, sum(Sales) AS s, avg(Sales) AS a, max(Sales) AS m, sum(Customers) AS c FROM sales)
SELECT industry, CAST(ordinal AS INTEGER) AS ordinal, label, round(CAST(value AS DOUBLE), 2) AS value FROM (
  SELECT 'Finance' AS industry, 0 AS ordinal, 'Total Value' AS label, s AS value FROM k
  UNION ALL SELECT 'Finance', 1, 'Average Value', a FROM k
  UNION ALL SELECT 'Finance', 2, 'Maximum Value', m FROM k
  UNION ALL SELECT 'Marketing', 0, 'Performance Total', s FROM k
  UNION ALL SELECT 'Marketing', 1, 'Average Performance', a FROM k
  UNION ALL SELECT 'Marketing', 2, 'Growth Signal', c FROM k
  UNION ALL SELECT 'Sales', 0, 'Sales Signal', s FROM k
  UNION ALL SELECT 'Sales', 1, 'Average Sale Signal', a FROM k
  UNION ALL SELECT 'Sales', 2, 'Peak Value', m FROM k
  UNION ALL SELECT 'Logistics', 0, 'Volume Processed', s FROM k
  UNION ALL SELECT 'Logistics', 1, 'Operational Average', a FROM k
  UNION ALL SELECT 'Logistics', 2, 'Capacity Signal', c FROM k
  UNION ALL SELECT 'Healthcare', 0, 'Activity Volume', s FROM k
  UNION ALL SELECT 'Healthcare', 1, 'Average Measure', a FROM k
  UNION ALL SELECT i, 0, 'Rows', n FROM k, (SELECT unnest(['General Business', 'Education', 'Retail', 'Operations']) AS i)
  UNION ALL SELECT i, 1, 'Columns', 6 FROM k, (SELECT unnest(['General Business', 'Education', 'Retail', 'Operations']) AS i)
  UNION ALL SELECT i, 2, 'Missing Values', 0 FROM k, (SELECT unnest(['General Business', 'Education', 'Retail', 'Operations']) AS i))""",
)
def industry_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(kpis.industry_kpis(sales_lines(spark, sf_dir)), "value")


@query(
    "auto_dashboard",
    f"""WITH {SALES_SQL} SELECT 'Sales' AS "column", round(sum(Sales), 2) AS total, round(avg(Sales), 4) AS mean,
  max(Sales) AS max, min(Sales) AS min FROM sales""",
)
def auto_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = kpis.auto_dashboard(sales_lines(spark, sf_dir))
    return rounded(rounded(summary, "total"), "mean", digits=4)


@query(
    "histogram",
    """WITH lim AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 10 AS w FROM orders),
c AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 9) AS INTEGER) AS bin, count(*) AS n FROM orders, lim GROUP BY 1),
b AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin)
SELECT b.bin, round(lo + b.bin * w, 4) AS bin_start, round(lo + (b.bin + 1) * w, 4) AS bin_end, coalesce(c.n, 0) AS n
FROM lim, b LEFT JOIN c ON b.bin = c.bin""",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(charts.histogram(table(spark, sf_dir, "orders"), "o_totalprice"), "bin_start", "bin_end", digits=4)


@query(
    "trend_series",
    f"WITH {DIRTY_SQL} SELECT o_orderkey, o_orderdate, coalesce(o_totalprice, 0) AS trend_value FROM dirty",
)
def trend_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.trend_series(dirty_orders(spark, sf_dir), ["o_orderkey", "o_orderdate"], "o_totalprice")


@query(
    "trend_buckets",
    f"""WITH {DIRTY_SQL}, k AS (SELECT o_orderdate AS key, epoch_us(o_orderdate)::DOUBLE AS k, coalesce(o_totalprice, 0) AS v FROM dirty),
lim AS (SELECT min(k) AS lo, (max(k) - min(k)) / 50 AS w FROM k)
SELECT CAST(least(floor((k - lo) / w), 49) AS INTEGER) AS bucket, min(key) AS first_key, max(key) AS last_key, count(*) AS n,
  round(avg(v), 4) AS mean_value FROM k, lim GROUP BY 1""",
)
def trend_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(charts.trend_buckets(dirty_orders(spark, sf_dir), "o_orderdate", "o_totalprice", 50), "mean_value", digits=4)


COMPARE_SQL = """a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
b AS (SELECT * EXCLUDE (o_orderpriority) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
sa AS (SELECT count(*) AS n, avg(o_custkey) AS c, avg(o_orderkey) AS k, avg(o_totalprice) AS p FROM a),
sb AS (SELECT count(*) AS n, avg(o_custkey) AS c, avg(o_orderkey) AS k, avg(o_totalprice) AS p FROM b)"""


@query(
    "compare_frames",
    f"""WITH {COMPARE_SQL}, v AS (
  SELECT 0 AS ordinal, 'rows' AS item, CAST(sa.n AS DOUBLE) AS a_value, CAST(sb.n AS DOUBLE) AS b_value FROM sa, sb
  UNION ALL SELECT 1, 'columns', 6, 5
  UNION ALL SELECT 2, 'o_custkey', sa.c, sb.c FROM sa, sb
  UNION ALL SELECT 3, 'o_orderkey', sa.k, sb.k FROM sa, sb
  UNION ALL SELECT 4, 'o_totalprice', sa.p, sb.p FROM sa, sb)
SELECT ordinal, item, round(a_value, 2) AS a_value, round(b_value, 2) AS b_value, round(b_value - a_value, 2) AS change FROM v""",
)
def compare_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.compare_frames(*_early_and_late(spark, sf_dir)), "a_value", "b_value", "change")


def _early_and_late(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    turn = F.lit("1998-01-01").cast("timestamp_ntz")
    return orders.where(F.col("o_orderdate") < turn), orders.where(F.col("o_orderdate") >= turn).drop("o_orderpriority")


@query(
    "comparison_text",
    f"""WITH {COMPARE_SQL} SELECT 'Comparison Summary' || chr(10) || '------------------' || chr(10)
  || 'File A shape: ' || sa.n || ' rows × 6 columns' || chr(10) || 'File B shape: ' || sb.n || ' rows × 5 columns' || chr(10)
  || 'Row difference: ' || (sb.n - sa.n) || chr(10) || 'Column difference: -1' || chr(10) || chr(10)
  || 'Shared Numeric Column Changes:' || chr(10)
  || format('- o_custkey: mean {{:.2f}} → {{:.2f}} (Δ {{:.2f}})', sa.c, sb.c, sb.c - sa.c) || chr(10)
  || format('- o_orderkey: mean {{:.2f}} → {{:.2f}} (Δ {{:.2f}})', sa.k, sb.k, sb.k - sa.k) || chr(10)
  || format('- o_totalprice: mean {{:.2f}} → {{:.2f}} (Δ {{:.2f}})', sa.p, sb.p, sb.p - sa.p) AS comparison FROM sa, sb""",
)
def comparison_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.comparison_text(*_early_and_late(spark, sf_dir))


@query(
    "cleaning_summary",
    f"""WITH {COUNTS_SQL} SELECT missing AS missing_before, CAST(0 AS BIGINT) AS missing_after, dups AS duplicates_before,
  CAST(0 AS BIGINT) AS duplicates_after, 'Missing values: ' || missing || ' → 0. Duplicate rows: ' || dups
  || ' → 0. {fixed.CLEANING_EFFECT}' AS summary FROM counts""",
)
def cleaning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cleaning_effect(dirty_orders(spark, sf_dir))


FINDINGS_SQL = (
    OUTLIERS_SQL
    + """, o AS (SELECT string_agg("column" || ': ' || outliers || ' possible outliers', '; ' ORDER BY ordinal) AS t FROM found WHERE outliers > 0),
counts AS (
  SELECT CAST(count(*) * 2 - count(o_orderstatus) - count(o_totalprice) AS BIGINT) AS missing,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS dups FROM dirty)"""
)
FIX_TEXTS = {
    k: v.replace("'", "''")
    for k, v in {
        "numeric": fixed.FIX_NUMERIC_GAPS,
        "text": fixed.FIX_TEXT_GAPS,
        "dups": fixed.FIX_DUPLICATES,
        "out": fixed.FIX_OUTLIERS,
        "const": fixed.FIX_CONSTANTS,
    }.items()
}


@query(
    "doctor_findings",
    f"""WITH {FINDINGS_SQL} SELECT 0 AS ordinal, 'missing' AS kind, 'Missing values detected: ' || missing AS issue,
  '{FIX_TEXTS["numeric"]}|{FIX_TEXTS["text"]}' AS recommendations FROM counts
UNION ALL SELECT 1, 'duplicates', 'Duplicate rows detected: ' || dups, '{FIX_TEXTS["dups"]}' FROM counts
UNION ALL SELECT 2, 'outliers', 'Possible outliers detected: ' || t, '{FIX_TEXTS["out"]}' FROM o
UNION ALL SELECT 3, 'constants', 'Constant columns detected: channel', '{FIX_TEXTS["const"]}'""",
)
def doctor_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(reports.doctor_findings(dirty_orders(spark, sf_dir)), "recommendations")


@query(
    "doctor_report",
    f"""WITH {FINDINGS_SQL} SELECT 'AI Data Doctor Findings' || chr(10) || '-----------------------' || chr(10)
  || '- Missing values detected: ' || missing || chr(10) || '- Duplicate rows detected: ' || dups || chr(10)
  || '- Possible outliers detected: ' || t || chr(10) || '- Constant columns detected: channel' || chr(10) || chr(10)
  || 'Recommended Fixes' || chr(10) || '-----------------' || chr(10)
  || '- {FIX_TEXTS["numeric"]}' || chr(10) || '- {FIX_TEXTS["text"]}' || chr(10) || '- {FIX_TEXTS["dups"]}' || chr(10)
  || '- {FIX_TEXTS["out"]}' || chr(10) || '- {FIX_TEXTS["const"]}' AS doctor FROM counts, o""",
)
def doctor_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.doctor_report(dirty_orders(spark, sf_dir))


def _decision_sql(missing: str, duplicates: str) -> str:
    head, middle, tail = (
        part.replace("'", "''").replace("\n", "' || chr(10) || '")
        for part in fixed.DECISION_REPORT.replace("{missing}", "\0").replace("{duplicates}", "\0").split("\0")
    )
    return f"'{head}' || {missing} || '{middle}' || {duplicates} || '{tail}'"


@query(
    "decision_report",
    f"WITH {COUNTS_SQL} SELECT {_decision_sql('missing', 'dups')} AS decision_report FROM counts",
)
def decision_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.decision_report(dirty_orders(spark, sf_dir))


@query(
    "boardroom_report",
    f"""WITH p AS (
  SELECT lang AS dataset_id, count(*) AS n, count(*) - count(DISTINCT (source, text)) AS d FROM documents GROUP BY 1),
m AS (SELECT *, CASE WHEN dataset_id = 'en' THEN NULL ELSE {_decision_sql("'0'", "d")} END AS dec FROM p)
SELECT dataset_id, 'Boardroom Report' || chr(10) || chr(10) || 'File: ' || CASE WHEN dataset_id = 'en' THEN '' ELSE dataset_id || '.csv' END
  || chr(10) || 'Rows: ' || n || chr(10) || 'Columns: 2' || chr(10) || 'Missing Values: 0' || chr(10) || 'Duplicate Rows: ' || d
  || chr(10) || chr(10) || 'Executive Insights' || chr(10) || '------------------' || chr(10) || '{fixed.NO_INSIGHTS}' || chr(10) || chr(10)
  || 'Data Doctor Findings' || chr(10) || '--------------------' || chr(10) || '{fixed.NO_FINDINGS}' || chr(10) || chr(10)
  || 'Decision Engine' || chr(10) || '---------------' || chr(10) || coalesce(dec, '{fixed.NO_DECISION}') || chr(10) AS report FROM m""",
)
def boardroom_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per language of the documents; English has no report parts yet."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("lang", "dataset_id")
    profiles = reports.profile_by(docs, "dataset_id", ["source", "text"])
    parts = profiles.where("dataset_id <> 'en'").select(
        "dataset_id",
        F.concat("dataset_id", F.lit(".csv")).alias("file_name"),
        F.lit(None).cast("string").alias("analysis"),
        F.lit(None).cast("string").alias("doctor"),
        reports.decision_text(F.col("missing_cells"), F.col("duplicate_rows")).alias("decision"),
    )
    return reports.boardroom_report(profiles, parts)


# --- Cleaning ------------------------------------------------------------------------------


@query("clean_dedupe", f"WITH {DIRTY_SQL} SELECT DISTINCT * FROM dirty")
def clean_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.drop_duplicates(dirty_orders(spark, sf_dir))


@query("clean_dedupe_pruned", f"WITH {DIRTY_SQL} SELECT DISTINCT * FROM dirty")
def clean_dedupe_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.drop_duplicates(dirty_orders(spark, sf_dir))


@query(
    "clean_fill_numeric",
    f"""WITH {DIRTY_SQL} SELECT * EXCLUDE (o_totalprice),
  round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM dirty)), 4) AS o_totalprice FROM dirty""",
)
def clean_fill_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.fill_numeric(dirty_orders(spark, sf_dir)), "o_totalprice", digits=4)


@query(
    "clean_fill_numeric_narrowed",
    f"""WITH {DIRTY_SQL} SELECT * EXCLUDE (o_totalprice),
  round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM dirty)), 4) AS o_totalprice FROM dirty""",
)
def clean_fill_numeric_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the gap columns given, so that no scan looks for them."""
    filled = cleaning.fill_numeric(dirty_orders(spark, sf_dir), ["o_totalprice"])
    return rounded(filled, "o_totalprice", digits=4)


@query(
    "clean_fill_text",
    f"""WITH {DIRTY_SQL} SELECT * EXCLUDE (o_orderstatus), coalesce(o_orderstatus, 'Unknown') AS o_orderstatus FROM dirty""",
)
def clean_fill_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.fill_text(dirty_orders(spark, sf_dir))


@query(
    "clean_trim",
    f"WITH {DIRTY_SQL} SELECT * EXCLUDE (o_orderpriority), trim(o_orderpriority) AS o_orderpriority FROM dirty",
)
def clean_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.trim_texts(dirty_orders(spark, sf_dir))


@query(
    "clean_dates",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_shipdate END AS ship_date,
  make_timestamp(l_orderkey * 1000) AS epoch_date FROM lineitem""",
)
def clean_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text dates of several spellings (some unreadable) and epoch numbers; only columns named as dates change."""
    rule = F.col("l_orderkey") % 10
    text = (
        F.when(rule == 0, "n/k")
        .when(rule == 1, F.date_format("l_shipdate", "MM/dd/yyyy"))
        .when(rule == 2, F.date_format("l_shipdate", " yyyy-MM-dd'T'HH:mm:ssXXX"))
        .when(rule == 3, F.date_format("l_shipdate", "d MMM yyyy"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        text.alias("ship_date"),
        (F.col("l_orderkey") * 1000000).alias("epoch_date"),
    )
    return cleaning.standardise_dates(lines)


@query("apply_cleaning", CLEANED_SQL.format(date="o_orderdate"))
def apply_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.apply_cleaning(dirty_orders(spark, sf_dir)), "o_totalprice", digits=4)


@query("auto_fix", CLEANED_SQL.format(date="o_orderdate"))
def auto_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.auto_fix(dirty_orders(spark, sf_dir)), "o_totalprice", digits=4)


@query(
    "auto_fix_actions",
    f"""WITH {COUNTS_SQL} SELECT 0 AS ordinal, 'Removed ' || dups || ' duplicate rows.' AS action FROM counts
UNION ALL SELECT 1, 'Filled missing numeric values in ''o_totalprice'' with median.'
UNION ALL SELECT 2, 'Filled missing text values in ''o_orderstatus'' with ''Unknown''.'
UNION ALL SELECT 3, 'Standardized date/time column ''o_orderdate''.'""",
)
def auto_fix_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.auto_fix_actions(dirty_orders(spark, sf_dir))


# --- Time series ---------------------------------------------------------------------------


def _forecast_sql(source: str, periods: int = 6, group: str = "") -> str:
    g = f"{group}, " if group else ""
    by = f"PARTITION BY {group} " if group else ""
    grouped = f"GROUP BY {group}" if group else ""
    return f"""WITH s AS ({source}),
i AS (SELECT *, row_number() OVER ({by}ORDER BY date) - 1 AS t FROM s),
m AS (SELECT {g}count(*) AS n, regr_slope(value, t) AS b, regr_intercept(value, t) AS a, max(date) AS last FROM i {grouped}),
r AS (SELECT {g}stddev_pop(value - (a + b * t)) AS band FROM i {"JOIN m USING (" + group + ")" if group else ", m"} {grouped}),
k AS (SELECT unnest(range(1, {periods + 1})) AS k)
SELECT {g}date_trunc('month', last) + to_months(CAST(k + CASE WHEN day(last) = 1 THEN 0 ELSE 1 END AS INTEGER))
    + (last - date_trunc('day', last)) AS "Date",
  round(a + b * (n + k - 1), 2) AS "Forecast", round(a + b * (n + k - 1) - band, 2) AS "Lower_Bound",
  round(a + b * (n + k - 1) + band, 2) AS "Upper_Bound"
FROM m {"JOIN r USING (" + group + ")" if group else ", r"}, k WHERE n >= 3"""


BOUNDS = ("Forecast", "Lower_Bound", "Upper_Bound")
DAILY_ORDERS_SQL = "SELECT o_orderdate AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1"


@query(
    "forecast_series",
    f"WITH {DIRTY_SQL} SELECT o_orderdate AS date, round(sum(o_totalprice), 2) AS value FROM dirty WHERE o_totalprice IS NOT NULL GROUP BY 1",
)
def forecast_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecast.forecast_series(dirty_orders(spark, sf_dir), "o_orderdate", "o_totalprice"), "value")


@query(
    "forecast_text_dates",
    f"WITH {DIRTY_SQL} SELECT o_orderdate AS date, round(sum(o_totalprice), 2) AS value FROM dirty WHERE o_totalprice IS NOT NULL GROUP BY 1",
)
def forecast_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as text, half of them with the day before the month."""
    day_first = F.date_format("o_orderdate", "dd/MM/yyyy")
    text = F.when(F.col("o_orderkey") % 2 == 0, day_first).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    series = forecast.forecast_series(dirty_orders(spark, sf_dir).withColumn("day", text), "day", "o_totalprice")
    return rounded(series, "value")


@query("linear_forecast", _forecast_sql(DAILY_ORDERS_SQL))
def linear_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = forecast.forecast_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    return rounded(forecast.linear_forecast(series), *BOUNDS)


@query(
    "forecast_midmonth",
    _forecast_sql("SELECT l_shipdate AS date, sum(l_quantity) AS value FROM lineitem GROUP BY 1", 12),
)
def forecast_midmonth(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = forecast.forecast_series(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity")
    return rounded(forecast.linear_forecast(series, 12), *BOUNDS)


@query(
    "forecast_events",
    _forecast_sql("SELECT ts AS date, sum(value) AS value FROM events GROUP BY 1", 3),
)
def forecast_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Microsecond time stamps: the positions come from the three-level numbering."""
    series = forecast.forecast_series(table(spark, sf_dir, "events"), "ts", "value")
    return rounded(forecast.linear_forecast(series, 3), *BOUNDS)


@query(
    "forecast_by_segment",
    _forecast_sql(
        "SELECT o_orderpriority, o_orderdate AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2",
        6,
        "o_orderpriority",
    ),
)
def forecast_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = ["o_orderpriority"]
    series = forecast.forecast_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", segment)
    return rounded(forecast.linear_forecast(series, 6, segment), *BOUNDS)


@query(
    "forecast_direction",
    f"""WITH f AS ({_forecast_sql(DAILY_ORDERS_SQL)}),
e AS (SELECT min_by("Forecast", "Date") AS f0, max_by("Forecast", "Date") AS f1 FROM f),
d AS (SELECT *, CASE WHEN f1 > f0 THEN 'upward' WHEN f1 < f0 THEN 'downward' ELSE 'stable' END AS direction FROM e)
SELECT f0 AS first_forecast, f1 AS last_forecast, direction,
  'The forecast for o_totalprice shows a ' || direction || ' direction over the selected horizon.' || chr(10)
  || 'This helps you anticipate likely business movement if recent patterns continue.' || chr(10)
  || 'Use it as a planning signal for budget, staffing, inventory, or operations.' AS interpretation,
  'Monitor o_totalprice closely, review the projected direction, and align planning decisions with the forecast trend.' AS recommendation
FROM d""",
)
def forecast_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = forecast.forecast_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    outlook = rounded(forecast.linear_forecast(series), *BOUNDS)
    return forecast.forecast_direction(outlook, "o_totalprice")


@query(
    "forecast_status",
    f"""SELECT count(*) AS dates, CASE WHEN count(*) >= 3 THEN '{fixed.FORECAST_MODEL}' ELSE '{fixed.FORECAST_NO_DATA}' END AS model,
  CASE WHEN count(*) >= 3 THEN '{fixed.FORECAST_EXPLANATION}' ELSE '' END AS explanation FROM ({DAILY_ORDERS_SQL})""",
)
def forecast_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = forecast.forecast_series(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    return forecast.forecast_status(series)


# --- Users ---------------------------------------------------------------------------------

PREMIUM_RUNS_SQL = (
    f"{RUNS_SQL}, {PROFILES_SQL}, looked AS (\n"
    "  SELECT r.*, coalesce(p.is_premium, false) AS is_premium FROM runs r"
    " LEFT JOIN profiles p ON lower(trim(r.email)) = p.email)"
)


def premium_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.profile_lookup(analysis_runs(spark, sf_dir), customer_profiles(spark, sf_dir))


@query(
    "profile_lookup",
    f"""WITH {PREMIUM_RUNS_SQL}, o AS (
  SELECT * REPLACE (is_premium OR user_id IN (7, 8, 0) AS is_premium) FROM looked)
SELECT *, CASE WHEN is_premium THEN 'premium' ELSE 'free' END AS plan FROM o""",
)
def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a list of emails that are premium, one of them without a profile."""
    listed = [*OVERRIDES, "user0@example.com"]
    known = customer_profiles(spark, sf_dir).where("email <> 'user0@example.com'")
    return users.profile_lookup(analysis_runs(spark, sf_dir), known, overrides=listed)


OVERRIDES = ["user7@example.com", " USER8@example.com "]


@query(
    "premium_status",
    f"""WITH {PROFILES_SQL}, e AS (
  SELECT *, is_premium OR email IN ('user7@example.com', 'user8@example.com') AS effective_premium FROM profiles)
SELECT *, CASE WHEN effective_premium THEN 'premium' ELSE 'free' END AS plan FROM e""",
)
def premium_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.premium_status(customer_profiles(spark, sf_dir), OVERRIDES)


REQUESTED_FEATURES = {"signup": "forecast", "purchase": "saved_reports", "error": "compare", "view": "ai_insights"}


@query(
    "feature_entitlements",
    f"""WITH {PREMIUM_RUNS_SQL}, asked AS (
  SELECT event_id, CASE feature_used WHEN 'signup' THEN 'forecast' WHEN 'purchase' THEN 'saved_reports'
    WHEN 'error' THEN 'compare' WHEN 'view' THEN 'ai_insights' ELSE 'preview' END AS feature, is_premium FROM looked)
SELECT *, feature NOT IN ('ai_insights', 'forecast', 'saved_reports', 'data_doctor_autofix', 'shareable_reports')
  OR is_premium AS enabled FROM asked""",
)
def feature_entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = F.coalesce(
        *[F.when(F.col("feature_used") == k, v) for k, v in REQUESTED_FEATURES.items()], F.lit("preview")
    )
    asked = premium_runs(spark, sf_dir).select("event_id", feature.alias("feature"), "is_premium")
    return users.feature_entitlements(asked)


@query(
    "usage_quota",
    f"""WITH {PREMIUM_RUNS_SQL}, ranked AS (
  SELECT *, coalesce(sum(CASE WHEN succeeded THEN 1 ELSE 0 END) OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM looked)
SELECT event_id, ts, user_id, succeeded, is_premium, is_premium OR earlier < 2 AS allowed,
  CASE WHEN is_premium OR earlier < 2 THEN '' ELSE 'Free analysis limit reached (2). Upgrade to continue.' END AS reason FROM ranked""",
)
def usage_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = premium_runs(spark, sf_dir).select("event_id", "ts", "user_id", "succeeded", "is_premium")
    return users.usage_quota(runs)


@query(
    "usage_summary",
    f"""WITH {RUNS_SQL}, u AS (
  SELECT user_id, count(*) FILTER (succeeded) AS used FROM (
    SELECT user_id, succeeded FROM runs UNION ALL SELECT -1 - c_custkey, false FROM customer) GROUP BY 1)
SELECT user_id, used, least(used, 2) AS used_capped, greatest(0, 2 - used) AS remaining,
  CAST(floor(least(used, 2) / 2.0 * 100) AS INTEGER) AS percent_used FROM u""",
)
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everyone with a run, and every customer as a user (of a negative number) who never ran anything."""
    runs = analysis_runs(spark, sf_dir)
    idle = table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("user_id"))
    return users.usage_summary(runs.where("succeeded"), users=runs.select("user_id").unionByName(idle))


SIGN_INS_SQL = (
    PROFILES_SQL
    + """,
sign_ins AS (
  SELECT 'user' || (user_id * 20) || '@example.com' AS email,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE 'auth-' || event_id END AS id,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM events),
latest AS (
  SELECT email, max(ts) AS ts, max_by(id, (ts, id)) FILTER (WHERE id <> '') AS id FROM sign_ins GROUP BY 1),
merged AS (
  SELECT coalesce(p.email, l.email) AS email, coalesce(l.id, p.id) AS id,
    CASE WHEN p.email IS NULL THEN false ELSE p.is_premium END AS is_premium,
    coalesce(l.ts, p.updated_at) AS updated_at FROM profiles p FULL JOIN latest l ON p.email = l.email)"""
)


def sign_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a sign-in; some users have a profile, some do not."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("User"), (F.col("user_id") * 20).cast("string"), F.lit("@example.com ")).alias("email"),
        F.when(F.col("event_id") % 3 == 0, "")
        .otherwise(F.concat(F.lit("auth-"), F.col("event_id").cast("string")))
        .alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
    )


@query("profile_upsert", f"WITH {SIGN_INS_SQL} SELECT * FROM merged")
def profile_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.profile_upsert(customer_profiles(spark, sf_dir), sign_ins(spark, sf_dir))


@query(
    "premium_activate",
    f"""WITH {SIGN_INS_SQL} SELECT email, id, is_premium OR email IN (SELECT email FROM latest) AS is_premium, updated_at
FROM merged""",
)
def premium_activate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users.premium_activate(customer_profiles(spark, sf_dir), sign_ins(spark, sf_dir))


# --- Streaming -----------------------------------------------------------------------------


def payment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = table(spark, sf_dir, "events")
    events = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events*.parquet")
    return payments.parse_events(payment_payloads(events))


@query("stream_parse_events", f"WITH {PAYMENTS_SQL} SELECT * FROM payments")
def stream_parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "stream_parse_events")
    payments.store_parsed(payment_stream(spark, sf_dir), f"{folder}/table", f"{folder}/progress").awaitTermination()
    return spark.read.parquet(f"{folder}/table")


@query(
    "event_email",
    """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 'user' || user_id || '@example.com' END AS email FROM events
WHERE event_type = 'purchase' AND event_id % 4 < 3""",
)
def event_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = payments.parse_events(payment_payloads(table(spark, sf_dir, "events")))
    return payments.with_email(parsed).select("event_id", "email")


@query(
    "stream_premium_activation",
    f"""WITH {PROFILES_SQL}, {PAYMENTS_SQL}, latest AS (
  SELECT email, max_by(customer_id, (event_time, event_id)) AS customer_id,
    max_by(session_id, (event_time, event_id)) AS session_id, max(event_time) AS event_time
  FROM payments WHERE email IS NOT NULL GROUP BY 1)
SELECT p.email, p.id, p.is_premium OR l.email IS NOT NULL AS is_premium, p.updated_at, p.created_at,
  l.customer_id AS stripe_customer_id, l.session_id AS stripe_checkout_session_id
FROM (SELECT *, CASE WHEN right(email, 13) = '5@example.com' THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2023-12-31' END AS created_at FROM profiles) p
LEFT JOIN latest l ON p.email = l.email AND l.event_time >= p.created_at""",
)
def stream_premium_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "stream_premium_activation")
    stream = payments.store_activations(payment_stream(spark, sf_dir), f"{folder}/table", f"{folder}/progress")
    stream.awaitTermination()
    late = F.when(F.col("email").endswith("5@example.com"), "2024-01-20").otherwise("2023-12-31")
    profiles = customer_profiles(spark, sf_dir).withColumn("created_at", late.cast("timestamp_ntz"))
    return payments.activated_profiles(profiles, spark.read.parquet(f"{folder}/table"))
