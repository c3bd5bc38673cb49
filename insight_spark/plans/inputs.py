"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with gaps, extreme prices, padded text, a constant column and repeated rows.

    The tables as given have no defects, so a rule on the key decides which rows get one; every
    order stays in.
    """
    key = F.col("o_orderkey")
    flawed = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(key % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 7 == 0, None)
        .when(key % 97 == 0, F.col("o_totalprice") * 50)
        .otherwise(F.col("o_totalprice"))
        .alias("o_totalprice"),
        "o_orderdate",
        F.when(key % 5 == 0, F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")))
        .otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority"),
        F.lit("web").alias("channel"),
    )
    return flawed.unionByName(flawed.where(key % 13 == 0))


DIRTY_SQL = """d AS (
  SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL
         WHEN o_orderkey % 97 = 0 THEN o_totalprice * 50
         ELSE o_totalprice END AS o_totalprice,
    o_orderdate,
    CASE WHEN o_orderkey % 5 = 0 THEN concat('  ', o_orderpriority, ' ')
         ELSE o_orderpriority END AS o_orderpriority,
    'web' AS channel
  FROM orders),
dirty AS (SELECT * FROM d UNION ALL SELECT * FROM d WHERE o_orderkey % 13 = 0)"""


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items under the column names of the metric registry."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("Sales"),
        F.col("l_quantity").alias("Customers"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("Returns"),
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
    )


SALES_SQL = """sales AS (
  SELECT l_extendedprice AS Sales, l_quantity AS Customers,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS Returns, l_orderkey, l_linenumber, l_shipdate
  FROM lineitem)"""


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as user profiles; the building segment is premium."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("id-"), F.col("c_custkey").cast("string")).alias("id"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_premium"),
        F.lit("2023-12-31T00:00:00Z").alias("updated_at"),
    )


PROFILES_SQL = """profiles AS (
  SELECT 'user' || c_custkey || '@example.com' AS email, 'id-' || c_custkey AS id,
    c_mktsegment = 'BUILDING' AS is_premium, '2023-12-31T00:00:00Z' AS updated_at
  FROM customer)"""


def analysis_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as analysis requests of their users; a view is a run that succeeded."""
    runs = table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.concat(F.lit(" User"), F.col("user_id").cast("string"), F.lit("@Example.com")).alias("email"),
        F.col("event_type").alias("feature_used"),
        (F.col("event_type") == "view").alias("succeeded"),
    )
    return runs


RUNS_SQL = """runs AS (
  SELECT event_id, ts, user_id, ' User' || user_id || '@Example.com' AS email,
    event_type AS feature_used, event_type = 'view' AS succeeded
  FROM events)"""


def payment_payloads(events: DataFrame) -> DataFrame:
    """Events as payment messages: a purchase is a completed checkout.

    The email sits in one of three places, with stray capitals and spaces, and is absent from
    some messages.
    """
    address = F.concat(F.lit(" User"), F.col("user_id").cast("string"), F.lit("@Example.com "))
    place = F.col("event_id") % 4
    session = F.struct(
        F.concat(F.lit("cs_"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("cus_"), F.col("user_id").cast("string")).alias("customer"),
        F.when(place == 1, address).otherwise("").alias("customer_email"),
        F.struct(F.when(place == 0, address).alias("email")).alias("customer_details"),
        F.struct(F.when(place == 2, address).alias("email")).alias("metadata"),
    )
    kind = F.when(F.col("event_type") == "purchase", "checkout.session.completed").otherwise(F.col("event_type"))
    return events.select(
        F.col("ts").alias("event_time"),
        "event_id",
        F.to_json(F.struct(kind.alias("type"), F.struct(session.alias("object")).alias("data"))).alias("payload"),
    )


PAYMENTS_SQL = """payments AS (
  SELECT ts AS event_time, event_id,
    CASE WHEN event_id % 4 < 3 THEN 'user' || user_id || '@example.com' END AS email,
    'cus_' || user_id AS customer_id, 'cs_' || event_id AS session_id
  FROM events WHERE event_type = 'purchase')"""


def conversation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as reports of a user; some have no email, some no analysis."""
    turn = table(spark, sf_dir, "conversations")
    conv = F.col("conv_id").cast("string")
    return turn.select(
        F.when(F.col("conv_id") % 10 == 3, "")
        .otherwise(F.concat(F.lit("User"), conv, F.lit("@Example.com ")))
        .alias("email"),
        F.concat(F.lit("conv_"), conv, F.lit(".txt")).alias("file_name"),
        F.when(F.col("conv_id") % 7 == 2, "").otherwise(F.col("text")).alias("analysis"),
        F.col("role").alias("answer"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int")).cast("timestamp_ntz").alias("at"),
    )


REPORTS_SQL = """reports AS (
  SELECT CASE WHEN conv_id % 10 = 3 THEN '' ELSE 'User' || conv_id || '@Example.com ' END AS email,
    'conv_' || conv_id || '.txt' AS file_name,
    CASE WHEN conv_id % 7 = 2 THEN '' ELSE text END AS analysis, role AS answer,
    strftime(DATE '2024-01-01' + CAST(turn AS INTEGER), '%Y-%m-%dT%H:%M:%SZ') AS created_at
  FROM conversations),
records AS (
  SELECT email,
    substr(sha256(concat(email, chr(31), file_name, chr(31), analysis, chr(31), chr(31), answer, chr(31), chr(31), created_at)), 1, 14) AS report_id,
    file_name, analysis, '' AS translation, answer, '' AS doctor, created_at
  FROM reports)"""
