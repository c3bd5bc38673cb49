"""Registered queries on event-time streams: the events as they arrive in micro-batches, some of them late or twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from insight_spark.plans.catalog import PREMIUM_RUNS_SQL, premium_runs, query, rounded
from insight_spark.plans.inputs import table
from insight_spark.session import shared_folder, stored
from insight_spark.streaming import quota, windows

BATCHES = 6
FILE_ROWS = 100_000  # of a batch, in one file and so in one task


def arrivals(events: DataFrame) -> DataFrame:
    """Events with the micro-batch they arrive in: five days each; of fifty, one comes a batch later and one three."""
    day = F.datediff("ts", F.lit("2024-01-01"))
    late = F.when(F.col("event_id") % 50 == 7, 1).when(F.col("event_id") % 50 == 8, 3).otherwise(0)
    return events.withColumn("batch", F.least(F.lit(BATCHES - 1), F.floor(day / 5).cast("int") + late).cast("int"))


#: what arrived, and what was not too late: rows of windows that had closed before the batch's predecessor
ARRIVED_SQL = f"""arrived AS (
  SELECT *, CAST(least({BATCHES - 1}, floor(date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) / 5)
    + CASE event_id % 50 WHEN 7 THEN 1 WHEN 8 THEN 3 ELSE 0 END) AS INTEGER) AS batch FROM events),
mark AS (SELECT max(ts) - INTERVAL 2 DAY AS final FROM arrived),
marks AS (
  SELECT b.batch, max(a.ts) - INTERVAL 2 DAY AS late FROM (SELECT DISTINCT batch FROM arrived) AS b
  LEFT JOIN arrived AS a ON a.batch <= b.batch - 2 GROUP BY 1)"""


def stream_of(spark: SparkSession, rows: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """A stream that reads rows (column batch) one batch at a time.

    A trigger takes a number of files, so every batch is written as equally many: its rows are dealt in turn to
    that many places, of about `file_rows` rows in the largest batch, and each place holds a row that stands for
    nothing as well, lest it has no file. No task writes a whole batch.
    """
    arrived = stored(rows)
    largest = arrived.groupBy("batch").count().agg(F.max("count")).first()[0] or 0
    places = -(-largest // file_rows) or 1
    place, came = (F.monotonically_increasing_id() % places).alias("place"), F.lit(True).alias("came")
    held = spark.range(places).select(F.col("id").alias("place"), F.lit(False).alias("came"))
    for k in range(BATCHES):
        dealt = arrived.where(F.col("batch") == k).drop("batch").select("*", place, came)
        batch = dealt.unionByName(held, allowMissingColumns=True)
        batch.repartition(places, "place").write.mode("append").partitionBy("place").parquet(f"{folder}/source")
    stream = spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", places).parquet(f"{folder}/source")
    return stream.where("came").drop("place", "came")


def closed_windows(spark: SparkSession, sf_dir: str, name: str, **spec) -> tuple[DataFrame, str]:
    folder = shared_folder(spark, name)
    stream = stream_of(spark, arrivals(table(spark, sf_dir, "events")), folder)
    found = windows.event_windows(stream, "ts", {"n": F.count("*"), "total": F.sum("value")}, delay="2 days", **spec)
    running = windows.store_windows(found, f"{folder}/table", f"{folder}/progress")
    running.awaitTermination()
    closed = spark.read.schema(found.schema).parquet(f"{folder}/table")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return rounded(closed, "total").withColumns(times), windows.watermark_of(running)


@query(
    "stream_tumbling_windows",
    f"""WITH {ARRIVED_SQL}
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end,
  event_type, count(*) AS n, round(sum(value), 2) AS total
FROM arrived JOIN marks USING (batch), mark
WHERE (late IS NULL OR time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR > late) AND time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= final
GROUP BY 1, 2, 3""",
)
def stream_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed_windows(spark, sf_dir, "stream_tumbling_windows", size="6 hours", by=["event_type"])[0]


@query(
    "stream_late_rows",
    f"""WITH {ARRIVED_SQL}
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS window_end,
  event_type, count(*) AS n_late
FROM arrived JOIN marks USING (batch) WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= late GROUP BY 1, 2, 3""",
)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed, mark = closed_windows(spark, sf_dir, "stream_late_rows", size="6 hours", by=["event_type"])
    closed = closed.withColumns({c: F.col(c).cast("timestamp") for c in ("window_start", "window_end")})
    late = windows.late_rows(table(spark, sf_dir, "events"), closed, "ts", "6 hours", mark, by=["event_type"])
    return late.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query(
    "stream_sliding_windows",
    f"""WITH {ARRIVED_SQL},
spread AS (
  SELECT a.*, time_bucket(INTERVAL 8 HOUR, ts) - k * INTERVAL 8 HOUR AS began FROM arrived AS a, (VALUES (0), (1), (2)) AS x(k))
SELECT began AS window_start, began + INTERVAL 1 DAY AS window_end, count(*) AS n, round(sum(value), 2) AS total
FROM spread JOIN marks USING (batch), mark
WHERE (late IS NULL OR began + INTERVAL 1 DAY > late) AND began + INTERVAL 1 DAY <= final GROUP BY 1, 2""",
)
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed_windows(spark, sf_dir, "stream_sliding_windows", size="1 day", slide="8 hours")[0]


@query(
    "stream_session_windows",
    f"""WITH {ARRIVED_SQL},
kept AS (SELECT a.* FROM arrived AS a JOIN marks USING (batch) WHERE late IS NULL OR ts + INTERVAL 2 HOUR > late),
begun AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM kept),
numbered AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM begun),
sessions AS (
  SELECT min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, user_id, count(*) AS n, round(sum(value), 2) AS total
  FROM numbered GROUP BY user_id, session)
SELECT sessions.* FROM sessions, mark WHERE window_end <= final""",
)
def stream_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed_windows(spark, sf_dir, "stream_session_windows", size="2 hours", session=True, by=["user_id"])[0]


@query(
    "stream_usage_quota",
    f"""WITH {PREMIUM_RUNS_SQL}, ranked AS (
  SELECT *, coalesce(sum(CASE WHEN succeeded THEN 1 ELSE 0 END) OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM looked)
SELECT event_id, ts, user_id, succeeded, is_premium, is_premium OR earlier < 2 AS allowed,
  CASE WHEN is_premium OR earlier < 2 THEN '' ELSE 'Free analysis limit reached (2). Upgrade to continue.' END AS reason
FROM ranked WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 11 DAY""",
)
def stream_usage_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests arrive out of order by up to two batches, and every seventh comes again one batch later."""
    runs = premium_runs(spark, sf_dir).select("event_id", "ts", "user_id", "succeeded", "is_premium")
    late = F.when(F.col("event_id") % 5 == 1, 1).otherwise(0)
    first = arrivals(runs).withColumn("batch", F.least(F.lit(BATCHES - 1), F.floor(F.datediff("ts", F.lit("2024-01-01")) / 5).cast("int") + late))
    again = first.where("event_id % 7 = 0").withColumn("batch", F.least(F.lit(BATCHES - 1), F.col("batch") + 1))
    folder = shared_folder(spark, "stream_usage_quota")
    found = quota.live_quota(stream_of(spark, first.unionByName(again), folder), "11 days")
    windows.store_windows(found, f"{folder}/table", f"{folder}/progress").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/table")
