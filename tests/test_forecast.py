import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from insight_spark.operators import forecast


def series_of(spark, pairs):
    return spark.createDataFrame(pairs, "date timestamp_ntz, value double")


def month_starts(last, n):
    """First days of months, the time of day kept: from the next month on if the last date is a first day,
    else from the one after it."""
    first = last.month + (0 if last.day == 1 else 1)
    return [last.replace(year=last.year + (first + k) // 12, month=(first + k) % 12 + 1, day=1) for k in range(n)]


def expected(pairs, periods):
    """Brute force on a small series: least squares, population band, month starts."""
    pairs = sorted(pairs)
    y = np.array([v for _, v in pairs])
    x = np.arange(len(y))
    slope, intercept = np.polyfit(x, y, 1)
    band = np.std(y - (slope * x + intercept))
    dates = month_starts(pairs[-1][0], periods)
    future = intercept + slope * np.arange(len(y), len(y) + periods)
    return [(d, f, f - band, f + band) for d, f in zip(dates, future)]


def check(spark, pairs, periods=6):
    rows = forecast.linear_forecast(series_of(spark, pairs), periods).orderBy("Date").collect()
    want = expected(pairs, periods)
    assert [r.Date for r in rows] == [w[0] for w in want]
    for r, w in zip(rows, want):
        assert [r.Forecast, r.Lower_Bound, r.Upper_Bound] == pytest.approx(w[1:], rel=1e-9, abs=1e-6)


def test_month_start_series(spark):
    values = [12.0, 13.2, 12.8, 14.1, 15.5, 16.2]
    check(spark, [(dt.datetime(2025, m + 1, 1), v) for m, v in enumerate(values)])


def test_mid_month_skips_one_start_and_keeps_time_of_day(spark):
    pairs = [(dt.datetime(2024, 11, d, 10, 30), float(d * d)) for d in (3, 9, 15, 28)]
    check(spark, pairs, 14)


def test_time_stamps_within_seconds_and_days(spark):
    rng = np.random.default_rng(5)
    start = dt.datetime(2024, 2, 28, 23, 59, 58)
    offsets = sorted({int(x) for x in rng.integers(0, 4_000_000, 300)} | {int(x) for x in rng.integers(0, 3 * 10**11, 300)})
    pairs = [(start + dt.timedelta(microseconds=o), float(v)) for o, v in zip(offsets, rng.normal(size=len(offsets)))]
    check(spark, pairs, 3)


def test_dates_before_the_epoch(spark):
    check(spark, [(dt.datetime(1950 + i, 3, 1 + i, 0, 0, 0, i), float(i % 4)) for i in range(12)], 4)


def test_large_offset_keeps_precision(spark):
    check(spark, [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 1e9 + (i % 7)) for i in range(400)])


def test_too_few_dates(spark):
    pairs = [(dt.datetime(2024, 1, 1), 1.0), (dt.datetime(2024, 1, 2), 2.0)]
    short = series_of(spark, pairs)
    assert forecast.linear_forecast(short).count() == 0
    assert forecast.forecast_direction(forecast.linear_forecast(short), "x").count() == 0
    assert forecast.forecast_status(short).first().model == "Not enough data"
    assert forecast.linear_forecast(short.limit(0)).count() == 0


def test_series_preparation(spark):
    frame = spark.createDataFrame(
        [("2024-01-02", "2"), ("2024-01-01", "1"), ("2024-01-02", " 3"), ("bad", "9"), ("2024-01-03", "x"), (None, "1")],
        "when string, v string",
    )
    rows = forecast.forecast_series(frame, "when", "v").orderBy("date").collect()
    assert [(str(r.date)[:10], r.value) for r in rows] == [("2024-01-01", 1.0), ("2024-01-02", 5.0)]
    assert forecast.forecast_series(frame, "nope", "v").count() == 0
    assert forecast.forecast_series(frame, "when", "nope").columns == ["date", "value"]


def test_series_uses_first_of_repeated_columns(spark):
    frame = spark.createDataFrame([("2024-01-01", 1.0, 5.0)], "d string, v double, w double").toDF("d", "v", "v")
    assert forecast.forecast_series(frame, "d", "v").first().value == 1.0


def test_segments_match_separate_runs(spark):
    frame = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("seg"),
        F.timestamp_micros(F.col("id") * 86_400_000_000 * 2).cast("timestamp_ntz").alias("day"),
        (F.col("id") * 1.5 + F.col("id") % 7).alias("v"),
    )
    series = forecast.forecast_series(frame, "day", "v", ["seg"])
    together = forecast.linear_forecast(series, 2, ["seg"]).collect()
    assert {r.seg for r in together} == {"a", "b", None}
    for seg in ("a", "b"):
        alone = forecast.linear_forecast(forecast.forecast_series(frame.where(F.col("seg") == seg), "day", "v"), 2)
        got = sorted((r.Date, r.Forecast) for r in together if r.seg == seg)
        want = sorted((r.Date, r.Forecast) for r in alone.collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_direction(spark):
    def direction(values):
        rows = [(dt.datetime(2025, m + 1, 1), v) for m, v in enumerate(values)]
        frame = spark.createDataFrame(rows, "Date timestamp_ntz, Forecast double")
        return forecast.forecast_direction(frame, "Sales").first()

    assert direction([1.0, 5.0, 2.0]).direction == "upward"
    assert direction([2.0, 1.0]).direction == "downward"
    row = direction([2.0, 9.0, 2.0])
    assert row.direction == "stable"
    assert row.interpretation.startswith("The forecast for Sales shows a stable direction over the selected horizon.\n")
    assert row.recommendation.startswith("Monitor Sales closely")


def test_one_scan(spark, folder, plan):
    spark.range(100).select(
        F.timestamp_micros(F.col("id")).cast("timestamp_ntz").alias("d"), F.rand(1).alias("v"), F.lit("x").alias("unused")
    ).write.parquet(folder)
    text = plan(forecast.linear_forecast(forecast.forecast_series(spark.read.parquet(folder), "d", "v")))
    assert text.count("FileScan") == 1 and "unused" not in text and "Join" not in text
