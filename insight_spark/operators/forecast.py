"""Series preparation, linear trend forecast, direction and recommendation.

The trend regresses the per-date totals on their position 0..n-1. Numbering all dates in one
window would pull every distinct time stamp into one task. Instead the moments of the regression
are merged upwards in three levels whose groups are bounded by the calendar: time stamps within
a second (at most 1,000,000 microseconds), seconds within a day (86,400), days (about 3.7 million
in the supported range). One scan, and no join back to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from insight_spark.functions import fixed
from insight_spark.functions.scalars import DEFAULT_DATE_FORMATS, coerce_numeric, coerce_timestamp, named
from insight_spark.operators.cleaning import date_formats
from insight_spark.operators.schema import unique_columns

def _groups(names: Sequence[str]) -> list[Column]:
    return [named(g) for g in names]


def forecast_series(
    df: DataFrame,
    date_column: str,
    value_column: str,
    group_cols: Sequence[str] = (),
    date_spellings: Sequence[str] | None = None,
) -> DataFrame:
    """Total per date: (group columns, date, value). Unreadable dates or numbers are dropped; a
    missing column gives an empty series. Unordered: sort when displaying. Text dates are read with
    `date_spellings`, or as `cleaning.date_formats` finds them written."""
    df = unique_columns(df)
    if date_column not in df.columns or value_column not in df.columns:
        spark = df.sparkSession
        kept = [f for f in df.schema.fields if f.name in group_cols]
        extra = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
        return spark.createDataFrame([], extra + "date timestamp_ntz, value double")
    types = {f.name: f.dataType for f in df.schema.fields}
    spellings = date_spellings or date_formats(df, [date_column]).get(date_column, DEFAULT_DATE_FORMATS)
    return (
        df.select(
            *_groups(group_cols),
            coerce_timestamp(named(date_column), types[date_column], spellings).alias("date"),
            coerce_numeric(named(value_column), types[value_column]).alias("value"),
        )
        .where("date IS NOT NULL AND value IS NOT NULL")
        .groupBy(*_groups(group_cols), "date")
        .agg(F.sum("value").alias("value"))
    )


def _merge_moments(parts: DataFrame, outer: list[Column], order: str) -> DataFrame:
    """Combine the moments of consecutive runs of a series.

    A run of `n` values sits at positions 0..n-1 and carries the mean `y`, the centred sums
    `sxy` and `syy`, and its `last` date. Runs are laid end to end in `order` within `outer`.
    Sums are taken about the mean of the whole, so a large common offset of the values does not
    eat into their precision.
    """
    whole = W.partitionBy(*outer)
    earlier = whole.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    placed = (
        parts.withColumn("__start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("__n", F.sum("n").over(whole))
        .withColumn("__y", F.sum(F.col("n") * F.col("y")).over(whole) / F.col("__n"))
    )
    dx = F.col("__start") + (F.col("n") - 1) / 2 - (F.col("__n") - 1) / 2
    dy = F.col("y") - F.col("__y")
    return placed.groupBy(*outer).agg(
        F.sum("n").alias("n"),
        F.max("__y").alias("y"),
        F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("sxy"),
        F.sum(F.col("syy") + F.col("n") * dy * dy).alias("syy"),
        F.max("last").alias("last"),
    )


def trend_model(series: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Least-squares line per group: (group columns, n, slope, intercept, band, last).

    `band` is the population standard deviation of the residuals.
    """
    g = _groups(group_cols)
    day, second = F.col("__day"), F.col("__second")
    rows = series.select(
        *g,
        F.col("date").cast("date").alias("__day"),
        (F.hour("date") * 3600 + F.minute("date") * 60 + F.second("date")).alias("__second"),
        "date",
        F.lit(1).cast("bigint").alias("n"),
        F.col("value").alias("y"),
        F.lit(0.0).alias("sxy"),
        F.lit(0.0).alias("syy"),
        F.col("date").alias("last"),
    )
    seconds = _merge_moments(rows, [*g, day, second], "date")
    days = _merge_moments(seconds, [*g, day], "__second")
    n = F.col("n").cast("double")
    unexplained = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("__sxx"), F.lit(0.0))
    return (
        _merge_moments(days, g, "__day")
        .where("n > 1")
        .withColumn("__sxx", n * (n * n - 1) / 12)
        .withColumn("slope", F.col("sxy") / F.col("__sxx"))
        .withColumn("intercept", F.col("y") - F.col("slope") * (n - 1) / 2)
        .withColumn("band", F.sqrt(unexplained / n))
        .select(*g, "n", "slope", "intercept", "band", "last")
    )


def month_start_after(last: Column, k: Column) -> Column:
    """The k-th forecast date: month starts after `last`, at its time of day.

    A last date that is not on the first of a month skips the following month start, because
    that one only anchors the range.
    """
    skip = F.when(F.dayofmonth(last) == 1, 0).otherwise(1)
    start = F.add_months(F.trunc(last.cast("date"), "MM"), (k + skip).cast("int"))
    return start.cast("timestamp_ntz") + (last - last.cast("date").cast("timestamp_ntz"))


def linear_forecast(series: DataFrame, periods: int = 6, group_cols: Sequence[str] = ()) -> DataFrame:
    """(group columns, Date, Forecast, Lower_Bound, Upper_Bound) for the next `periods` months.

    The band is the population standard deviation of the residuals. Groups with fewer than three
    dates give no rows.
    """
    g = _groups(group_cols)
    step = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("k")
    return (
        trend_model(series, group_cols)
        .where("n >= 3")
        .select("*", step)
        .withColumn("Forecast", F.col("intercept") + F.col("slope") * (F.col("n") + F.col("k") - 1))
        .select(
            *g,
            month_start_after(F.col("last"), F.col("k")).alias("Date"),
            "Forecast",
            (F.col("Forecast") - F.col("band")).alias("Lower_Bound"),
            (F.col("Forecast") + F.col("band")).alias("Upper_Bound"),
        )
    )


def forecast_direction(forecast: DataFrame, metric_name: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Direction of the forecast, its interpretation and the recommendation; no forecast, no row."""
    first, last = F.col("first_forecast"), F.col("last_forecast")
    trend = F.when(last > first, "upward").when(last < first, "downward").otherwise("stable")
    return (
        forecast.groupBy(*_groups(group_cols))
        .agg(
            F.min_by("Forecast", "Date").alias("first_forecast"),
            F.max_by("Forecast", "Date").alias("last_forecast"),
        )
        .where("first_forecast IS NOT NULL")
        .withColumn("direction", trend)
        # Wording of the two sentences.
        .withColumn(
            "interpretation",
            F.concat(
                F.lit(f"The forecast for {metric_name} shows a "),
                F.col("direction"),
                F.lit(
                    " direction over the selected horizon.\n"
                    "This helps you anticipate likely business movement if recent patterns continue.\n"
                    "Use it as a planning signal for budget, staffing, inventory, or operations."
                ),
            ),
        )
        .withColumn(
            "recommendation",
            F.lit(
                f"Monitor {metric_name} closely, review the projected direction, "
                "and align planning decisions with the forecast trend."
            ),
        )
    )


def forecast_status(series: DataFrame) -> DataFrame:
    """Model name and explanation, or the notice that fewer than three dates are too few."""
    enough = F.col("n") >= 3
    return series.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("n").alias("dates"),
        F.when(enough, fixed.FORECAST_MODEL).otherwise(fixed.FORECAST_NO_DATA).alias("model"),
        F.when(enough, fixed.FORECAST_EXPLANATION).otherwise("").alias("explanation"),
    )
