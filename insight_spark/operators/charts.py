"""Data behind the charts: histogram bins and the trend series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from insight_spark.functions.scalars import coerce_numeric, named
from insight_spark.operators.schema import numeric_columns


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the finite values: (bin, bin_start, bin_end, n), empty bins included.

    Infinite values are in no bin; `infinite_values` counts them. The last bin is closed on both sides; a single-valued column is widened by 0.5 each way.
    """
    number = coerce_numeric(named(column), df.schema[column].dataType)
    values = df.select(number.alias("x")).where(F.abs("x") < float("inf"))
    limits = values.agg(F.min("x").alias("least"), F.max("x").alias("most")).select(
        F.struct(
            F.when(F.col("least") == F.col("most"), F.col("least") - 0.5).otherwise(F.col("least")).alias("lo"),
            F.when(F.col("least") == F.col("most"), F.col("most") + 0.5).otherwise(F.col("most")).alias("hi"),
        ).alias("limits")
    )
    width = (F.col("limits")["hi"] - F.col("limits")["lo"]) / bins

    def start(i: Column) -> Column:
        return F.col("limits")["lo"] + i * width

    guess = F.least(F.floor((F.col("x") - F.col("limits")["lo"]) / width), F.lit(bins - 1)).cast("int")
    # The division can land next to a bin edge; the edges themselves decide.
    settled = (
        F.when(F.col("x") < start(F.col("guess")), F.col("guess") - 1)
        .when((F.col("guess") < bins - 1) & (F.col("x") >= start(F.col("guess") + 1)), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    counts = (
        values.withColumn("limits", limits.scalar())
        .withColumn("guess", guess)
        .select(settled.alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    frame = limits.select("limits", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).where(
        F.col("limits")["lo"].isNotNull()
    )
    return frame.join(counts, "bin", "left").select(
        "bin",
        start(F.col("bin")).alias("bin_start"),
        start(F.col("bin") + 1).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def infinite_values(df: DataFrame, column: str) -> DataFrame:
    """How many infinite values a histogram of the column leaves out: one row (n)."""
    number = coerce_numeric(named(column), df.schema[column].dataType)
    return df.agg(F.count_if(F.abs(number) == float("inf")).alias("n"))


def trend_buckets(df: DataFrame, order_by: str, column: str | None = None, buckets: int = 200) -> DataFrame:
    """The trend for a chart of any table: (bucket, first_key, last_key, n, mean_value), in key order.

    The range of a number or time key is cut into buckets of equal width, and each gives the mean of the
    column (by default the first numeric one), missing as zero; empty buckets and rows without key are
    left out. Two aggregations, no sort, and as many rows as buckets at most.
    """
    column = column or numeric_columns(df)[0]
    kind = df.schema[order_by].dataType
    key = F.unix_micros(named(order_by).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else named(order_by)
    value = F.coalesce(coerce_numeric(named(column), df.schema[column].dataType), F.lit(0.0))
    rows = df.select(named(order_by).alias("key"), key.cast("double").alias("k"), value.alias("v")).where("k IS NOT NULL AND NOT isnan(k)")
    limits = rows.agg(F.struct(F.min("k").alias("lo"), F.max("k").alias("hi")).alias("l"))
    width = (F.col("l.hi") - F.col("l.lo")) / buckets
    bucket = F.when(width > 0, F.least(F.floor((F.col("k") - F.col("l.lo")) / width), F.lit(buckets - 1))).otherwise(0)
    placed = rows.withColumn("l", limits.scalar()).withColumn("bucket", bucket.cast("int"))
    return (
        placed.groupBy("bucket")
        .agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_value"))
        .orderBy("bucket")
    )


def trend_series(df: DataFrame, order_by: Sequence[str], column: str | None = None) -> DataFrame:
    """Values of a numeric column (by default the first) in key order, missing as zero.

    Frames have no row order of their own, so the order key is an argument. The sort is a
    distributed range sort; the read position breaks ties, which also lets rows that share a key
    be spread over several ranges.
    """
    column = column or numeric_columns(df)[0]
    keys = [named(k) for k in order_by]
    value = F.coalesce(coerce_numeric(named(column), df.schema[column].dataType), F.lit(0.0))
    placed = df.select(*keys, value.alias("trend_value"), F.monotonically_increasing_id().alias("__position"))
    return placed.orderBy(*keys, "__position").drop("__position")
