"""Interquartile-range outliers of numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.functions import fixed
from insight_spark.functions.scalars import named, nan_to_null
from insight_spark.operators.quantiles import exact_quantiles
from insight_spark.operators.schema import numeric_columns


def iqr_outliers(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Per numeric column (with `max_columns`: the first so many): quartiles, fences, values strictly outside.

    Columns with fewer than 8 values or no spread are reported with zero outliers.
    """
    columns = numeric_columns(df)[:max_columns]
    if not columns:
        return df.sparkSession.createDataFrame(
            [],
            "ordinal int, column string, values bigint, q1 double, q3 double, lower double, upper double,"
            " outliers bigint",
        )
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    packed = quartiles.select(F.struct("*").alias("q")).scalar()

    def fence(i: int, upper: bool) -> Column:
        q1, q3 = F.col("q")[f"q{i}"][0], F.col("q")[f"q{i}"][1]
        return q3 + fixed.IQR_FACTOR * (q3 - q1) if upper else q1 - fixed.IQR_FACTOR * (q3 - q1)

    def judged(i: int) -> Column:
        spread = F.col("q")[f"q{i}"][1] - F.col("q")[f"q{i}"][0]
        return (F.col("q")[f"n{i}"] >= fixed.OUTLIER_MIN_VALUES) & (spread > 0)

    values = df.select([nan_to_null(named(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
    counts = values.withColumn("q", packed).agg(
        *[
            F.count_if(judged(i) & ((F.col(f"v{i}") < fence(i, False)) | (F.col(f"v{i}") > fence(i, True)))).alias(
                f"o{i}"
            )
            for i in range(len(columns))
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(c).alias("column"),
                F.col("q")[f"n{i}"].alias("values"),
                F.col("q")[f"q{i}"][0].alias("q1"),
                F.col("q")[f"q{i}"][1].alias("q3"),
                fence(i, False).alias("lower"),
                fence(i, True).alias("upper"),
                F.col(f"o{i}").alias("outliers"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return counts.withColumn("q", packed).select(F.inline(rows))
