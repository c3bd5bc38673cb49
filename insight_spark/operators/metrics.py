"""Semantic metrics: a fixed registry, what is available on a frame, and the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.functions import fixed
from insight_spark.functions.scalars import array_total, coerce_numeric, format_metric, named, names_array
from insight_spark.operators.profile import COPIES, duplicates, grouped_copies, row_counts, weighted_present


def metric_registry(df: DataFrame) -> DataFrame:
    """The registry as a frame (seven rows)."""
    return df.sparkSession.createDataFrame(
        [(i, *entry) for i, entry in enumerate(fixed.METRICS)],
        "ordinal int, key string, label string, description string, format string, required_columns array<string>",
    )


def metric_availability(df: DataFrame) -> DataFrame:
    """For each metric: whether it can be computed on `df`, and the columns it lacks."""
    lacking = F.array_except("required_columns", names_array(df.columns))
    return metric_registry(df).select(
        "ordinal", "key", "label", (F.size(lacking) == 0).alias("available"), lacking.alias("missing_columns")
    )


def semantic_metrics(df: DataFrame) -> DataFrame:
    """Long frame (ordinal, key, label, description, raw_value, formatted_value, source_columns).

    One scan and one grouping on all columns; sums are weighted by the number of copies.
    """
    width = len(df.columns)
    schema = {f.name: f.dataType for f in df.schema.fields}
    sums = {
        key: required[0]
        for key, _, _, _, required in fixed.METRICS
        if required and all(c in df.columns for c in required)
    }
    exprs = [*row_counts(), weighted_present(df.columns)]
    for key, column in sums.items():
        number = coerce_numeric(named(column), schema[column])
        exprs.append(F.coalesce(F.sum(number * F.col(COPIES)), F.lit(0.0)).alias(key))
    totals = grouped_copies(df).agg(*exprs)

    rows = F.col("rows").cast("double")
    values: dict[str, Column] = {
        "record_count": rows,
        "column_count": F.lit(float(width)),
        "missing_value_rate": (rows * width - array_total(F.col("present"))) / F.greatest(rows * max(width, 1), F.lit(1.0)),
        "duplicate_rate": duplicates().cast("double") / F.greatest(rows, F.lit(1.0)),
        **{key: F.col(key) for key in sums},
    }
    whole_frame = {"missing_value_rate", "duplicate_rate"}
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(key).alias("key"),
            F.lit(label).alias("label"),
            F.lit(description).alias("description"),
            values[key].cast("double").alias("raw_value"),
            format_metric(values[key], F.lit(fmt)).alias("formatted_value"),
            names_array(df.columns if key in whole_frame else required).alias("source_columns"),
        )
        for i, (key, label, description, fmt, required) in enumerate(fixed.METRICS)
        if key in values
    ]
    return totals.select(F.inline(F.array(*entries)))
