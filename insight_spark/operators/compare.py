"""Comparison of two frames: shape and means of shared numeric columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from insight_spark.functions import fixed
from insight_spark.functions.scalars import named, plain_number
from insight_spark.operators.schema import normalise_missing, numeric_columns


def _summary(df: DataFrame, columns: list[str]):
    means = [F.avg(named(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]
    packed = normalise_missing(df).agg(F.count(F.lit(1)).alias("rows"), *means)
    return packed.select(F.struct("*").alias("s"))


def shared_numeric(a: DataFrame, b: DataFrame, limit: int | None = None) -> list[str]:
    return sorted(set(numeric_columns(a)) & set(numeric_columns(b)))[:limit]


def compare_frames(a: DataFrame, b: DataFrame, limit: int | None = None) -> DataFrame:
    """Long frame (ordinal, item, a_value, b_value, change): rows, columns, then column means."""
    columns = shared_numeric(a, b, limit)
    both = _summary(a, columns).select(F.col("s").alias("a")).withColumn("b", _summary(b, columns).scalar())
    pairs = [
        ("rows", F.col("a")["rows"].cast("double"), F.col("b")["rows"].cast("double")),
        ("columns", F.lit(float(len(a.columns))), F.lit(float(len(b.columns)))),
        *[(c, F.col("a")[f"m{i}"], F.col("b")[f"m{i}"]) for i, c in enumerate(columns)],
    ]
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(item).alias("item"),
            left.alias("a_value"),
            right.alias("b_value"),
            (right - left).alias("change"),
        )
        for i, (item, left, right) in enumerate(pairs)
    ]
    return both.select(F.inline(F.array(*entries)))


def comparison_text(a: DataFrame, b: DataFrame, limit: int | None = None) -> DataFrame:
    """The comparison as one text row."""
    columns = shared_numeric(a, b, limit)
    both = _summary(a, columns).select(F.col("s").alias("a")).withColumn("b", _summary(b, columns).scalar())
    rows_a, rows_b = F.col("a")["rows"], F.col("b")["rows"]
    width_a, width_b = len(a.columns), len(b.columns)

    def mean(value):
        return F.coalesce(plain_number(value), F.lit("nan"))

    lines = [
        F.lit(fixed.COMPARE_HEADING),
        F.format_string("File A shape: %d rows × %d columns\n", rows_a, F.lit(width_a)),
        F.format_string("File B shape: %d rows × %d columns\n", rows_b, F.lit(width_b)),
        F.format_string("Row difference: %d\n", rows_b - rows_a),
        F.format_string("Column difference: %d", F.lit(width_b - width_a)),
        F.lit(fixed.COMPARE_COLUMNS if columns else fixed.COMPARE_NONE),
        F.concat_ws(
            "\n",
            *[
                F.concat(
                    F.lit(f"- {c}: mean "),
                    mean(F.col("a")[f"m{i}"]),
                    F.lit(" → "),
                    mean(F.col("b")[f"m{i}"]),
                    F.lit(" (Δ "),
                    mean(F.col("b")[f"m{i}"] - F.col("a")[f"m{i}"]),
                    F.lit(")"),
                )
                for i, c in enumerate(columns)
            ],
        ),
    ]
    return both.select(F.concat(*lines).alias("comparison"))
