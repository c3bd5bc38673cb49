"""Quality score, readiness band, executive summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.functions import fixed
from insight_spark.functions.scalars import percent_text, truncated_percent
from insight_spark.operators.profile import profile
from insight_spark.operators.schema import date_like_columns, numeric_columns, text_columns


def present(items: list[Column]) -> Column:
    """Array of the items that are not null."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def or_else(items: Column, fallback: str) -> Column:
    return F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(fallback)))


def score_of_profile() -> Column:
    """Score 0..100 from the columns of a `profile` row."""
    penalty = (
        F.least(F.lit(35), truncated_percent(F.col("missing_rate")))
        + F.least(F.lit(25), truncated_percent(F.col("duplicate_rate")))
        + F.least(F.lit(20), F.size("constant_columns") * 4)
    )
    clipped = F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty))
    return F.when(F.col("rows") > 0, clipped).otherwise(F.lit(0))


def listed(names: str, most: int | None) -> Column:
    """The names of an array column in one text; with `most`, the first so many and how many more there are."""
    if most is None:
        return F.array_join(names, ", ")
    more = F.size(names) - most
    rest = F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), rest)


def quality_score(df: DataFrame, max_names: int | None = None, profiled: DataFrame | None = None) -> DataFrame:
    """One row: the profile columns, `score` and `notes`. `profiled`: the frame's profile row, if it is there."""
    p = profile(df) if profiled is None else profiled
    notes = present(
        [
            F.when(
                F.col("missing_rate") > 0,
                F.concat(F.lit("Missing values affect "), percent_text(F.col("missing_rate")), F.lit(" of cells.")),
            ),
            F.when(
                F.col("duplicate_rate") > 0,
                F.concat(
                    F.lit("Duplicate rows affect "), percent_text(F.col("duplicate_rate")), F.lit(" of records.")
                ),
            ),
            F.when(
                F.size("constant_columns") > 0,
                F.concat(
                    F.lit("Constant columns detected: "),
                    listed("constant_columns", max_names),
                ),
            ),
        ]
    )
    return p.withColumn("score", score_of_profile()).withColumn(
        "notes",
        F.when(F.col("rows") > 0, or_else(notes, fixed.HEALTHY_NOTE)).otherwise(F.array(F.lit(fixed.NO_DATA))),
    )


def readiness(df: DataFrame, profiled: DataFrame | None = None) -> DataFrame:
    """Score, band, band message, notes, and how many columns play each role."""
    score = F.col("score")
    return quality_score(df, profiled=profiled).select(
        score,
        F.when(score >= 85, "ready").when(score >= 65, "cleaning_recommended").otherwise("needs_cleaning").alias("band"),
        F.when(score >= 85, fixed.READY)
        .when(score >= 65, fixed.CLEANING_RECOMMENDED)
        .otherwise(fixed.NEEDS_CLEANING)
        .alias("message"),
        F.lit(len(numeric_columns(df))).alias("numeric_fields"),
        F.lit(len(text_columns(df))).alias("text_fields"),
        F.lit(len(date_like_columns(df))).alias("date_fields"),
        "notes",
    )
