"""Cleaning steps, the configurable pipeline, automatic fixing with an action log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from insight_spark.functions import fixed
from insight_spark.functions.scalars import (
    DAY_FIRST_FORMATS,
    DEFAULT_DATE_FORMATS,
    MONTH_FIRST_FORMATS,
    array_over,
    coerce_timestamp,
    named,
    names_array,
    nan_to_null,
    trim_text,
)
from insight_spark.operators.profile import drop_duplicates, profile
from insight_spark.operators.quality import or_else
from insight_spark.operators.quantiles import exact_quantiles
from insight_spark.operators.schema import (
    DATE_NAME_PARTS,
    date_like_columns,
    normalise_missing,
    numeric_columns,
    text_columns,
)
from insight_spark.session import stored

CLEANING_DATE_PARTS = ("date",)


def numeric_gaps(df: DataFrame) -> list[str]:
    """Numeric columns with at least one missing value.

    Runs one aggregate over the numeric columns and reads back a single row. Knowing the gaps
    keeps whole columns of integers as integers and limits the medians to columns that need one.
    """
    columns = numeric_columns(df)
    if not columns:
        return []
    counts = normalise_missing(df).agg(
        F.count(F.lit(1)).alias("rows"), array_over(columns, lambda c: f"count({c})", "bigint").alias("present")
    ).first()
    return [c for c, present in zip(columns, counts.present) if present < counts.rows]


def fill_numeric(df: DataFrame, gap_columns: Sequence[str] | None = None) -> DataFrame:
    """Fill missing numbers with the column median; filled integer columns become doubles.

    A column without any value stays missing. Pass `gap_columns` to skip the scan that finds them.
    """
    columns = list(numeric_gaps(df) if gap_columns is None else gap_columns)
    if not columns:
        return normalise_missing(df)
    medians = exact_quantiles(df, columns, [0.5])
    packed = medians.select(F.struct(*[F.col(f"q{i}")[0].alias(f"m{i}") for i in range(len(columns))]).alias("m"))
    filled = {
        c: F.coalesce(nan_to_null(named(c).cast("double")), F.col("__medians")[f"m{i}"])
        for i, c in enumerate(columns)
    }
    return normalise_missing(df).withColumn("__medians", packed.scalar()).withColumns(filled).drop("__medians")


def fill_text(df: DataFrame, filler: str = "Unknown") -> DataFrame:
    columns = text_columns(df)
    return df.withColumns({c: F.coalesce(named(c), F.lit(filler)) for c in columns}) if columns else df


def trim_texts(df: DataFrame) -> DataFrame:
    columns = text_columns(df)
    return df.withColumns({c: trim_text(named(c)) for c in columns}) if columns else df


def date_formats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """For each text column the formats to read it with: those of one reading, and the order of day and
    month that reads more of its values. If both read as many, the month comes first; if neither reads
    any, there is none.

    One aggregate over the columns, of which the driver reads a single row.
    """
    columns = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    if not columns:
        return {}
    orders = (MONTH_FIRST_FORMATS, DAY_FIRST_FORMATS)
    counts = df.agg(
        *[
            F.array(*[F.count_if(coerce_timestamp(named(c), formats=o).isNotNull()) for o in orders]).alias(f"n{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    chosen = {}
    for i, c in enumerate(columns):
        month, day = counts[f"n{i}"]
        chosen[c] = DEFAULT_DATE_FORMATS + (orders[day > month] if month or day else ())
    return chosen


def unread_dates(
    df: DataFrame, name_parts: tuple[str, ...] = CLEANING_DATE_PARTS, formats: Sequence[str] | None = None
) -> DataFrame:
    """How much of each date-like text column `standardise_dates` cannot read: (column, present, unread)."""
    columns = [c for c in date_like_columns(df, name_parts) if isinstance(df.schema[c].dataType, T.StringType)]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, present bigint, unread bigint")
    chosen = date_formats(df, columns) if formats is None else dict.fromkeys(columns, formats)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(named(c)).alias("present"),
            F.count_if(named(c).isNotNull() & coerce_timestamp(named(c), formats=chosen[c]).isNull()).alias("unread"),
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def standardise_dates(
    df: DataFrame,
    name_parts: tuple[str, ...] = CLEANING_DATE_PARTS,
    formats: Sequence[str] | None = None,
    numeric: str = "epoch_ns",
) -> DataFrame:
    """Turn columns with a date-like name into timestamps; unreadable values become missing.

    Without `formats`, those of each text column are chosen by one aggregate (`date_formats`);
    `unread_dates` reports what they leave.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = date_like_columns(df, name_parts)
    chosen = date_formats(df, columns) if formats is None else {}
    changed = {
        c: coerce_timestamp(named(c), types[c], chosen.get(c, formats or DEFAULT_DATE_FORMATS), numeric)
        for c in columns
        if not (numeric == "keep" and isinstance(types[c], T.NumericType))
    }
    return df.withColumns(changed) if changed else df


def apply_cleaning(
    df: DataFrame,
    remove_duplicates: bool = True,
    fill_numbers: bool = True,
    fill_texts: bool = True,
    trim: bool = True,
    dates: bool = False,
    date_spellings: Sequence[str] | None = None,
    gap_columns: Sequence[str] | None = None,
) -> DataFrame:
    """The cleaning pipeline in its fixed order: duplicates, numbers, texts, spaces, dates.

    Medians come from the deduplicated rows. The order is part of the result: rows that become
    equal only after trimming stay.
    """
    cleaned = normalise_missing(df)
    if fill_numbers and gap_columns is None:
        gap_columns = numeric_gaps(cleaned)  # copies of a row have the same gaps
    if remove_duplicates:
        cleaned = drop_duplicates(cleaned)
        if fill_numbers and gap_columns:
            cleaned = stored(cleaned)  # read for the medians and for the result; rows shuffle once
    if fill_numbers:
        cleaned = fill_numeric(cleaned, gap_columns)
    if fill_texts:
        cleaned = fill_text(cleaned)
    if trim:
        cleaned = trim_texts(cleaned)
    if dates:
        cleaned = standardise_dates(cleaned, formats=date_spellings)
    return cleaned


def auto_fix(df: DataFrame, date_spellings: Sequence[str] | None = None, **options) -> DataFrame:
    """All steps at once; dates cover every column whose name contains "date" or "time"."""
    cleaned = apply_cleaning(df, dates=False, **options)
    return standardise_dates(cleaned, DATE_NAME_PARTS, date_spellings)


def auto_fix_actions(df: DataFrame, profiled: DataFrame | None = None) -> DataFrame:
    """What `auto_fix` does to this frame: (ordinal, action)."""
    removed = F.when(
        F.col("duplicate_rows") > 0,
        F.concat(F.lit("Removed "), F.col("duplicate_rows").cast("string"), F.lit(" duplicate rows.")),
    )

    def filled(columns: list[str], before: str, after: str) -> Column:
        """One sentence per column of the list that has gaps."""
        gaps = F.filter("stats", lambda s: (s["missing"] > 0) & F.array_contains(names_array(columns), s["column"]))
        return F.transform(gaps, lambda s: F.concat(F.lit(before), s["column"], F.lit(after)))

    dated = F.transform(
        names_array(date_like_columns(df)),
        lambda c: F.concat(F.lit("Standardized date/time column '"), c, F.lit("'.")),
    )
    entries = F.concat(
        F.array_compact(F.array(removed)),
        filled(numeric_columns(df), "Filled missing numeric values in '", "' with median."),
        filled(text_columns(df), "Filled missing text values in '", "' with 'Unknown'."),
        dated,
    )
    return (profile(df) if profiled is None else profiled).select(
        F.posexplode(or_else(entries, fixed.NO_FIX_ACTIONS)).alias("ordinal", "action")
    )
