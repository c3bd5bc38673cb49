"""Profiling: shape, missing cells, duplicates, constant columns.

`profile` answers all of them from one scan: rows are grouped on all columns (partial
aggregation shrinks hot groups of copies before the shuffle) and every statistic is then a
weighted aggregate over the distinct rows. The statistics that need no row comparison
(`column_stats`) aggregate the scan directly, without that shuffle.

Grouping shuffles each distinct row of a task once, at every size and whatever the share of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from insight_spark.functions.scalars import array_over, array_total, named, names_array
from insight_spark.operators.schema import comparable, holds_map, normalise_missing, ordered

COPIES = "__copies"


def _ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def _column_structs(columns: list[str]) -> Column:
    """Array with one entry per column from `rows` and the arrays `present` and `same`."""

    def entry(name: Column, i: Column) -> Column:
        present = F.get("present", i)
        one_value = (present == F.col("rows")) & F.coalesce(F.get("same", i), F.lit(False))
        return F.struct(
            i.alias("ordinal"),
            name.alias("column"),
            (F.col("rows") - present).alias("missing"),
            ((present == 0) | one_value).alias("is_constant"),
        )

    return F.transform(names_array(columns), entry)


def _same(columns: list[str]) -> Column:
    """Per column: whether its least and greatest present values are equal."""
    return array_over(columns, lambda c: f"min({c}) = max({c})", "boolean").alias("same")


def weighted_present(columns: list[str]) -> Column:
    """Per column: number of present cells of rows weighted by `COPIES`."""
    return array_over(columns, lambda c: f"coalesce(sum(if({c} IS NULL, 0, {COPIES})), 0)", "bigint").alias("present")


def profile_shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def column_stats(df: DataFrame) -> DataFrame:
    """One row per column: rows, missing, is_constant. One pass, no shuffle of rows."""
    stats = comparable(df).agg(
        F.count(F.lit(1)).alias("rows"),
        array_over(df.columns, lambda c: f"count({c})", "bigint").alias("present"),
        _same(df.columns),
    )
    return stats.select("rows", F.inline(_column_structs(df.columns))).select(
        "ordinal", "column", "rows", "missing", "is_constant"
    )


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing cells per column, then one total row (column null) with the overall rate."""
    stats = column_stats(df)
    per_column = stats.select(
        "ordinal", "column", "missing", _ratio(F.col("missing"), F.col("rows")).alias("missing_rate")
    )
    total = stats.agg(F.sum("missing").alias("missing"), F.sum("rows").alias("cells")).select(
        F.lit(len(df.columns)).alias("ordinal"),
        F.lit(None).cast("string").alias("column"),
        "missing",
        _ratio(F.col("missing"), F.col("cells")).alias("missing_rate"),
    )
    return per_column.unionByName(total)


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value, counting missing as a value."""
    return column_stats(df).where("is_constant").select("ordinal", "column")


def grouped_copies(df: DataFrame) -> DataFrame:
    """Distinct rows with the number of copies of each."""
    data = comparable(df)
    return data.groupBy(*[named(c) for c in data.columns]).agg(F.count(F.lit(1)).alias(COPIES))


def row_counts() -> list[Column]:
    return [F.coalesce(F.sum(COPIES), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")]


def duplicates() -> Column:
    return F.col("rows") - F.col("distinct_rows")


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Rows, duplicate rows (every copy after the first) and their share."""
    counts = grouped_copies(df).agg(*row_counts()).select("rows", duplicates().alias("duplicate_rows"))
    return counts.withColumn("duplicate_rate", _ratio(F.col("duplicate_rows"), F.col("rows")))


def profile(df: DataFrame) -> DataFrame:
    """One row with everything the quality operators need.

    Columns: rows, columns, missing_cells, missing_rate, duplicate_rows, duplicate_rate,
    constant_columns (array of names), stats (array of per-column structs).
    """
    return profile_of_copies(grouped_copies(df), df.columns)


def profile_of_copies(copies: DataFrame, columns: list[str]) -> DataFrame:
    """The profile of the rows that were grouped into distinct rows with their number (`COPIES`)."""
    width = len(columns)
    return (
        copies.agg(*row_counts(), weighted_present(columns), _same(columns))
        .withColumn("columns", F.lit(width).cast("bigint"))
        .withColumn("stats", _column_structs(columns))
        .withColumn("missing_cells", F.col("rows") * width - array_total(F.col("present")))
        .withColumn("duplicate_rows", duplicates())
        .withColumn("missing_rate", _ratio(F.col("missing_cells"), F.col("rows") * max(width, 1)))
        .withColumn("duplicate_rate", _ratio(F.col("duplicate_rows"), F.col("rows")))
        .withColumn(
            "constant_columns",
            F.transform(F.filter("stats", lambda s: s["is_constant"]), lambda s: s["column"]),
        )
        .select(
            "rows", "columns", "missing_cells", "missing_rate", "duplicate_rows", "duplicate_rate",
            "constant_columns", "stats",
        )
    )


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate removal; missing values compare equal."""
    nested = [f.name for f in df.schema.fields if holds_map(f.dataType) and not isinstance(f.dataType, T.MapType)]
    if not nested:
        return _restore_maps(comparable(df).dropDuplicates(), df)
    kept = normalise_missing(df)
    keys = {f"__key{i}": ordered(named(c), df.schema[c].dataType) for i, c in enumerate(df.columns)}
    return kept.withColumns(keys).dropDuplicates(list(keys)).drop(*keys)


def _restore_maps(data: DataFrame, original: DataFrame) -> DataFrame:
    maps = {c: F.map_from_entries(named(c)) for c, t in original.dtypes if t.startswith("map")}
    return data.withColumns(maps) if maps else data
