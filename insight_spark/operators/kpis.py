"""Industry KPI templates, first-number summary, what-if totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.functions import fixed
from insight_spark.functions.scalars import array_over, array_total, coerce_numeric, named
from insight_spark.operators.schema import normalise_missing, numeric_columns

AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "avg": F.avg,
    "max": F.max,
}


def industry_kpis(df: DataFrame, industries: Sequence[str] = tuple(fixed.INDUSTRIES)) -> DataFrame:
    """Long frame (industry, ordinal, label, value) for the chosen templates, from one aggregate.

    Templates work on the first and second numeric column; a frame with one numeric column uses
    it for both, one without any reports rows and columns. An empty frame gives no KPIs.
    """
    data, numeric = normalise_missing(df), numeric_columns(df)
    picked = [numeric[0], numeric[1] if len(numeric) > 1 else numeric[0]] if numeric else []
    exprs: dict[str, Column] = {"rows": F.count(F.lit(1)).cast("double")}
    shape = [("Rows", F.col("rows")), ("Columns", F.lit(float(len(df.columns))))]
    by_industry: dict[str, list[tuple[str, Column]]] = {}
    for industry in industries:
        template = fixed.INDUSTRY_KPIS.get(industry)
        if not numeric:
            by_industry[industry] = shape
        elif template is None:
            exprs["present"] = array_over(df.columns, lambda c: f"count({c})", "bigint")
            missing = F.col("rows") * len(df.columns) - array_total(F.col("present"))
            by_industry[industry] = shape + [("Missing Values", missing)]
        else:
            items = []
            for label, aggregate, position in template:
                name = f"{aggregate}_{position}"
                exprs[name] = AGGREGATES[aggregate](named(picked[position]).cast("double"))
                items.append((label, F.col(name)))
            by_industry[industry] = items
    entries = [
        F.struct(
            F.lit(industry).alias("industry"),
            F.lit(i).alias("ordinal"),
            F.lit(label).alias("label"),
            value.cast("double").alias("value"),
        )
        for industry, items in by_industry.items()
        for i, (label, value) in enumerate(items)
    ]
    totals = data.agg(*[e.alias(n) for n, e in exprs.items()])
    return totals.where("rows > 0").select(F.inline(F.array(*entries)))


def auto_dashboard(df: DataFrame) -> DataFrame:
    """Total, mean, max and min of the first numeric column; no row if there is none or no data."""
    numeric = numeric_columns(df)
    schema = "column string, total double, mean double, max double, min double"
    if not numeric:
        return df.sparkSession.createDataFrame([], schema)
    value = named(numeric[0]).cast("double")
    totals = normalise_missing(df).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
        F.min(value).alias("min"),
    )
    return totals.where("rows > 0").select(F.lit(numeric[0]).alias("column"), "total", "mean", "max", "min")


def scenario(df: DataFrame, column: str, percents: Sequence[float] = (10.0,)) -> DataFrame:
    """What-if on a column total: one row per percent change (each within -100..100)."""
    if any(not -100 <= p <= 100 for p in percents):
        raise ValueError("percent changes must lie within -100..100")
    dtype = df.schema[column].dataType
    base = df.agg(F.coalesce(F.sum(coerce_numeric(named(column), dtype)), F.lit(0.0)).alias("base_value"))
    change = F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("change_percent")
    adjusted = F.col("base_value") * (1 + F.col("change_percent") / 100)
    return (
        base.select("base_value", change)
        .withColumn("adjusted_value", adjusted)
        .withColumn("difference", F.col("adjusted_value") - F.col("base_value"))
        .withColumn(
            "meaning",
            F.when(F.col("difference") > 0, fixed.SCENARIO_UP)
            .when(F.col("difference") < 0, fixed.SCENARIO_DOWN)
            .otherwise(fixed.SCENARIO_FLAT),
        )
    )
