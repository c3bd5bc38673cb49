"""Profiles that grow with their table: mergeable sketches per batch, kept in a store, merged without rereading."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from insight_spark.functions.scalars import named

LG_REGISTERS = 12  # relative standard error of the distinct count: about 1.6 %
RANKS = 800  # size of the quantile sketch: ranks are off by about 0.4 % of the rows, rarely more
SKETCH = "column string, n bigint, missing bigint, total double, least string, greatest string, low double, high double, hll binary, kll binary"


def column_sketches(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column with what a profile needs of these rows, in a form that merges (SKETCH).

    NaN counts as missing. Numeric columns get their sum, least and greatest value and a quantile sketch
    (as doubles), others their least and greatest value as text; all get a distinct sketch. One scan, and
    one row per task is shuffled. A frame without rows gives counts of zero; arrays, maps and the like are
    taken as JSON text.
    """
    columns = list(columns or df.columns)
    parts = []
    for n, name in enumerate(columns):
        kind, value = df.schema[name].dataType, named(name)
        number = isinstance(kind, NumericType)
        if isinstance(kind, (DoubleType, FloatType)):
            value = F.when(~F.isnan(value), value)
        text = value.cast("string") if kind.simpleString().split("<")[0] not in ("array", "map", "struct") else F.to_json(value)
        double = value.cast("double") if number else F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.lit(name).alias("column"), F.count("*").alias("n"), (F.count("*") - F.count(value)).alias("missing"),
                F.sum(double).alias("total"), F.min(F.lit(None) if number else text).cast("string").alias("least"),
                F.max(F.lit(None) if number else text).cast("string").alias("greatest"), F.min(double).alias("low"), F.max(double).alias("high"),
                F.hll_sketch_agg(text, F.lit(LG_REGISTERS)).alias("hll"),
                (F.call_function("kll_sketch_agg_double", double, F.lit(RANKS)) if number else F.lit(None).cast("binary")).alias("kll"),
            ).alias(f"c{n}")
        )
    return df.agg(*parts).select(F.explode(F.array(*(f"c{n}" for n in range(len(parts))))).alias("s")).select("s.*")


def store_batch(sketches: DataFrame, path: str, batch: str) -> None:
    """Keep the sketches of one batch; the same batch again replaces itself."""
    sketches.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={quote(batch, safe='')}")


def stored_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a store: batch and the columns of SKETCH."""
    return spark.read.schema(f"{SKETCH}, batch string").parquet(path)


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of the same columns as one each. Counts, sums of whole numbers, extremes and distinct counts
    do not depend on the order of merging; quantiles stay within their error."""
    found = sketches.groupBy("column").agg(
        *(F.sum(c).alias(c) for c in ("n", "missing", "total")), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.hll_union_agg("hll").alias("hll"),
        F.call_function("kll_merge_agg_double", F.col("kll")).alias("kll"), F.max(F.col("kll").isNotNull()).alias("number"),
    )
    return found.withColumn("kll", F.when(F.col("number"), F.col("kll"))).drop("number").select(*(c.split()[0] for c in SKETCH.split(", ")))


def sketch_profile(sketches: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """column, n, missing, distinct (estimate), mean, least, greatest (as text), quantiles (estimates; null
    for columns without numbers)."""
    some = F.col("kll").isNotNull() & (F.col("n") > F.col("missing"))
    # a sketch without values has no quantiles, and asking it is an error
    wanted = F.call_function("kll_sketch_get_quantile_double", F.col("kll"), F.array(*map(F.lit, quantiles)))
    return sketches.select(
        "column", "n", "missing", F.coalesce(F.hll_sketch_estimate("hll"), F.lit(0)).alias("distinct"),
        F.try_divide("total", F.col("n") - F.col("missing")).alias("mean"),
        F.coalesce("least", F.col("low").cast("string")).alias("least"), F.coalesce("greatest", F.col("high").cast("string")).alias("greatest"),
        F.when(some, wanted).alias("quantiles"),
    )
