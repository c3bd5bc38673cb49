"""Row sets with multiplicity, and what changed between two versions of a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.functions.scalars import named


def multiplicities(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("n_left", "n_right")) -> DataFrame:
    """Every distinct row of both frames (same columns by name) with how often each holds it; nulls are equal.

    One grouping of both, counted within tasks first, so a row that repeats very often stays one row a task.
    """
    columns = left.columns
    if set(columns) != set(right.columns) or set(names) & set(columns):
        raise ValueError("both frames need the same columns, and counts names of their own")
    sides = [df.select(*[named(c) for c in columns], F.lit(k).alias("side_of_row")) for k, df in enumerate((left, right))]
    count = lambda k, name: F.count(F.when(F.col("side_of_row") == k, 1)).alias(name)
    return sides[0].unionByName(sides[1]).groupBy(*[named(c) for c in columns]).agg(count(0, names[0]), count(1, names[1]))


def repeated(rows: DataFrame, times: Column) -> DataFrame:
    """Each row as often as `times` says; long repetitions are written a thousand at a time, so none is one list."""
    whole, step = rows.columns, 1000
    counted = rows.withColumn("times_of_row", times).where("times_of_row > 0")
    blocks = counted.withColumn("block_of_row", F.explode(F.sequence(F.lit(0), F.expr(f"(times_of_row - 1) div {step}"))))
    here = F.least(F.lit(step), F.col("times_of_row") - F.col("block_of_row") * step)
    return blocks.withColumn("one_of_row", F.explode(F.sequence(F.lit(1), here.cast("int")))).select(*whole)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left, each as many times less as right holds it."""
    counted = multiplicities(left, right, ("n_left_of_row", "n_right_of_row"))
    out = repeated(counted, F.greatest(F.col("n_left_of_row") - F.col("n_right_of_row"), F.lit(0)))
    return out.select(*left.columns)


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both frames, each as often as the frame that holds it less often."""
    counted = multiplicities(left, right, ("n_left_of_row", "n_right_of_row"))
    return repeated(counted, F.least("n_left_of_row", "n_right_of_row")).select(*left.columns)


def row_changes(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per key: keys, status, changed (names of columns), n_old, n_new.

    status: "added", "removed", "changed", "same", or "repeated" where a version holds the key more than once,
    so that rows cannot be told apart. columns: what is compared, the shared columns by default; null equals
    null, NaN equals NaN. Columns are compared as they are, so give both versions the same types. Keys may be null.

    Both versions meet in one grouping by key; no join, and a key of very many rows is counted within tasks.
    """
    shared = [c for c in old.columns if c in set(new.columns) and c not in keys]
    columns = shared if columns is None else list(columns)
    whole = lambda df, k: df.select(
        *[named(c).alias(f"k{n}") for n, c in enumerate(keys)], F.struct(F.lit(0).alias("z"), *[named(c).alias(f"c{n}") for n, c in enumerate(columns)]).alias("row"), F.lit(k).alias("side")
    )
    both = whole(old, 0).unionByName(whole(new, 1))
    side = lambda k: F.col("side") == k
    met = both.groupBy(*(f"k{n}" for n in range(len(keys)))).agg(
        *(F.count(F.when(side(k), 1)).alias(name) for k, name in ((0, "n_old"), (1, "n_new"))),
        *(F.any_value(F.when(side(k), F.col("row")), ignoreNulls=True).alias(name) for k, name in ((0, "before"), (1, "after"))),
    )
    differ = [F.when(~F.col(f"before.c{n}").eqNullSafe(F.col(f"after.c{n}")), F.lit(c)) for n, c in enumerate(columns)]
    names = F.filter(F.array(*differ).cast("array<string>"), lambda c: c.isNotNull()) if columns else F.array().cast("array<string>")
    single = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    status = (
        F.when((F.col("n_old") > 1) | (F.col("n_new") > 1), "repeated").when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed")
        .when(F.size("names") > 0, "changed").otherwise("same")
    )
    met = met.withColumn("names", F.when(single, names).otherwise(F.array().cast("array<string>")))
    return met.select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(keys)], status.alias("status"), F.col("names").alias("changed"), "n_old", "n_new")


def change_counts(changes: DataFrame) -> DataFrame:
    """status, column, n: keys by status, and for changed ones also by column (null: all columns together)."""
    by_status = changes.groupBy("status").agg(F.count("*").alias("n")).select("status", F.lit(None).cast("string").alias("column"), "n")
    changed = changes.select("status", F.explode("changed").alias("column")).groupBy("status", "column").agg(F.count("*").alias("n"))
    return by_status.unionByName(changed)
