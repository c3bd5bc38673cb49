"""Exact interpolated quantiles: sketches bracket the wanted ranks, only the values in between are sorted.

One scan builds a mergeable quantile sketch of every column, which gives two values around each wanted
rank. A second scan counts what lies below them and counts the values between them, which are dealt by
range, so that each part holds neighbouring values of bounded number; only the few parts that hold the
wanted ranks are ranked. Results are exact: if a rank is not where its sketch has put it, which the counts
show, that column's values are all taken. No task sees a whole column, and little is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window as W, functions as F

from insight_spark.functions.scalars import named, nan_to_null
from insight_spark.session import stored

RANKS = 800  # size of the sketches; ranks are off by about 0.4 % of the values, rarely more
SLACK = 0.01  # how far below and above the wanted rank the brackets lie
FEW = 2000  # columns of so few values are taken whole: their brackets could lie between two neighbours


def brackets(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> tuple[list[list[tuple[float, float]]], bool]:
    """For each column and probability two values between which the quantile lies, as its sketch has it; and
    whether there is any value."""
    ranks = [r for p in probabilities for r in (max(0.0, p - SLACK), min(1.0, p + SLACK))]
    sketch = lambda c: F.call_function("kll_sketch_agg_double", nan_to_null(named(c).cast("double")), F.lit(RANKS))
    sketches = df.agg(*(sketch(c).alias(f"s{i}") for i, c in enumerate(columns)), *(F.count(nan_to_null(named(c).cast("double"))).alias(f"n{i}") for i, c in enumerate(columns)))
    wanted = F.array(*map(F.lit, ranks))
    # an empty sketch has no quantiles, and asking it is an error
    found = [F.when(F.col(f"n{i}") > FEW, F.call_function("kll_sketch_get_quantile_double", F.col(f"s{i}"), wanted)) for i in range(len(columns))]
    row = sketches.select(F.array(*found).alias("q"), F.greatest(F.lit(0), *(F.col(f"n{i}") for i in range(len(columns)))).alias("most")).first()
    whole = [(-math.inf, math.inf)] * len(probabilities)
    return [list(zip(q[::2], q[1::2], strict=True)) if q else whole for q in row.q], row.most > 0


def between(df: DataFrame, columns: Sequence[str], limits: list[list[tuple[float, float]]]):
    """The values between the limits, counted, as a stored frame (c, k, part, v, n); how many values each
    column has, how many lie below each lower limit and between both, as an observation."""
    values = df.select(*[nan_to_null(named(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
    seen, cells, measures = Observation(), [], []
    for i, own in enumerate(limits):
        v = F.col(f"v{i}")
        measures.append(F.count(v).alias(f"n{i}"))
        for k, (low, high) in enumerate(own):
            inside = (v >= F.lit(low)) & (v <= F.lit(high))
            measures += [F.count_if(v < F.lit(low)).alias(f"b{i}_{k}"), F.count_if(inside).alias(f"i{i}_{k}")]
            cells.append(F.when(inside, F.struct(F.lit(i).alias("c"), F.lit(k).alias("k"), v.alias("v"))))
    spread = values.observe(seen, *measures).select(F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull())))
    counted = stored(spread.groupBy("c", "k", "v").agg(F.count(F.lit(1)).alias("n")))
    return stored(counted.repartitionByRange("c", "k", "v").withColumn("part", F.spark_partition_id())), seen


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """One row: for each column (in order) ``q0, q1, ...`` an array of quantiles and ``n0, n1, ...``
    the number of values. Linear interpolation between neighbours; missing values are skipped, and a
    column without values has null.

    Two scans run when called; the values around the wanted ranks are written to the shared folder.
    """
    limits, some = brackets(df, columns, probabilities)
    placed, targets = df.sparkSession.createDataFrame([], "c int, k int, v double, n bigint, part int"), []
    whole = [(-math.inf, math.inf)] * len(probabilities)
    for _ in range(2 if some else 0):
        placed, seen = between(df, columns, limits)
        if placed.isEmpty():  # no bracket holds a value, and an observation of nothing has no counts
            limits = [whole] * len(columns)
            continue
        counts, targets, missed = seen.get, [], set()
        for i in range(len(columns)):
            total = counts[f"n{i}"]
            for k, p in enumerate(probabilities):
                target = (total - 1) * float(p)
                low = math.floor(target)
                high, below = min(low + 1, total - 1), counts[f"b{i}_{k}"]
                if total and not below <= low <= high < below + counts[f"i{i}_{k}"]:
                    missed.add(i)
                if total:
                    targets.append((i, k, total, below, target, low, high))
        if not missed:
            break
        limits = [whole if i in missed else own for i, own in enumerate(limits)]
    wanted = df.sparkSession.createDataFrame(targets, "c int, k int, total bigint, below bigint, target double, low bigint, high bigint")
    upto = F.sum("m").over(W.partitionBy("c", "k").orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    parts = placed.groupBy("c", "k", "part").agg(F.sum("n").alias("m")).withColumn("before", upto - F.col("m"))
    # as many rows as there are columns and probabilities
    targets = (
        parts.join(F.broadcast(wanted), ["c", "k"])
        .withColumn("before", F.col("before") + F.col("below"))
        .where("(low >= before AND low < before + m) OR (high >= before AND high < before + m)")
    )
    rank = F.col("before") + F.sum("n").over(
        W.partitionBy("c", "k", "part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    )
    share = F.max(F.col("target") - F.col("low"))
    found = (
        placed.join(targets, ["c", "k", "part"])
        .withColumn("rank", rank)
        .groupBy("c", "k")
        .agg(
            F.max("total").alias("total"),
            share.alias("share"),
            F.min(F.when(F.col("rank") > F.col("low"), F.col("v"))).alias("lower"),
            F.min(F.when(F.col("rank") > F.col("high"), F.col("v"))).alias("upper"),
        )
        .withColumn(
            "value",
            F.when(F.col("share") == 0, F.col("lower")).otherwise(
                F.col("lower") * (1 - F.col("share")) + F.col("upper") * F.col("share")
            ),
        )
    )

    def one(i: int, k: int):
        return F.max(F.when((F.col("c") == i) & (F.col("k") == k), F.col("value")))

    count = [F.coalesce(F.max(F.when(F.col("c") == i, F.col("total"))), F.lit(0)) for i in range(len(columns))]
    return found.agg(
        *[
            F.when(count[i] > 0, F.array(*[one(i, k) for k in range(len(probabilities))])).alias(f"q{i}")
            for i in range(len(columns))
        ],
        *[n.cast("bigint").alias(f"n{i}") for i, n in enumerate(count)],
    )
