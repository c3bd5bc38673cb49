"""Frequent values of columns: a bounded summary names the candidates, a second scan counts them exactly."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from insight_spark.functions.scalars import named


class Summary:
    """Misra-Gries: at most `most` values with counters. A value seen more than n / (most + 1) times is among
    them, and no counter is short by more than what was taken from all (`lost`)."""

    def __init__(self, most: int):
        self.most, self.held, self.lost = most, Counter(), 0

    def add(self, counts: dict[str, int]) -> None:
        """Counts of further rows. Those of one Arrow batch meet the summary, then it shrinks to its size."""
        self.held.update(counts)
        if len(self.held) > self.most:
            cut = sorted(self.held.values(), reverse=True)[self.most]
            self.lost += cut
            self.held = Counter({v: n - cut for v, n in self.held.items() if n > cut})


def candidates(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """column, value: every value (as text) that at least `share` of the rows may hold; at most 2 / share of
    each column, whatever the data."""
    most = int(2 / share) + 1

    def run(batches):
        summaries, total = [Summary(most) for _ in columns], 0
        for batch in batches:
            total += batch.num_rows
            for summary, values in zip(summaries, batch.columns, strict=True):
                counted = pc.value_counts(values.drop_null())
                summary.add(dict(zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist(), strict=True)))
        rows = [(c, v, n, s.lost) for c, s in zip(columns, summaries, strict=True) for v, n in s.held.items()]
        rows += [(c, None, total, s.lost) for c, s in zip(columns, summaries, strict=True)]
        names, kinds = ["column", "value", "n", "lost"], [pa.string(), pa.string(), pa.int64(), pa.int64()]
        data = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(data, kinds, strict=True)], names=names)

    found = df.select(*[named(c).cast("string").alias(f"c{n}") for n, c in enumerate(columns)]).mapInArrow(run, "column string, value string, n long, lost long")
    total = found.where("value IS NULL").groupBy("column").agg(F.sum("n").alias("rows"), F.sum("lost").alias("slack"))
    kept = found.where("value IS NOT NULL").groupBy("column", "value").agg(F.sum("n").alias("n"))
    # a task may have lost sight of as many of a value as it has taken from every counter
    return kept.join(F.broadcast(total), "column").where(F.col("n") + F.col("slack") >= F.col("rows") * share).select("column", "value")


def frequent_values(df: DataFrame, columns: list[str] | None = None, share: float = 0.01) -> DataFrame:
    """column, value (as text), n, share: all values that at least `share` of the rows hold, counted exactly.

    Nulls are not values (they count as rows). Two scans: each task keeps a summary of at most 2 / share
    values per column, so memory does not depend on how many values there are; the candidates that the
    merged summaries leave, at most 2 / share per column, are broadcast and counted. An empty frame gives
    none.
    """
    if not 0 < share <= 1:
        raise ValueError("share lies above 0 and is at most 1")
    columns = list(columns or df.columns)
    wanted = candidates(df, columns, share)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value")) for c in columns]))
    counted = df.select(cells.alias("cell")).select("cell.*").join(F.broadcast(wanted), ["column", "value"], "left_semi")
    rows = df.select(F.count("*").alias("rows"))
    found = counted.groupBy("column", "value").agg(F.count("*").alias("n"))
    held = found.withColumn("share", F.col("n") / rows.scalar())
    return held.where(F.col("n") >= rows.scalar() * share)
