"""Rows in one global order, without a task that sees them all: range partitions and their row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.session import stored

PART_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in so many bits


def laid_out(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """The rows dealt by range of `order` and sorted, with a number that grows in that order.

    The number has gaps (it names the partition as well) and holds for one evaluation only, as the
    borders of ranges are sampled: store the frame, or what is made of it, before using it twice.
    Rows of equal order go to one partition, so end `order` with a column that tells rows apart if
    very many may be equal. Nulls come first.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def consecutive(df: DataFrame, name: str) -> DataFrame:
    """Numbers of laid_out in a stored frame, made consecutive from 0.

    The driver learns one count per partition, and a table of as many rows is broadcast.
    """
    part = F.shiftright(F.col(name), PART_BITS)
    counts = df.groupBy(part.alias("part")).count().collect()
    start, rows = 0, []
    for part_id, n in sorted(tuple(r) for r in counts):
        rows.append(f"({part_id}L, {start}L)")
        start += n
    if not rows:
        return df
    starts = df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({name}_part, {name}_start)")
    place = F.col(name).bitwiseAND(F.lit((1 << PART_BITS) - 1)) + F.col(f"{name}_start")
    dealt = df.join(F.broadcast(starts), part == F.col(f"{name}_part"))
    return dealt.withColumn(name, place).select(*df.columns)


def numbered(df: DataFrame, order: list[str | Column], name: str = "at") -> DataFrame:
    """The rows with their place (from 0) in the order of `order`, as a stored table."""
    return consecutive(stored(laid_out(df, order, name)), name)
