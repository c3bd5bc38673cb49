"""Cubes: totals for every combination of dimensions, coarser cells made from finer ones."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from insight_spark.functions.scalars import named
from insight_spark.session import stored

LG_REGISTERS = 12


def cube(
    df: DataFrame, dimensions: list[str], sums: list[str] = (), distinct: list[str] = (), exact: bool = True, levels: list[tuple[str, ...]] | None = None
) -> DataFrame:
    """One row per cell: the dimensions (null where a cell spans all), grouping (bit per dimension, the first
    highest, set where it spans all), n, sum_, min_, max_ of `sums` and distinct_ of `distinct` columns.

    levels: the combinations of dimensions wanted, all of them by default. Null is a value of a dimension;
    grouping tells it from "all". Nulls count in no sum or distinct count. exact: distinct counts are counts
    of distinct pairs of cell and value; otherwise estimates of sketches (about 1.6 % standard error).

    Rows are read once: only the finest cells are made from them. Each coarser level is made from the level
    with one dimension more that was made before it, so its input is cells, not rows, and no row is
    multiplied. Distinct pairs shrink on the way in the same manner. The cell of all has as many pairs as
    there are values; they are counted by all tasks.
    """
    dimensions, sums, distinct = list(dimensions), list(sums), list(distinct)
    wanted = [tuple(d for d in dimensions if d in level) for level in levels] if levels is not None else [
        c for size in range(len(dimensions), -1, -1) for c in combinations(dimensions, size)
    ]
    d = {name: f"d{n}" for n, name in enumerate(dimensions)}
    rows = df.select(*[named(c).alias(d[c]) for c in dimensions], *[named(c).alias(f"s{n}") for n, c in enumerate(sums)], *[named(c).alias(f"v{n}") for n, c in enumerate(distinct)])
    cells: dict[tuple[str, ...], DataFrame] = {}
    pairs: dict[tuple[str, ...], list[DataFrame]] = {}
    state = ["n", *(f"{what}{n}" for n in range(len(sums)) for what in ("sum", "min", "max"))]
    hll = [] if exact else [f"h{n}" for n in range(len(distinct))]

    def merged(frame: DataFrame, level: tuple[str, ...]) -> DataFrame:
        how = {"s": F.sum, "n": F.sum, "m": None}
        found = [(F.min if c.startswith("min") else F.max if c.startswith("max") else how[c[0]])(c).alias(c) for c in state]
        return frame.groupBy(*(d[c] for c in level)).agg(*found, *(F.hll_union_agg(h).alias(h) for h in hll))

    finest = tuple(dimensions)
    needed = closed_under_parents(wanted, finest)
    for level in needed:
        if level == finest:
            parts = [F.count("*").alias("n")]
            for n in range(len(sums)):
                parts += [f(f"s{n}").alias(f"{what}{n}") for f, what in ((F.sum, "sum"), (F.min, "min"), (F.max, "max"))]
            parts += [F.hll_sketch_agg(F.col(f"v{n}").cast("string"), F.lit(LG_REGISTERS)).alias(h) for n, h in enumerate(hll)]
            cells[level] = stored(rows.groupBy(*(d[c] for c in level)).agg(*parts))
            pairs[level] = [stored(rows.select(*d.values(), f"v{n}").where(F.col(f"v{n}").isNotNull()).distinct()) for n in range(len(distinct))] if exact else []
        else:
            parent = next(p for p in reversed(list(cells)) if set(p) > set(level) and len(p) == len(level) + 1)
            cells[level] = stored(merged(cells[parent], level))
            pairs[level] = [stored(p.select(*(d[c] for c in level), f"v{n}").distinct()) for n, p in enumerate(pairs[parent])]
    out = []
    for level in wanted:
        frame = cells[level].where("n > 0")
        for n in range(len(distinct)):
            if exact:
                keys = [d[c] for c in level]
                counted = pairs[level][n].groupBy(*keys).agg(F.count("*").alias(f"u{n}"))
                counted = counted.select(*(F.col(k).alias(f"p{n}{k}") for k in keys), f"u{n}")
                same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"p{n}{k}")) for k in keys], F.lit(True))
                frame = frame.join(counted, same, "left") if keys else frame.withColumn(f"u{n}", counted.scalar())
            else:
                frame = frame.withColumn(f"u{n}", F.hll_sketch_estimate(f"h{n}"))
        bits = sum(1 << (len(dimensions) - 1 - n) for n, c in enumerate(dimensions) if c not in level)
        values = [F.col(d[c]).alias(c) if c in level else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in dimensions]
        measures = [F.col(f"{what}{n}").alias(f"{what}_{c}") for n, c in enumerate(sums) for what in ("sum", "min", "max")]
        counts = [F.coalesce(f"u{n}", F.lit(0)).cast("long").alias(f"distinct_{c}") for n, c in enumerate(distinct)]
        out.append(frame.select(*values, F.lit(bits).alias("grouping"), "n", *measures, *counts))
    return reduce(DataFrame.unionByName, out)


def closed_under_parents(wanted: list[tuple[str, ...]], finest: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The wanted levels and those between them and the finest, larger ones first."""
    needed = {finest}
    for level in wanted:
        while set(level) < set(finest) and level not in needed:
            needed.add(level)
            grown = set(level) | {next(c for c in finest if c not in level)}
            level = tuple(c for c in finest if c in grown)
    return sorted(needed, key=lambda level: (-len(level), [finest.index(c) for c in level]))
