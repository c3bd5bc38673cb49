"""Windows over one long series (or few): frames, shifts and running totals without a task that holds a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from insight_spark.functions.scalars import named
from insight_spark.operators.asof import distance, ticks
from insight_spark.operators.ordered import PART_BITS, laid_out, numbered
from insight_spark.session import stored

BLOCK = 1 << 16  # rows of a series that one window sees, halo aside


def frame_columns(df: DataFrame, count: int) -> list[str]:
    """Names that df does not have."""
    used, out = {c.lower() for c in df.columns}, []
    for n in range(count):
        name = f"w{n}"
        while name in used:
            name += "_"
        used.add(name)
        out.append(name)
    return out


def row_frames(
    df: DataFrame,
    order_by: list[str | Column],
    measures: dict[str, Column],
    preceding: int,
    following: int = 0,
    by: list[str] | tuple[str, ...] = (),
    block: int = BLOCK,
) -> DataFrame:
    """df with window measures over the rows from `preceding` before to `following` after each row.

    measures: name -> aggregate or window expression, without its window (F.sum("x"), F.min("x"),
    F.first("x") and so on). order_by must tell rows of a series apart for a defined result; nulls come
    first. by: columns that name the series; null is one of them. New columns replace old ones of the name.

    Rows are numbered in order of series and order_by, cut into blocks of `block` rows (the frame's width at
    least), and each block gets the rows of its neighbours that its frames reach. One window task holds a
    block and its halo, whatever the length of a series.
    """
    if preceding < 0 or following < 0:
        raise ValueError("a frame reaches from rows before to rows after its own")
    return blocked(df, order_by, measures, (-preceding, following), by, max(block, preceding, following))


def shifted(
    df: DataFrame,
    order_by: list[str | Column],
    values: dict[str, tuple[str | Column, int]],
    by: list[str] | tuple[str, ...] = (),
    block: int = BLOCK,
) -> DataFrame:
    """df with values of other rows: name -> (column, n), n rows before (lag), or after if n is negative (lead).

    Null where there is no such row. See row_frames for the order and how it spreads.
    """
    reach = max([abs(n) for _, n in values.values()] or [0])
    measures = {name: F.lag(column, n) for name, (column, n) in values.items()}
    return blocked(df, order_by, measures, None, by, max(block, reach), reach)


def blocked(df, order_by, measures, frame, by, block, reach=None) -> DataFrame:
    at, own, home, part = frame_columns(df, 4)
    before, after = (reach, reach) if frame is None else (-frame[0], frame[1])
    rows = numbered(df, [*by, *order_by], at)
    here = F.expr(f"{at} div {block}")
    place = F.col(at) % block
    homes = F.filter(
        F.array(here, F.when((place >= block - before) & F.lit(before > 0), here + 1), F.when((place < after) & (here > 0), here - 1)),
        lambda b: b.isNotNull(),
    )
    spread = rows.withColumn(home, here).withColumn(part, F.explode(homes))
    window = W.partitionBy(part, *by).orderBy(at)
    if frame is not None:
        window = window.rowsBetween(*frame)
    found = spread.select("*", *(m.over(window).alias(f"{own}_{n}") for n, m in enumerate(measures.values())))
    found = found.where(F.col(part) == F.col(home))
    out = [c for c in df.columns if c not in measures]
    return found.select(*out, *(F.col(f"{own}_{n}").alias(name) for n, name in enumerate(measures)))


def piece_offsets(pieces: DataFrame, keys: list[str], sums: list[str]) -> DataFrame | None:
    """What the earlier partitions of each series hold, for series in several partitions: at most one for
    each border between partitions. The driver sees one row for each."""
    own = pieces.join(pieces.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n"), keys, "left_semi") if keys else pieces
    rows = sorted((r.asDict() for r in own.collect()), key=lambda r: r["part"])
    if not rows:
        return None
    total, out = {}, []
    for r in rows:
        key = tuple(r[k] for k in keys)
        held = total.setdefault(key, [None] * len(sums))
        out.append((r["part"], *key, *held))
        total[key] = [(a if b is None else b if a is None else a + b) for a, b in zip(held, (r[s] for s in sums))]
    schema = StructType([own.schema["part"], *(own.schema[k] for k in keys)])
    for s in sums:
        schema = schema.add(f"{s}_before", own.schema[s].dataType)
    return own.sparkSession.createDataFrame(out, schema)


def totalled(laid: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """A stored, laid out frame (column at) with running sums of the values up to each row, per series."""
    laid = laid.withColumn("part", F.shiftright("at", PART_BITS))
    window = W.partitionBy("part", *keys).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    pieces = laid.groupBy("part", *keys).agg(*(F.sum(v).alias(name) for name, v in values.items()))
    before = piece_offsets(pieces, keys, list(values))
    rows = laid.select("*", *(F.sum(v).over(window).alias(name) for name, v in values.items()))
    if before is None:
        return rows
    # the series in several partitions are at most as many as there are borders
    same = [rows["part"] == before["part"], *(rows[k].eqNullSafe(before[k]) for k in keys)]
    both = rows.join(F.broadcast(before), same, "left")
    zero = {name: F.lit(0).cast(rows.schema[name].dataType) for name in values}
    total = {name: F.when(F.col(name).isNull() & F.col(f"{name}_before").isNull(), None).otherwise(F.coalesce(name, zero[name]) + F.coalesce(f"{name}_before", zero[name])) for name in values}
    return both.select(*(rows[c] for c in laid.columns), *(c.alias(name) for name, c in total.items()))


def running_totals(
    df: DataFrame, order_by: list[str | Column], totals: dict[str, str | Column], by: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """df with the sum of each value (name -> column) over the rows of the series up to and with each row.

    Partial sums within a partition are windows, what earlier partitions hold is added. Nulls count as
    nothing; before the first value the total is null. Doubles are added in another order than one
    task would; decimals and integers are exact.
    """
    whole = F.struct(*[named(c).alias(f"c{n}") for n, c in enumerate(df.columns)]).alias("row")
    keys = [f"k{n}" for n in range(len(by))]
    values = [c if isinstance(c, Column) else named(c) for c in totals.values()]
    order = [c if isinstance(c, Column) else named(c) for c in order_by]
    rows = df.select(*[named(c).alias(k) for c, k in zip(by, keys)], *[c.alias(f"o{n}") for n, c in enumerate(order)], *[v.alias(f"v{n}") for n, v in enumerate(values)], whole)
    laid = stored(laid_out(rows, [*keys, *(f"o{n}" for n in range(len(order)))], "at"))
    found = totalled(laid, keys, {f"s{n}": F.col(f"v{n}") for n in range(len(values))})
    kept = [F.col("row")[f"c{n}"].alias(c) for n, c in enumerate(df.columns) if c not in totals]
    return found.select(*kept, *(F.col(f"s{n}").alias(name) for n, name in enumerate(totals)))


def range_frames(
    df: DataFrame,
    order_by: str,
    sums: dict[str, str | Column],
    before,
    after=0,
    by: list[str] | tuple[str, ...] = (),
    count: str | None = None,
) -> DataFrame:
    """df with sums over all rows of the series whose order_by lies from `before` before to `after` after.

    order_by: a time (before and after are timedeltas) or a number. sums: name -> column; count: name of a
    column for the number of rows in the frame. Rows with a null order_by share a frame of their own, as in
    SQL. A frame without values sums to null.

    Frames may hold any number of rows, so none is gathered: the sum of a frame is the running total at its
    end less the one before its start. Rows and both ends of every frame are laid out in one order, running
    totals run over it by partitions (see running_totals), and the two ends of a row meet again by its
    number. Doubles lose what the running total cannot hold (about 16 digits of it).
    """
    keys = [f"k{n}" for n in range(len(by))]
    whole = F.struct(*[named(c).alias(f"c{n}") for n, c in enumerate(df.columns)]).alias("row")
    time = ticks(named(order_by), df.schema[order_by].dataType)
    values = [c if isinstance(c, Column) else named(c) for c in sums.values()]
    rows = df.select(*[named(c).alias(k) for c, k in zip(by, keys)], time.alias("time"), *[v.alias(f"v{n}") for n, v in enumerate(values)], whole)
    rows = stored(rows.withColumn("id", F.monotonically_increasing_id()))
    nothing = [F.lit(None).cast(rows.schema[f"v{n}"].dataType).alias(f"v{n}") for n in range(len(values))]
    starts = rows.select(*keys, (F.col("time") - distance(before)).alias("time"), F.lit(0).alias("side"), *nothing, "id")
    here = rows.select(*keys, "time", F.lit(1).alias("side"), *(f"v{n}" for n in range(len(values))), "id")
    ends = rows.select(*keys, (F.col("time") + distance(after)).alias("time"), F.lit(2).alias("side"), *nothing, "id")
    laid = stored(laid_out(starts.unionByName(here).unionByName(ends), [*keys, "time", "side"], "at"))
    counted = {f"n{n}": F.when(F.col(f"v{n}").isNotNull(), 1).otherwise(0).cast("long") for n in range(len(values))}
    counted["n"] = F.when(F.col("side") == 1, 1).otherwise(0).cast("long")
    total = totalled(laid, keys, {f"s{n}": F.col(f"v{n}") for n in range(len(values))} | counted)
    side = lambda name, k: F.max(F.when(F.col("side") == k, F.col(name)))
    names = [f"s{n}" for n in range(len(values))] + list(counted)
    met = total.where("side <> 1").groupBy("id").agg(*(f(name, k).alias(f"{name}_{k}") for f in (side,) for name in names for k in (0, 2)))
    out = rows.select("id", "row").join(met, "id")
    kept = [F.col("row")[f"c{n}"].alias(c) for n, c in enumerate(df.columns) if c not in sums and c != count]
    zero = lambda name: F.coalesce(f"{name}_2", F.lit(0)) - F.coalesce(f"{name}_0", F.lit(0))
    found = [F.when(zero(f"n{n}") > 0, zero(f"s{n}")).cast(total.schema[f"s{n}"].dataType).alias(name) for n, name in enumerate(sums)]
    return out.select(*kept, *found, *([zero("n").alias(count)] if count else []))
