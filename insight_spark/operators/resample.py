"""Regular series from irregular rows: one value per group and calendar step, gaps filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType

from insight_spark.functions.scalars import named
from insight_spark.operators.series import BLOCK, shifted

STEPS = {
    "minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY",
    "month": "INTERVAL 1 MONTH", "quarter": "INTERVAL 3 MONTH", "year": "INTERVAL 1 YEAR",
}
FILLS = ("none", "zero", "last", "linear")


def resample(
    df: DataFrame,
    time: str,
    measures: dict[str, Column],
    step: str = "day",
    by: list[str] | tuple[str, ...] = (),
    fill: str | dict[str, str] = "none",
    start: Column | None = None,
    end: Column | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """One row per group and calendar step from a group's first step to its last: by, time, measures.

    measures: name -> aggregate of the rows of a step (F.sum("x")). fill: what a measure is in steps without
    rows, for all or by name: "none" (null), "zero", "last" (the step with rows before it), or "linear" (on
    the line through the steps with rows before and after, by elapsed time). start and end widen every
    group's series to the steps of these times: before its first row there is nothing to fill from but
    zero, after its last the last value stays. A step whose measure is null though it has rows stays null
    and is filled from like any other. Rows with a null time are left out; a null group is a group. The
    time of a step is its beginning, of the input's time type.

    Rows are added up per group and step before anything moves. A step with rows learns the next one of its
    group (series.shifted, so one long series spreads as well as many), and writes the steps in between
    itself: no calendar is joined, and no window holds a series.
    """
    if step not in STEPS:
        raise ValueError(f"step is one of {', '.join(STEPS)}")
    fills = {name: fill if isinstance(fill, str) else fill.get(name, "none") for name in measures}
    if set(fills.values()) - set(FILLS):
        raise ValueError(f"fill is one of {', '.join(FILLS)}")
    keys = [f"k{n}" for n in range(len(by))]
    to_step = lambda c: F.date_trunc(step, c.cast("timestamp")).cast("timestamp_ntz")
    own = df.where(named(time).isNotNull()).groupBy(*[named(c).alias(k) for c, k in zip(by, keys)], to_step(named(time)).alias("step"))
    seen = own.agg(*(m.alias(f"m{n}") for n, m in enumerate(measures.values())))
    values = [f"m{n}" for n in range(len(measures))]
    jump = F.expr(STEPS[step])
    wanted = {"later": ("step", -1)} | {f"{m}_later": (m, -1) for m in values}
    if start is not None:
        wanted["earlier"] = ("step", 1)
    rows = shifted(seen, ["step"], wanted, keys, block)
    until = F.col("later") - jump
    if end is not None:
        until = F.coalesce(until, F.greatest(F.col("step"), to_step(end)))
    steps = F.sequence("step", F.coalesce(until, F.col("step")), jump)
    if start is not None:
        head = to_step(start)
        lead = F.when(F.col("earlier").isNull() & (head < F.col("step")), F.sequence(head, F.col("step") - jump, jump))
        steps = F.concat(F.coalesce(lead, F.array().cast("array<timestamp_ntz>")), steps)
    spread = rows.withColumn("at", F.explode(steps))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    share = (micros("at") - micros("step")) / (micros("later") - micros("step"))
    out = []
    for value, (name, how) in zip(values, fills.items()):
        kind, here = seen.schema[value].dataType, F.col("at") == F.col("step")
        before = F.col("at") < F.col("step")
        zero = F.lit(0).cast(kind) if how == "zero" else F.lit(None).cast(kind)
        if how == "last":
            found = F.when(~before, F.col(value))
        elif how == "linear":
            line = F.col(value) + (F.col(f"{value}_later") - F.col(value)) * share
            found = F.when(here, F.col(value).cast("double")).when(~before, F.when(F.col("later").isNull(), F.col(value).cast("double")).otherwise(line.cast("double")))
        else:
            found = F.when(here, F.col(value)).otherwise(zero)
        out.append(found.alias(name))
    at = F.col("at") if isinstance(df.schema[time].dataType, TimestampNTZType) else F.col("at").cast(df.schema[time].dataType)
    return spread.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], at.alias(time), *out)
