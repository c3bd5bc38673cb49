"""Correlation and covariance of all pairs of numeric columns in one scan, with pairwise missing values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NumericType

from insight_spark.functions.scalars import named

PARTIAL = "i int, j int, n double, mx double, my double, cxx double, cyy double, cxy double"
BLOCK = 64  # columns of one block: a task multiplies blocks of columns, and holds the moments of all pairs


def moments(x: np.ndarray, y: np.ndarray):
    """Pairwise n, means and centred moments of two blocks of columns; NaN is missing. The columns are
    shifted by their own medians first, so that neither large offsets nor a few far values cost digits."""
    has_x, has_y = ~np.isnan(x), ~np.isnan(y)
    shift_x, shift_y = (np.nanmedian(np.where(h.any(0), v, 0.0), axis=0) for v, h in ((x, has_x), (y, has_y)))
    a, b = np.where(has_x, x - shift_x, 0.0), np.where(has_y, y - shift_y, 0.0)
    hx, hy = has_x.astype(float), has_y.astype(float)
    n = hx.T @ hy
    safe = np.maximum(n, 1)
    sx, sy = a.T @ hy, hx.T @ b
    mx, my = sx / safe, sy / safe
    return n, mx + shift_x[:, None], my + shift_y[None, :], (a * a).T @ hy - sx * mx, hx.T @ (b * b) - sy * my, a.T @ b - sx * my


def merged(a, b):
    """Moments of both parts together."""
    n = a[0] + b[0]
    share = np.where(n > 0, b[0] / np.maximum(n, 1), 0.0)
    dx, dy = b[1] - a[1], b[2] - a[2]
    weight = a[0] * share
    return n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per pair of numeric columns: column_a, column_b (in the frame's order), n, covariance (of the
    sample), correlation.

    A pair uses the rows in which both columns have a value (null and NaN are missing; infinite values count
    as missing too). covariance is null for fewer than two rows, correlation also where a column does not
    vary. An empty frame has pairs with n = 0.

    Each task adds up centred moments of its batches by blocks of columns, as matrix products; one row per
    pair and task is shuffled, and merging is exact algebra on centred moments, so neither a large offset nor
    the order of merging costs digits.
    """
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    blocks = [(a, b) for a in range(0, len(columns), BLOCK) for b in range(a, len(columns), BLOCK)]

    def run(batches):
        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            x[~np.isfinite(x)] = np.nan
            for a, b in blocks:
                found = moments(x[:, a : a + BLOCK], x[:, b : b + BLOCK])
                held[a, b] = merged(held[a, b], found) if (a, b) in held else found
        for (a, b), found in held.items():
            i, j = np.nonzero(a + np.arange(found[0].shape[0])[:, None] < b + np.arange(found[0].shape[1])[None, :])
            kinds = [pa.int32(), pa.int32()] + [pa.float64()] * 6
            arrays = [i + a, j + b, *(m[i, j] for m in found)]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(arrays, kinds, strict=True)], names=[c.split()[0] for c in PARTIAL.split(", ")])

    values = df.select(*[named(c).cast("double").alias(f"c{n}") for n, c in enumerate(columns)])
    parts = values.mapInArrow(run, PARTIAL).where("n > 0")
    # means first, then moments about them: each part brings its own and its distance from the whole
    mean = parts.groupBy("i", "j").agg(F.sum("n").alias("all_n"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("ax"), (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("ay"))
    both = parts.groupBy("i", "j").agg(F.collect_list(F.struct("n", "mx", "my", "cxx", "cyy", "cxy")).alias("parts"))
    add = lambda p, q: f"aggregate(parts, 0D, (s, p) -> s + {p} + p.n * {q})"
    dx, dy = "(p.mx - ax)", "(p.my - ay)"
    whole = both.join(mean, ["i", "j"]).select(
        "i", "j", "all_n", F.expr(add("p.cxx", f"{dx} * {dx}")).alias("cxx"), F.expr(add("p.cyy", f"{dy} * {dy}")).alias("cyy"), F.expr(add("p.cxy", f"{dx} * {dy}")).alias("cxy")
    )
    pairs = df.sparkSession.createDataFrame(
        [(i, j, columns[i], columns[j]) for i in range(len(columns)) for j in range(i + 1, len(columns))], "i int, j int, column_a string, column_b string"
    )
    out = pairs.join(whole, ["i", "j"], "left")
    vary = (F.col("all_n") > 1) & (F.col("cxx") > 0) & (F.col("cyy") > 0)
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cxy") / F.sqrt("cxx") / F.sqrt("cyy")))
    return out.select(
        "column_a", "column_b", F.coalesce("all_n", F.lit(0)).cast("long").alias("n"),
        F.when(F.col("all_n") > 1, F.col("cxy") / (F.col("all_n") - 1)).alias("covariance"), F.when(vary, bounded).alias("correlation"),
    )
