"""Event-time windows over streams: tumbling, sliding and session windows that close when the watermark has passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from insight_spark.functions.scalars import named


def window_of(time: Column, size: str, slide: str | None = None, session: bool = False) -> Column:
    """The windows a time belongs to: of a size, one beginning every `slide` (tumbling without it), or a
    session that ends when nothing has come for `size`."""
    if session:
        return F.session_window(time, size)
    return F.window(time, size, slide) if slide else F.window(time, size)


def event_windows(
    events: DataFrame,
    time: str,
    measures: dict[str, Column],
    size: str,
    delay: str,
    slide: str | None = None,
    session: bool = False,
    by: list[str] | tuple[str, ...] = (),
) -> DataFrame:
    """One row per window and group: window_start, window_end, by, measures. Works on streams and batches.

    On a stream a window is written once, when the greatest event time seen is `delay` past its end; rows
    that come after that are dropped (late_rows counts them). State holds one row of partial results per open
    window and group, and rows are added up within their task first, so a busy group stays small. Rows with a
    null time belong to no window. A batch gives all windows of its rows.
    """
    marked = events.withColumn("event_time", named(time).cast("timestamp")).withWatermark("event_time", delay)
    found = marked.groupBy(window_of(F.col("event_time"), size, slide, session).alias("span"), *[named(c) for c in by])
    return found.agg(*(m.alias(name) for name, m in measures.items())).select(
        F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), *by, *measures
    )


def store_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a table, each once, also over restarts."""
    writer = windows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start(path)


def watermark_of(query: StreamingQuery) -> str | None:
    """The watermark that a finished stream has reached, as UTC text."""
    marks = [p["eventTime"].get("watermark") for p in query.recentProgress if p["eventTime"]]
    return max(filter(None, marks), default=None)


def late_rows(
    events: DataFrame, stored: DataFrame, time: str, size: str, watermark: str | Column, slide: str | None = None,
    by: list[str] | tuple[str, ...] = (), count: str = "n",
) -> DataFrame:
    """Rows that came too late: window_start, window_end, by, n_late, for windows that lost any.

    events: all rows that arrived; stored: the windows as written, whose column `count` counts their rows;
    watermark: how far the stream has come. A row that lies in several windows counts in each that lost it.
    Not for sessions, whose borders depend on what was dropped.
    """
    came = events.select(window_of(named(time).cast("timestamp"), size, slide).alias("span"), *by)
    came = came.groupBy("span", *by).agg(F.count("*").alias("came"))
    came = came.select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), *by, "came")
    closed = F.lit(watermark).cast("timestamp") if isinstance(watermark, str) else watermark
    keys = ["window_start", "window_end", *by]
    held = stored.select(*(F.col(c).alias(f"h{n}") for n, c in enumerate(keys)), F.col(count).alias("held"))
    same = [came[c].eqNullSafe(held[f"h{n}"]) for n, c in enumerate(keys)]
    both = came.where(F.col("window_end") <= closed).join(held, same, "left")
    late = F.col("came") - F.coalesce("held", F.lit(0))
    return both.select(*keys, late.alias("n_late")).where("n_late > 0")
