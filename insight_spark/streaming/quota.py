"""Live usage quota: analysis requests of a stream, allowed or not by what their user did before."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from insight_spark.functions import fixed

DECIDED = "event_id bigint, at bigint, user_id {user}, succeeded boolean, is_premium boolean, allowed boolean"
STATE = "used int, last bigint, held string"


def live_quota(runs: DataFrame, delay: str, limit: int = fixed.FREE_ANALYSIS_LIMIT, forget_after: timedelta | None = None) -> DataFrame:
    """Requests (event_id, ts, user_id, succeeded, is_premium) of a stream with `allowed` and `reason`.

    The same rule as users.usage_quota: premium users may always, others while fewer than `limit` of their
    earlier requests succeeded, in order of ts and event_id. Requests may arrive in any order and more than
    once, as long as they are not more than `delay` behind the newest: a request is decided when the
    watermark has passed its time, with all earlier ones there. Later copies of a decided request, and
    requests that come too late, are dropped. Null flags count as false, rows without ts or event_id are
    left out, and a null user is one user.

    State per user: the number of successes (never more than limit), and the requests that wait, which are
    those of the last `delay`. A timer wakes a user when the next request can be decided. With forget_after a
    user who was quiet for that long is forgotten, and starts anew; otherwise a count stays, as a few bytes.
    """
    user = runs.schema["user_id"].dataType.simpleString()
    flags = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in ("succeeded", "is_premium")]
    rows = runs.where("ts IS NOT NULL AND event_id IS NOT NULL").select(
        F.col("ts").cast("timestamp").alias("event_time"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("bigint").alias("event_id"), "user_id", *flags
    )
    quiet = None if forget_after is None else forget_after // timedelta(milliseconds=1)

    def decide(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, last, held = state.get if state.exists else (0, 0, "[]")
        waiting = {(at, event): (done, premium) for at, event, done, premium in json.loads(held)}
        if not state.hasTimedOut:
            for frame in frames:
                for at, event, done, premium in zip(frame["at"], frame["event_id"], frame["succeeded"], frame["is_premium"], strict=True):
                    waiting[int(at), int(event)] = bool(done), bool(premium)
        now = state.getCurrentWatermarkMs()
        ready = sorted(k for k in waiting if k[0] <= now * 1000)
        out = []
        for at, event in ready:
            done, premium = waiting.pop((at, event))
            if quiet is not None and last and at - last > quiet * 1000:
                used = 0
            out.append((event, at, key[0], done, premium, premium or used < limit))
            used = min(limit, used + done)
            last = at
        if waiting or used:
            state.update((used, last, json.dumps([[at, e, d, p] for (at, e), (d, p) in sorted(waiting.items())])))
            if waiting:
                # the first millisecond at which the earliest one is certain
                state.setTimeoutTimestamp(max(now + 1, -(-min(waiting)[0] // 1000)))
            elif quiet is not None:
                state.setTimeoutTimestamp(max(now + 1, last // 1000 + quiet + 1))
        elif state.exists:
            state.remove()
        if state.exists and quiet is not None and not waiting and last // 1000 + quiet < now:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["event_id", "at", "user_id", "succeeded", "is_premium", "allowed"])

    found = (
        rows.withWatermark("event_time", delay)
        .groupBy("user_id")
        .applyInPandasWithState(decide, DECIDED.format(user=user), STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
    refused = f"Free analysis limit reached ({limit}). Upgrade to continue."
    return found.select(
        "event_id", F.timestamp_micros("at").cast(runs.schema["ts"].dataType).alias("ts"), "user_id", "succeeded", "is_premium", "allowed",
        F.when(F.col("allowed"), "").otherwise(refused).alias("reason"),
    )
