"""Event-time windows and the live quota: micro-batches with late, shuffled and repeated rows against the batch result."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from insight_spark.operators import users
from insight_spark.plans import streams
from insight_spark.streaming import quota, windows

DAY = datetime(2024, 1, 1)


def add(spark, path, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


EVENTS = "id long, ts timestamp_ntz, g string, v double"


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    at = lambda h: DAY + timedelta(hours=h)
    batches = [
        [(1, at(0.5), "a", 1.0), (2, at(1.5), "a", 2.0), (3, None, "a", 9.0), (4, at(0.2), None, 4.0)],
        [(5, at(9), "a", 1.0), (6, at(8.5), "b", 1.0), (7, at(0.7), "a", 5.0)],  # 7 is late, but its window is open
        [(8, at(20), "a", 1.0), (9, at(8.1), "b", 2.0)],
        [(10, at(21), "a", 1.0), (11, at(0.9), "a", 7.0), (12, at(1.1), "a", 7.0), (13, at(0.9), "z", 7.0)],  # three too late
    ]
    path, table, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    found = None
    for k, rows in enumerate(batches):
        add(spark, path, EVENTS, rows)
        found = windows.event_windows(source(spark, path, EVENTS), "ts", {"n": F.count("*"), "v": F.sum("v")}, "1 hour", "2 hours", by=["g"])
        running = windows.store_windows(found, table, progress)  # a new run each time, from where the last one was
        running.awaitTermination()
    stored = spark.read.schema(found.schema).parquet(table)
    got = {(r.window_start.hour, r.g): (r.n, r.v) for r in stored.collect()}
    assert got == {(0, "a"): (2, 6.0), (0, None): (1, 4.0), (1, "a"): (1, 2.0), (8, "b"): (2, 3.0), (9, "a"): (1, 1.0)}
    events = spark.createDataFrame([r for b in batches for r in b], EVENTS)
    late = windows.late_rows(events, stored, "ts", "1 hour", windows.watermark_of(running), by=["g"])
    assert {(r.window_start.hour, r.g): r.n_late for r in late.collect()} == {(0, "a"): 1, (1, "a"): 1, (0, "z"): 1}
    batch = windows.event_windows(events, "ts", {"n": F.count("*")}, "1 hour", "2 hours", by=["g"])
    assert sum(r.n for r in batch.collect()) == 12


RUNS = "event_id long, ts timestamp_ntz, user_id long, succeeded boolean, is_premium boolean"


def runs(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        user = rng.choice([1, 1, 1, 2, 3, None])
        out.append((k, DAY + timedelta(minutes=rng.randrange(3000)), user, rng.choice([True, False, None]), user == 2 or (None if user == 3 else False)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_quota_does_not_depend_on_how_requests_arrive(spark, tmp_path, seed):
    """Batches in an order shuffled by up to ten hours, with repeated requests, and a restart in between."""
    rows, rng = runs(seed, 200), random.Random(seed + 9)
    arriving = sorted(((r[1] + timedelta(hours=rng.uniform(0, 10)), r) for r in rows + rng.sample(rows, 60)), key=lambda x: x[0])
    path, table, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for low in range(0, len(arriving), 65):
        add(spark, path, RUNS, [r for _, r in arriving[low : low + 65]] + [(None, DAY, 1, True, False), (10_000, None, 1, True, False)])
        if low % 130 == 65:
            found = quota.live_quota(source(spark, path, RUNS), "11 hours")
            windows.store_windows(found, table, progress).awaitTermination()
    add(spark, path, RUNS, [(9999, DAY + timedelta(days=9), 77, False, False)])
    windows.store_windows(quota.live_quota(source(spark, path, RUNS), "11 hours"), table, progress).awaitTermination()
    got = spark.read.schema(found.schema).parquet(table)
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("succeeded", "is_premium")}
    want = users.usage_quota(spark.createDataFrame(rows, RUNS).withColumns(flags).withColumn("user_id", F.coalesce("user_id", F.lit(-1))))
    have = got.withColumn("user_id", F.coalesce("user_id", F.lit(-1)))
    assert sorted(map(tuple, have.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_quiet_users_are_forgotten(spark, tmp_path):
    at = lambda h: DAY + timedelta(hours=h)
    path, table, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    add(spark, path, RUNS, [(1, at(0), 1, True, False), (2, at(1), 1, True, False), (3, at(2), 1, True, False)])
    add(spark, path, RUNS, [(4, at(40), 2, False, False)])
    add(spark, path, RUNS, [(5, at(41), 1, True, False), (6, at(90), 2, False, False)])
    found = quota.live_quota(source(spark, path, RUNS), "1 hour", forget_after=timedelta(hours=24))
    windows.store_windows(found, table, progress).awaitTermination()
    got = {r.event_id: r.allowed for r in spark.read.schema(found.schema).parquet(table).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_a_batch_comes_whole_in_files_of_bounded_size(spark, tmp_path):
    """Batches of very different sizes, one of them empty: each is one micro-batch, none is written by one task."""
    size = {0: 1, 1: 950, 2: 0, 3: 30, 4: 400, 5: 7}
    rows = [(k * 10_000 + n, None if n % 9 == 4 else f"v{n}", k) for k, m in size.items() for n in range(m)]
    frame = spark.createDataFrame(rows, "id long, v string, batch int").repartition(3)
    stream = streams.stream_of(spark, frame, str(tmp_path / "s"), file_rows=100)
    assert stream.columns == ["id", "v"]
    seen = []
    writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    writer.foreachBatch(lambda df, _: seen.append(sorted(map(tuple, df.collect())))).start().awaitTermination()
    assert seen == [sorted(r[:2] for r in rows if r[2] == k) for k in size]
    stored = spark.read.parquet(str(tmp_path / "s" / "source")).groupBy(F.input_file_name()).agg(F.count_if("came").alias("n"))
    files = [r.n for r in stored.collect()]
    assert len(files) == 10 * len(size) and max(files) <= 100
