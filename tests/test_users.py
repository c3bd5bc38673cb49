import datetime as dt

import pytest
from pyspark.sql import functions as F

from insight_spark.operators import users

PROFILES = [("a@x.com", "1", True, "t0"), ("b@x.com", "2", False, "t0"), ("dup@x.com", "3", True, "t0"), ("dup@x.com", "4", True, "t0")]
SCHEMA = "email string, id string, is_premium boolean, updated_at string"


@pytest.fixture
def profiles(spark):
    return spark.createDataFrame(PROFILES, SCHEMA)


def test_lookup(spark, profiles):
    asked = spark.createDataFrame([(" A@x.com",), ("b@x.com",), ("new@x.com",), ("dup@x.com",), ("",), (None,)], "email string")
    rows = {r.email: (r.is_premium, r.plan) for r in users.profile_lookup(asked, profiles).collect()}
    assert rows[" A@x.com"] == (True, "premium") and rows["b@x.com"] == (False, "free")
    assert {rows[e] for e in ("new@x.com", "dup@x.com", "", None)} == {(False, "free")}


def test_lookup_keeps_every_request_of_a_busy_user(spark, profiles):
    asked = spark.range(900).select(F.when(F.col("id") % 3 == 0, F.concat("id", F.lit("@x.com"))).otherwise("a@x.com").alias("email"))
    assert users.profile_lookup(asked, profiles).where("is_premium").count() == 600


def test_premium_status(profiles):
    rows = {r.email: r for r in users.premium_status(profiles.limit(2), [" B@x.com", ""]).collect()}
    assert rows["a@x.com"].plan == rows["b@x.com"].plan == "premium" and not rows["b@x.com"].is_premium
    plain = {r.email: r.plan for r in users.premium_status(profiles.limit(2), []).collect()}
    assert plain == {"a@x.com": "premium", "b@x.com": "free"}


def test_entitlements(spark):
    rows = [("forecast", False), ("forecast", True), ("compare", False), ("forecast", None), (None, False)]
    frame = spark.createDataFrame(rows, "feature string, is_premium boolean")
    assert [r.enabled for r in users.feature_entitlements(frame).collect()] == [False, True, True, False, True]
    own = users.feature_entitlements(frame, {"compare": True, "forecast": False})
    assert [r.enabled for r in own.collect()] == [True, True, False, True, True]


def brute_quota(rows, limit=2):
    used, out = {}, {}
    for event_id, minute, user, premium, ok in sorted(rows, key=lambda r: (r[1], r[0])):
        out[event_id] = premium or used.get(user, 0) < limit
        used[user] = used.get(user, 0) + (1 if ok else 0)
    return out


def test_quota_matches_brute_force(spark):
    rows = [(i, (i * 7919) % 101, 0 if i % 3 else i % 11, i % 11 == 5 and i % 3 == 0, i % 4 != 1) for i in range(300)]
    start = dt.datetime(2024, 1, 1)
    frame = spark.createDataFrame(
        [(i, start + dt.timedelta(minutes=m), u, p, ok) for i, m, u, p, ok in rows],
        "event_id int, ts timestamp_ntz, user_id int, is_premium boolean, succeeded boolean",
    )
    got = users.usage_quota(frame).collect()
    assert {r.event_id: r.allowed for r in got} == brute_quota(rows)
    assert {r.reason for r in got if r.allowed} == {""}
    assert {r.reason for r in got if not r.allowed} == {"Free analysis limit reached (2). Upgrade to continue."}


def test_quota_limits_before_the_shuffle(spark, folder, plan):
    spark.range(10).select(
        F.col("id").alias("event_id"), F.col("id").alias("ts"), F.lit(1).alias("user_id"), F.lit(False).alias("is_premium")
    ).write.parquet(folder)
    text = plan(users.usage_quota(spark.read.parquet(folder)))
    limits = [line for line in text.splitlines() if "WindowGroupLimit" in line]
    assert len(limits) == 2 and "Partial" in limits[1]


def test_usage_summary(spark):
    frame = spark.createDataFrame([(1,), (2,), (2,), (2,)], "user_id int")
    rows = {r.user_id: (r.used, r.used_capped, r.remaining, r.percent_used) for r in users.usage_summary(frame).collect()}
    assert rows == {1: (1, 1, 1, 50), 2: (3, 2, 0, 100)}
    assert users.usage_summary(frame, limit=7).where("user_id = 2").first().percent_used == int(3 / 7 * 100)


def test_upsert(spark, profiles):
    batch = spark.createDataFrame(
        [("A@x.com ", "9", "t1"), ("a@x.com", "", "t2"), ("new@x.com", None, "t3"), ("", "5", "t4"), (None, "6", "t4")],
        "email string, id string, ts string",
    )
    rows = {r.email: tuple(r)[1:] for r in users.profile_upsert(profiles.limit(2), batch).collect()}
    assert rows == {"a@x.com": ("9", True, "t2"), "b@x.com": ("2", False, "t0"), "new@x.com": (None, False, "t3")}
    again = {r.email: tuple(r)[1:] for r in users.profile_upsert(users.profile_upsert(profiles.limit(2), batch), batch).collect()}
    assert again == rows


def test_activate_inserts(spark, profiles):
    batch = spark.createDataFrame([("b@x.com", None, "t1"), ("new@x.com", "8", "t1")], "email string, id string, ts string")
    rows = {r.email: (r.id, r.is_premium) for r in users.premium_activate(profiles.limit(2), batch).collect()}
    assert rows == {"a@x.com": ("1", True), "b@x.com": ("2", True), "new@x.com": ("8", True)}


def test_lookup_with_overrides_and_idle_users(spark):
    asked = spark.createDataFrame([("A@x.com",), ("b@x.com",), ("c@x.com",)], "email string")
    profiles = spark.createDataFrame([("b@x.com", False)], "email string, is_premium boolean")
    rows = {r.email: r.plan for r in users.profile_lookup(asked, profiles, overrides=[" a@X.com", "b@x.com"]).collect()}
    assert rows == {"A@x.com": "premium", "b@x.com": "premium", "c@x.com": "free"}
    runs = spark.createDataFrame([(1,), (1,), (1,)], "user_id int")
    everyone = spark.createDataFrame([(1,), (2,), (2,)], "user_id int")
    got = {r.user_id: (r.used, r.remaining, r.percent_used) for r in users.usage_summary(runs, users=everyone).collect()}
    assert got == {1: (3, 0, 100), 2: (0, 2, 0)}


def test_activation_joins_once(spark, plan):
    profiles = spark.createDataFrame([("a", "1", False, "t")], "email string, id string, is_premium boolean, updated_at string")
    batch = spark.createDataFrame([("a", "1", "t")], "email string, id string, ts string")
    text = plan(users.premium_activate(profiles, batch))
    assert text.count("FullOuter") == 1 and "LeftOuter" not in text
