import json
import os

import pytest
from insight_spark.streaming import payments

RAW = "event_time string, event_id bigint, payload string"


def event(time, number, email=None, place="customer_email", kind=payments.COMPLETED, customer="c", session=None):
    session = session or f"s{number}"
    obj = {"id": session, "customer": customer, "customer_email": "", "customer_details": {"email": ""}, "metadata": {}}
    if place == "customer_email":
        obj[place] = email
    else:
        obj[place] = {"email": email}
    return (time, number, json.dumps({"type": kind, "data": {"object": obj}}))


EVENTS = [
    event("t1", 1, "A@x.com"),
    event("t2", 2, " a@X.com ", "customer_details"),
    event("t1", 3, "b@x.com", "metadata"),
    event("t3", 4, "b@x.com", kind="invoice.paid"),
    event("t3", 5, "nobody@x.com"),
    event("t3", 6, "   "),
    event("t3", 7, None),
    ("t9", 8, "not json"),
    ("t9", 9, '{"type": "checkout.session.completed"}'),
]


@pytest.fixture
def profiles(spark):
    rows = [("a@x.com", False), ("b@x.com", None), ("c@x.com", True), ("d@x.com", False)]
    return spark.createDataFrame(rows, "email string, is_premium boolean")


def test_parse(spark):
    rows = payments.parse_events(spark.createDataFrame(EVENTS, RAW)).collect()
    got = {r.event_id: r.email for r in rows}
    assert {k: got[k] for k in (1, 2, 3, 5)} == {1: "a@x.com", 2: "a@x.com", 3: "b@x.com", 5: "nobody@x.com"}
    assert set(got) == {1, 2, 3, 5, 6, 7, 9}
    kept = payments.with_email(payments.parse_events(spark.createDataFrame(EVENTS, RAW)))
    assert sorted(r.event_id for r in kept.collect()) == [1, 2, 3, 5]


def test_first_place_wins(spark):
    body = {"type": payments.COMPLETED, "data": {"object": {
        "customer_details": {"email": "first@x.com"}, "customer_email": "second@x.com", "metadata": {"email": "third@x.com"}}}}
    frame = spark.createDataFrame([("t", 1, json.dumps(body))], RAW)
    assert payments.parse_events(frame).first().email == "first@x.com"


def add_file(spark, path, events):
    spark.createDataFrame(events, RAW).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, table, progress):
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(source)
    payments.store_activations(payments.parse_events(stream), table, progress).awaitTermination()


def test_activation_across_batches(spark, folder, profiles):
    source, table, progress = f"{folder}/in", f"{folder}/table", f"{folder}/progress"
    add_file(spark, source, EVENTS[:5])
    run(spark, source, table, progress)
    add_file(spark, source, [event("t0", 20, "a@x.com", session="late")])
    add_file(spark, source, [event("t5", 21, "b@x.com", session="new")])
    run(spark, source, table, progress)
    rows = {r.email: tuple(r)[1:] for r in payments.activated_profiles(profiles, spark.read.parquet(table)).collect()}
    assert rows == {
        "a@x.com": (True, "c", "s2"),  # the late event does not replace a newer one
        "b@x.com": (True, "c", "new"),
        "c@x.com": (True, None, None),
        "d@x.com": (False, None, None),
    }
    (own,) = [d for d in os.listdir(table) if d.startswith("progress=")]
    assert len([d for d in os.listdir(f"{table}/{own}") if d.startswith("batch_id=")]) == 3


def test_replayed_batch_overwrites_itself(spark, folder, profiles):
    source, table = f"{folder}/in", f"{folder}/table"
    add_file(spark, source, EVENTS)
    run(spark, source, table, f"{folder}/p1")
    once = sorted(map(str, payments.activated_profiles(profiles, spark.read.parquet(table)).collect()))
    run(spark, source, table, f"{folder}/p2")  # lost progress: batch 0 runs again, beside the older batches
    again = spark.read.parquet(table)
    assert again.select("progress").distinct().count() == 2
    assert sorted(map(str, payments.activated_profiles(profiles, again).collect())) == once


def test_only_profiles_that_were_there(spark):
    rows = [("a@x.com", False, "t1", None), ("b@x.com", False, "t2", None), ("c@x.com", False, "t0", "t3"), ("d@x.com", True, "t0", "t0")]
    profiles = spark.createDataFrame(rows, "email string, is_premium boolean, created_at string, premium_changed_at string")
    events = [event("t2", 1, "a@x.com"), event("t1", 2, "b@x.com"), event("t2", 3, "c@x.com")]
    paid = payments.parse_events(spark.createDataFrame(events, RAW))
    got = {r.email: r.is_premium for r in payments.activated_profiles(profiles, paid).collect()}
    assert got == {"a@x.com": True, "b@x.com": False, "c@x.com": False, "d@x.com": True}
    version = payments.folded(profiles, paid)
    assert {r.email: (r.is_premium, r.premium_changed_at) for r in version.collect()} == {
        "a@x.com": (True, "t2"), "b@x.com": (False, "t1"), "c@x.com": (False, "t3"), "d@x.com": (True, "t0")
    }
    reset = version.withColumn("is_premium", payments.F.lit(False))
    assert payments.activated_profiles(reset, paid).where("is_premium").count() == 0


def test_existing_ids_survive(spark):
    profile = spark.createDataFrame(
        [("a@x.com", True, "old", "olds")],
        "email string, is_premium boolean, stripe_customer_id string, stripe_checkout_session_id string",
    )
    none = payments.parse_events(spark.createDataFrame(EVENTS[3:4], RAW))
    assert tuple(payments.activated_profiles(profile, none).first())[2:] == ("old", "olds")


def test_store_parsed(spark, folder):
    add_file(spark, f"{folder}/in", EVENTS)
    stream = spark.readStream.schema(RAW).parquet(f"{folder}/in")
    payments.store_parsed(payments.parse_events(stream), f"{folder}/table", f"{folder}/p").awaitTermination()
    assert spark.read.parquet(f"{folder}/table").count() == 7


def test_hot_email_is_reduced_before_the_shuffle(spark, folder, plan):
    add_file(spark, f"{folder}/in", EVENTS)
    text = plan(payments.newest_per_email(payments.parse_events(spark.read.parquet(f"{folder}/in"))))
    assert "partial_max" in text and "Python" not in text
