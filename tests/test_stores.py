import json
import os

import pytest
from pyspark.sql import functions as F

from insight_spark.session import shared_folder
from insight_spark.sources import stores


def at(text="2024-05-06 07:08:09"):
    return F.lit(text).cast("timestamp_ntz")


def reports_frame(spark, rows):
    return spark.createDataFrame(rows, "email string, file_name string, analysis string, doctor string")


def test_report_records(spark):
    frame = reports_frame(spark, [("a@x.com", "f.csv", "text", None)])
    row = stores.report_records(frame, at()).first()
    assert len(row.report_id) == 14 and row.created_at == "2024-05-06T07:08:09Z"
    assert (row.translation, row.answer, row.doctor) == ("", "", "")
    assert stores.report_records(frame, at()).first() == row


def test_store_and_list(spark, folder):
    rows = [("A@x.com ", "1", "t", ""), ("b@x.com", "2", "t", ""), ("", "3", "t", ""), (None, "4", "t", "")]
    stores.append_records(stores.report_records(reports_frame(spark, rows), at()), folder, "report_id")
    stores.append_records(stores.report_records(reports_frame(spark, [("a@X.com", "5", "t", "")]), at("2024-06-01")), folder, "report_id")
    mine = stores.list_records(spark, folder, "report_id", " A@x.com")
    assert [r.file_name for r in mine.collect()] == ["5", "1"]
    assert stores.list_records(spark, folder, "report_id").count() == 3
    assert stores.list_records(spark, folder, "report_id", "nobody@x.com").count() == 0


def test_reading_one_user_prunes(spark, folder, plan):
    rows = [(f"u{i}@x.com", str(i), "t", "") for i in range(50)]
    stores.append_records(stores.report_records(reports_frame(spark, rows), at()), folder, "report_id")
    text = plan(stores.list_records(spark, folder, "report_id", "u7@x.com"))
    assert "PartitionFilters: [isnotnull(key_prefix" in text and "EqualTo(user_key," in text


def test_active_user_is_spread_over_files(spark, folder):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.range(2000).select(
            F.when(F.col("id") % 3 == 0, F.concat(F.lit("u"), "id", F.lit("@x.com"))).otherwise("hot@x.com").alias("email"),
            F.col("id").cast("string").alias("file_name"), F.lit("t").alias("analysis"), F.lit("").alias("doctor"),
        )
        stores.append_records(stores.report_records(frame, at()), folder, "report_id")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = spark.read.parquet(stores.current(spark, folder)).where("email = 'hot@x.com'").select(F.input_file_name().alias("file"))
    assert hot.distinct().count() > 1


def test_json_store_skips_broken_lines(spark, folder):
    records = stores.report_records(reports_frame(spark, [("a@x.com", "1", "t", "")]), at())
    stores.append_records(records, folder, "report_id", fmt="json")
    version = stores.current(spark, folder)
    partition = next(d for d in os.listdir(version) if d.startswith("key_prefix="))
    with open(os.path.join(version, partition, "extra.json"), "w") as f:
        f.write('{"broken\n' + json.dumps({"email": "a@x.com", "report_id": "zz", "created_at": "2020", "user_key": "k"}) + "\n")
    schema = "email string, report_id string, file_name string, created_at string, user_key string, key_prefix string"
    rows = stores.list_records(spark, folder, "report_id", fmt="json", schema=schema).collect()
    assert [r.created_at for r in rows] == ["2024-05-06T07:08:09Z", "2020"]
    with pytest.raises(ValueError):
        stores.list_records(spark, folder, "report_id", fmt="json")


def test_share_links(spark):
    rows = [("a@x.com", "1", "text", ""), ("a@x.com", "2", "", "finding"), ("a@x.com", "3", "", None)]
    shared = {r.file_name: r for r in stores.share_links(reports_frame(spark, rows), "https://h", at()).collect()}
    assert set(shared) == {"1", "2"}
    assert shared["1"].link == f"https://h?share={shared['1'].share_id}" and len(shared["1"].share_id) == 16
    assert stores.share_links(reports_frame(spark, rows)).first().link.startswith("?share=")


def test_snapshots(spark, folder):
    frame = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    snap = stores.dashboard_snapshot(frame, "", "f.csv", created_at=at())
    row = snap.first()
    assert (row.email, row.rows, row.columns, row.missing_values, row.duplicate_rows) == ("local_user", 3, 2, 2, 1)
    assert row.data_quality_score == 100 - 33 - 25 and row.industry_template == "General Business"
    assert stores.dashboard_snapshot(frame.limit(0), "", "f.csv").count() == 0
    stores.append_records(snap, folder, "dashboard_id", keep_local=True)
    assert stores.list_records(spark, folder, "dashboard_id", "").count() == 1


def test_purge(spark, folder):
    rows = [("a@x.com", "1", "t", ""), ("a@x.com", "2", "t", ""), ("b@x.com", "3", "t", "")]
    stores.append_records(stores.report_records(reports_frame(spark, rows), at()), folder, "report_id")
    requests = spark.createDataFrame([(" A@X.com",), ("A@X.com",), ("zz@x.com",)], "email string")
    kept = stores.purge_users(stores.list_records(spark, folder, "report_id"), requests)
    assert [r.file_name for r in kept.collect()] == ["3"]


def test_repeated_append_adds_nothing(spark, folder):
    frame = reports_frame(spark, [("a@x.com", "1", "t", ""), ("a@x.com", "1", "t", ""), ("b@x.com", "2", "t", "")])
    records = stores.report_records(frame, at())
    for _ in range(3):
        stores.append_records(records, folder, "report_id")
    assert stores.list_records(spark, folder, "report_id").count() == 2
    stores.append_records(records.limit(0), folder, "report_id")
    assert stores.versions(spark, folder) == [0]


def test_purge_switches_the_version(spark, folder):
    rows = [("a@x.com", "1", "t", ""), ("b@x.com", "2", "t", "")]
    stores.append_records(stores.report_records(reports_frame(spark, rows), at()), folder, "report_id")
    stores.purge_store(spark, folder, "report_id", spark.createDataFrame([("A@x.com",)], "email string"))
    assert stores.versions(spark, folder) == [1] and os.listdir(folder) == ["version-1"]
    assert [r.file_name for r in stores.list_records(spark, folder, "report_id").collect()] == ["2"]
    stores.append_records(stores.report_records(reports_frame(spark, rows[:1]), at()), folder, "report_id")
    assert stores.list_records(spark, folder, "report_id").count() == 2


def test_compaction_bounds_files(spark, folder):
    for day in range(1, 5):
        frame = reports_frame(spark, [(f"u{k}@x.com", "f", "t", "") for k in range(20)])
        stores.append_records(stores.report_records(frame, at(f"2024-05-0{day}")), folder, "report_id")
    count = lambda: sum(f.endswith(".parquet") for _, _, names in os.walk(folder) for f in names)
    before, rows = count(), stores.list_records(spark, folder, "report_id").count()
    stores.compact(spark, folder, "report_id")
    assert rows == 80 == stores.list_records(spark, folder, "report_id").count() and count() < before / 2


def test_share_store(spark, folder):
    rows = [("A@x.com", "1", "text", ""), (None, "2", "text", "")]
    links = stores.share_links(reports_frame(spark, rows), "https://h", at())
    stores.append_records(links, folder, "share_id", owner="shared_by")
    assert [r.link for r in stores.list_records(spark, folder, "share_id", "a@x.com").collect()] == [r.link for r in links.where("shared_by = 'A@x.com'").collect()]


def test_shared_folder_uses_the_configured_one(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one.startswith(base) and one != two


def test_rewriting_json_keeps_what_the_schema_does_not_read(spark, folder):
    frame = reports_frame(spark, [("a@x.com", "1", "t", ""), ("b@x.com", "2", "t", "")])
    stores.append_records(stores.report_records(frame, at()), folder, "report_id", fmt="json")
    part = os.path.join(stores.current(spark, folder), "key_prefix=k0")
    os.makedirs(part, exist_ok=True)
    extra = ['{"broken', json.dumps({"user_key": "0", "report_id": "zz", "more": 7})]
    with open(os.path.join(part, "extra.json"), "w") as f:
        f.write("\n".join(extra) + "\n")
    stores.purge_store(spark, folder, "report_id", spark.createDataFrame([("a@x.com",)], "email string"), "json", "email string")
    lines = [r.value for r in spark.read.text(stores.current(spark, folder)).collect()]
    assert set(extra) <= set(lines) and len(lines) == 3 and sum("b@x.com" in x for x in lines) == 1


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_store_from_before_versions(spark, folder, fmt):
    first, second = (stores.report_records(reports_frame(spark, [(f"{u}@x.com", u, "t", "")]), at()) for u in "ab")
    schema = "email string, report_id string, file_name string, created_at string, user_key string, key_prefix string"
    for name, step in (("one", "append"), ("two", "purge")):
        made = stores.append_records(first, f"{folder}/{name}-made", "report_id", fmt=fmt)
        old = f"{folder}/{name}"
        os.makedirs(folder, exist_ok=True)
        os.rename(f"{made}/version-0", old)
        if step == "append":
            stores.append_records(second, old, "report_id", fmt=fmt)
            assert sorted(r.file_name for r in stores.list_records(spark, old, "report_id", fmt=fmt, schema=schema).collect()) == ["a", "b"]
        else:
            stores.purge_store(spark, old, "report_id", spark.createDataFrame([("b@x.com",)], "email string"), fmt, schema)
            assert [r.file_name for r in stores.list_records(spark, old, "report_id", fmt=fmt, schema=schema).collect()] == ["a"]
            assert stores.versions(spark, old) == [0]
