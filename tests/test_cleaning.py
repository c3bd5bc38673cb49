import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from insight_spark.operators import cleaning, profile, reports

NAN = float("nan")
ROWS = [
    (1, 10, 1.0, " a", "2024-01-01", True),
    (1, 10, 1.0, " a", "2024-01-01", True),
    (2, None, NAN, None, "bad", None),
    (3, 30, 5.0, "a", None, False),
    (4, 41, None, " b ", "2024-02-30", False),
]
SCHEMA = "id bigint, n int, v double, t string, order_date string, flag boolean"


@pytest.fixture
def messy(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_pipeline(messy):
    rows = by_id(cleaning.apply_cleaning(messy))
    assert len(rows) == 4
    assert rows[2].n == 30.0 and rows[2].v == 3.0  # medians of the deduplicated rows
    assert rows[2].t == "Unknown" and rows[1].t == "a" and rows[4].t == "b"
    assert rows[2].flag is None and rows[3].order_date == "Unknown"


def test_types_after_filling(messy):
    types = dict(cleaning.apply_cleaning(messy).dtypes)
    assert types["id"] == "bigint"  # no gaps: stays an integer
    assert types["n"] == "double"  # gaps were filled
    assert types["flag"] == "boolean"


def test_matches_pandas(messy):
    pdf = pd.DataFrame(ROWS, columns=["id", "n", "v", "t", "order_date", "flag"]).drop_duplicates()
    for c in ("id", "n", "v"):
        pdf[c] = pdf[c].fillna(pdf[c].median())
    rows = by_id(cleaning.apply_cleaning(messy))
    for _, want in pdf.iterrows():
        assert (rows[want.id].n, rows[want.id].v) == (want.n, want.v)


def test_steps_can_be_switched_off(messy):
    rows = cleaning.apply_cleaning(messy, False, False, False, False, False).collect()
    assert len(rows) == 5 and [r.t for r in rows].count(None) == 1
    trimmed = by_id(cleaning.apply_cleaning(messy, fill_texts=False))
    assert trimmed[2].t is None  # trimming keeps missing text missing


def test_trimming_may_leave_equal_rows(spark):
    frame = spark.createDataFrame([("a",), (" a",)], "t string")
    once = cleaning.apply_cleaning(frame)
    assert [r.t for r in once.collect()] == ["a", "a"]
    assert cleaning.apply_cleaning(once).count() == 1


def test_cleaning_leaves_no_gaps(messy):
    cleaned = cleaning.apply_cleaning(messy)
    missing = {r.column: r.missing for r in profile.column_stats(cleaned).collect()}
    assert {c for c, n in missing.items() if n} == {"flag"}


def test_column_without_values_stays_missing(spark):
    frame = spark.createDataFrame([(None, 1), (None, 2)], "v double, n int")
    assert [r.v for r in cleaning.fill_numeric(frame).collect()] == [None, None]


def test_date_columns(spark):
    frame = spark.createDataFrame([("2024-01-02", "2024-01-02", 86_400_000_000_000)], "order_date string, time string, Update_ns bigint")
    cleaned = cleaning.standardise_dates(frame).first()
    assert cleaned.order_date == dt.datetime(2024, 1, 2) and cleaned.time == "2024-01-02"
    assert cleaned.Update_ns == dt.datetime(1970, 1, 2)
    kept = cleaning.standardise_dates(frame, numeric="keep").first()
    assert kept.Update_ns == 86_400_000_000_000
    fixed = cleaning.auto_fix(frame).first()
    assert fixed.time == dt.datetime(2024, 1, 2)


def test_action_log(messy, spark):
    actions = [r.action for r in cleaning.auto_fix_actions(messy).orderBy("ordinal").collect()]
    assert actions == [
        "Removed 1 duplicate rows.",
        "Filled missing numeric values in 'n' with median.",
        "Filled missing numeric values in 'v' with median.",
        "Filled missing text values in 't' with 'Unknown'.",
        "Filled missing text values in 'order_date' with 'Unknown'.",
        "Standardized date/time column 'order_date'.",
    ]
    clean = spark.createDataFrame([(1,)], "id int")
    assert [r.action for r in cleaning.auto_fix_actions(clean).collect()] == [
        "No major cleaning issues found. Dataset already looks clean."
    ]


def test_cleaning_summary(messy):
    row = reports.cleaning_summary(messy, cleaning.apply_cleaning(messy)).first()
    assert reports.cleaning_effect(messy).first() == row
    assert row.summary == (
        "Missing values: 6 → 1. Duplicate rows: 1 → 0. The cleaning steps improved dataset quality for analysis."
    )


def test_medians_do_not_cross_join(spark, folder, plan):
    spark.range(50).select("id", F.when(F.col("id") > 5, F.col("id") * 1.0).alias("v")).write.parquet(folder)
    text = plan(cleaning.fill_numeric(spark.read.parquet(folder)))
    assert "Subquery" in text and "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


def test_date_spellings(spark):
    day = dt.datetime(2024, 1, 31)
    spelled = {
        "2024-01-31 10:00:00.123": day.replace(hour=10, microsecond=123_000), "2024-01-31T10:00:00Z": day.replace(hour=10),
        "2024-01-31T10:00:00+02:00": day.replace(hour=8), "Jan 31, 2024": day, " 2024-01-31": day, "2024/1/31": day,
        "31 Jan 2024": day, "n/k": None, None: None,
    }
    frame = spark.createDataFrame([(t,) for t in spelled], "the_date string")
    rows = cleaning.standardise_dates(frame.withColumn("text", frame.the_date)).collect()
    assert {r.text: r.the_date for r in rows} == spelled
    assert tuple(cleaning.unread_dates(frame).first()) == ("the_date", 8, 1)


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        (["01/31/2024", "02/03/2024"], [(1, 31), (2, 3)]),
        (["31/01/2024", "02/03/2024"], [(1, 31), (3, 2)]),
        (["02/03/2024"], [(2, 3)]),  # both orders read it: the month comes first
        (["31.01.2024", "2024-05-06"], [(1, 31), (5, 6)]),
    ],
)
def test_order_of_day_and_month(spark, texts, want):
    frame = spark.createDataFrame([(t,) for t in texts], "date string")
    got = [(r.date.month, r.date.day) for r in cleaning.standardise_dates(frame.coalesce(1)).collect()]
    assert got == want
