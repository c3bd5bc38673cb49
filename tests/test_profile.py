import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from insight_spark.operators import outliers, profile, quality, schema
from insight_spark.operators.quantiles import exact_quantiles

NAN = float("nan")
ROWS = [
    (1, 1.0, "a", True, None),
    (1, 1.0, "a", True, None),
    (2, NAN, None, False, None),
    (2, None, None, False, None),
    (2, NAN, None, False, None),
    (3, 0.0, "a ", None, None),
    (3, -0.0, "a ", None, None),
]
SCHEMA = "id bigint, v double, t string, flag boolean, empty string"


@pytest.fixture
def messy(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_roles(spark):
    frame = spark.createDataFrame(
        [], "a int, b decimal(5,2), c boolean, Updated string, lifetime_value double, d timestamp, m map<string,int>"
    )
    roles = {r.column: r for r in schema.column_roles(frame).collect()}
    assert [c for c, r in roles.items() if r.is_numeric] == ["a", "b", "lifetime_value"]
    assert [c for c, r in roles.items() if r.is_text] == ["Updated"]
    assert [c for c, r in roles.items() if r.is_date_like] == ["Updated", "lifetime_value"]


def test_unique_columns_keeps_first(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("a", "b.x", "a")
    assert schema.unique_columns(frame).collect()[0].asDict() == {"a": 1, "b.x": 2}


def test_profile_counts(messy):
    p = profile.profile(messy).first()
    assert (p.rows, p.columns) == (7, 5)
    assert p.missing_cells == 3 + 3 + 2 + 7
    # NaN and null are one missing value, 0.0 equals -0.0
    assert p.duplicate_rows == 1 + 2 + 1
    assert p.constant_columns == ["empty"]
    assert p.missing_rate == 15 / 35 and p.duplicate_rate == 4 / 7


def test_drop_duplicates(messy):
    assert profile.drop_duplicates(messy).count() == 3


def test_duplicates_match_pandas(messy):
    pdf = pd.DataFrame(ROWS, columns=["id", "v", "t", "flag", "empty"])
    assert profile.duplicate_profile(messy).first().duplicate_rows == int(pdf.duplicated().sum())


def test_map_columns(spark):
    frame = spark.createDataFrame([({"a": 1, "b": 2},), ({"b": 2, "a": 1},), ({"a": 2},)], "m map<string,int>")
    assert profile.duplicate_profile(frame).first().duplicate_rows == 1
    kept = profile.drop_duplicates(frame)
    assert kept.count() == 2 and dict(kept.dtypes)["m"] == "map<string,int>"


def test_arrays_and_dotted_names(spark):
    frame = spark.createDataFrame([([1], 1), ([1], 1), ([2], 1)], "a array<int>, `x.y` int")
    p = profile.profile(frame).first()
    assert p.duplicate_rows == 1 and p.constant_columns == ["x.y"]


def test_constant_needs_no_gap(spark):
    frame = spark.createDataFrame([("x", "y"), ("x", None)], "a string, b string")
    assert [r.column for r in profile.constant_columns(frame).collect()] == ["a"]


def test_empty_frame(spark):
    empty = spark.createDataFrame([], "a int, b string")
    p = quality.quality_score(empty).first()
    assert (p.rows, p.missing_cells, p.duplicate_rows, p.score, p.notes) == (0, 0, 0, 0, ["No data loaded."])
    assert p.constant_columns == ["a", "b"]
    assert profile.missing_profile(empty).count() == 3
    assert outliers.iqr_outliers(empty).first().outliers == 0


def test_quality_notes(spark):
    clean = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    row = quality.quality_score(clean).first()
    assert row.score == 100
    assert row.notes == ["Dataset looks structurally healthy for first-pass analysis."]
    assert quality.readiness(clean).first().band == "ready"


def test_score_is_clipped_by_its_caps(spark):
    frame = spark.createDataFrame([(None,) * 6] * 10, ", ".join(f"c{i} string" for i in range(6)))
    assert quality.quality_score(frame).first().score == 100 - 35 - 25 - 20
    assert quality.readiness(frame).first().band == "needs_cleaning"


def test_profile_is_one_scan_without_python(spark, folder, plan):
    spark.range(100).withColumn("v", F.rand(1)).write.parquet(folder)
    text = plan(quality.quality_score(spark.read.parquet(folder)))
    assert text.count("FileScan") == 1
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_column_stats_do_not_shuffle_rows(spark, folder, plan):
    spark.range(100).withColumn("v", F.rand(1)).write.parquet(folder)
    text = plan(profile.column_stats(spark.read.parquet(folder)))
    assert "hashpartitioning" not in text


def reference_quantile(values, p):
    return float(pd.Series(values, dtype="float64").quantile(p))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0])), min_size=0, max_size=60)
)
def test_quantiles_of_small_columns(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(frame, ["v"], [0.25, 0.5, 0.75]).first()
    present = [v for v in values if v is not None]
    assert row.n0 == len(present)
    if present:
        assert row.q0 == pytest.approx([reference_quantile(present, p) for p in (0.25, 0.5, 0.75)], abs=1e-6)
    else:
        assert row.q0 is None


SHAPES = {
    "uniform": "rand(7)",
    "hot value": "case when id % 3 = 0 then 42.0 else rand(3) * 100 end",
    "extremes": "case when id % 997 = 0 then 1e300 when id % 991 = 0 then -1e300 else id * 1.0 end",
    "few values": "cast(id % 5 as double)",
    "one value": "1.5D",
    "gaps": "case when id % 2 = 0 then null else exp(id % 40) + id end",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_quantiles_are_exact(spark, shape):
    frame = spark.range(20_000).select(F.expr(SHAPES[shape]).alias("v"), F.col("id"))
    values = [r.v for r in frame.select("v").collect() if r.v is not None]
    probabilities = [0.0, 0.25, 0.999]
    row = exact_quantiles(frame, ["v"], probabilities).first()
    assert row.n0 == len(values)
    assert row.q0 == pytest.approx([reference_quantile(values, p) for p in probabilities], rel=1e-12)


def test_quantiles_of_several_columns(spark):
    frame = spark.range(20_000).select(F.col("id"), (F.lit(1.0) / (F.col("id") + 1)).alias("v"))
    row = exact_quantiles(frame, ["id", "v"], [0.5, 1.0]).first()
    assert row.q0 == [9999.5, 19_999.0]
    assert row.q1 == pytest.approx([(1 / 10_000 + 1 / 10_001) / 2, 1.0], rel=1e-12)


def test_quantiles_count_repeated_rows(spark):
    """Repetition that no size estimate sees: 300 values, each a thousand times over."""
    frame = spark.range(300).select(F.col("id").cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(1000))))
    row = exact_quantiles(frame, ["v"], [0.25, 0.5]).first()
    assert row.n0 == 300_000 and row.q0 == [74.75, 149.5]


def test_quantiles_are_ranked_in_parts(spark, plan):
    frame = spark.range(1000).select(F.rand(1).alias("v"), F.rand(2).alias("w"))
    assert "percentile" not in plan(exact_quantiles(frame, ["v", "w"], [0.5]))


def test_quantiles_of_nothing(spark):
    frame = spark.createDataFrame([(None,)], "v double")
    row = exact_quantiles(frame, ["v"], [0.5]).first()
    assert row.n0 == 0 and (row.q0 is None or row.q0 == [None])


def test_outlier_rules(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 100.0, -50.0]
    frame = spark.createDataFrame([(v, 1.0, v if v < 5 else None) for v in values], "a double, flat double, few double")
    rows = {r.column: r.outliers for r in outliers.iqr_outliers(frame).collect()}
    series = pd.Series(values)
    q1, q3 = series.quantile(0.25), series.quantile(0.75)
    want = int(((series < q1 - 1.5 * (q3 - q1)) | (series > q3 + 1.5 * (q3 - q1))).sum())
    assert rows == {"a": want, "flat": 0, "few": 0} and want == 2


def test_outlier_column_limit(spark):
    frame = spark.range(10).select(*[F.col("id").alias(f"c{i}") for i in range(12)])
    assert outliers.iqr_outliers(frame).count() == 12
    assert outliers.iqr_outliers(frame, max_columns=8).count() == 8
    assert outliers.iqr_outliers(frame.select(F.lit("x").alias("t"))).count() == 0


def test_maps_inside_other_types(spark):
    frame = spark.createDataFrame(
        [([{"a": 1, "b": 2}], 1), ([{"b": 2, "a": 1}], 1), ([{"a": 2}], 1), (None, 1)], "m array<map<string,int>>, n int"
    )
    p = profile.profile(frame).first()
    assert p.duplicate_rows == 1 and p.constant_columns == ["n"] and p.missing_cells == 1
    kept = profile.drop_duplicates(frame)
    assert kept.count() == 3 and dict(kept.dtypes)["m"] == "array<map<string,int>>"


def test_reports_share_one_profile(spark, folder, plan):
    spark.range(50).selectExpr("id % 7 AS a", "id % 3 AS b").write.parquet(folder)
    frame = spark.read.parquet(folder)
    row = spark.createDataFrame(profile.profile(frame).collect(), profile.profile(frame).schema)
    pages = [quality.quality_score(frame, profiled=row), quality.readiness(frame, profiled=row)]
    assert all("FileScan" not in plan(p) for p in pages)
    assert pages[0].first() == quality.quality_score(frame).first()


def test_listed_names_say_what_is_left_out(spark):
    frame = spark.createDataFrame([(1, 1, 1, 1, 2), (1, 1, 1, 1, 3)], "a int, b int, c int, d int, e int")
    assert quality.quality_score(frame).first().notes == ["Constant columns detected: a, b, c, d"]
    assert quality.quality_score(frame, max_names=3).first().notes == ["Constant columns detected: a, b, c and 1 more"]


def test_quantiles_by_brackets_and_whole(spark):
    """Columns large enough for brackets, with heavy values, gaps, infinities, and one whose sketch is no help."""
    import numpy as np

    from insight_spark.operators import quantiles

    rng = np.random.default_rng(3)
    x = rng.normal(size=6000)
    rows = [(float(v), float(round(v)), None if k % 3 else float(k), float("inf") if k % 2 else -1.0, None, float("nan")) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double").repartition(5)
    wanted = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, df.columns, wanted).first()
    for i in range(3):
        values = np.array([r[i] for r in rows if r[i] is not None])
        assert np.allclose(got[f"q{i}"], np.quantile(values, wanted)) and got[f"n{i}"] == len(values)
    assert got["q3"][0] == -1.0 and got["q3"][3] == float("inf") and (got["q4"], got["n4"], got["q5"], got["n5"]) == (None, 0, None, 0)
    # brackets that miss are noticed, and the column is taken whole
    slack, quantiles.SLACK = quantiles.SLACK, -0.2
    try:
        wrong = quantiles.exact_quantiles(df, ["a"], [0.25, 0.5]).first()
    finally:
        quantiles.SLACK = slack
    assert np.allclose(wrong["q0"], np.quantile(x, [0.25, 0.5]))
