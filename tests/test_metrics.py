import pandas as pd
import pytest
from pyspark.sql import functions as F

from insight_spark.functions import fixed
from insight_spark.operators import charts, compare, kpis, metrics
from insight_spark.sources.files import sample_dataset


@pytest.fixture
def sample(spark):
    return sample_dataset(spark)


def test_sample_table(sample):
    rows = sample.orderBy("Date").collect()
    assert len(rows) == 12 and [str(r.Date)[:10] for r in rows[:2]] == ["2025-01-01", "2025-02-01"]
    assert sum(r.Sales for r in rows) == 193100
    assert sum(r.Customers for r in rows) == 3093 and sum(r.Returns for r in rows) == 201
    assert {r.Region for r in rows} == {"South"}


def test_semantic_metrics_of_sample(sample):
    rows = {r.key: r for r in metrics.semantic_metrics(sample).collect()}
    assert [rows[k].formatted_value for k in ("record_count", "column_count", "missing_value_rate", "revenue")] == [
        "12", "5", "0.00%", "$193,100.00"
    ]
    assert rows["returns"].raw_value == 201 and rows["returns"].source_columns == ["Returns"]
    assert rows["duplicate_rate"].source_columns == ["Date", "Sales", "Customers", "Returns", "Region"]
    assert rows["record_count"].source_columns == []


def test_metric_sums_read_text_and_count_copies(spark):
    frame = spark.createDataFrame([("10",), ("10",), ("x",), (None,)], "Sales string")
    rows = {r.key: r for r in metrics.semantic_metrics(frame).collect()}
    assert rows["revenue"].raw_value == 20.0
    assert rows["duplicate_rate"].formatted_value == "25.00%"
    assert set(rows) == {"record_count", "column_count", "missing_value_rate", "duplicate_rate", "revenue"}


def test_availability_is_case_sensitive(spark):
    frame = spark.createDataFrame([], "sales int, Returns int")
    rows = {r.key: r for r in metrics.metric_availability(frame).collect()}
    assert not rows["revenue"].available and rows["revenue"].missing_columns == ["Sales"]
    assert rows["returns"].available and rows["record_count"].missing_columns == []


def test_metrics_of_empty_frame(spark):
    rows = {r.key: r.raw_value for r in metrics.semantic_metrics(spark.createDataFrame([], "Sales double")).collect()}
    assert rows["record_count"] == 0 and rows["revenue"] == 0 and rows["missing_value_rate"] == 0


def test_industry_kpis(sample):
    rows = [(r.label, r.value) for r in kpis.industry_kpis(sample, ["Marketing"]).orderBy("ordinal").collect()]
    assert rows == [("Performance Total", 193100.0), ("Average Performance", 193100 / 12), ("Growth Signal", 3093.0)]
    general = [(r.label, r.value) for r in kpis.industry_kpis(sample, ["Retail"]).orderBy("ordinal").collect()]
    assert general == [("Rows", 12.0), ("Columns", 5.0), ("Missing Values", 0.0)]


def test_industry_kpis_special_frames(spark):
    one = spark.createDataFrame([(2.0, "a"), (None, None)], "v double, t string")
    assert [r.value for r in kpis.industry_kpis(one, ["Logistics"]).orderBy("ordinal").collect()] == [2.0, 2.0, 2.0]
    assert [r.value for r in kpis.industry_kpis(one, ["Other"]).orderBy("ordinal").collect()] == [2.0, 2.0, 2.0]
    texts = spark.createDataFrame([("a",)], "t string")
    assert [r.label for r in kpis.industry_kpis(texts, ["Finance"]).orderBy("ordinal").collect()] == ["Rows", "Columns"]
    assert kpis.industry_kpis(texts.limit(0)).count() == 0
    gaps = spark.createDataFrame([(None,)], "v double")
    assert [r.value for r in kpis.industry_kpis(gaps, ["Finance"]).orderBy("ordinal").collect()] == [0.0, None, None]


def test_auto_dashboard(sample, spark):
    row = kpis.auto_dashboard(sample).first()
    assert (row.column, row.total, row.max, row.min) == ("Sales", 193100.0, 20500.0, 12000.0)
    assert kpis.auto_dashboard(spark.createDataFrame([("a",)], "t string")).count() == 0
    assert kpis.auto_dashboard(sample.limit(0)).count() == 0


def test_scenario(sample, spark):
    rows = kpis.scenario(sample, "Sales", [10, 0, -100]).collect()
    assert [r.adjusted_value for r in rows] == pytest.approx([212410.0, 193100.0, 0.0])
    assert [r.meaning for r in rows] == [fixed.SCENARIO_UP, fixed.SCENARIO_FLAT, fixed.SCENARIO_DOWN]
    texts = spark.createDataFrame([("5",), ("oops",), (None,)], "v string")
    assert kpis.scenario(texts, "v").first().base_value == 5.0
    with pytest.raises(ValueError):
        kpis.scenario(sample, "Sales", [101])


def test_histogram_matches_numpy(spark):
    import numpy as np

    values = [float(v) for v in np.random.default_rng(3).normal(size=500)]
    frame = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    rows = charts.histogram(frame, "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=10)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.bin_start for r in rows] == pytest.approx(edges[:-1].tolist())


def test_values_on_bin_edges_match_numpy(spark):
    import numpy as np

    values = [round(0.1 * i, 1) for i in range(0, 31)]  # many values sit on the edges of ten bins
    rows = charts.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v").orderBy("bin").collect()
    assert [r.n for r in rows] == np.histogram(values, bins=10)[0].tolist()


def test_histogram_of_one_value_and_of_nothing(spark):
    frame = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    rows = charts.histogram(frame, "v").orderBy("bin").collect()
    assert [r.n for r in rows] == [0, 0, 0, 0, 0, 2, 0, 0, 0, 0]
    assert (rows[0].bin_start, rows[9].bin_end) == (1.5, 2.5)
    assert charts.histogram(frame.where("v > 5"), "v").count() == 0


def test_histogram_with_empty_bins(spark):
    frame = spark.createDataFrame([(0.0,), (10.0,), (9.99,)], "v double")
    rows = charts.histogram(frame, "v").orderBy("bin").collect()
    assert [r.n for r in rows] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 2]


def test_trend_series_order_and_ties(spark):
    frame = spark.range(1000, numPartitions=4).select(
        (F.col("id") % 3).alias("k"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("v")
    )
    rows = charts.trend_series(frame, ["k"], "v").collect()
    want = sorted((i % 3, i, float(i) if i % 5 else 0.0) for i in range(1000))
    assert [(r.k, r.trend_value) for r in rows] == [(k, v) for k, _, v in want]


def test_comparison(spark):
    a = spark.createDataFrame([(1, 2.0, "x"), (3, None, "y")], "n int, v double, t string")
    b = spark.createDataFrame([(5, 1.0, 9)], "n int, v double, extra int")
    text = compare.comparison_text(a, b).first().comparison
    assert text == (
        "Comparison Summary\n------------------\nFile A shape: 2 rows × 3 columns\nFile B shape: 1 rows × 3 columns\n"
        "Row difference: -1\nColumn difference: 0\n\nShared Numeric Column Changes:\n"
        "- n: mean 2.00 → 5.00 (Δ 3.00)\n- v: mean 2.00 → 1.00 (Δ -1.00)"
    )
    none = compare.comparison_text(a.select("t"), b).first().comparison
    assert none.endswith("\n\nNo shared numeric columns found for comparison.")
    gaps = compare.comparison_text(a.where("v is null").select("v"), b).first().comparison
    assert gaps.endswith("- v: mean nan → 1.00 (Δ nan)")


def test_comparison_limits_columns(spark):
    wide = spark.range(3).select(*[F.col("id").alias(f"c{i:02d}") for i in range(12)])
    assert compare.compare_frames(wide, wide).count() == 14
    items = [r.item for r in compare.compare_frames(wide, wide, limit=10).orderBy("ordinal").collect()]
    assert items == ["rows", "columns", *[f"c{i:02d}" for i in range(10)]]


def test_pandas_and_spark_agree_on_sums(spark):
    pdf = pd.DataFrame({"Sales": ["1", "2.5", "no", None, " 4 "]})
    frame = spark.createDataFrame([(v,) for v in pdf["Sales"]], "Sales string")
    want = pd.to_numeric(pdf["Sales"], errors="coerce").fillna(0).sum()
    assert {r.key: r.raw_value for r in metrics.semantic_metrics(frame).collect()}["revenue"] == want


def test_histogram_leaves_out_infinities(spark):
    frame = spark.createDataFrame([(float(v),) for v in range(10)] + [(float("inf"),), (float("-inf"),), (None,)], "v double")
    rows = charts.histogram(frame, "v", 3).orderBy("bin").collect()
    assert [r.n for r in rows] == [3, 3, 4] and rows[-1].bin_end == 9.0
    assert charts.infinite_values(frame, "v").first().n == 2


def test_trend_buckets(spark):
    frame = spark.createDataFrame([(k, float(k) if k % 2 else None) for k in range(100)] + [(None, 5.0)], "k int, v double")
    rows = charts.trend_buckets(frame, "k", buckets=4, column="v").collect()
    assert [(r.bucket, r.n) for r in rows] == [(0, 25), (1, 25), (2, 25), (3, 25)]
    assert sum(r.mean_value * r.n for r in rows) == 2500 and rows[0].first_key == 0 and rows[-1].last_key == 99
    flat = charts.trend_buckets(frame.where("k = 1"), "k").collect()
    assert [(r.bucket, r.n, r.mean_value) for r in flat] == [(0, 1, 1.0)]


def test_comparison_of_infinite_means(spark):
    one, two = spark.createDataFrame([(float("inf"),)], "v double"), spark.createDataFrame([(1.0,)], "v double")
    assert compare.comparison_text(one, two).first().comparison.endswith("- v: mean inf \u2192 1.00 (\u0394 -inf)")
