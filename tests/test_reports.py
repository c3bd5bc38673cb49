import pytest
from pyspark.sql import functions as F

from insight_spark.operators import reports


@pytest.fixture
def messy(spark):
    rows = [(float(i), "x", None if i == 3 else "t") for i in range(9)] + [(500.0, "x", "t"), (1.0, "x", "t")]
    return spark.createDataFrame(rows, "v double, c string, t string")


def test_doctor_report(messy):
    assert reports.doctor_report(messy).first().doctor == (
        "AI Data Doctor Findings\n-----------------------\n"
        "- Missing values detected: 1\n- Duplicate rows detected: 1\n"
        "- Possible outliers detected: v: 1 possible outliers\n- Constant columns detected: c\n\n"
        "Recommended Fixes\n-----------------\n"
        "- Fill missing numeric values with median or business-approved defaults.\n"
        "- Fill missing text fields with explicit placeholders like 'Unknown' only when appropriate.\n"
        "- Review duplicate rows before deletion to separate true duplicates from repeated business events.\n"
        "- Inspect outliers to separate real signals from data entry errors.\n"
        "- Review constant columns. They may be placeholders, IDs gone wrong, or fields with no analytical value."
    )


def test_doctor_without_issues(spark):
    rows = reports.doctor_findings(spark.range(5).toDF("id")).collect()
    assert [(r.kind, r.issue) for r in rows] == [("none", "No major structural issues detected.")]
    assert rows[0].recommendations == ["Proceed with analysis while validating business context."]


def test_constant_names_are_limited(spark):
    wide = spark.range(2).select(*[F.lit(1).alias(f"c{i:02d}") for i in range(20)], "id")
    issue = reports.doctor_findings(wide).where("kind = 'constants'").first().issue
    assert issue == "Constant columns detected: " + ", ".join(f"c{i:02d}" for i in range(20))


def test_executive_dashboard(messy, spark):
    row = reports.executive_dashboard(messy).first()
    assert (row.rows, row.columns, row.missing, row.duplicates) == (11, 3, 1, 1) and len(row.insights) == 2
    clean = reports.executive_dashboard(spark.range(3).toDF("id")).first()
    assert clean.insights == ["Dataset is clean and ready for analysis."]
    assert reports.executive_dashboard(messy.limit(0)).count() == 0
    assert reports.executive_metrics(messy).count() == 4


def test_decision_report(messy):
    text = reports.decision_report(messy).first().decision_report
    assert text.startswith("\nDecision Engine Report\n\n1. Immediate Priority\n")
    assert "\n2. Main Risk\nMissing values: 1\nDuplicate rows: 1\n" in text and text.endswith("decision confidence.\n")
    assert reports.decision_report(messy.limit(0)).first().decision_report == "No dataset loaded."


def test_boardroom_report(spark):
    profiles = spark.createDataFrame(
        [("d1", 5, 2, 1, 0), ("d2", 6, 2, 0, 0)],
        "dataset_id string, rows bigint, columns bigint, missing_cells bigint, duplicate_rows bigint",
    )
    parts = spark.createDataFrame(
        [("d1", "f.csv", "insight", None, "decide")],
        "dataset_id string, file_name string, analysis string, doctor string, decision string",
    )
    texts = {r.dataset_id: r.report for r in reports.boardroom_report(profiles, parts).collect()}
    assert texts["d1"] == (
        "Boardroom Report\n\nFile: f.csv\nRows: 5\nColumns: 2\nMissing Values: 1\nDuplicate Rows: 0\n\n"
        "Executive Insights\n------------------\ninsight\n\n"
        "Data Doctor Findings\n--------------------\nNo Data Doctor report generated yet.\n\n"
        "Decision Engine\n---------------\ndecide\n"
    )
    assert "No AI insights generated yet." in texts["d2"] and "No Decision Engine report generated yet." in texts["d2"]


def test_profile_by_matches_profile(spark):
    frame = spark.createDataFrame(
        [("a", 1, None), ("a", 1, None), ("b", 2, "x"), ("a", 3, "y"), (None, 1, "z")], "d string, n int, t string"
    )
    rows = {r.d: tuple(r)[1:] for r in reports.profile_by(frame, "d", ["n", "t"]).collect()}
    assert rows == {"a": (3, 2, 2, 1), "b": (1, 2, 0, 0), None: (1, 2, 0, 0)}


def test_preview(spark):
    frame = spark.range(100).select((99 - F.col("id")).alias("k"))
    assert [r.k for r in reports.preview(frame, ["k"], 3).collect()] == [0, 1, 2]


def test_content_summary(spark):
    frame = spark.createDataFrame([(i, f"t{i}") for i in range(12)], "k int, t string")
    row = reports.content_summary(frame, ["k"]).first()
    assert (row.rows, row.columns, row.column_names, len(row.preview)) == (12, 2, "k, t", 10)
    assert row.preview[0] == '{"k":0,"t":"t0"}'
    wide = spark.range(1).select(*[F.lit(1).alias(f"c{i}") for i in range(60)])
    assert reports.content_summary(wide, ["c0"]).first().column_names.count(",") == 49


def test_text_summary(spark):
    rows = [("a" * 6000, "text"), ("b" * 6000, "image"), ("", "image"), ("x", "other")]
    frame = spark.createDataFrame(rows, "t string, m string")
    texts = [
        r.s for r in frame.select(reports.text_summary(F.col("t"), F.col("m"), F.lit(1), F.lit(2)).alias("s")).collect()
    ]
    assert texts[0] == "\nText dataset shape: 1 rows x 2 columns\nText preview:\n" + "a" * 5000 + "\n"
    assert texts[1] == "\nImage metadata table shape: 1 rows x 2 columns\nOCR preview:\n" + "b" * 3000 + "\n"
    assert texts[2].endswith("OCR preview:\nNo OCR text available.\n") and texts[3] == "No summary available."
