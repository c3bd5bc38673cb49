"""Report texts: findings, cleaning effect, decision and boardroom reports, content summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.functions import fixed
from insight_spark.functions.scalars import array_total, bullet_list, named
from insight_spark.operators.cleaning import apply_cleaning
from insight_spark.operators.metrics import semantic_metrics
from insight_spark.operators.outliers import iqr_outliers
from insight_spark.operators.profile import COPIES, grouped_copies, profile, profile_of_copies, row_counts, weighted_present
from insight_spark.operators.quality import listed, or_else, present
from insight_spark.session import stored


def _count_text(label: str, count: str) -> Column:
    return F.when(F.col(count) > 0, F.concat(F.lit(label), F.col(count).cast("string")))


def _finding(kind: str, issue: Column, *recommendations: str) -> Column:
    """A finding struct, or null where there is no issue."""
    return F.when(
        issue.isNotNull(),
        F.struct(
            F.lit(kind).alias("kind"),
            issue.alias("issue"),
            F.array(*[F.lit(r) for r in recommendations]).alias("recommendations"),
        ),
    )


def doctor_findings(
    df: DataFrame, max_names: int | None = None, profiled: DataFrame | None = None
) -> DataFrame:
    """Data-quality findings: (ordinal, kind, issue, recommendations)."""
    return _findings_row(df, max_names, profiled).select(
        F.posexplode("findings").alias("ordinal", "f")
    ).select("ordinal", "f.kind", "f.issue", "f.recommendations")


def doctor_report(df: DataFrame, max_names: int | None = None, profiled: DataFrame | None = None) -> DataFrame:
    """The findings as one text row."""
    findings = F.col("findings")
    text = F.concat(
        F.lit(fixed.FINDINGS_HEADING),
        bullet_list(F.transform(findings, lambda f: f["issue"])),
        F.lit(fixed.FIXES_HEADING),
        bullet_list(F.flatten(F.transform(findings, lambda f: f["recommendations"]))),
    )
    return _findings_row(df, max_names, profiled).select(text.alias("doctor"))


def _findings_row(df: DataFrame, max_names: int | None, profiled: DataFrame | None) -> DataFrame:
    # One outlier row for each numeric column.
    notes = (
        iqr_outliers(df)
        .where("outliers > 0")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "ordinal",
                        F.concat(
                            "column", F.lit(": "), F.col("outliers").cast("string"), F.lit(" possible outliers")
                        ).alias("note"),
                    )
                )
            ).alias("notes")
        )
    )
    outlier_text = F.array_join(F.transform("outlier_notes", lambda n: n["note"]), "; ")
    candidates = present(
        [
            _finding(
                "missing",
                _count_text("Missing values detected: ", "missing_cells"),
                fixed.FIX_NUMERIC_GAPS,
                fixed.FIX_TEXT_GAPS,
            ),
            _finding(
                "duplicates", _count_text("Duplicate rows detected: ", "duplicate_rows"), fixed.FIX_DUPLICATES
            ),
            _finding(
                "outliers",
                F.when(
                    F.size("outlier_notes") > 0, F.concat(F.lit("Possible outliers detected: "), outlier_text)
                ),
                fixed.FIX_OUTLIERS,
            ),
            _finding(
                "constants",
                F.when(
                    F.size("constant_columns") > 0,
                    F.concat(
                        F.lit("Constant columns detected: "),
                        listed("constant_columns", max_names),
                    ),
                ),
                fixed.FIX_CONSTANTS,
            ),
        ]
    )
    none = F.array(_finding("none", F.lit(fixed.NO_ISSUES), fixed.FIX_NOTHING))
    return (
        (profile(df) if profiled is None else profiled)
        .withColumn("outlier_notes", notes.scalar())
        .withColumn("found", candidates)
        .select(F.when(F.size("found") > 0, F.col("found")).otherwise(none).alias("findings"))
    )


def executive_dashboard(df: DataFrame, profiled: DataFrame | None = None) -> DataFrame:
    """One row (rows, columns, missing, duplicates, insights); an empty frame gives no row."""
    insights = present(
        [
            F.when(F.col("missing_cells") > 0, fixed.INSIGHT_MISSING),
            F.when(F.col("duplicate_rows") > 0, fixed.INSIGHT_DUPLICATES),
        ]
    )
    return (
        (profile(df) if profiled is None else profiled)
        .where("rows > 0")
        .select(
            "rows",
            "columns",
            F.col("missing_cells").alias("missing"),
            F.col("duplicate_rows").alias("duplicates"),
            or_else(insights, fixed.INSIGHT_CLEAN).alias("insights"),
        )
    )


def executive_metrics(df: DataFrame, max_items: int | None = None) -> DataFrame:
    """The metric cards of the dashboard: the available metrics, or the first `max_items` of them."""
    cards = semantic_metrics(df).orderBy("ordinal")
    return cards if max_items is None else cards.limit(max_items)


def cleaning_effect(df: DataFrame, **options) -> DataFrame:
    """`cleaning_summary` of a frame and of what `apply_cleaning` makes of it.

    Rows are grouped once; the groups give the counts before and are the deduplicated rows that the
    other steps go on with. Options are those of `apply_cleaning`.
    """
    copies = stored(grouped_copies(df))
    if options.pop("remove_duplicates", True) and not any(t.startswith("map") for _, t in df.dtypes):
        cleaned = apply_cleaning(copies.drop(COPIES), remove_duplicates=False, **options)
    else:
        cleaned = apply_cleaning(df, **options)
    return cleaning_summary(df, cleaned, profile_of_copies(copies, df.columns))


def cleaning_summary(original: DataFrame, cleaned: DataFrame, profiled: DataFrame | None = None) -> DataFrame:
    """Missing cells and duplicate rows before and after, and the sentence about them."""
    before = (profile(original) if profiled is None else profiled).select(
        F.col("missing_cells").alias("missing_before"), F.col("duplicate_rows").alias("duplicates_before")
    )
    after = profile(cleaned).select(F.struct("missing_cells", "duplicate_rows").alias("after"))
    sentence = F.format_string(
        f"Missing values: %d → %d. Duplicate rows: %d → %d. {fixed.CLEANING_EFFECT}",
        "missing_before", "missing_after", "duplicates_before", "duplicates_after",
    )
    return (
        before.withColumn("__after", after.scalar())
        .withColumn("missing_after", F.col("__after")["missing_cells"])
        .withColumn("duplicates_after", F.col("__after")["duplicate_rows"])
        .withColumn("summary", sentence)
        .select("missing_before", "missing_after", "duplicates_before", "duplicates_after", "summary")
    )


def decision_text(missing: Column, duplicates: Column) -> Column:
    text = fixed.DECISION_REPORT.format(missing="%d", duplicates="%d")
    return F.format_string(text, missing.cast("bigint"), duplicates.cast("bigint"))


def decision_report(df: DataFrame, profiled: DataFrame | None = None) -> DataFrame:
    """The decision report as one text row."""
    text = decision_text(F.col("missing_cells"), F.col("duplicate_rows"))
    return (profile(df) if profiled is None else profiled).select(
        F.when(F.col("rows") > 0, text).otherwise(fixed.NO_DATASET).alias("decision_report")
    )


def profile_by(df: DataFrame, dataset_id: str, columns: Sequence[str]) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows per dataset in a frame that stacks several.

    Rows are grouped on the id and all columns first, so a dataset that holds most of the rows is
    spread over its distinct rows and never gathered in one task.
    """
    width = len(columns)
    return (
        grouped_copies(df.select(named(dataset_id), *[named(c) for c in columns]))
        .groupBy(named(dataset_id))
        .agg(*row_counts(), weighted_present(list(columns)))
        .select(
            named(dataset_id),
            "rows",
            F.lit(width).cast("bigint").alias("columns"),
            (F.col("rows") * width - array_total(F.col("present"))).alias("missing_cells"),
            (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"),
        )
    )


def boardroom_report(
    profiles: DataFrame, parts: DataFrame, dataset_id: str = "dataset_id", title: str = "Boardroom Report"
) -> DataFrame:
    """Combine profile counts with report parts (file_name, analysis, doctor, decision) per dataset.

    `profiles` has one row per dataset (rows, columns, missing_cells, duplicate_rows), `parts`
    at most one; absent parts are replaced by a "not generated" sentence.
    """

    def part(name: str, fallback: str) -> Column:
        return F.coalesce(F.col(name), F.lit(fallback))

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value.cast("string"), F.lit("\n"))

    def section(heading: str, body: Column, tail: str) -> Column:
        rule = "-" * len(heading)
        return F.concat(F.lit(f"{heading}\n{rule}\n"), body, F.lit(tail))

    text = F.concat(
        F.lit(f"{title}\n\n"),
        line("File", part("file_name", "")),
        line("Rows", F.col("rows")),
        line("Columns", F.col("columns")),
        line("Missing Values", F.col("missing_cells")),
        line("Duplicate Rows", F.col("duplicate_rows")),
        F.lit("\n"),
        section("Executive Insights", part("analysis", fixed.NO_INSIGHTS), "\n\n"),
        section("Data Doctor Findings", part("doctor", fixed.NO_FINDINGS), "\n\n"),
        section("Decision Engine", part("decision", fixed.NO_DECISION), "\n"),
    )
    return profiles.join(parts, dataset_id, "left").select(dataset_id, text.alias("report"))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The first n rows in key order (a distributed top-n)."""
    return df.orderBy(*[named(k) for k in order_by]).limit(n)


def content_summary(df: DataFrame, order_by: Sequence[str], preview_rows: int = 10) -> DataFrame:
    """One row: row and column count, the first 50 column names, a preview as JSON rows."""
    keys = [named(k) for k in order_by]
    # The preview is limited to `preview_rows` rows before it is gathered.
    sample = preview(df, order_by, preview_rows).select(
        F.struct(*keys).alias("key"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")
    )
    rows = F.transform(F.array_sort(F.collect_list(F.struct("key", "row"))), lambda x: x["row"])
    names = ", ".join(df.columns[: fixed.SUMMARY_COLUMN_LIMIT])
    return (
        df.agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("columns", F.lit(len(df.columns)))
        .withColumn("column_names", F.lit(names))
        .withColumn("preview", sample.agg(rows.alias("p")).scalar())
        .withColumn(
            "summary",
            F.concat(
                F.format_string("\nStructured dataset shape: %d rows x %d columns\n", "rows", "columns"),
                F.lit("Columns: "),
                "column_names",
                F.lit("\nPreview:\n"),
                F.array_join("preview", "\n"),
                F.lit("\n"),
            ),
        )
    )


def text_summary(text: Column, mode: Column, rows: Column, columns: Column) -> Column:
    """Content summary of a text or image dataset: its shape and the start of its text."""
    text_part = F.concat(
        F.format_string("\nText dataset shape: %d rows x %d columns\nText preview:\n", rows, columns),
        F.substring(text, 1, fixed.TEXT_PREVIEW_CHARS),
        F.lit("\n"),
    )
    shown = F.when(F.length(text) > 0, F.substring(text, 1, fixed.IMAGE_PREVIEW_CHARS)).otherwise(fixed.NO_OCR_TEXT)
    image_part = F.concat(
        F.format_string("\nImage metadata table shape: %d rows x %d columns\nOCR preview:\n", rows, columns),
        shown,
        F.lit("\n"),
    )
    return F.when(mode == "text", text_part).when(mode == "image", image_part).otherwise(fixed.NO_SUMMARY)
