"""Removal of boilerplate lines: lines that many distinct sites carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.llm.common import fresh, prepare
from insight_spark.session import stored

# Sketch estimates off by more than this do not occur in practice: about nine standard errors at 2**12 registers.
MARGIN = 0.15


def lines_of(text: Column) -> Column:
    """Lines of a text, as between line breaks; a null text has none."""
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """What makes lines equal: their characters without spaces, tabs and carriage returns at both ends."""
    return F.md5(F.trim(line, F.lit(" \t\r")))


def boilerplate(docs: DataFrame, min_sites: int = 10, min_chars: int = 1) -> DataFrame:
    """Keys of the lines that at least min_sites distinct sites carry, with the smallest doc_id that has each.

    Sites are counted by one HyperLogLog sketch per line, merged by the aggregation; lines whose
    estimate is near the threshold are counted exactly, after one row a line and site is left. A line
    seen less often than min_sites needs no count. A null source is no site.
    """
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("site"), F.explode(lines_of(F.col("text").cast("string"))).alias("line"))
    trimmed = F.length(F.trim("line", F.lit(" \t\r")))
    seen = seen.where(trimmed >= min_chars).select("doc_id", "site", line_key(F.col("line")).alias("key"))
    often = seen.groupBy("key").agg(
        F.count("site").alias("n"), F.min("doc_id").alias("first"), F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(12))).alias("sites")
    )
    often = stored(often.where(F.col("n") >= min_sites).where(F.col("sites") >= min_sites * (1 - MARGIN)))
    close = often.where(F.col("sites") <= min_sites * (1 + MARGIN)).select("key")
    exact = (
        seen.join(close, "key")
        .where("site IS NOT NULL")
        .select("key", "site")
        .distinct()
        .groupBy("key")
        .count()
        .where(F.col("count") >= min_sites)
        .select("key")
    )
    sure = often.where(F.col("sites") > min_sites * (1 + MARGIN))
    return stored(sure.unionByName(often.join(exact, "key", "left_semi")).select("key", "first"))


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, min_chars: int = 1) -> DataFrame:
    """The rows and columns of docs, text without boilerplate lines, and n_lines, n_removed.

    A line that min_sites distinct sites carry goes from every document but the one with the smallest
    doc_id, so nothing is lost altogether; there every repetition of it stays. Lines of fewer than
    min_chars characters (blank ones) always stay. A null text stays null, with no lines; an empty
    text is one blank line. A row without doc_id loses all its boilerplate. Rows that repeat a doc_id
    are each treated alike. Columns n_lines and n_removed of the input are replaced; others pass
    through. An n_chars column is set to the new length where the text changed.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed")
    own, taken, left = fresh(docs, "doc", "taken", "left")
    common = boilerplate(docs, min_sites, min_chars)
    places = (
        docs.select(F.col("doc_id").cast("long").alias("doc"), F.explode(lines_of(F.col("text").cast("string"))).alias("line"))
        .select("doc", line_key(F.col("line")).alias("key"))
        .join(common, "key")
        .where("doc IS NULL OR doc > first")
        .groupBy(F.col("doc").alias(own))
        .agg(F.collect_set("key").alias(taken))
    )
    lines = lines_of(F.col("text"))
    gone = F.coalesce(taken, F.array().cast("array<string>"))
    kept = F.filter(lines, lambda x: ~F.array_contains(gone, line_key(x)))
    both = docs.withColumn("text", F.col("text").cast("string")).join(places, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left")
    touched = F.col(taken).isNotNull()
    out = both.withColumns({"n_lines": F.coalesce(F.size(lines), F.lit(0)), left: F.when(touched, kept)})
    out = out.withColumns({"n_removed": F.when(touched, F.col("n_lines") - F.size(left)).otherwise(0), "text": F.when(touched, F.array_join(left, "\n")).otherwise(F.col("text"))})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(touched, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"))
