"""Registered queries on distributions, row sets, cubes and nested text, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from insight_spark.operators.correlation import correlations
from insight_spark.operators.cubes import cube
from insight_spark.operators.frequent import frequent_values
from insight_spark.operators.paths import path_profile
from insight_spark.operators.rowsets import change_counts, except_all, intersect_all, row_changes
from insight_spark.operators.sketches import column_sketches, merged_sketches, sketch_profile, store_batch, stored_batches
from insight_spark.plans.catalog import query, rounded
from insight_spark.plans.inputs import DIRTY_SQL, dirty_orders, table
from insight_spark.session import shared_folder

SKETCHED = ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")


@query(
    "sketch_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean,
  CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS greatest, TRUE AS distinct_ok, TRUE AS median_ok FROM lineitem"""
        for c in SKETCHED
    ),
)
def sketch_profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as four batches with their sketches in a store; the merged estimates are held against the table."""
    lines, folder = table(spark, sf_dir, "lineitem").select(*SKETCHED), shared_folder(spark, "sketch_profile")
    for k in range(4):
        store_batch(column_sketches(lines.where(F.col("l_orderkey") % 4 == k)), folder, f"part/{k}")
    found = sketch_profile(merged_sketches(stored_batches(spark, folder)), (0.5,))
    medians = {r["column"]: r["quantiles"][0] for r in found.collect()}
    truth = lines.agg(
        *(F.count_distinct(c).alias(f"d_{c}") for c in SKETCHED), *(F.avg((F.col(c) < medians[c]).cast("int")).alias(f"a_{c}") for c in SKETCHED),
        *(F.avg((F.col(c) <= medians[c]).cast("int")).alias(f"b_{c}") for c in SKETCHED),
    )
    truth = truth.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("d"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in SKETCHED))).alias("t")).select("t.*")
    both = found.join(truth, "column")
    near = (F.col("a") <= 0.51) & (F.col("b") >= 0.49)
    return rounded(
        both.select("column", "n", "missing", "mean", F.col("least").cast("double"), F.col("greatest").cast("double"), (F.abs(F.col("distinct") - F.col("d")) <= 0.08 * F.col("d")).alias("distinct_ok"), near.alias("median_ok")),
        "mean", digits=4,
    )


@query(
    "frequent_values",
    """SELECT 'user_id' AS "column", CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY 2 HAVING count(*) >= 0.008 * (SELECT count(*) FROM events)
UNION ALL SELECT 'event_type', event_type, count(*) FROM events GROUP BY 2 HAVING count(*) >= 0.008 * (SELECT count(*) FROM events)
UNION ALL SELECT 'value', CAST(value AS VARCHAR), count(*) FROM events GROUP BY 2 HAVING count(*) >= 0.008 * (SELECT count(*) FROM events)
UNION ALL SELECT 'props', props, count(*) FROM events GROUP BY 2 HAVING count(*) >= 0.008 * (SELECT count(*) FROM events)""",
)
def frequent_values_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return frequent_values(events, ["user_id", "event_type", "value", "props"], share=0.008).drop("share")


PARTS_SQL = f"""{DIRTY_SQL},
a AS (SELECT o_custkey, o_orderstatus FROM dirty WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_custkey, o_orderstatus FROM dirty WHERE o_orderkey % 2 = 0)"""


def status_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and statuses of two overlapping parts of the orders; rows repeat, statuses may be null."""
    rows = dirty_orders(spark, sf_dir)
    pick = lambda rule: rows.where(rule).select("o_custkey", "o_orderstatus")
    return pick("o_orderkey % 3 <> 0"), pick("o_orderkey % 2 = 0")


@query("rows_except_all", f"WITH {PARTS_SQL} SELECT * FROM a EXCEPT ALL SELECT * FROM b")
def rows_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return except_all(*status_rows(spark, sf_dir))


@query("rows_intersect_all", f"WITH {PARTS_SQL} SELECT * FROM a INTERSECT ALL SELECT * FROM b")
def rows_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intersect_all(*status_rows(spark, sf_dir))


VERSIONS_SQL = f"""{DIRTY_SQL},
before AS (SELECT * FROM d WHERE o_orderkey % 17 <> 0),
after AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 6 = 2 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority, channel
  FROM dirty WHERE o_orderkey % 19 <> 0),
counted AS (
  SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, coalesce(nb, 0) AS n_old, coalesce(na, 0) AS n_new,
    b.o_orderstatus IS DISTINCT FROM a.o_orderstatus AS c1, b.o_totalprice IS DISTINCT FROM a.o_totalprice AS c2
  FROM (SELECT *, 1 AS nb FROM before) AS b
  FULL JOIN (SELECT o_orderkey, any_value(o_orderstatus) AS o_orderstatus, any_value(o_totalprice) AS o_totalprice, count(*) AS na FROM after GROUP BY 1) AS a
  ON a.o_orderkey = b.o_orderkey),
changes AS (
  SELECT *, CASE WHEN n_new > 1 THEN 'repeated' WHEN n_old = 0 THEN 'added' WHEN n_new = 0 THEN 'removed'
    WHEN c1 OR c2 THEN 'changed' ELSE 'same' END AS status FROM counted)"""


def row_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = dirty_orders(spark, sf_dir), F.col("o_orderkey")
    before = rows.dropDuplicates(["o_orderkey"]).where(key % 17 != 0)
    after = rows.where(key % 19 != 0).withColumns(
        {"o_orderstatus": F.when(key % 5 == 1, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(key % 6 == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))}
    )
    return row_changes(before, after, ["o_orderkey"])


@query(
    "row_changes",
    f"""WITH {VERSIONS_SQL}
SELECT o_orderkey, status, CASE WHEN status = 'changed' THEN concat_ws(',', CASE WHEN c1 THEN 'o_orderstatus' END, CASE WHEN c2 THEN 'o_totalprice' END) ELSE '' END AS changed,
  n_old, n_new FROM changes""",
)
def row_changes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_versions(spark, sf_dir).withColumn("changed", F.array_join("changed", ","))


@query(
    "row_change_counts",
    f"""WITH {VERSIONS_SQL}
SELECT status, NULL AS "column", count(*) AS n FROM changes GROUP BY 1
UNION ALL SELECT status, 'o_orderstatus', count(*) FROM changes WHERE status = 'changed' AND c1 GROUP BY 1
UNION ALL SELECT status, 'o_totalprice', count(*) FROM changes WHERE status = 'changed' AND c2 GROUP BY 1""",
)
def row_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_counts(row_versions(spark, sf_dir))


@query(
    "order_cube",
    f"""WITH {DIRTY_SQL},
y AS (SELECT *, year(o_orderdate) AS year FROM dirty)
SELECT o_orderstatus, o_orderpriority, year, grouping(o_orderstatus, o_orderpriority, year) AS "grouping", count(*) AS n,
  round(sum(o_totalprice), 2) AS sum_o_totalprice, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice,
  count(DISTINCT o_custkey) AS distinct_o_custkey
FROM y GROUP BY CUBE (o_orderstatus, o_orderpriority, year)""",
)
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty_orders(spark, sf_dir).withColumn("year", F.year("o_orderdate"))
    found = cube(rows, ["o_orderstatus", "o_orderpriority", "year"], ["o_totalprice"], ["o_custkey"])
    return rounded(found, "sum_o_totalprice")


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "shifted")
NUMBERS_SQL = """numbers AS (
  SELECT l_quantity, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS l_extendedprice,
    CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END AS l_discount, l_extendedprice / 1000 + 1e9 AS shifted FROM lineitem)"""


@query(
    "correlations",
    f"WITH {NUMBERS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, count(CASE WHEN {a} IS NOT NULL THEN {b} END) AS n,
  round(corr({a}{o}, {b}{o2}), 6) AS correlation, round(covar_samp({a}{o}, {b}{o2}), 3) AS covariance FROM numbers"""
        for k, a in enumerate(NUMBERS) for b in NUMBERS[k + 1 :]
        for o, o2 in [(" - 1e9" if a == "shifted" else "", " - 1e9" if b == "shifted" else "")]
    ),
)
def correlations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps in two columns, and one far from zero (the SQL takes the offset out first)."""
    key = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_quantity", F.when(key % 7 != 0, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(key % 5 != 0, F.col("l_discount")).alias("l_discount"), (F.col("l_extendedprice") / 1000 + 1e9).alias("shifted"),
    )
    return rounded(rounded(correlations(rows), "correlation", digits=6), "covariance", digits=3)


@query(
    "json_paths",
    """SELECT '$' AS path, count(*) AS n, 0 AS nulls, 0 AS n_missing, 'object ' || count(*) AS types, 1 AS n_types FROM events WHERE props IS NOT NULL
UNION ALL
SELECT '$.k', count(k), count(CASE WHEN json_type(k) = 'NULL' THEN 1 END), count(*) - count(k), 'number ' || count(k), 1
FROM (SELECT json_extract(props, '$.k') AS k FROM events WHERE props IS NOT NULL) AS p""",
)
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_profile(table(spark, sf_dir, "events"), "props")
