"""What the corpus operators share: session settings, words, hashes, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from insight_spark.session import configure, stored

SETTINGS = {
    # Arrow batches are bounded in bytes, so tasks with very long texts stay small as well.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    # Shuffle files go when their job is over; what later jobs need is in written tables.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, the named columns, and the whole text as UTF-8 bytes (null text: empty)."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns, body)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has them in any case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among ids (one column); rows without doc_id stay."""
    (name,) = fresh(docs, "gone")
    return docs.join(ids.toDF(name).distinct(), F.col("doc_id") == F.col(name), "left_anti")


def components(edges: DataFrame, limit: int = 40) -> DataFrame:
    """Connected components of an edge list (a long, b long): one row per vertex (v, c), c its smallest vertex.

    Each round every vertex points at its smallest neighbour, pointers are followed twice over, and
    edges are redrawn between what their ends point at; equal and closed ones go. Edges so shrink from
    round to round, and only the first round touches all of them. Rounds are written to the shared
    folder; the driver learns no more than whether edges are left. A vertex of very many edges is
    pre-aggregated by Spark's partial minimum. Edges with a null end and loops are ignored.
    """

    def drawn(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return stored(ends.where("a <> b").distinct())

    left = drawn(edges.where("a IS NOT NULL AND b IS NOT NULL"))
    found = None
    for _ in range(limit):
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c")).select("v", F.least("v", "c").alias("c"))
        to = stored(to)
        for _ in range(2):
            next_to = to.select(F.col("v").alias("c"), F.col("c").alias("further"))
            to = stored(to.join(next_to, "c").select("v", F.col("further").alias("c")))
        step = to.select(F.col("v").alias("c"), F.col("c").alias("further"))
        found = to if found is None else stored(
            found.join(step, "c", "left").select("v", F.coalesce("further", "c").alias("c"))
        )
        a, b = (to.select(F.col("v").alias(x), F.col("c").alias(f"{x}_to")) for x in "ab")
        left = drawn(left.join(a, "a").join(b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")))
        if left.isEmpty():
            return found
    raise RuntimeError(f"components did not settle in {limit} rounds")
