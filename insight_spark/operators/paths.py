"""Profile of nested JSON: one row per path, with how often it is there and the types it has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from insight_spark.functions.scalars import named
from insight_spark.session import stored

DEEPEST = 100


def path_profile(df: DataFrame, column: str) -> DataFrame:
    """path, n, nulls, n_missing, types, n_types of a column of JSON text.

    path: `$` is the document, `.name` a member (quoted like `."a.b"` where the name has other characters
    than letters, digits and _), `[*]` the elements of a list. n: values at the path, JSON nulls included;
    nulls: how many of them are null. n_missing: for members, the objects at the path above that lack it;
    for others 0. types: "object 3, text 1" and so on by number, then name; mixed types stay apart. Text that
    is not JSON counts at `$` as type "invalid", a null text not at all. Whole numbers, decimals and doubles
    are "number". An empty column has no path.

    Values are unpacked one level of nesting after the other, all rows at once, and each level is added up by
    path and type before anything moves; as many jobs as the deepest nesting. Lists are unpacked element by
    element in their task.
    """
    tvf = df.sparkSession.tvf
    text = df.select(named(column).cast("string").alias("text")).where("text IS NOT NULL")
    level = text.select(F.lit(None).cast("string").alias("above"), F.lit("$").alias("path"), F.try_parse_json("text").alias("value"))
    kind = F.schema_of_variant("value")
    kind = (
        F.when(F.col("value").isNull(), "invalid").when(F.is_variant_null("value"), "null").when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "list").when(kind == "STRING", "text").when(kind == "BOOLEAN", "boolean").otherwise("number")
    )
    counts = []
    for _ in range(DEEPEST):
        typed = stored(level.withColumn("type", kind))
        counts.append(typed.groupBy("above", "path", "type").agg(F.count("*").alias("n")))
        nested = typed.where("type IN ('object', 'list')").select(F.col("path").alias("above"), "type", F.col("value").alias("held"))
        if nested.isEmpty():
            break
        inner = nested.alias("o").lateralJoin(tvf.variant_explode(F.col("o.held").outer()))
        member = F.col("type") == "object"
        quoted = F.concat(F.lit('."'), F.replace("key", F.lit('"'), F.lit('\\"')), F.lit('"'))
        name = F.when(~member, F.lit("[*]")).when(F.col("key").rlike("^[A-Za-z0-9_]+$"), F.concat(F.lit("."), "key")).otherwise(quoted)
        level = inner.select(F.when(member, F.col("above")).alias("above"), F.concat("above", name).alias("path"), "value")
    else:
        raise ValueError(f"nested more than {DEEPEST} deep")
    found = stored(reduce(DataFrame.unionByName, counts))
    objects = found.where("type = 'object'").groupBy(F.col("path").alias("above")).agg(F.sum("n").alias("objects"))
    # "object 3, text 1": more frequent types first
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "type", "n")))
    paths = found.groupBy("path").agg(F.max("above").alias("above"), F.sum("n").alias("n"), F.sum(F.when(F.col("type") == "null", F.col("n")).otherwise(0)).alias("nulls"), listed.alias("types"))
    said = F.array_join(F.transform("types", lambda t: F.concat_ws(" ", t["type"], t["n"].cast("string"))), ", ")
    missing = F.when(F.col("above").isNotNull(), F.col("objects") - F.col("n")).otherwise(0)
    return paths.join(objects, "above", "left").select("path", "n", "nulls", missing.alias("n_missing"), said.alias("types"), F.size("types").alias("n_types"))
