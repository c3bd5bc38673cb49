"""Secret scan with multipart linking. Built-in expressions only.

Base kinds are reported wherever they match. Weak candidates (an identifier, a key, an endpoint) mean
little alone: each is reported only if a complementary part lies within its scope, found by an interval
join of the parts' scopes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from insight_spark.llm.common import prepare
from insight_spark.session import stored

# kind -> pattern, group whose length counts, its least length. Fixed values of the base kinds; a run of at
# least n characters is matched as such where shorter runs cannot hold a later match.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "identifier": (r"(?<![A-Za-z0-9])(?!AKIA)(?=[A-Z0-9]{0,19}[0-9])(?=[A-Z0-9]{0,19}[A-Z])[A-Z0-9]{20}(?![A-Za-z0-9])", 0, 20),
    "key": (r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    "endpoint": (r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9./_-]*""", 0, 10),
}
ORDER = {kind: k for k, kind in enumerate([*BASE, *WEAK])}
PART = {"access": "id", "identifier": "id", "assign": "secret", "hex": "secret", "key": "secret", "endpoint": "endpoint"}
COMPLEMENTS = {"identifier": ["secret"], "key": ["id"], "endpoint": ["id", "secret"]}


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (gap, size, kept) of the leftmost non-overlapping matches: characters since the last match,
    characters of the match, and whether the counted group is long enough."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    found = F.zip_with(
        F.zip_with(F.slice(gaps, 1, F.size(whole)), whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("size"))),
        counted,
        lambda a, c: F.struct(a["gap"].alias("gap"), a["size"].alias("size"), (F.length(c) >= least).alias("kept")),
    )
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast("array<struct<gap:int,size:int,kept:boolean>>"))


def parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs (row, doc_id), and every match of every kind (row, kind, start, end) in code points."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.map_from_arrays(
        F.array(*(F.lit(kind) for kind in ORDER)), F.array(*(matches(text, *spec) for spec in (BASE | WEAK).values()))
    )
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), found.alias("found")))
    each = rows.select("row", F.explode("found").alias("kind", "found")).select("row", "kind", F.posexplode("found").alias("n", "m"))
    before = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(before)
    spans = each.select("row", "kind", "m", end.alias("end")).where("m.kept")
    return rows.select("row", "doc_id"), stored(spans.select("row", "kind", (F.col("end") - F.col("m.size")).cast("long").alias("start"), "end"))


def linked(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans with a complementary part at most scope characters away, none inside a base span.

    Both sides are dealt by row and by stretches of scope characters; a span meets the parts of its
    own stretches only, so a document of very many parts is spread, and no pair leaves the join.
    """
    part = F.create_map(*(F.lit(x) for kv in PART.items() for x in kv))
    weak = spans.where(F.col("kind").isin(*WEAK))
    base = spans.where(F.col("kind").isin(*BASE))

    def cut(df: DataFrame, reach: int) -> DataFrame:
        low, high = F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach
        return df.withColumn("stretch", F.explode(F.sequence((low / scope).cast("long"), (high / scope).cast("long"))))

    w = cut(weak, 0).alias("w")
    b = cut(base, 0).alias("b")
    inside = (F.col("w.row") == F.col("b.row")) & (F.col("w.stretch") == F.col("b.stretch")) & (F.col("w.start") < F.col("b.end")) & (F.col("b.start") < F.col("w.end"))
    covered = w.join(b, inside, "left_semi").select("row", "kind", "start").distinct()
    free = weak.join(covered, ["row", "kind", "start"], "left_anti")
    p = cut(base.unionByName(free), scope).withColumn("part", part[F.col("kind")]).alias("p")
    wanted = F.lit(False)
    for kind, need in COMPLEMENTS.items():
        wanted = wanted | ((F.col("f.kind") == kind) & F.col("p.part").isin(*need))
    near = (F.col("f.row") == F.col("p.row")) & (F.col("f.stretch") == F.col("p.stretch"))
    near = near & (F.col("p.start") <= F.col("f.end") + scope) & (F.col("f.start") <= F.col("p.end") + scope) & wanted
    return cut(free, 0).alias("f").join(p, near, "left_semi").select("row", "kind", "start", "end").distinct()


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id and its reported spans, an array of (start, rank, kind, end) in order of start, then kind.

    Offsets are code points of the text as given, end exclusive. A null or empty text has no span. Rows
    that repeat a doc_id are scanned each; a null doc_id is kept. Other columns are ignored; an empty
    table gives none. Spans of one document meet in one row, their pairs never do.
    """
    prepare(docs.sparkSession)
    rows, spans = parts(docs)
    all_spans = spans.where(F.col("kind").isin(*BASE)).unionByName(linked(spans, scope))
    rank = F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv))[F.col("kind")]
    grouped = all_spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    nothing = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return rows.join(grouped, "row", "left").select("doc_id", F.coalesce("spans", nothing).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
