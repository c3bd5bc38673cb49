"""Delimited files: header handling, null tokens, type inference, export."""

from __future__ import annotations

from csv import reader as csv_reader
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from insight_spark.functions import fixed
from insight_spark.functions.scalars import INTEGER_PATTERN, coerce_numeric, named

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
OPTIONS = {"quote": '"', "escape": '"', "encoding": "UTF-8"}


def header_names(raw: list[str | None]) -> list[str]:
    """Column names from a header row: blanks become ``Unnamed: i``, repeats get the first suffix
    ``.1``, ``.2``... that gives an unused name."""
    cells = [cell if cell else f"Unnamed: {i}" for i, cell in enumerate(raw)]
    names: list[str] = []
    for cell in cells:
        suffixed = (f"{cell}.{n}" for n in range(1, len(cells) + 1))
        free = (name for name in suffixed if name not in cells and name not in names)
        names.append(next(free) if cell in names else cell)
    return names


WHOLE_FIELD = r'(?<=^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|$)'
OPEN_FIELD = r'(?:^|,)"'
SURPLUS = "__surplus"


def has_multiline_fields(spark: SparkSession, path: str) -> bool:
    """Whether any quoted field spans lines: a line opens a quoted field and does not close it.

    A quote inside a field (5" pipe) opens nothing. Splittable scan with a one-row result. Files
    without such fields can be read in parallel splits instead of one task per file.
    """
    rest = F.regexp_replace("value", F.lit(WHOLE_FIELD), F.lit(""))
    opened = rest.rlike(OPEN_FIELD)
    return bool(spark.read.text(path).agg(F.coalesce(F.bool_or(opened), F.lit(False))).first()[0])


def files_by_header(spark: SparkSession, path: str, multi_line: bool = False) -> dict[tuple[str, ...], list[str]]:
    """Paths to read under each list of header cells: the path as given, if all files agree.

    Files are grouped by their header line in Spark, so the driver learns the different header lines; it
    learns the names of files only where lines name different columns.
    """
    start = F.col("_metadata.file_block_start")
    lines = spark.read.text(path).where(start == 0).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("n"))
    heads = lines.groupBy("file").agg(F.min_by("value", "n").alias("line"))
    if multi_line:  # a header that goes on in the next line is told by its file
        heads = heads.withColumn("open_file", F.when(F.length(F.regexp_replace("line", '[^"]', "")) % 2 == 1, F.col("file")))
    else:
        heads = heads.withColumn("open_file", F.lit(None).cast("string"))
    kinds = heads.groupBy("line", "open_file").agg(F.min("file").alias("file")).collect()
    found: dict[tuple[str, ...], list] = {}
    for row in sorted(kinds, key=lambda r: r.file):
        cells = list(spark.read.options(**OPTIONS, multiLine=True).csv(unquote(row.file)).first()) if row.open_file else next(csv_cells(row.line))
        found.setdefault(tuple(header_names(cells)), []).append((row.line, row.open_file))
    if len(found) <= 1:
        return {names: [path] for names in found}
    files = {}
    for row in heads.collect():
        files.setdefault((row.line, row.open_file), []).append(unquote(row.file))
    return {names: sorted(f for kind in kinds_of for f in files[kind]) for names, kinds_of in found.items()}


def csv_cells(line: str):
    """Cells of one header line."""
    return csv_reader([line])


def read_strings(
    spark: SparkSession, path: str, multi_line: bool | None = None, surplus: str = "error"
) -> tuple[DataFrame, list[str]]:
    """All cells as text with null tokens as nulls, in columns ``_0``, ``_1``..., and the names.

    Files of a folder are matched by name: each is read under its own header, and all must name the
    same columns. Rows with more cells than the header are an error when they are read
    (``surplus="error"``), or lose those cells and are marked in a last column (``surplus="mark"``).
    """
    if multi_line is None:
        multi_line = has_multiline_fields(spark, path)
    by_header = files_by_header(spark, path, multi_line)
    if not by_header:
        return spark.createDataFrame([], T.StructType([])), []
    names = list(next(iter(by_header)))
    parts = None
    for header, paths in by_header.items():
        if sorted(header) != sorted(names):
            raise ValueError(f"files of one folder name different columns: {names} and {list(header)} in {paths[0]}")
        schema = T.StructType([T.StructField(f"_{names.index(c)}", T.StringType()) for c in header])
        schema = schema.add(SURPLUS, "string")
        reader = spark.read.options(**OPTIONS, multiLine=multi_line).schema(schema)
        cells = reader.csv(paths, header=True, enforceSchema=True, nullValue="")
        parts = cells if parts is None else parts.unionByName(cells)
    known = [F.when(~F.col(f"_{i}").isin(fixed.NULL_TOKENS), F.col(f"_{i}")).alias(f"_{i}") for i in range(len(names))]
    more = F.col(SURPLUS).isNotNull()
    if surplus == "mark":
        return parts.select(*known, more.alias(SURPLUS)), [*names, SURPLUS]
    message = F.concat(F.lit(f"a row has more than the {len(names)} cells of the header, it begins with "), F.coalesce(F.col("_0"), F.lit("")))
    loud = F.when(more, F.raise_error(message).cast("boolean")).otherwise(True)
    return parts.where(loud).select(known), names


def _is_integer(c: Column) -> Column:
    return c.rlike(INTEGER_PATTERN) & F.trim(c, F.lit(" \t\n\x0b\f\r")).try_cast("bigint").isNotNull()


def _is_boolean(c: Column) -> Column:
    return c.isin(fixed.TRUE_TOKENS + fixed.FALSE_TOKENS)


def infer_types(strings: DataFrame) -> list[str]:
    """Narrowest type that fits every present value of each column, from one aggregate.

    Order: bigint, double, boolean, string; a column without values is double.
    """
    columns = [named(c) for c in strings.columns]
    tests = {
        "present": lambda c: c.isNotNull(),
        "bigint": _is_integer,
        "double": lambda c: coerce_numeric(c).isNotNull(),
        "boolean": _is_boolean,
    }
    counts = strings.agg(*[F.array(*[F.count_if(test(c)) for c in columns]).alias(kind) for kind, test in tests.items()]).first()

    def narrowest(i: int) -> str:
        present = counts["present"][i]
        if present == 0:
            return "double"
        return next((t for t in ("bigint", "double", "boolean") if counts[t][i] == present), "string")

    return [narrowest(i) for i in range(len(columns))]


def cast_columns(strings: DataFrame, types: list[str]) -> DataFrame:
    def typed(name: str, dtype: str) -> Column:
        c = named(name)
        if dtype == "bigint":
            return F.trim(c, F.lit(" \t\n\x0b\f\r")).try_cast("bigint")
        if dtype == "double":
            return coerce_numeric(c)
        if dtype == "boolean":
            return F.when(c.isNotNull(), c.isin(fixed.TRUE_TOKENS))
        return c

    return strings.select([typed(n, t).alias(n) for n, t in zip(strings.columns, types)])


def read_csv(
    spark: SparkSession, path: str, types: list[str] | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Typed frame from a delimited file or folder with a header line.

    Dates stay text. Pass `types` (one per column) to skip the inference pass, `multi_line` to
    skip the check for quoted fields that span lines. A row with more cells than the header is an
    error, as is a file whose header names other columns.
    """
    strings, names = read_strings(spark, path, multi_line)
    return cast_columns(strings, types or infer_types(strings)).toDF(*names)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Export with a header line and without a row index; missing values are empty cells.

    A single column is quoted throughout, as readers skip blank lines.
    """
    df.write.mode(mode).options(
        quoteAll=len(df.columns) == 1,
        **OPTIONS,
        nullValue="",
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        timestampFormat=TIMESTAMP_FORMAT,
        timestampNTZFormat=TIMESTAMP_FORMAT,
    ).csv(path, header=True)
    return path
