"""Column-level building blocks. Every function maps columns to columns and stays in the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F, types as T

from insight_spark.functions import fixed

NUMBER_PATTERN = r"^[ \t\n\x0B\f\r]*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))[ \t\n\x0B\f\r]*$"
INTEGER_PATTERN = r"^[ \t\n\x0B\f\r]*[+-]?[0-9]+[ \t\n\x0B\f\r]*$"
OUTER_SPACE_PATTERN = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"
LINE_BREAK_PATTERN = r"\r\n|[\n\r\x0B\f\x1c\x1d\x1e\x85\u2028\u2029]"

# Spellings with one reading each. Of the others, `operators.cleaning.date_formats` picks one per column.
DEFAULT_DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd",
    "yyyy/M/d",
    "MMM d, yyyy",
    "d MMM yyyy",
)
MONTH_FIRST_FORMATS = ("M/d/yyyy", "M/d/yyyy HH:mm:ss", "M-d-yyyy")
DAY_FIRST_FORMATS = ("d/M/yyyy", "d/M/yyyy HH:mm:ss", "d-M-yyyy", "d.M.yyyy")


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def named(column: str) -> Column:
    """Reference a column by its literal name, even with dots or backticks in it."""
    return F.col(quoted(column))


def names_array(names: Sequence[str]) -> Column:
    """Literal array of names, as one expression however many there are."""
    return F.from_json(F.lit(json.dumps(list(names))), "array<string>")


def array_over(columns: Sequence[str], expression: Callable[[str], str], element: str) -> Column:
    """Array with one SQL expression per column; keeps plans of very wide tables small."""
    return F.expr("array(" + ", ".join(expression(quoted(c)) for c in columns) + ")").cast(f"array<{element}>")


def array_total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda total, x: total + x)


def any_of(conditions: Sequence[Column]) -> Column:
    """Disjunction as a balanced tree, so that many conditions do not nest deeply."""
    if len(conditions) == 1:
        return conditions[0]
    middle = len(conditions) // 2
    return any_of(conditions[:middle]) | any_of(conditions[middle:])


def is_missing(col: Column, dtype: T.DataType) -> Column:
    """Null, or NaN for floating-point columns."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def coerce_numeric(col: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Best-effort number as double: unreadable text becomes null, booleans become 0/1.

    `try_cast` alone would accept spellings such as ``1d``; the pattern rules them out.
    """
    if isinstance(dtype, T.StringType):
        return F.when(col.rlike(NUMBER_PATTERN), F.trim(col, F.lit(" \t\n\x0b\f\r")).try_cast("double"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return nan_to_null(col.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return col.cast("double")
    return F.lit(None).cast("double")


def coerce_timestamp(
    col: Column,
    dtype: T.DataType = T.StringType(),
    formats: Sequence[str] = DEFAULT_DATE_FORMATS,
    numeric: str = "epoch_ns",
) -> Column:
    """Best-effort timestamp without time zone; unreadable values become null.

    Text is trimmed and tried against `formats` in order; a time with a zone becomes its UTC time. Numbers are epoch nanoseconds
    (``numeric="epoch_ns"``) or left alone (``numeric="keep"``).
    """
    if isinstance(dtype, T.TimestampNTZType):
        return col
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return col.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        text = trim_text(col)
        tried = [F.try_to_timestamp(text, F.lit(fmt)) for fmt in formats]
        return F.coalesce(*tried).cast("timestamp_ntz")
    if isinstance(dtype, T.NumericType):
        if numeric == "keep":
            return col
        micros = F.floor(nan_to_null(col.cast("double")) / 1000) if isinstance(
            dtype, (T.FloatType, T.DoubleType)
        ) else F.floor(col / F.lit(1000).cast("decimal(5,0)"))
        return F.timestamp_micros(micros.try_cast("bigint")).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def trim_text(col: Column) -> Column:
    """Strip all Unicode white space from both ends; missing text stays missing."""
    return F.regexp_replace(col, OUTER_SPACE_PATTERN, "")


def decode_text(content: Column) -> Column:
    """UTF-8 bytes to text, dropping undecodable bytes."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def lines_of(text: Column) -> Column:
    """Array of lines; a trailing line break adds no empty line, empty text is one empty line."""
    parts = F.split(text, LINE_BREAK_PATTERN, -1)
    dropped = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), dropped).otherwise(parts)


def truncated_percent(rate: Column) -> Column:
    """Whole percent, cut off (never rounded): 0.29 gives 28."""
    return (rate * 100).cast("int")


def percent_text(rate: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(rate * 100, digits), F.lit("%"))


def plain_number(value: Column, digits: int = 2) -> Column:
    """Fixed decimals without thousands separators."""
    return F.replace(finite_text(value, digits), F.lit(","), F.lit(""))


def finite_text(value: Column, digits: int) -> Column:
    """Grouped digits with fixed decimals; infinities as words."""
    return (
        F.when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .otherwise(F.format_number(value, digits))
    )


def format_metric(value: Column, fmt: Column) -> Column:
    """Display text of a metric by format: currency, percent, integer, anything else two decimals."""
    value = value.cast("double")

    return (
        F.when(value.isNull() | F.isnan(value), F.lit("N/A"))
        .when(fmt == "currency", F.concat(F.lit("$"), finite_text(value, 2)))
        .when(fmt == "percent", F.concat(finite_text(value * 100, 2), F.lit("%")))
        .when(fmt == "integer", finite_text(F.bround(value), 0))
        .otherwise(finite_text(value, 2))
    )


def normalised_email(col: Column) -> Column:
    return F.lower(trim_text(col))


def user_key(email: Column) -> Column:
    """Storage key of a user: 20 hex characters derived from the normalised email."""
    return F.substring(F.sha2(normalised_email(email).cast("binary"), 256), 1, 20)


def content_id(length: int, *parts: Column) -> Column:
    """Repeatable identifier of a record, derived from its content."""
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *filled).cast("binary"), 256), 1, length)


def utc_stamp(ts: Column | None = None) -> Column:
    """``2025-01-31T10:20:30Z``; defaults to the current time. The session time zone must be UTC."""
    return F.date_format(F.current_timestamp() if ts is None else ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def bullet_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda item: F.concat(F.lit("- "), item)), "\n")
