import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from insight_spark.functions import scalars as s


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("r")).first().r


NUMBER_TEXTS = [
    "1,000", "$3", " 2 ", "1e3", "1d", "1f", "inf", "-Infinity", "nan", "0x10", "1_000", "", "+5", ".5", "5.",
    "1e", " 5", "true", "1E+5", "١", "\t3\n", "-.5e-2", "--1", "1 2", ".", "e5",
]


def test_coerce_numeric_agrees_with_pandas(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(NUMBER_TEXTS)], "i int, t string")
    got = [r.n for r in frame.select("i", s.coerce_numeric(F.col("t")).alias("n")).orderBy("i").collect()]
    want = pd.to_numeric(pd.Series([*NUMBER_TEXTS, "0.5"]), errors="coerce").tolist()[:-1]
    assert got == [None if math.isnan(x) else x for x in want]


def test_coerce_numeric_other_types(spark):
    assert one(spark, s.coerce_numeric(F.col("b"), T.BooleanType()), b=("boolean", True)) == 1.0
    assert one(spark, s.coerce_numeric(F.col("d"), T.DoubleType()), d=("double", float("nan"))) is None
    assert one(spark, s.coerce_numeric(F.col("d"), T.DateType()), d=("date", dt.date(2024, 1, 1))) is None


@pytest.mark.parametrize("nanos", [1, 999, 1000, 1500, 1_700_000_000_123_456_789, -1, -1500, 0])
def test_numbers_are_epoch_nanoseconds(spark, nanos):
    got = one(spark, s.coerce_timestamp(F.col("n"), T.LongType()), n=("bigint", nanos))
    assert got == pd.to_datetime(pd.Series([nanos]))[0].floor("us").to_pydatetime()


def test_coerce_timestamp_formats(spark):
    read = s.coerce_timestamp(F.col("t"))
    assert one(spark, read, t=("string", "2024-02-29 01:02:03")) == dt.datetime(2024, 2, 29, 1, 2, 3)
    assert one(spark, read, t=("string", "2024-02-29")) == dt.datetime(2024, 2, 29)
    assert one(spark, read, t=("string", "2023-02-29")) is None
    assert one(spark, read, t=("string", "29/02/2024")) is None
    own = s.coerce_timestamp(F.col("t"), formats=["dd/MM/yyyy"])
    assert one(spark, own, t=("string", "29/02/2024")) == dt.datetime(2024, 2, 29)
    assert one(spark, s.coerce_timestamp(F.col("b"), T.BooleanType()), b=("boolean", True)) is None
    kept = s.coerce_timestamp(F.col("n"), T.LongType(), numeric="keep")
    assert one(spark, kept, n=("bigint", 5)) == 5


SPACES = ["  a b ", " x ", "\x1cz\x1f", "\x85y ", "", " \t\n", "in ner", "​keep"]


def test_trim_agrees_with_python(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(SPACES)], "i int, t string")
    got = [r.t for r in frame.select("i", s.trim_text(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got == [t.strip() for t in SPACES]
    assert one(spark, s.trim_text(F.col("t")), t=("string", None)) is None


TEXTS = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i j k", "a\r\n", "\r\n\r\nx"]


def test_lines_agree_with_python(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = [r.p for r in frame.select("i", s.lines_of(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == [t.splitlines() or [t] for t in TEXTS]


BYTES = [b"plain", "hé".encode(), b"a\xffb", b"\xc3(", b"\xe2\x82", b"", b"\xf0\x9f\x98\x80ok\xed\xa0\x80"]


def test_decode_drops_bad_bytes(spark):
    frame = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(BYTES)], "i int, b binary")
    got = [r.t for r in frame.select("i", s.decode_text(F.col("b")).alias("t")).orderBy("i").collect()]
    assert got == [b.decode("utf-8", errors="ignore") for b in BYTES]


NAN, INF = float("nan"), float("inf")
METRIC_TEXTS = [
    # value, currency, percent, integer, anything else
    (None, "N/A", "N/A", "N/A", "N/A"),
    (NAN, "N/A", "N/A", "N/A", "N/A"),
    (0.0, "$0.00", "0.00%", "0", "0.00"),
    (0.125, "$0.12", "12.50%", "0", "0.12"),
    (2.675, "$2.67", "267.50%", "3", "2.67"),
    (0.5, "$0.50", "50.00%", "0", "0.50"),
    (1.5, "$1.50", "150.00%", "2", "1.50"),
    (2.5, "$2.50", "250.00%", "2", "2.50"),
    (-2.5, "$-2.50", "-250.00%", "-2", "-2.50"),
    (1234567.891, "$1,234,567.89", "123,456,789.10%", "1,234,568", "1,234,567.89"),
    (-1234.5, "$-1,234.50", "-123,450.00%", "-1,234", "-1,234.50"),
    (0.005, "$0.01", "0.50%", "0", "0.01"),
    (1e9, "$1,000,000,000.00", "100,000,000,000.00%", "1,000,000,000", "1,000,000,000.00"),
    (INF, "$inf", "inf%", "inf", "inf"),
    (0.29, "$0.29", "29.00%", "0", "0.29"),
    (99999.995, "$99,999.99", "9,999,999.50%", "100,000", "99,999.99"),
]


@pytest.mark.parametrize(("fmt", "column"), [("currency", 1), ("percent", 2), ("integer", 3), ("decimal", 4)])
def test_format_metric(spark, fmt, column):
    frame = spark.createDataFrame([(i, row[0]) for i, row in enumerate(METRIC_TEXTS)], "i int, v double")
    got = [r.t for r in frame.select("i", s.format_metric(F.col("v"), F.lit(fmt)).alias("t")).orderBy("i").collect()]
    assert got == [row[column] for row in METRIC_TEXTS]


def test_percent_is_cut_off(spark):
    assert one(spark, s.truncated_percent(F.col("r")), r=("double", 0.29)) == int(0.29 * 100) == 28


def test_user_key(spark):
    import hashlib

    want = hashlib.sha256(b"ann@example.com").hexdigest()[:20]
    assert one(spark, s.user_key(F.col("e")), e=("string", " Ann@Example.COM ")) == want


def test_content_id_is_repeatable(spark):
    a = one(spark, s.content_id(14, F.col("x"), F.col("y")), x=("string", "1"), y=("string", None))
    b = one(spark, s.content_id(14, F.col("x"), F.col("y")), x=("string", "1"), y=("string", ""))
    c = one(spark, s.content_id(14, F.col("x"), F.col("y")), x=("string", ""), y=("string", "1"))
    assert len(a) == 14 and a == b != c


def test_utc_stamp(spark):
    at = s.utc_stamp(F.col("t"))
    assert one(spark, at, t=("timestamp_ntz", dt.datetime(2024, 1, 2, 3, 4, 5, 678))) == "2024-01-02T03:04:05Z"
    assert one(spark, s.utc_stamp(), t=("int", 1)).endswith("Z")
