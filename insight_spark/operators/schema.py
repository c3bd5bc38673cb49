"""Column roles, unique names, and one meaning of "missing"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from insight_spark.functions.scalars import named, nan_to_null

DATE_NAME_PARTS = ("date", "time")


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType))


def is_date_like(name: str, parts: tuple[str, ...] = DATE_NAME_PARTS) -> bool:
    return any(part in name.lower() for part in parts)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f)]


def date_like_columns(df: DataFrame, parts: tuple[str, ...] = DATE_NAME_PARTS) -> list[str]:
    return [c for c in df.columns if is_date_like(c, parts)]


def normalise_missing(df: DataFrame) -> DataFrame:
    """Turn NaN into null so that both count, group and compare as one missing value."""
    floats = {
        f.name: nan_to_null(named(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(floats) if floats else df


def comparable(df: DataFrame) -> DataFrame:
    """`normalise_missing`, plus maps at any depth as sorted entries so that rows can be grouped."""
    df = normalise_missing(df)
    maps = {f.name: ordered(named(f.name), f.dataType) for f in df.schema.fields if holds_map(f.dataType)}
    return df.withColumns(maps) if maps else df


def holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return holds_map(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(holds_map(f.dataType) for f in dtype.fields)


def ordered(col: Column, dtype: T.DataType) -> Column:
    """A value with every map in it as the array of its entries in order of key; null stays null."""
    if not holds_map(dtype):
        return col
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(col),
            lambda e: F.struct(ordered(e["key"], dtype.keyType).alias("key"), ordered(e["value"], dtype.valueType).alias("value")),
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: ordered(x, dtype.elementType))
    parts = F.struct(*[ordered(col[f.name], f.dataType).alias(f.name) for f in dtype.fields])
    return F.when(col.isNotNull(), parts)


def unique_columns(df: DataFrame) -> DataFrame:
    """Keep the first of several columns with the same name."""
    positions = [f"_{i}" for i in range(len(df.columns))]
    first = {}
    for position, name in zip(positions, df.columns):
        first.setdefault(name, position)
    return df.toDF(*positions).select([F.col(p).alias(n) for n, p in first.items()])


def column_roles(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type and the roles the other operators go by."""
    rows = [
        (i, f.name, f.dataType.simpleString(), is_numeric(f), is_text(f), is_date_like(f.name))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "ordinal int, column string, type string, is_numeric boolean, is_text boolean, is_date_like boolean",
    )
