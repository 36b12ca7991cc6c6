"""Type tests on schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.NumericType,)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, FLOATING)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_boolean(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def columns_where(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


def ident(name: str) -> str:
    """Column reference that survives dots and spaces in the name."""
    return "`" + name.replace("`", "``") + "`"


def holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType)


def comparable(c: Column, dtype: T.DataType) -> Column:
    """The same value for equal values: maps, which Spark neither hashes nor compares, as entries sorted by key."""
    if not holds_map(dtype):
        return c
    if isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(c),
            lambda e: F.struct(
                comparable(e["key"], dtype.keyType).alias("key"), comparable(e["value"], dtype.valueType).alias("value")
            ),
        )
        return F.array_sort(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda e: comparable(e, dtype.elementType))
    fields = [comparable(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
    return F.when(c.isNotNull(), F.struct(*fields))
