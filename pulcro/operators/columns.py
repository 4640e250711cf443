"""What kind of column this is, and its text form."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values up to this many bytes are compared as they are, longer ones by length and digest.
KEY_BYTES = 128
NULL_KEY = "~"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str) -> Column:
    """The named column of ``df``; an unknown name is an error right away."""
    if name not in df.columns:
        raise ValueError(f"unknown column: {name}")
    return F.col(quoted(name))


def type_of(df: DataFrame, name: str) -> T.DataType:
    column(df, name)
    return df.schema[name].dataType


def type_name(dtype: T.DataType) -> str:
    """Name of a type in results; both kinds of timestamp are one."""
    return "timestamp" if isinstance(dtype, T.TimestampNTZType) else dtype.simpleString()


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def scalar_columns(df: DataFrame) -> list[str]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]


def known(df: DataFrame, name: str) -> Column:
    """The named column with NaN as null: both are missing values."""
    value = column(df, name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def missing(df: DataFrame, name: str) -> Column:
    """Whether the value is null or NaN."""
    return known(df, name).isNull()


def as_text(df: DataFrame, name: str) -> Column:
    """Text form of a scalar column, null where the value is missing; nested columns have none."""
    dtype = type_of(df, name)
    if name not in scalar_columns(df):
        raise TypeError(f"column {name} of type {dtype.simpleString()} has no text form")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return (known(df, name) + F.lit(0.0)).cast("string")  # one text for 0.0 and -0.0
    return column(df, name).cast("string")


def match_key(value: Column) -> Column:
    """Key of bounded width that is equal exactly for equal texts; nulls equal each other.

    Long texts are represented by their length and SHA-256, so neither a shuffle nor a broadcast
    of keys ever carries whole documents.
    """
    digest = F.concat(F.lit("#"), F.octet_length(value).cast("string"), F.lit(":"), F.sha2(value, 256))
    return F.coalesce(
        F.when(F.octet_length(value) <= KEY_BYTES, F.concat(F.lit("="), value)).otherwise(digest),
        F.lit(NULL_KEY),
    )


def compute_once(df: DataFrame, computed: dict[str, Column]) -> DataFrame:
    """Adds computed columns that later filters read instead of computing them again.

    The optimizer moves a filter below a projection together with the expressions it refers to,
    which runs costly rules twice per row; it does not move one below a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in computed.items()]))))


def check_all(df: DataFrame, names: Iterable[str]) -> list[str]:
    names = list(names)
    for name in names:
        column(df, name)
    return names
