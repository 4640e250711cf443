"""Checks of master data: fields that must be filled, prices above zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.columns import as_text, column


def required(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    """Name of the check -> True where the field is null or blank."""
    return {f"falta_{name}": text.is_blank(as_text(df, name)) for name in names}


def check(df: DataFrame, tests: dict[str, Column], key: str) -> DataFrame:
    """key, one boolean per failed check, and whether the record is valid."""
    bad = F.lit(False)
    for test in tests.values():
        bad = bad | test
    return df.select(
        column(df, key), *[test.alias(name) for name, test in tests.items()], (~bad).alias("valido")
    )


def customers(df: DataFrame, name: str, email: str, key: str = "fila") -> DataFrame:
    """Name and e-mail are required."""
    return check(df, required(df, [name, email]), key)


def suppliers(df: DataFrame, tax_id: str, country: str, key: str = "fila") -> DataFrame:
    """Tax id and country are required."""
    return check(df, required(df, [tax_id, country]), key)


def products(df: DataFrame, code: str, price: str, key: str = "fila") -> DataFrame:
    """Code is required, the price must be above zero; a missing price is not."""
    tests = required(df, [code])
    tests["precio_invalido"] = ~F.coalesce(column(df, price) > 0, F.lit(False))
    return check(df, tests, key)
