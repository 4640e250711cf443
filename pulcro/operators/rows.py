"""Row and column operations on a whole table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .columns import as_text, check_all, column, known, missing, text_columns, type_of


def keep_values(df: DataFrame, name: str | None, values: Sequence) -> DataFrame:
    """Rows whose column holds one of the values; without values nothing is filtered."""
    if not values:
        return df
    return df.filter(column(df, name).isin(*values))


def count_kept(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """One row: how many rows the filter keeps."""
    return keep_values(df, name, values).agg(F.count(F.lit(1)).alias("filas"))


def distinct_values(df: DataFrame, name: str, order: str = "fila") -> DataFrame:
    """Non-null values in the order of their first row."""
    return (
        df.filter(column(df, name).isNotNull())
        .groupBy(column(df, name).alias(name))
        .agg(F.min(order).alias("primera"))
        .orderBy("primera")
    )


def preview(df: DataFrame, rows: int = 10, order: str = "fila") -> DataFrame:
    """First rows of the table."""
    return df.orderBy(order).limit(rows)


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Without the named columns; names that are not there are ignored."""
    return df.drop(*names)


def fill_nulls(df: DataFrame, value: str, skip: Iterable[str] = ()) -> DataFrame:
    """Nulls, and NaN, of every column become ``value``.

    A column whose type cannot hold the value becomes text, decided from the schema and the
    value alone.
    """
    probe = df.sparkSession.range(1)
    skip = set(skip)
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name not in skip}
    typed = {n: t for n, t in kinds.items() if not isinstance(t, T.StringType)}
    fits = {}
    if typed:
        row = probe.select(
            *[F.lit(value).try_cast(t).isNotNull().alias(f"c{i}") if _castable(t) else
              F.lit(False).alias(f"c{i}") for i, t in enumerate(typed.values())]
        ).first()
        fits = {n: row[i] for i, n in enumerate(typed)}
    filled = {}
    for name, kind in kinds.items():
        if isinstance(kind, T.StringType):
            filled[name] = F.coalesce(column(df, name), F.lit(value))
        elif fits[name]:
            filled[name] = F.coalesce(known(df, name), F.lit(value).cast(kind))
        else:
            filled[name] = F.coalesce(as_text(df, name), F.lit(value))
    return df.withColumns(filled) if filled else df


def _castable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType))


def clean_names(names: Sequence[str], df: DataFrame, taken: Iterable[str] = ()) -> list[str]:
    """Column names in snake case; empty ones and collisions, also with ``taken``, get a number.

    Accents and punctuation are dropped by the same expression that cleans cells.
    """
    folded = (
        df.sparkSession.range(1)
        .select(
            F.transform(
                F.array(*[F.lit(n) for n in names]),
                lambda n: F.regexp_replace(
                    F.regexp_replace(F.lower(text.clean_text(n)), r"\s+", "_"), "[^a-z0-9_]", ""
                ),
            ).alias("nombres")
        )
        .first()["nombres"]
    )
    used: set[str] = set(taken)
    result = []
    for position, name in enumerate(folded, start=1):
        base = name or f"columna_{position}"
        unique, number = base, 2
        while unique in used:
            unique, number = f"{base}_{number}", number + 1
        used.add(unique)
        result.append(unique)
    return result


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns, df)) if df.columns else df


def replace_values(
    df: DataFrame, find: str, new: str, columns: Iterable[str] | None = None, exact: bool = True
) -> DataFrame:
    """Finds and replaces in the columns, by default in every text column.

    Exact replacement compares whole cells with a text, so it leaves other types alone; partial
    replacement turns the column into text.
    """
    texts = set(text_columns(df))
    names = check_all(df, columns) if columns is not None else list(text_columns(df))
    if exact:
        changed = {
            n: text.replace_exact(column(df, n), find, new) for n in names if n in texts
        }
    else:
        changed = {n: text.replace_part(as_text(df, n), find, new) for n in names}
    return df.withColumns(changed) if changed else df


def drop_empty_rows(df: DataFrame, columns: Iterable[str] | None = None, how="all") -> DataFrame:
    """Without rows whose columns are all (or, with ``how='any'``, partly) null, NaN or blank."""
    if how not in ("all", "any"):
        raise ValueError("how is 'all' or 'any'")
    names = check_all(df, columns) if columns is not None else df.columns
    texts = set(text_columns(df))
    empty = [
        text.is_blank(column(df, n)) if n in texts else missing(df, n) for n in names
    ]
    if not empty:
        return df
    condition = empty[0]
    for other in empty[1:]:
        condition = (condition & other) if how == "all" else (condition | other)
    return df.filter(~condition)


def _digest(columns: Iterable[Column], seed: str) -> Column:
    """64 bits of some cells; a null is a value of its own, not the same as in another place."""
    cells = [part for c in columns for part in (c.isNull(), c)]
    return F.xxhash64(F.lit(seed), *cells)


def _place(df: DataFrame, order: str, tie: Column) -> Column:
    """Order and 62 bits of the cells as one decimal; smaller is earlier, a null order is last."""
    kind, value = type_of(df, order), column(df, order)
    if isinstance(kind, T.DateType):
        value = F.unix_date(value)
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)
    elif not isinstance(kind, T.IntegralType):
        raise TypeError(f"rows cannot be put in the order of {order}: {kind.simpleString()}")
    first = F.coalesce(value.cast("decimal(19,0)"), F.lit(Decimal(2**63)))
    return first * F.lit(Decimal(2**62)) + F.shiftrightunsigned(tie, 2)


def drop_duplicate_rows(
    df: DataFrame, columns: Iterable[str] | None = None, order: str = "fila"
) -> DataFrame:
    """The first row, by ``order``, of every group of equal rows; all its cells are of one row.

    ``order`` is a whole number, a date or a time; null comes last. Of several rows that are first,
    one is chosen by its cells. Order and cells make one number, so one scan finds the first place of
    every group by hash aggregation, combined before the shuffle: a key that holds a third of the
    table, with whatever order or none, costs one row per task. Rows then meet the winners once,
    named by 128 bits of the key. No window or sort of whole groups is needed.
    """
    keys = check_all(df, columns) if columns is not None else [n for n in df.columns if n != order]
    others = [n for n in df.columns if n not in keys and n != order]
    keyed = [column(df, n) for n in keys]
    if not others:
        first = df.groupBy(*keyed).agg(F.min(order).alias(order))
        return first.select(*[column(df, n) for n in df.columns])
    group = ["__g1", "__g2"]
    named = df.withColumns({
        **{g: _digest(keyed, g) for g in group},
        "__place": _place(df, order, _digest([column(df, n) for n in others], "tie")),
    })
    winners = named.groupBy(*group).agg(F.min("__place").alias("__place"))
    whole = named.join(winners, [*group, "__place"], "left_semi")
    # What is left of a group is one row, or the same row several times.
    return whole.select(*[column(df, n) for n in df.columns]).distinct()


def impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and columns before and after a transformation, and the differences."""
    n = F.count(F.lit(1))
    counted = before.agg(n.alias("antes"), F.lit(0).cast("long").alias("despues")).unionByName(
        after.agg(F.lit(0).cast("long").alias("antes"), n.alias("despues"))
    )
    first, last = len(before.columns), len(after.columns)
    return counted.agg(
        F.sum("antes").alias("filas_antes"), F.sum("despues").alias("filas_despues")
    ).select(
        "filas_antes",
        "filas_despues",
        (F.col("filas_despues") - F.col("filas_antes")).alias("filas_delta"),
        F.lit(first).cast("long").alias("columnas_antes"),
        F.lit(last).cast("long").alias("columnas_despues"),
        F.lit(last - first).cast("long").alias("columnas_delta"),
    )
