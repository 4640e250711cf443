"""Profile of a table: overview, types, histogram, statistics and the column report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .analysis import Analysis
from .columns import as_text, known, match_key, missing, numeric_columns, scalar_columns, type_name
from .metrics import frequencies, number_frequencies
from .quantiles import exact_quantiles


def overview(df: DataFrame) -> DataFrame:
    """filas, columnas, celdas_vacias of the table."""
    empty = F.lit(0).cast("long")
    for name in df.columns:
        empty = empty + F.count_if(missing(df, name))
    return df.agg(F.count(F.lit(1)).alias("filas"), empty.alias("celdas_vacias")).select(
        "filas", F.lit(len(df.columns)).cast("long").alias("columnas"), "celdas_vacias"
    )


def types(df: DataFrame) -> DataFrame:
    """tipo, columnas, celdas_vacias: how the columns divide into data types."""
    by_type: dict[str, list[str]] = {}
    for field in df.schema.fields:
        by_type.setdefault(type_name(field.dataType), []).append(field.name)
    nulls = df.agg(
        *[F.count_if(missing(df, n)).alias(f"n_{i}") for i, n in enumerate(df.columns)]
    )
    position = {name: i for i, name in enumerate(df.columns)}
    entries = []
    for kind, names in by_type.items():
        empty = F.lit(0).cast("long")
        for name in names:
            empty = empty + F.col(f"n_{position[name]}")
        entries.append(
            F.struct(
                F.lit(kind).alias("tipo"),
                F.lit(len(names)).cast("long").alias("columnas"),
                empty.alias("celdas_vacias"),
            )
        )
    return nulls.select(F.inline(F.array(*entries)))


def lengths(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """columna, longitud_minima, longitud_maxima of the text forms, in one aggregation."""
    columns = list(columns) if columns is not None else scalar_columns(df)
    bounds = df.agg(
        *[F.min(F.length(as_text(df, n))).alias(f"min_{i}") for i, n in enumerate(columns)],
        *[F.max(F.length(as_text(df, n))).alias(f"max_{i}") for i, n in enumerate(columns)],
    )
    return bounds.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("columna"),
                        F.col(f"min_{i}").alias("longitud_minima"),
                        F.col(f"max_{i}").alias("longitud_maxima"),
                    )
                    for i, n in enumerate(columns)
                ]
            )
        )
    )


def histogram(df: DataFrame, name: str, bins: int = 10) -> DataFrame:
    """tramo, desde, hasta, cantidad, fuera: equal-width bins over the range, the last one closed.

    Range and bins are of the finite values; ``fuera`` is the number of infinite ones, the same in
    every row. Missing values, NaN among them, are not counted.
    """
    value = known(df, name).cast("double")
    infinite = F.abs(value) == F.lit(float("inf"))
    finite = F.when(~infinite, value)
    limits = df.agg(
        F.min(finite).alias("low"), F.max(finite).alias("high"), F.count_if(infinite).alias("n")
    ).first()
    schema = "tramo int, desde double, hasta double, cantidad long, fuera long"
    if limits["low"] is None:
        return df.sparkSession.createDataFrame([], schema)
    low, high = limits["low"], limits["high"]
    width = (high - low) / bins
    position = F.least(F.floor((finite - low) / width), F.lit(bins - 1)) if width else F.lit(0)
    counts = (
        df.filter(finite.isNotNull())
        .groupBy(position.cast("int").alias("tramo"))
        .agg(F.count(F.lit(1)).alias("cantidad"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("tramo"))
    return (
        every.join(counts, "tramo", "left")
        .select(
            "tramo",
            (F.lit(low) + F.col("tramo") * F.lit(width)).alias("desde"),
            (F.lit(low) + (F.col("tramo") + 1) * F.lit(width)).alias("hasta"),
            F.coalesce("cantidad", F.lit(0).cast("long")).alias("cantidad"),
            F.lit(limits["n"]).cast("long").alias("fuera"),
        )
        .orderBy("tramo")
    )


def _counted_values(df: DataFrame, columns: list[str], numeric: list[str]) -> DataFrame:
    """columna, nulo, n of every distinct value."""
    plain = [n for n in numeric if not isinstance(df.schema[n].dataType, T.DecimalType)]
    parts = []
    if plain:
        parts.append(number_frequencies(df, plain).select("columna", "nulo", "n"))
    others = [n for n in columns if n not in plain]
    if others:
        parts.append(frequencies(df, others).select("columna", "nulo", "n"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


PROFILE = (
    "columna string, tipo string, vacios long, unicos long, duplicados long, cantidad long, "
    "media double, desviacion double, minimo double, p25 double, p50 double, p75 double, "
    "maximo double"
)


def columns_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, empty, distinct, repeated and descriptive statistics of every scalar column.

    Counts, mean, deviation and extremes are one aggregation over one scan, exact distinct counts a
    shuffle of distinct values, exact quartiles one more for all columns; ``approximate`` takes sketches in the same aggregation instead and stores nothing. Statistics
    are null for columns that are not numeric. The driver sees one row per column.
    """
    columns = scalar_columns(df)
    numeric = [n for n in numeric_columns(df) if n in columns]
    if not columns:
        return df.sparkSession.createDataFrame([], PROFILE)
    parts = []
    for i, name in enumerate(columns):
        value = known(df, name)
        number = value.cast("double") if name in numeric else F.lit(None).cast("double")
        parts += [
            F.count_if(value.isNull()).alias(f"vacios_{i}"),
            F.avg(number).alias(f"media_{i}"),
            F.stddev_samp(number).alias(f"desviacion_{i}"),
            F.min(number).alias(f"minimo_{i}"),
            F.max(number).alias(f"maximo_{i}"),
        ]
        if approximate:
            key = value if name in numeric else match_key(as_text(df, name))
            parts += [
                F.approx_count_distinct(F.when(value.isNotNull(), key)).alias(f"unicos_{i}"),
                F.percentile_approx(number, [0.25, 0.5, 0.75]).alias(f"cuartiles_{i}"),
            ]
    stats = df.agg(F.count(F.lit(1)).alias("filas"), *parts)

    def entry(i: int, name: str) -> Column:
        empty, rows = F.col(f"vacios_{i}"), F.col("filas")
        unique = F.col(f"unicos_{i}") if approximate else F.lit(None).cast("long")
        filled = rows - empty
        shown = [F.get(f"cuartiles_{i}", F.lit(k)) if approximate else F.lit(None).cast("double") for k in range(3)]
        return F.struct(
            F.lit(name).alias("columna"),
            F.lit(type_name(df.schema[name].dataType)).alias("tipo"),
            empty.alias("vacios"),
            F.least(unique, filled).alias("unicos"),
            F.greatest(filled - unique, F.lit(0)).alias("duplicados"),
            (filled if name in numeric else F.lit(None).cast("long")).alias("cantidad"),
            *[F.col(f"{n}_{i}").alias(n) for n in ("media", "desviacion", "minimo")],
            *[q.alias(p) for q, p in zip(shown, ("p25", "p50", "p75"), strict=True)],
            F.col(f"maximo_{i}").alias("maximo"),
        )

    described = stats.select(F.inline(F.array(*[entry(i, n) for i, n in enumerate(columns)])))
    if approximate:
        # A null counts as one value, as in the exact form.
        repeated = F.col("duplicados") + F.greatest(F.col("vacios") - 1, F.lit(0))
        return described.withColumn("duplicados", repeated)
    counted = _counted_values(df, columns, numeric)
    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
    fixed = df.sparkSession.createDataFrame(
        [(n, *quartiles.get(n, [None] * 3)) for n in columns],
        "columna string, p25 double, p50 double, p75 double",
    )
    distinct = counted.groupBy("columna").agg(
        F.count_if(~F.col("nulo")).alias("unicos"), F.sum(F.col("n") - 1).alias("duplicados")
    )
    whole = described.drop("unicos", "duplicados", "p25", "p50", "p75")
    whole = whole.join(F.broadcast(fixed), "columna").join(F.broadcast(distinct), "columna", "left")
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("unicos", "duplicados")]
    return whole.select(
        "columna", "tipo", "vacios", *zero, "cantidad", "media", "desviacion", "minimo",
        "p25", "p50", "p75", "maximo",
    )


def columns_report(df: DataFrame, assignments, parameters=None) -> DataFrame:
    """Profile of each column with the error rate of those that have rules."""
    rates = Analysis(df, assignments, parameters).column_error_rate()
    return columns_profile(df).join(F.broadcast(rates), "columna", "left")
