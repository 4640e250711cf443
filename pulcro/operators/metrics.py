"""Quality metrics of one column or of a whole table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalogue import HAS_DIGIT, HAS_LETTER, ONLY_LETTERS, SPECIAL, only_digits_pattern
from .columns import KEY_BYTES, as_text, known, match_key, scalar_columns, type_of

def pattern_tests() -> dict[str, str]:
    """Metric -> pattern whose matches it counts."""
    return {
        "contiene_numeros": HAS_DIGIT,
        "contiene_letras": HAS_LETTER,
        "solo_numeros": only_digits_pattern(),
        "solo_letras": ONLY_LETTERS,
        "caracteres_especiales": SPECIAL,
    }


def text_tests(dtype: T.DataType, text: Column) -> dict[str, Column]:
    """Metric -> whether the text form of a value of the type matches its pattern; null for a null.

    Texts of integers and doubles have few forms, which are told apart without patterns: a sign and ASCII
    digits; and besides a point, perhaps an exponent, or an infinity.
    """
    signed = text.startswith("-")
    yes, no = F.when(text.isNotNull(), F.lit(True)), F.when(text.isNotNull(), F.lit(False))
    if isinstance(dtype, T.IntegralType):
        answers = (yes, no, ~signed, no, signed)
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        infinite = text.endswith("y")
        answers = (~infinite, infinite | text.contains("E"), no, infinite & ~signed, ~infinite | signed)
    else:
        return {metric: text.rlike(pattern) for metric, pattern in pattern_tests().items()}
    names = ("contiene_numeros", "contiene_letras", "solo_numeros", "solo_letras", "caracteres_especiales")
    return dict(zip(names, answers, strict=True))


def quality_metrics(df: DataFrame, name: str, n: int = 10, approximate: bool = False) -> DataFrame:
    """The nine metrics of one column in one aggregation over one scan.

    Repeats are rows after the first of each value, nulls counting as one value. The exact
    distinct count shuffles keys of bounded width; ``approximate`` avoids even that shuffle.
    """
    value = as_text(df, name)
    filled = F.when(value.isNotNull(), match_key(value))
    distinct = F.approx_count_distinct(filled) if approximate else F.count_distinct(filled)
    total, nulls = F.count(F.lit(1)), F.count_if(value.isNull())
    return df.agg(
        total.alias("total"),
        nulls.alias("vacios"),
        distinct.alias("unicos"),
        F.count_if(F.length(value) > n).alias("longitud_mayor"),
        *[F.count_if(value.rlike(p)).alias(metric) for metric, p in pattern_tests().items()],
    ).select(
        "vacios",
        (F.col("total") - F.col("unicos") - F.when(F.col("vacios") > 0, 1).otherwise(0)).alias(
            "duplicados"
        ),
        "unicos",
        "longitud_mayor",
        *pattern_tests(),
    )


def _marks(value: Column) -> Column:
    """The pattern metrics of a value as bits of one integer."""
    bits = [
        F.when(value.rlike(pattern), F.lit(1 << bit)).otherwise(F.lit(0))
        for bit, pattern in enumerate(pattern_tests().values())
    ]
    return sum(bits[1:], bits[0])


def frequencies(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """columna, valor, nulo, largo, marcas, n: one row per distinct value of each column.

    ``valor`` is the value itself when it is short.

    One shuffle for all columns, counts combined before it. Short values travel as they are and
    are tested once per distinct value; long ones are tested at the scan and travel as a digest.
    """
    columns = list(columns)
    short = F.octet_length("valor") <= KEY_BYTES
    long = F.octet_length("valor") > KEY_BYTES
    grouped = (
        df.select(*[as_text(df, name).alias(name) for name in columns])
        .unpivot([], columns, "columna", "valor")
        .select(
            "columna",
            F.when(short, F.col("valor")).alias("corto"),
            F.when(long, F.sha2("valor", 256)).alias("huella"),
            F.when(long, F.length("valor")).alias("largo"),
            F.when(long, _marks(F.col("valor"))).alias("marcas"),
        )
        .groupBy("columna", "corto", "huella", "largo", "marcas")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return grouped.select(
        "columna",
        F.col("corto").alias("valor"),
        (F.col("corto").isNull() & F.col("huella").isNull()).alias("nulo"),
        F.coalesce("largo", F.length("corto")).alias("largo"),
        F.coalesce("marcas", F.when(F.col("corto").isNotNull(), _marks(F.col("corto")))).alias(
            "marcas"
        ),
        "n",
    )


def number_frequencies(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """columna, valor, nulo, n: one row per distinct value of integer and floating columns.

    Keys are fixed in width, an integer per column and the value in its own kind, so equal large
    integers are never confused; ``valor`` is the value as double.
    """
    columns = list(columns)
    cells = []
    for position, name in enumerate(columns):
        value, whole = known(df, name), isinstance(type_of(df, name), T.IntegralType)
        cells += [
            F.lit(position),
            value.cast("bigint") if whole else F.lit(None).cast("bigint"),
            F.lit(None).cast("double") if whole else value.cast("double") + F.lit(0.0),
        ]
    grouped = (
        df.select(F.stack(F.lit(len(columns)), *cells).alias("i", "entero", "real"))
        .groupBy("i", "entero", "real")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = F.array(*[F.lit(name) for name in columns])
    return grouped.select(
        F.get(names, F.col("i")).alias("columna"),
        F.coalesce("real", F.col("entero").cast("double")).alias("valor"),
        (F.col("entero").isNull() & F.col("real").isNull()).alias("nulo"),
        "n",
    )


def summarise(counted: DataFrame, n: int = 10) -> DataFrame:
    """The nine metrics and the length range of every column of a frequency table."""
    count = F.col("n")

    def rows_where(condition: Column) -> Column:
        return F.sum(F.when(condition, count).otherwise(0))

    return counted.groupBy("columna").agg(
        rows_where(F.col("nulo")).alias("vacios"),
        F.sum(count - 1).alias("duplicados"),
        F.count_if(~F.col("nulo")).alias("unicos"),
        rows_where(F.col("largo") > n).alias("longitud_mayor"),
        *[
            rows_where(F.col("marcas").bitwiseAND(F.lit(1 << bit)) > 0).alias(metric)
            for bit, metric in enumerate(pattern_tests())
        ],
        F.min("largo").alias("longitud_minima"),
        F.max("largo").alias("longitud_maxima"),
    )


def quality_metrics_all(
    df: DataFrame, columns: Iterable[str] | None = None, n: int = 10, approximate: bool = False
) -> DataFrame:
    """The nine metrics and the length range of every scalar column, from one scan.

    ``approximate`` counts distinct values by sketch, in one aggregation without any shuffle of
    values.
    """
    columns = list(columns) if columns is not None else scalar_columns(df)
    if not approximate or not columns:
        return summarise(frequencies(df, columns), n)
    cells = df.select(*[as_text(df, name).alias(f"c{i}") for i, name in enumerate(columns)])
    parts = []
    for i in range(len(columns)):
        value = F.col(f"c{i}")
        distinct = F.approx_count_distinct(F.when(value.isNotNull(), match_key(value)))
        parts += [
            F.count_if(value.isNull()).alias(f"vacios_{i}"),
            distinct.alias(f"unicos_{i}"),
            F.count_if(F.length(value) > n).alias(f"longitud_mayor_{i}"),
            *[F.count_if(value.rlike(p)).alias(f"{m}_{i}") for m, p in pattern_tests().items()],
            F.min(F.length(value)).alias(f"longitud_minima_{i}"),
            F.max(F.length(value)).alias(f"longitud_maxima_{i}"),
        ]
    told = cells.agg(F.count(F.lit(1)).alias("filas"), *parts)
    names = ("longitud_mayor", *pattern_tests(), "longitud_minima", "longitud_maxima")

    def entry(i: int, name: str) -> Column:
        empty = F.col(f"vacios_{i}")
        unique = F.least(F.col(f"unicos_{i}"), F.col("filas") - empty)
        one = F.when(empty > 0, 1).otherwise(0)
        return F.struct(
            F.lit(name).alias("columna"),
            empty.alias("vacios"),
            (F.col("filas") - unique - one).alias("duplicados"),
            unique.alias("unicos"),
            *[F.col(f"{m}_{i}").alias(m) for m in names],
        )

    return told.select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)])))
