"""Profiles kept per load that merge, so that a new load is profiled without reading the old ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import as_text, known, match_key, numeric_columns, scalar_columns, type_name
from .metrics import pattern_tests, text_tests

#: Size of the sketches: distinct counts have a standard error of 0.8 %, ranks one of about 0.3 %.
DISTINCT_BITS = 14
RANK_SIZE = 800
#: Type of a column whose loads disagree.
MIXED = "mixto"

_QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def load_profile(df: DataFrame, n: int = 10) -> DataFrame:
    """What one load adds to the profile and the metrics, a row a scalar column, from one aggregation.

    columna, tipo, filas, vacios, sketches of distinct values and of ranks, cantidad, media, m2 (sum
    of squared deviations), minimo, maximo of numbers, counts of the metrics and the length range.
    NaN is missing. Nothing is shuffled but one row a task.
    """
    columns = scalar_columns(df)
    numeric = set(numeric_columns(df))
    # Texts and keys are projected once; inside the aggregation each of its functions would make its own.
    told = df.select(
        *[(known(df, c).cast("double") if c in numeric else F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)],
        *[as_text(df, c).alias(f"t{i}") for i, c in enumerate(columns)],
    )
    texts = {f"t{i}": F.col(f"t{i}") for i in range(len(columns))}
    told = told.select("*", *[F.when(t.isNotNull(), match_key(t)).alias(f"k{n}") for n, t in texts.items()])
    parts = []
    for i, name in enumerate(columns):
        number, text = F.col(f"v{i}"), F.col(f"t{i}")
        parts += [
            F.count_if(text.isNull()).alias(f"vacios_{i}"),
            F.hll_sketch_agg(F.col(f"kt{i}"), DISTINCT_BITS).alias(f"distintos_{i}"),
            F.count(number).alias(f"cantidad_{i}"),
            F.avg(number).alias(f"media_{i}"),
            (F.var_pop(number) * F.count(number)).alias(f"m2_{i}"),
            F.min(number).alias(f"minimo_{i}"),
            F.max(number).alias(f"maximo_{i}"),
            (F.kll_sketch_agg_double(number, RANK_SIZE) if name in numeric else F.lit(None).cast("binary")).alias(f"rangos_{i}"),
            F.count_if(F.length(text) > n).alias(f"longitud_mayor_{i}"),
            *[F.count_if(test).alias(f"{m}_{i}") for m, test in text_tests(df.schema[name].dataType, text).items()],
            F.min(F.length(text)).alias(f"longitud_minima_{i}"),
            F.max(F.length(text)).alias(f"longitud_maxima_{i}"),
        ]
    stats = told.agg(F.count(F.lit(1)).alias("filas"), *parts)
    names = (
        "vacios", "distintos", "cantidad", "media", "m2", "minimo", "maximo", "rangos", "longitud_mayor",
        *pattern_tests(), "longitud_minima", "longitud_maxima",
    )

    def entry(i: int, name: str) -> Column:
        return F.struct(
            F.lit(name).alias("columna"),
            F.lit(type_name(df.schema[name].dataType)).alias("tipo"),
            F.lit(name in numeric).alias("numerica"),
            F.col("filas"),
            *[F.col(f"{m}_{i}").alias(m) for m in names],
        )

    return stats.select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)])))


def merge_profiles(states: DataFrame) -> DataFrame:
    """One state a column from those of several loads, in any order and any grouping of loads.

    Counts add up, sketches unite, means and deviations are merged pair by pair. A column that a load
    does not have is missing in all its rows.
    """
    rows = F.col("filas")
    moments = F.collect_list(F.when(F.col("cantidad") > 0, F.struct(F.col("cantidad").alias("n"), "media", "m2")))

    def merge(a: Column, b: Column) -> Column:
        n, step = a["n"] + b["n"], b["media"] - a["media"]
        return F.struct(
            n.alias("n"),
            (a["media"] + step * b["n"] / n).alias("media"),
            (a["m2"] + b["m2"] + step * step * a["n"] * b["n"] / n).alias("m2"),
        )

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("media"), F.lit(0.0).alias("m2"))
    merged = states.groupBy("columna").agg(
        F.when(F.min("tipo") == F.max("tipo"), F.min("tipo")).otherwise(MIXED).alias("tipo"),
        F.max("numerica").alias("numerica"),
        F.sum(rows).alias("filas"),
        F.sum("vacios").alias("vacios"),
        F.hll_union_agg("distintos").alias("distintos"),
        moments.alias("momentos"),
        F.min("minimo").alias("minimo"),
        F.max("maximo").alias("maximo"),
        F.kll_merge_agg_double("rangos").alias("rangos"),
        *[F.sum(m).alias(m) for m in ("longitud_mayor", *pattern_tests())],
        F.min("longitud_minima").alias("longitud_minima"),
        F.max("longitud_maxima").alias("longitud_maxima"),
    )
    total = F.aggregate("momentos", start, merge)
    merged = merged.withColumn("__m", total)
    some = F.col("__m.n") > 0
    return merged.select(
        "columna", "tipo", "numerica", "filas", "vacios", "distintos", F.col("__m.n").alias("cantidad"),
        F.when(some, F.col("__m.media")).alias("media"), F.when(some, F.col("__m.m2")).alias("m2"),
        "minimo", "maximo", "rangos", "longitud_mayor", *pattern_tests(), "longitud_minima", "longitud_maxima",
    )


def _distinct() -> tuple[Column, Column]:
    """Estimated distinct values, and rows that repeat one; a null counts as one value, as elsewhere."""
    filled = F.col("filas") - F.col("vacios")
    unique = F.least(F.hll_sketch_estimate("distintos"), filled)
    return unique, filled - unique + F.greatest(F.col("vacios") - 1, F.lit(0))


def finish_profile(state: DataFrame) -> DataFrame:
    """The column profile of a state, with the columns of ``columns_profile``."""
    unique, repeated = _distinct()
    number = F.col("numerica")
    filled = F.when(F.col("cantidad") > 0, F.col("rangos"))
    return state.select(
        "columna", "tipo", "vacios", unique.alias("unicos"), repeated.alias("duplicados"),
        F.when(number, F.col("cantidad")).alias("cantidad"),
        "media",
        F.when(F.col("cantidad") > 1, F.sqrt(F.col("m2") / (F.col("cantidad") - 1))).alias("desviacion"),
        "minimo",
        *[F.kll_sketch_get_quantile_double(filled, F.lit(p)).alias(name) for name, p in _QUARTILES.items()],
        "maximo",
    )


def finish_metrics(state: DataFrame) -> DataFrame:
    """The nine metrics and the length range of a state, with the columns of ``quality_metrics_all``."""
    unique, repeated = _distinct()
    return state.select(
        "columna", "vacios", repeated.alias("duplicados"), unique.alias("unicos"), "longitud_mayor",
        *pattern_tests(), "longitud_minima", "longitud_maxima",
    )


def store_load(df: DataFrame, path: str, load: str, n: int = 10) -> None:
    """Keeps the state of a load under its name; a load that is stored again replaces its state only."""
    (
        load_profile(df, n)
        .withColumn("carga", F.lit(load))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("carga")
        .parquet(path)
    )


def read_loads(spark: SparkSession, path: str, loads: list[str] | None = None) -> DataFrame:
    """The merged state of all stored loads, or of some."""
    states = spark.read.parquet(path)
    if loads is not None:
        states = states.filter(F.col("carga").cast("string").isin(*loads))
    return merge_profiles(states)
