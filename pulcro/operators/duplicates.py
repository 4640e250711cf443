"""Repeated values: found by one aggregation, brought back to the rows by a size-checked join."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, materialise, spread
from .columns import as_text, match_key

#: Most frequent values that never take part in a shuffle join. What is left out of these holds at
#: most 1/1001 of the rows per value, however the data is skewed.
HOT_VALUES = 1_000

#: Bytes a broadcast key takes besides its text.
ROW_OVERHEAD = 48


def repeated_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(columna, clave, n) of every value that occurs more than once, stored reliably.

    All columns share one shuffle of keys; counts are combined before it, so a value that fills a
    third of the table arrives as one row per task.
    """
    keys = df.select(*[match_key(as_text(df, name)).alias(name) for name in columns])
    counted = (
        keys.unpivot([], columns, "columna", "clave")
        .groupBy("columna", "clave")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    return materialise(counted)


def _shuffle_flag(df: DataFrame, key: str, flag: str, repeated: DataFrame) -> DataFrame:
    """Join with a table of repeated values that is too large to broadcast.

    The most frequent values are matched by broadcast; their rows go through the shuffle join
    spread evenly, under keys that match nothing.
    """
    hot = (
        repeated.orderBy(F.desc("n"), "clave")
        .limit(HOT_VALUES)
        .select(F.col("clave").alias("__clave"), F.lit(True).alias("__frecuente"))
    )
    cold = repeated.select(
        F.col("clave").alias("__clave2"), F.lit(-1).alias("__cubo2"), F.lit(True).alias("__resto")
    )
    rows = df.join(F.broadcast(hot), F.col(key) == F.col("__clave"), "left").withColumn(
        "__cubo", F.when(F.col("__frecuente"), spread()).otherwise(F.lit(-1))
    )
    return (
        rows.join(
            cold, (F.col("__cubo") == F.col("__cubo2")) & (F.col(key) == F.col("__clave2")), "left"
        )
        .withColumn(flag, F.col("__frecuente").isNotNull() | F.col("__resto").isNotNull())
        .drop("__clave", "__frecuente", "__cubo", "__clave2", "__cubo2", "__resto")
    )


def flag_duplicates(
    df: DataFrame, outputs: Mapping[str, str], broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Adds a boolean column per entry of ``outputs`` (column -> flag name): value repeated?

    Every member of a repeated group is flagged. The measured size of the repeated values decides
    how they travel: none at all, by broadcast up to ``broadcast_bytes``, by shuffle beyond.
    """
    if not outputs:
        return df
    repeated = repeated_values(df, list(outputs))
    measured = repeated.groupBy("columna").agg(
        F.sum(F.octet_length("clave") + ROW_OVERHEAD).alias("bytes")
    )
    sizes = {row["columna"]: row["bytes"] for row in measured.collect()}  # one row per column
    for position, (name, flag) in enumerate(outputs.items()):
        size = sizes.get(name, 0)
        if size == 0:
            df = df.withColumn(flag, F.lit(False))
            continue
        key = f"__clave_{position}"
        mine = repeated.filter(F.col("columna") == name).select("clave", "n")
        df = df.withColumn(key, match_key(as_text(df, name)))
        if size <= broadcast_bytes:
            small = mine.select(F.col("clave").alias("__valor"))
            df = (
                df.join(F.broadcast(small), F.col(key) == F.col("__valor"), "left")
                .withColumn(flag, F.col("__valor").isNotNull())
                .drop("__valor")
            )
        else:
            df = _shuffle_flag(df, key, flag, mine)
        df = df.drop(key)
    return df
