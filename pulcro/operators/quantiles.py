"""Exact quantiles by radix selection: three scans of the distinct values for any number of columns and ranks."""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .columns import known, quoted

#: Bits of the key that are still open after each scan.
OPEN_BITS = (42, 21, 0)
#: Buckets of a level that one window adds up; it finds the group of buckets first, then the bucket.
GROUP_BITS = 11

_NORMAL = 2.0**-1022
_TINY = 2.0**-1074


def sort_keys(values: DataFrame, names: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Doubles as longs in the same order: the bits of their size, negative for negative ones.

    The exponent is estimated by a logarithm and put right by comparison; dividing by a power of two
    and taking off the leading one are exact. Each step is a projection of its own, because what is
    used several times in the next one is then computed once. There are no nulls to fear: they stay. Columns to ``keep`` come along, before the keys of ``names``.
    """
    names = values.columns if names is None else names
    places, along = range(len(names)), [F.col(quoted(n)) for n in keep]
    steps = values.select(*along, *[(F.col(quoted(n)) + 0.0).alias(f"v{i}") for i, n in enumerate(names)])
    sizes = [F.abs(F.col(f"v{i}")) for i in places]
    guesses = [F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)) for size in sizes]
    steps = steps.select("*", *[F.when(sizes[i].isNotNull(), g).alias(f"g{i}") for i, g in enumerate(guesses)])
    steps = steps.select("*", *[F.pow(F.lit(2.0), F.col(f"g{i}")).alias(f"p{i}") for i in places])
    bits = []
    for i, size in enumerate(sizes):
        guess, power = F.col(f"g{i}"), F.col(f"p{i}")
        over, under = size >= power * 2.0, size < power
        exponent = guess + F.when(over, 1).when(under, -1).otherwise(0)
        leading = power * F.when(over, 2.0).when(under, 0.5).otherwise(1.0)
        bits.append(
            F.when(size == 0, F.lit(0).cast("long"))
            .when(size == float("inf"), F.lit(2047 << 52))
            .when(size < _NORMAL, (size / _TINY).cast("long"))
            .when(
                size.isNotNull(),
                F.shiftleft((exponent + 1023).cast("long"), 52) + ((size / leading - 1.0) * 2.0**52).cast("long"),
            )
        )
    steps = steps.select(*along, *[f"v{i}" for i in places], *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    signed = [F.when(F.col(f"v{i}") < 0, -F.col(f"b{i}")).otherwise(F.col(f"b{i}")) for i in places]
    return steps.select(*along, *[k.alias(n) for k, n in zip(signed, names)])


def from_sort_key(key: int) -> float:
    (value,) = struct.unpack("<d", struct.pack("<q", abs(key)))
    return -value if key < 0 else value


def _counted(values: DataFrame) -> DataFrame:
    """i, n, v, stored: the place of a column, the rows of a value of it that is not null, and its key."""
    cells = [x for i, name in enumerate(values.columns) for x in (F.lit(i), F.col(quoted(name)) + F.lit(0.0))]
    rows = values.select(F.stack(F.lit(len(values.columns)), *cells).alias("i", "v")).filter("v IS NOT NULL")
    counted = rows.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    return stored(sort_keys(counted, ["v"], keep=["i", "n"]), "valores")


def _level(counted: DataFrame, names: Sequence[str], level: int, kept: Mapping[str, Sequence[int]] | None) -> DataFrame:
    """columna, padre, tramo, n: rows by the bits known after this scan, inside the buckets ``kept``."""
    padre = F.lit(0).cast("long") if kept is None else F.shiftright("v", OPEN_BITS[level - 1])
    rows = counted.select("i", "n", padre.alias("padre"), F.shiftright("v", OPEN_BITS[level]).alias("tramo"))
    if kept is not None:
        buckets = [(names.index(name), b) for name, some in kept.items() for b in sorted(set(some))]
        inside = counted.sparkSession.createDataFrame(buckets, "i int, padre long")  # a few a column
        rows = rows.join(F.broadcast(inside), ["i", "padre"])
    counts = rows.groupBy("i", "padre", "tramo").agg(F.sum("n").alias("n"))
    columna = F.get(F.array(*[F.lit(name) for name in names]), F.col("i"))
    return stored(counts.select(columna.alias("columna"), "padre", "tramo", "n"), "tramos")


def _locate(counts: DataFrame, wanted: list[tuple[str, int, list[int]]]) -> list[tuple[str, int, int, int, int]]:
    """(columna, padre, rango, tramo, antes): the bucket that holds each rank of each parent bucket.

    ``wanted`` has columna, padre and ranks inside it. Groups of buckets are added up first, then the
    buckets of those groups that hold a rank, so no window sees more than a few thousand rows.
    """
    asked = counts.sparkSession.createDataFrame(wanted, "columna string, padre long, rangos array<long>")
    upto = (Window.unboundedPreceding, Window.currentRow)

    def reached(sums: DataFrame, group: list[str], order: str) -> DataFrame:
        """Sums with the ranks that fall into them, counted from their start."""
        total = F.sum("n").over(Window.partitionBy(*group).orderBy(order).rowsBetween(*upto))
        known_ = sums.withColumn("hasta", F.col("previo") + total)
        start = F.col("hasta") - F.col("n")
        inside = F.filter("rangos", lambda r: (r >= start) & (r < F.col("hasta")))
        return known_.select("*", start.alias("antes"), inside.alias("dentro")).filter(F.size("dentro") > 0)

    grouped = counts.withColumn("grupo", F.shiftright("tramo", GROUP_BITS))
    sums = grouped.groupBy("columna", "padre", "grupo").agg(F.sum("n").alias("n"))
    sums = sums.join(F.broadcast(asked), ["columna", "padre"]).withColumn("previo", F.lit(0).cast("long"))
    groups = reached(sums, ["columna", "padre"], "grupo").select(
        "columna", "padre", "grupo", F.col("antes").alias("previo"), F.col("dentro").alias("rangos")
    )
    # At most one group for each rank.
    inner = grouped.join(F.broadcast(groups), ["columna", "padre", "grupo"])
    found = reached(inner, ["columna", "padre", "grupo"], "tramo")
    rows = found.select("columna", "padre", "tramo", "antes", F.explode("dentro").alias("rango")).collect()
    return [(r["columna"], r["padre"], r["rango"], r["tramo"], r["antes"]) for r in rows]


def exact_quantiles(
    df: DataFrame, names: Sequence[str], probabilities: Sequence[float]
) -> dict[str, list[float | None]]:
    """Quantiles per column with linear interpolation; None for a column of nulls.

    Rows are counted by value, all columns in one shuffle with map-side combine. The distinct values become
    64-bit keys in the same order and are stored. Each of three scans of them adds up the next bits of the
    keys that can still hold a wanted rank; after the third the keys at the ranks are known to the last
    bit. The table itself is read once.
    """
    if not names:
        return {}
    values = df.select(*[known(df, name).cast("double").alias(name) for name in names])
    counted = _counted(values)
    first = _level(counted, values.columns, 0, None)
    sizes = {r["columna"]: r["n"] for r in first.groupBy("columna").agg(F.sum("n").alias("n")).collect()}
    positions = {n: [p * (sizes[n] - 1) for p in probabilities] for n in names if n in sizes}
    open_ranks = {
        (name, 0): {rank: rank for x in some for rank in (floor(x), ceil(x))} for name, some in positions.items()
    }  # ranks inside a bucket -> ranks in the column
    if not open_ranks:
        return {name: [None] * len(probabilities) for name in names}
    counts, picked = first, {}
    for level in range(len(OPEN_BITS)):
        if level:
            kept: dict[str, list[int]] = {}
            for name, bucket in open_ranks:
                kept.setdefault(name, []).append(bucket)
            counts = _level(counted, values.columns, level, kept)
        found = _locate(counts, [(name, bucket, sorted(ranks)) for (name, bucket), ranks in open_ranks.items()])
        following: dict[tuple[str, int], dict[int, int]] = {}
        for name, parent, rank, bucket, before in found:
            own = open_ranks[(name, parent)][rank]
            following.setdefault((name, bucket), {})[rank - before] = own
            picked[(name, own)] = bucket
        open_ranks = following

    def at(name: str, x: float) -> float:
        low, high = (from_sort_key(picked[(name, edge)]) for edge in (floor(x), ceil(x)))
        return low + (high - low) * (x - floor(x)) if low != high else low

    return {
        name: [at(name, x) for x in positions[name]] if name in positions else [None] * len(probabilities)
        for name in names
    }
