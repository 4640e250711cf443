"""Row numbers without a window over the rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import is_small, materialise, stored

#: Bits of ``monotonically_increasing_id`` that count rows inside a partition.
_OFFSET_BITS = 33


def sheet_row(fila: Column) -> Column:
    """Row number a spreadsheet shows for the row at zero-based position ``fila``."""
    return fila + 2


def _running_start(counts: DataFrame, order: str) -> DataFrame:
    """Adds ``inicio``, the rows before each entry. One entry per file or partition, so few."""
    upto = F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("inicio", upto - F.col("n"))


def with_row_number(df: DataFrame, output: str = "fila") -> DataFrame:
    """Adds the zero-based position of each row.

    The rows are stored first, because both passes must see the same partitions; the second pass
    adds the rows of the partitions before to the offset inside the partition.
    """
    stable = materialise(df).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", _OFFSET_BITS)
    counts = stable.groupBy(part.alias("__parte")).agg(F.count(F.lit(1)).alias("n"))
    starts = _running_start(counts, "__parte").select("__parte", "inicio")
    offset = F.col("__id").bitwiseAND(F.lit((1 << _OFFSET_BITS) - 1))
    return (
        stable.withColumn("__parte", part)
        .join(F.broadcast(starts), "__parte")  # one row per partition
        .select((F.col("inicio") + offset).alias(output), *df.columns)
    )


def read_parquet_numbered(spark: SparkSession, path: str, output: str = "fila") -> DataFrame:
    """Rows of parquet files with their zero-based position, files in the order of their paths.

    The reader knows the position inside a file, whatever its splits, so nothing is stored and
    the counting pass reads no column.
    """
    raw = spark.read.parquet(path)
    files = (
        raw.select(F.col("_metadata.file_path").alias("__archivo"))
        .groupBy("__archivo")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    starts = materialise(_running_start(files, "__archivo").select("__archivo", "inicio"))
    side = F.broadcast(starts) if is_small(starts) else starts
    return (
        raw.select(
            *raw.columns,
            F.col("_metadata.file_path").alias("__archivo"),
            F.col("_metadata.row_index").alias("__posicion"),
        )
        .join(side, "__archivo")
        .select((F.col("inicio") + F.col("__posicion")).alias(output), *raw.columns)
    )


def pin_splits(spark: SparkSession) -> None:
    """Fixes how files are cut into splits, which otherwise follows the cores at hand."""
    setting = "spark.sql.files.minPartitionNum"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(spark.sparkContext.defaultParallelism))


@dataclass(frozen=True)
class NumberedLines:
    """``lines`` with their number; per file ``archivo``, the lines kept ``n`` and how many of them
    satisfy each of the tests asked for."""

    lines: DataFrame
    files: DataFrame


def number_lines(
    lines: DataFrame, keep: Column, output: str, tests: Mapping[str, Column] = MappingProxyType({})
) -> NumberedLines:
    """Numbers the kept lines of each file, from zero.

    ``lines`` has archivo and bloque (file and first byte of the split a line was read from). A
    split is read in order by one task, so its lines are numbered from the id of its first one
    plus the lines of the splits before. One pass counts, the pass that uses the lines numbers.

    Both passes must cut the files alike, also when executors come or go between them, so the
    number of splits aimed at is pinned. Should the cut differ all the same (settings changed in
    between), ids of a split are shifted and leave the counted range: that is an error, never a
    wrong number or a lost line.
    """
    pin_splits(lines.sparkSession)
    marked = lines.filter(keep).withColumn("__id", F.monotonically_increasing_id())
    splits = marked.groupBy("archivo", "bloque").agg(
        F.min("__id").alias("__primera"),
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(test).alias(name) for name, test in tests.items()],
    )
    before = Window.partitionBy("archivo").orderBy("bloque")
    upto = F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, 0))
    starts = stored(splits.withColumn("__antes", upto - F.col("n")), "cortes")
    side = starts.select("archivo", "bloque", "__primera", "__antes", F.col("n").alias("__n"))
    side = F.broadcast(side) if is_small(starts) else side
    offset = F.col("__id") - F.col("__primera")
    position = F.when(
        (offset >= 0) & (offset < F.col("__n")), offset + F.col("__antes")
    ).otherwise(F.raise_error(F.lit("files were split differently while numbering lines")))
    numbered = marked.join(side, ["archivo", "bloque"], "left").select(
        *lines.columns, position.cast("long").alias(output)
    )
    files = starts.groupBy("archivo").agg(
        F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in tests]
    )
    return NumberedLines(numbered, files)


def number_across_files(
    rows: DataFrame, file: str, position: str, counts: DataFrame, output: str, keep_file=False
) -> DataFrame:
    """Position over all files, in the order of their paths, from the position inside a file.

    ``counts`` holds the positions ``n`` of each file.
    """
    starts = materialise(_running_start(counts, file).select(file, "inicio"))
    side = F.broadcast(starts) if is_small(starts) else starts
    kept = [n for n in rows.columns if n != position and (keep_file or n != file)]
    return rows.join(side, file).select(
        (F.col("inicio") + F.col(position)).alias(output), *[F.col(f"`{n}`") for n in kept]
    )
