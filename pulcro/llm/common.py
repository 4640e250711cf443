"""What several operators of this subpackage need: input, keys of rows, stored tables, numbering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulcro.session import scratch_path

#: Rows per numbered block: bounds the window that counts within a block.
BLOCK_ROWS = 65_536
#: Rows that a Python worker gets at a time while a table is stored.
BATCH_ROWS = 1_024
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whether Spark removes the shuffle files of a query when it ends.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes ``df`` once to the shared folder; later plans read the files, whatever executors die.

    While it is written, Python workers get batches of at most ``BATCH_ROWS`` rows: texts can be long,
    and a worker holds a batch several times over. The shuffle files go as soon as the table is written,
    not when the driver's collector finds them, since nothing reads them again. The session's own settings
    are put back afterwards.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    given, cleanup = spark.conf.get(BATCH_SETTING), spark.conf.get(CLEANUP_SETTING, "false")
    if not 0 < int(given) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, given)
        spark.conf.set(CLEANUP_SETTING, cleanup)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(text: Column) -> list[Column]:
    """128 bits of a text: with the document id they name a row by its content.

    Two scans of one input agree on them even if the input is split differently the second time.
    """
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2")]


def same_key(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality of the named columns."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def running_sums(array: str) -> str:
    """SQL for the sums of all elements up to and including each element of an array of integers.

    Sums run in chunks of 512, so the cost stays near linear for arrays of any length.
    """
    chunks = (
        f"transform(sequence(0, greatest(cast(ceil(size({array}) / 512.0) as int) - 1, 0)), "
        f"k -> slice({array}, k * 512 + 1, 512))"
    )
    bases = (
        f"aggregate({chunks}, array(0L), (acc, c) -> concat(acc, array("
        "element_at(acc, -1) + aggregate(c, 0L, (s, x) -> s + x))))"
    )
    return (
        f"flatten(zip_with({chunks}, slice({bases}, 1, size({chunks})), (c, b) -> slice("
        "aggregate(c, array(b), (acc, x) -> concat(acc, array(element_at(acc, -1) + x))), "
        "2, size(c))))"
    )


def number_within(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds the long ``name``: 0, 1, ... without gaps within each value of ``group``, in ``order``.

    The table is range-sorted and stored with its position; positions fall into blocks of bounded
    size; a window counts inside (group, block) and the counts of the blocks before are added. No
    window ever holds a whole group. Ties are broken by the place in the input.
    """
    keyed = df.withColumn("__row", F.monotonically_increasing_id())
    placed = store(
        keyed.orderBy(*order, "__row")
        .drop("__row")
        .withColumn("__pos", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn(
        "__block",
        F.expr("shiftright(__pos, 33)") * F.lit(1 << 20)
        + F.floor((F.col("__pos") % F.lit(1 << 33)) / BLOCK_ROWS),
    )
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(group, "__block")
        .agg(F.count("*").alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy(group, "__block").orderBy("__pos")
    return (
        placed.withColumn("__rank", F.row_number().over(inside))
        .join(offsets, [group, "__block"])
        .withColumn(name, (F.col("__offset") + F.col("__rank") - 1).cast("long"))
        .drop("__offset", "__rank", "__block", "__pos")
    )


def sorted_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Cuts a partition that is sorted by ``key`` into lists of whole groups, one frame a batch.

    Only the rows of the last, still open group are carried to the next batch.
    """
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[key].to_numpy()
        if rest and keys[-1] == rest[0][key].iloc[0]:
            rest.append(batch)
            continue
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        whole = pd.concat([*rest, batch.iloc[:cut]], ignore_index=True) if rest else batch[:cut]
        if len(whole):
            yield whole
        rest = [batch.iloc[cut:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b): root is the least node.

    Alternating large and small stars; each round is a few shuffles of the edge list, stored, and
    rounds end when the edges no longer change. Least neighbours are combined before the shuffle, so
    a node with very many neighbours costs no more than its edges.
    """
    now = store(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), "m")
        large = large.select("a", F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))))
            .select("col.a", F.col("col.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        now = store(small, "edges")
        seen = now.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if mark == seen:
            break
        mark = seen
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


