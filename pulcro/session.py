"""Helpers that depend on the session: shared scratch space and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest tables that are ever hinted for broadcast: by rows where their width is fixed, else by
#: measured bytes.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests) falls back to a temporary folder of its own: on a cluster a
    machine-local folder would be lost with its executor, so an unset folder is an error there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pulcro-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created."""
    return f"{checkpoint_dir(spark).rstrip('/')}/pulcro-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later uses read the stored rows, also after executors are lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table whose order does not matter to the shared folder and reads it from there.

    It is computed once; a checkpoint computes it a second time to write it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when a (cheap to scan) table holds at most ``max_rows`` rows; reads no further."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(buckets: int = 1024) -> Column:
    """Bucket number that spreads rows evenly, whatever their values are."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int")
