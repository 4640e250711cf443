"""Queries that SQL can say equal their SQL; all are registered under their numbers."""

import re
import time
from pathlib import Path

import __spark_entry__ as contract
import duckdb
import pytest
from pulcro.llm.common import CLEANUP_SETTING, store
from pulcro.llm.oracles import ORACLES
from pulcro.llm.queries import QUERIES
from pyspark.sql import functions as F
from tools.compare import bag


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_each_operator_has_one_query():
    assert [int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES] == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(QUERIES) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert bag(df.columns, df.collect()) == bag(names, result.fetchall())


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def shuffles():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {name for name in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    before, given = shuffles(), spark.conf.get(CLEANUP_SETTING)
    rows = spark.range(20_000).repartition(4, "id").groupBy((F.col("id") % 1000).alias("k")).count()
    store(rows, "counts")
    assert spark.conf.get(CLEANUP_SETTING) == given
    written = None
    for _ in range(20):
        written = shuffles() - before
        if not written:
            break
        time.sleep(0.5)
    assert not written
