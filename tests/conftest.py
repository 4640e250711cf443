import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("pulcro-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture
def texts(spark):
    """Table with one text column ``v`` and its position ``fila``."""

    def make(values):
        return spark.createDataFrame(list(enumerate(values)), "fila long, v string")

    return make


@pytest.fixture
def apply(texts):
    """Values of a column function over the given texts, in order."""

    def run(values, function):
        rows = texts(values).select("fila", function(F.col("v")).alias("r")).collect()
        return [row["r"] for row in sorted(rows, key=lambda row: row["fila"])]

    return run
