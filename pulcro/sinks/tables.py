"""Result tables and the error report as files."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.analysis import Analysis
from ..session import scratch_path

# Characters a section label may not hold, its greatest length, and its name when nothing is
# left. Fixed values.
FORBIDDEN = r"[:\\/?*\[\]]"
LABEL_LENGTH = 31
EMPTY_LABEL = "hoja"


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited files with a header; quotes are doubled and white space is kept."""
    options = {"header": True, "escape": '"'}
    keep_space = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("errorifexists").options(**options, **keep_space).csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def publish(df: DataFrame, name: str) -> DataFrame:
    """Makes the result available by name to whatever analyses it next.

    The result is stored first, so that its plan does not run once for every analysis.
    """
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    df.sparkSession.read.schema(df.schema).parquet(path).createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def report_labels(names: Iterable[str]) -> dict[str, str]:
    """Section label of each analysed column, distinct and fit for a sheet name."""
    labels: dict[str, str] = {}
    used: set[str] = set()
    for name in names:
        base = re.sub(FORBIDDEN, "_", name)[:LABEL_LENGTH].strip() or EMPTY_LABEL
        candidates = [base]
        while candidates[-1] in used:
            ending = f"_{len(candidates)}"
            candidates.append(base[: LABEL_LENGTH - len(ending)] + ending)
        labels[name] = candidates[-1]
        used.add(candidates[-1])
    return labels


def error_report(analysis: Analysis) -> DataFrame:
    """hoja, columna, all columns of the bad row, categoria_error."""
    labels = report_labels(c.name for c in analysis.columns)
    names = [part for pair in labels.items() for part in map(F.lit, pair)]
    errors = analysis.errors()
    return errors.select(F.create_map(*names)[F.col("columna")].alias("hoja"), *errors.columns)


def write_error_report(analysis: Analysis, path: str, max_rows_per_file: int = 5_000_000) -> None:
    """One folder per analysed column.

    Rows are rebalanced by section first: files get a sensible size whatever the number of tasks,
    and a section that holds most of the errors is split over several of them.
    """
    (
        error_report(analysis)
        .hint("rebalance", F.col("hoja"))
        .write.mode("errorifexists")
        .option("maxRecordsPerFile", max_rows_per_file)
        .partitionBy("hoja")
        .parquet(path)
    )
