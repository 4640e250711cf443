"""Times the headline queries; prints one JSON line.

Each query runs to completion over all its rows and columns (``noop`` sink), once to warm up and
then ``BENCH_RUNS`` times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from checks.queries import QUERIES  # noqa: E402

HEADLINE = (
    "column_error_rate",
    "category_distribution",
    "row_category",
    "error_report",
    "rule_duplicates_lineitem",
    "rule_duplicates_documents",
    "phone_diagnosis",
    "email_diagnosis",
    "quality_metrics_documents",
    "quality_metrics_all_documents",
    "profile_columns_lineitem",
    "profile_columns",
    "profile_histogram",
    "text_clean",
    "text_fold",
    "country_code",
    "dates_formats",
    "clean_table",
    "clean_then_validate",
    "promote_types",
    "drop_duplicate_rows",
    "row_number_excel",
    "ingest_csv_rows",
    "ruleset_rules",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pulcro-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Generated methods beyond this size are never compiled to machine code.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pulcro-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
