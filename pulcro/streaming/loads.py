"""Rules on a file stream: every load is counted once, whatever restarts come between."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.analysis import Analysis
from ..operators.catalogue import get_rule


class StreamedAnalysis(Analysis):
    """Analysis of all rows that a stream has brought so far.

    Rates, totals and distributions come from the counts of its loads; the rows themselves are not
    kept. Rules that look at other rows cannot be counted load by load and are an error.
    """

    def __init__(
        self,
        spark: SparkSession,
        schema: T.StructType,
        assignments: Mapping[str, Sequence[str]],
        target: str,
        parameters: Mapping[tuple[str, str], object] | None = None,
    ):
        looking_around = sorted({r for rules in assignments.values() for r in rules if get_rule(r).uses_duplicates})
        if looking_around:
            raise ValueError(f"rules that look at other rows: {', '.join(looking_around)}")
        super().__init__(spark.createDataFrame([], schema), assignments, parameters)
        self._assignments, self._parameters = assignments, parameters
        self.target = target.rstrip("/")

    def _store(self, batch: DataFrame, number: int) -> None:
        """Counts of one load, a few bytes, under its number; a load that comes again replaces them."""
        counted = Analysis(batch, self._assignments, self._parameters).totals
        (
            counted.withColumn("lote", F.lit(number).cast("long"))
            .coalesce(1)  # one row
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("lote")
            .parquet(f"{self.target}/lotes")
        )

    def run_available(self, source: str, files_per_load: int | None = None) -> None:
        """Counts the parquet files that have come to ``source`` since the last call, then stops.

        The checkpoint beside the counts remembers the files and the number of each load, so a load
        that was cut short is done again under its number.
        """
        spark = self.source.sparkSession
        reader = spark.readStream.schema(self.source.schema)
        if files_per_load:
            reader = reader.option("maxFilesPerTrigger", files_per_load)
        query = (
            reader.parquet(source)
            .writeStream.foreachBatch(self._store)
            .option("checkpointLocation", f"{self.target}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    @property
    def loads(self) -> DataFrame:
        """Counts by load: lote, total, malas and one column per column and rule."""
        counts = Analysis(self.source, self._assignments, self._parameters).totals.schema.fields
        schema = T.StructType([*counts, T.StructField("lote", T.LongType())])
        return self.source.sparkSession.read.schema(schema).parquet(f"{self.target}/lotes")

    @cached_property
    def totals(self) -> DataFrame:
        counts = self.loads
        return counts.agg(*[F.sum(c).alias(c) for c in counts.columns if c != "lote"])
