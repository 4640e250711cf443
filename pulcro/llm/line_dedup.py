"""Operator 8, line dedup: levelled sorted runs of line hashes, merged batch by batch.

Documents come in batches of descending ids. The distinct line keys of a batch merge-anti-join the
runs stored so far: a key that no run holds is first seen here, so the largest id that holds it lies
in this batch and is kept with it; a known key only adds its number of documents. The batch's keys
become a run of level 0, sorted by hash; ``fanout`` runs of a level are compacted into one of the
next. Frequent keys are read off the runs, and lines that hold one are dropped outside its keeper.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulcro.llm.common import same_key, store, text_key, text_or_empty
from pulcro.session import scratch_path

WHITE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A to Z in lower case; other letters stay."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(WHITE)), capitals, capitals.lower())


class LineRuns:
    """Levelled sorted runs of (h1, h2, n, keeper), a key once a run; each is a bucketed table in the shared folder.

    Runs are dealt to buckets and sorted by hash when they are written, so a batch is merged with
    them without moving them again. There are as many buckets as shuffles have parts: a part then holds
    whole buckets, and a run is one file a bucket instead of one for every part and bucket.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _dealt(self, run: DataFrame) -> DataFrame:
        if self.buckets == int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            return run.repartition(*KEY)
        return run.repartition(self.buckets, *KEY)

    def _write(self, run: DataFrame) -> str:
        name = f"llm_line_run_{uuid.uuid4().hex}"
        (
            self._dealt(run)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", scratch_path(self.spark, name))
            .saveAsTable(name)
        )
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Merges the distinct keys (h1, h2, n, top) of a batch and stores them as a new run."""
        rest, seen = batch, F.lit(False)
        for k, run in enumerate(self.runs()):
            rest = rest.join(run.select(*KEY, F.lit(True).alias(f"in{k}")), KEY, "left")
            seen = seen | F.coalesce(F.col(f"in{k}"), F.lit(False))
        # What no run holds is the anti-join; the rest adds its documents to a key already there.
        keeper = F.when(~seen, F.col("top"))
        self._push(0, self._write(rest.select(*KEY, "n", keeper.alias("keeper"))))

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self._write(self.merged(old))
            self.levels[level] = []
            for each in old:
                self.spark.sql(f"DROP TABLE {each}")
            self._push(level + 1, merged)

    def drop(self) -> None:
        """Takes the runs out of the catalogue; their files lie in the shared folder."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = []

    def merged(self, names: list[str] | None = None) -> DataFrame:
        """One row a key over the given runs (all by default): documents in all and the keeper."""
        tables = [self.spark.table(n) for n in names] if names is not None else self.runs()
        whole = tables[0]
        for each in tables[1:]:
            # Sorted runs of the same buckets are merged where they lie.
            other = each.select(*KEY, F.col("n").alias("m"), F.col("keeper").alias("other"))
            whole = whole.join(other, KEY, "full").select(
                *KEY,
                (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"),
                F.greatest("keeper", "other").alias("keeper"),
            )
        return whole


def dropped_lines(
    docs: DataFrame, min_chars: int = 40, min_documents: int = 5, batches: int = 3
) -> DataFrame:
    """(doc_id, t1, t2, places): sorted places of the lines to drop, for documents that have some.

    A document is named by its id and 128 bits of its text, so repeated rows share their entry. Rows
    with one id are one document; a null id is one, the smallest. Each batch is a range of ids.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    shares = [k / batches for k in range(1, batches)]
    known = docs.where(F.col("doc_id").isNotNull())
    edges = known.approxQuantile("doc_id", shares, 0.01) if shares else []
    batch = F.lit(0)
    for edge in sorted(set(edges)):
        batch = batch + F.when(F.col("doc_id") > edge, 0).otherwise(1)
    lines = docs.select("doc_id", *text_key(text), F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))
    lines = lines.select("doc_id", "t1", "t2", "place", line_key(F.col("line")).alias("key"))
    lines = store(
        lines.where(F.length("key") >= min_chars).select(
            "doc_id", "t1", "t2", "place",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second"), "key").alias("h2"),
            batch.alias("batch"),
        ),
        "lines", "batch",
    )
    runs = LineRuns(spark)
    for k in range(len(set(edges)) + 1):
        holders = lines.where(F.col("batch") == k).groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))
        runs.add(holders.groupBy(*KEY).agg(F.count("one").alias("n"), F.max("doc_id").alias("top")))
    frequent = store(runs.merged().where(F.col("n") >= min_documents).select(*KEY, "keeper"), "frequent")
    runs.drop()
    hits = lines.join(frequent, KEY).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return hits.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("place")).alias("places"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with ``text`` less the dropped lines, plus n_lines and n_dropped.

    A null or empty text is one empty line. All columns of the input stay as they are but ``text``
    (and n_chars, if there is one); columns named n_lines or n_dropped are replaced.
    """
    text = text_or_empty()
    own = docs.drop("n_lines", "n_dropped")
    drops = dropped_lines(docs, **options).select(
        *[F.col(c).alias(f"__d_{c}") for c in ("doc_id", "t1", "t2", "places")]
    )
    t1, t2 = text_key(text)
    left = own.withColumns({"__t1": t1, "__t2": t2})
    joined = left.join(
        drops,
        left["doc_id"].eqNullSafe(drops["__d_doc_id"])
        & (left["__t1"] == drops["__d_t1"])
        & (left["__t2"] == drops["__d_t2"]),
        "left",
    ).drop("__t1", "__t2", "__d_doc_id", "__d_t1", "__d_t2")
    split = joined.withColumn("__lines", F.split(text, "\n", -1))
    # The stretches between dropped places, in order: linear in the lines.
    kept = F.expr(
        "array_join(flatten(transform(sequence(0, size(__d_places)), k -> slice(__lines, "
        "if(k = 0, 0, __d_places[k - 1] + 1) + 1, "
        "if(k = size(__d_places), size(__lines), __d_places[k]) "
        "- if(k = 0, 0, __d_places[k - 1] + 1)))), '\\n')"
    )
    out = split.withColumn("text", F.when(F.col("__d_places").isNull(), text).otherwise(kept))
    out = out.withColumns(
        {
            "n_lines": F.size("__lines").cast("long"),
            "n_dropped": F.coalesce(F.size("__d_places"), F.lit(0)).cast("long"),
        }
    )
    if "n_chars" in own.columns:
        out = out.withColumn("n_chars", F.length("text").cast(own.schema["n_chars"].dataType))
    return out.select(*own.columns, "n_lines", "n_dropped")
