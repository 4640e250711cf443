"""What is wrong with files before they are read: one row a file, the job goes on without the bad ones."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import is_small, scratch_path, stored

# Reasons why a file is set apart.
EMPTY = "Archivo vacío"
UNREADABLE = "No se pudo leer completo"
TRUNCATED = "Comprimido truncado o dañado"
UTF_32 = "Codificación UTF-32"
UTF_16 = "Codificación UTF-16"
BINARY = "Contiene bytes nulos (binario o UTF-16 sin marca)"
NOT_UTF_8 = "Codificación distinta de UTF-8"
NO_HEADER = "Sin fila de encabezado"

#: More files than that are inspected and read in batches: Spark's index of a folder lies in the driver, some
#: kilobytes a file, and every scan makes one.
MANY_FILES = 256
BATCH_FILES = 10_000
LISTING_SETTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

#: Cuts compressed bytes into pieces of some 64 KB.
_CUT = b"\n\n"


def _hidden(name: str) -> bool:
    """Names that Spark's sources pass over."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _walk(spark: SparkSession, path: str) -> Iterator[str]:
    """The files below a path or pattern, one after the other, as patterns that match only themselves.

    Folders are listed ``BATCH_FILES`` at a time, and only names leave the JVM. What a path's listing gives back
    as itself is a file.
    """
    jvm = spark.sparkContext._jvm
    texts, root = jvm.org.apache.hadoop.util.StringUtils, jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(statuses) -> list[str]:
        size = len(statuses)
        every = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, size)
        jvm.java.lang.System.arraycopy(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(statuses), 0, every, 0, size)
        return texts.join("\0", jvm.java.util.Arrays.asList(every)).split("\0") if size else []

    def below(asked: list[str]) -> Iterator[str]:
        for at in range(0, len(asked), BATCH_FILES):
            part = asked[at : at + BATCH_FILES]
            found = names(fs.listStatus(texts.stringToPath(texts.getStrings("\0".join(part), "\0"))))
            known, inner = set(part), []
            for name in found:
                if name in known:
                    yield re.sub(r"([{}\[\]*?\\])", r"\\\1", name)
                elif not _hidden(name.rsplit("/", 1)[1]):
                    inner.append(name)
            yield from below(inner)

    found = fs.globStatus(root)
    return below(names(found)) if found else iter(())


@contextmanager
def _few_listings(spark: SparkSession) -> Iterator[None]:
    """While files are read by name, a job that lists them has a few tasks a core, not one a file."""
    given = spark.conf.get(LISTING_SETTING)
    spark.conf.set(LISTING_SETTING, str(min(int(given), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING_SETTING, given)


def by_batches(
    spark: SparkSession, path: str, read: Callable[[list[str]], DataFrame], name: str, few: int
) -> DataFrame | None:
    """What ``read`` gives of the files of a path, stored batch by batch; none if there are only ``few``.

    Spark holds the index of the files of a batch in the driver, not of all.
    """
    files = _walk(spark, path)
    first = list(islice(files, few + 1))
    if len(first) <= few:
        return None
    files, target = chain(first, files), scratch_path(spark, name)
    with _few_listings(spark):
        for batch in iter(lambda: list(islice(files, BATCH_FILES)), []):
            rows = read(batch)
            rows.write.mode("append").parquet(target)
    return spark.read.schema(rows.schema).parquet(target)


def _stream_faults(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files of a task whose compressed stream breaks off or fails its checksum, a piece at a time."""
    now, unpacker, broken, rest = None, None, False, b""

    def feed(data: bytes) -> None:
        nonlocal unpacker, broken, rest
        try:
            while data and not broken:
                if unpacker is None:
                    # A member may begin in the last bytes of a piece.
                    unpacker = zlib.decompressobj(31)
                tail = unpacker.unconsumed_tail
                unpacker.decompress(tail + data, 1 << 24)
                while unpacker.unconsumed_tail and not unpacker.eof:
                    unpacker.decompress(unpacker.unconsumed_tail, 1 << 24)
                data, unpacker = (unpacker.unused_data, None) if unpacker.eof else (b"", unpacker)
        except zlib.error:
            # Zeros behind the last member are padding.
            broken = bool(data.strip(b"\0"))

    def whole() -> bool:
        if unpacker is not None and not broken:
            feed(_CUT)  # the source drops a separator at the very end
        return not broken and unpacker is None

    for batch in batches:
        faults = []
        for file, piece in batch.itertuples(index=False):
            if file != now:
                if now is not None and not whole():
                    faults.append(now)
                now, unpacker, broken = file, None, False
                feed(bytes(piece))
            else:
                feed(_CUT + bytes(piece))
        yield pd.DataFrame({"archivo": faults}, dtype=object)
    if now is not None and not whole():
        yield pd.DataFrame({"archivo": [now]}, dtype=object)


def _broken_streams(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(archivo) of .gz files that cannot be unpacked to their end; they are read as they are stored."""
    reader = spark.read.option("encoding", "ISO-8859-1").option("lineSep", _CUT.decode())
    for prefix in ("", "org.apache.hadoop.shaded."):  # client jars of Spark rename one of the settings
        reader = reader.option(f"{prefix}io.compression.codecs", "org.apache.hadoop.io.compress.PassthroughCodec")
        reader = reader.option(f"{prefix}io.compress.passthrough.extension", ".gz")
    # Only these files are opened, not all of the folder.
    reader = reader.option("pathGlobFilter", "*.gz").option("ignoreCorruptFiles", "true")
    pieces = reader.text(path).filter("_metadata.file_path LIKE '%.gz'")
    return pieces.select(
        F.col("_metadata.file_path").alias("archivo"), F.col("value").cast("binary").alias("piece")
    ).mapInPandas(_stream_faults, "archivo string")


def _listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(archivo, bytes) of every file. Scans pass over empty files, so names come from the index itself."""
    found = spark.read.format("binaryFile").load(path)
    sizes = found.select(F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_size").alias("bytes"))
    key = F.regexp_replace("archivo", "^([^:/]+):/+", "$1:/")  # both ways of writing file:///
    names = spark.createDataFrame([(name,) for name in found.inputFiles()], "archivo string")
    empty = names.withColumn("k", key).join(sizes.select(key.alias("k")), "k", "left_anti")
    return sizes.unionByName(empty.select("archivo", F.lit(0).cast("long").alias("bytes")))


def inspect_files(spark: SparkSession, path: str) -> DataFrame:
    """(archivo, bytes, problema) of every file; ``problema`` is null if it can be read as UTF-8 text.

    Names and sizes come from the index Spark holds of the folder. One scan of the text counts per file, with map-side
    combine, the bytes it yields, lines that are no UTF-8 and lines with null bytes; a file that
    yields less than its size could not be read to its end, whatever the reason, and does not end
    the job. Compressed files are unpacked once more, piece by piece, up to their checksum. Many files
    are inspected batch by batch, and the results stored.
    """
    many = by_batches(spark, path, lambda files: _inspected(spark, files), "inspeccion", MANY_FILES)
    return _inspected(spark, path) if many is None else many


def _inspected(spark: SparkSession, path: str | list[str]) -> DataFrame:
    listed = stored(_listing(spark, path), "indice")
    lines = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", "true").text(path)
    value = F.col("value")
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    seen = (
        lines.select(F.col("_metadata.file_path").alias("archivo"), "value", place.alias("place"))
        .groupBy("archivo")
        .agg(
            F.sum(F.octet_length(value) + 1).alias("leidos"),
            F.count_if(~F.is_valid_utf8(value)).alias("malas"),
            F.count_if(value.contains("\0")).alias("nulas"),
            F.min_by(F.hex(F.substring(value.cast("binary"), 1, 4)), "place").alias("marca"),
        )
    )
    packed = F.col("archivo").endswith(".gz")
    files = listed.join(seen, "archivo", "left")
    if not listed.filter(packed).isEmpty():
        broken = stored(_broken_streams(spark, path).withColumn("rota", F.lit(True)), "rotas")
        files = files.join(F.broadcast(broken) if is_small(broken) else broken, "archivo", "left")
    else:
        files = files.withColumn("rota", F.lit(None).cast("boolean"))
    # The last line may lack its end; the mark of UTF-8, three bytes, is taken off by the source.
    lost = F.col("bytes") - F.coalesce("leidos", F.lit(0))
    compressed = F.col("archivo").rlike(r"\.(gz|bz2|deflate|lz4|snappy|zst)$")
    mark = F.col("marca")
    problem = (
        F.when(F.col("bytes") == 0, EMPTY)
        .when(F.col("rota"), TRUNCATED)
        .when(~compressed & ~lost.isin(-1, 0, 2, 3), UNREADABLE)
        .when(mark.startswith("FFFE0000") | mark.startswith("0000FEFF"), UTF_32)
        .when(mark.startswith("FFFE") | mark.startswith("FEFF"), UTF_16)
        .when(F.col("nulas") > 0, BINARY)
        .when(F.col("malas") > 0, NOT_UTF_8)
    )
    return files.select("archivo", "bytes", problem.alias("problema"))
