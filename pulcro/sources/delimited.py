"""Delimited text, every column as text."""

from __future__ import annotations

import csv
from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions import unicode_tables as U
from ..session import is_small, materialise, stored
from . import inspection
from .numbering import number_across_files, number_lines

#: Records that are numbered together.
BLOCK = 65_536
#: The lines of more files than that are stored once: opening many small files takes longer than reading them.
MANY_FILES = inspection.MANY_FILES


@dataclass(frozen=True)
class Delimited:
    """``rows``: fila and the text columns. ``bad``: fila, registro of records with too many fields or
    with quotes that are never closed."""

    rows: DataFrame
    bad: DataFrame

    def bad_count(self) -> DataFrame:
        return self.bad.agg(F.count(F.lit(1)).alias("malos"))


@dataclass(frozen=True)
class FilesRead(Delimited):
    """Also ``files``: archivo, bytes, filas (records read, bad ones included) and, for files that
    were set apart, problema."""

    files: DataFrame


def column_names(header: Sequence[str | None]) -> list[str]:
    """Names from header cells: empty ones are numbered, repeated ones get a suffix."""
    names: list[str] = []
    seen: dict[str, int] = {}
    for position, cell in enumerate(header):
        base = cell if cell not in (None, "") else f"Unnamed: {position}"
        name = base
        while name in names:
            seen[base] = seen.get(base, 0) + 1
            name = f"{base}.{seen[base]}"
        names.append(name)
    return names


def _field_count(record: Column, separator: str) -> Column:
    unquoted = F.regexp_replace(record, '"(?:[^"]|"")*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(separator), F.lit(""))) + 1


def _quote_states(line: Column, separator: str) -> tuple[Column, Column]:
    """Whether a line ends inside quotes if it starts outside, and if it starts inside them.

    A quote opens only at the start of a field: an inch mark in a plain field is a character like
    any other.
    """
    s = "\\" + separator
    inner = '[^"]*+(?:""[^"]*+)*+'  # inside quotes, up to the one that closes
    fields = f'(?:(?:"{inner}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+'
    opened = f'{fields}"{inner}'
    plain = ~line.contains('"')
    outside = ~plain & line.rlike(f"(?s)^{opened}$")
    inside = plain | line.rlike(f'(?s)^(?:{inner}|{inner}"[^{s}]*+{s}{opened})$')
    return outside, inside


def _tidy(rows: DataFrame, names: Sequence[str], null_tokens: bool) -> DataFrame:
    cells = [F.col(f"c{i}") for i in range(len(names))]
    if null_tokens:
        cells = [text.null_tokens_to_null(c) for c in cells]
    return rows.select("fila", *[c.alias(name) for c, name in zip(cells, names)])


def _split_records(rows: DataFrame, names: Sequence[str], separator: str, null_tokens: bool):
    """Splits rows of (fila, registro, rota) into cells; odd records keep their raw text."""
    width = len(names)
    schema = ", ".join(f"c{i} string" for i in range(width)) + ", __registro string"
    options = {
        "sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "__registro",
    }
    # A generator, so that the filters on the parsed record do not parse it once more.
    raw = F.when(F.col("rota"), F.col("registro")).alias("__rota")
    parsed = rows.select("fila", raw, F.inline(F.array(F.from_csv("registro", schema, options))))
    return _separate(parsed, names, separator, null_tokens)


def _separate(parsed: DataFrame, names, separator: str, null_tokens: bool) -> Delimited:
    """A short record is padded with nulls and fine; one with too many fields, or left open, is bad."""
    raw = F.col("__registro")
    is_bad = F.col("__rota").isNotNull() | (raw.isNotNull() & (_field_count(raw, separator) > len(names)))
    return Delimited(
        rows=_tidy(parsed.filter(~is_bad), names, null_tokens),
        bad=parsed.filter(is_bad).select("fila", F.coalesce("__rota", raw).alias("registro")),
    )


def _running(rows: DataFrame, value: str, output: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the file up to each one.

    Rows are summed inside their split or block (``bloque``), in the order of ``orden``, and the
    sums of the ones before are added: no window holds a file.
    """
    within = Window.partitionBy("archivo", "bloque").orderBy("orden")
    across = Window.partitionBy("archivo").orderBy("bloque")
    before = F.sum("__n").over(across.rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.groupBy("archivo", "bloque").agg(F.sum(value).alias("__n"))
    sums = sums.withColumn("__antes", F.coalesce(before, F.lit(0))).drop("__n")
    inside = F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("__dentro", inside)
        .join(sums, ["archivo", "bloque"])
        .withColumn(output, F.col("__dentro") + F.col("__antes"))
        .drop("__dentro", "__antes")
    )


def _with_states(lines: DataFrame, separator: str) -> DataFrame:
    """Adds whether quotes are open before each line (``open``) and after it (``after``), 0 or 1.

    A line keeps the state, turns it round, or sets it, whatever it was. So the state at a line
    follows from the last line that sets it and the number of turns since, first inside each split,
    then from the start state of the split, which follows from the splits before in the same way.
    """
    outside, inside = _quote_states(F.col("registro"), separator)
    marked = lines.select("archivo", "bloque", "orden", "registro", outside.alias("o"), inside.alias("i"))
    marked = marked.withColumns(
        {"turn": (F.col("o") & ~F.col("i")).cast("int"), "fixed": F.when(F.col("o") == F.col("i"), F.col("o").cast("int"))}
    )

    def state(window, start: Column) -> Column:
        """State before each row of a window over rows with turn and fixed, from its start state."""
        past = window.rowsBetween(Window.unboundedPreceding, -1)
        turns = F.coalesce(F.sum("turn").over(past), F.lit(0))
        last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", F.col("turns").alias("t"))), True).over(past)
        value = F.when(last.isNotNull(), last["fixed"] + turns - last["t"]).otherwise(start + turns)
        return value % 2

    split = Window.partitionBy("archivo", "bloque").orderBy("orden")
    file = Window.partitionBy("archivo").orderBy("bloque")
    upto = split.rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("turns", F.sum("turn").over(upto))
    # What a whole split does to the state: the last set value and the turns after it, or its turns.
    ends = marked.groupBy("archivo", "bloque").agg(
        F.max_by(F.struct("fixed", "turns"), F.when(F.col("fixed").isNotNull(), F.col("orden"))).alias("set"),
        F.sum("turn").alias("all"),
    )
    ends = ends.select(
        "archivo", "bloque",
        F.when(F.col("set").isNotNull(), (F.col("set.fixed") + F.col("all") - F.col("set.turns")) % 2).alias("fixed"),
        F.when(F.col("set").isNotNull(), 0).otherwise(F.col("all")).alias("turn"),
    )
    ends = ends.withColumn("turns", F.sum("turn").over(file.rowsBetween(Window.unboundedPreceding, 0)))
    starts = ends.select("archivo", "bloque", state(file, F.lit(0)).alias("start"))
    known = marked.join(starts, ["archivo", "bloque"]).withColumn("open", state(split, F.col("start")))
    after = F.when(F.col("open") == 0, F.col("o")).otherwise(F.col("i")).cast("int")
    return known.select("archivo", "bloque", "orden", "registro", "open", after.alias("after"))


def _recovered(lines: DataFrame, separator: str) -> DataFrame:
    """(archivo, bloque, orden, registro, begins, rota): where records begin, whatever is never closed.

    If a file ends inside quotes, the line with which its last record begins is a record of its own
    (``rota``), and the lines after it are read anew from outside quotes, until no file ends inside
    them. Each round looks only at the lines behind the last failure, of files that have one.
    """
    parts = []
    columns = ["archivo", "bloque", "orden", "registro"]
    begins = F.col("open") == 0
    while True:
        known = _with_states(lines, separator)
        ends = known.groupBy("archivo").agg(
            F.max_by("after", "orden").alias("after"), F.max(F.when(begins, F.col("orden"))).alias("abre")
        )
        left_open = materialise(ends.filter("after = 1").select("archivo", "abre"))
        known = known.select(*columns, begins.cast("int").alias("begins"))
        if left_open.isEmpty():
            parts.append(known.withColumn("rota", F.lit(False)))
            break
        side = F.broadcast(left_open) if is_small(left_open) else left_open
        known = known.join(side, "archivo", "left")
        upto = known.filter("abre IS NULL OR orden <= abre")
        parts.append(upto.select(*columns, "begins", F.col("orden").eqNullSafe(F.col("abre")).alias("rota")))
        lines = materialise(known.filter("orden > abre").select(*columns))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def _join_records(lines: DataFrame, separator: str) -> DataFrame:
    """(archivo, registro_n, registro, rota) from lines of files with line breaks inside quotes."""
    numbered = _running(_recovered(lines, separator), "begins", "registro_n")
    joined = numbered.groupBy("archivo", (F.col("registro_n") - 1).alias("registro_n")).agg(
        F.sort_array(F.collect_list(F.struct("bloque", "orden", "registro"))).alias("p"), F.max("rota").alias("rota")
    )
    whole = F.array_join(F.transform("p", lambda x: x["registro"]), "\n")
    return joined.select("archivo", "registro_n", whole.alias("registro"), "rota")


def _headers(first: DataFrame, separator: str) -> dict[tuple[str, ...], list[str]]:
    """Column names -> the header records that give them; one record per distinct header."""
    found: dict[tuple[str, ...], list[str]] = {}
    for row in first.select("registro").distinct().orderBy("registro").collect():
        cells = next(csv.reader([row["registro"].removeprefix("\ufeff")], delimiter=separator))
        found.setdefault(tuple(column_names(cells)), []).append(row["registro"])
    return found


def read_delimited(
    spark: SparkSession,
    path: str,
    header_row: int = 0,
    skip_rows: Collection[int] = (),
    separator: str = ",",
    null_tokens: bool = True,
) -> Delimited:
    """Reads one or many files, each by its own header.

    ``skip_rows`` are record numbers of a file, from zero; blank records are skipped, and
    ``header_row`` counts what remains. A field that opens a quote and never closes it makes its
    record's first line bad; the lines after it are read as records again. Files are split by line and read in parallel, also where
    records hold line breaks: only the files that have a field open at the end of some line are put
    together from lines, in their splits. Columns are matched by name; a column that a file does
    not have is null in its rows. Line breaks inside quotes are read as ``\\n``.
    """
    return _read(_lines(spark, spark.read, path), header_row, skip_rows, separator, null_tokens)[0]


def read_delimited_files(
    spark: SparkSession,
    path: str,
    header_row: int = 0,
    skip_rows: Collection[int] = (),
    separator: str = ",",
    null_tokens: bool = True,
) -> FilesRead:
    """``read_delimited`` of those files that can be read; the others are reported, one row each.

    Files are inspected first (``inspection``): empty, unreadable, truncated or wrongly encoded ones
    are set apart and the rest is read. A file without the header row is reported too. An error is
    raised only if no file has one.
    """
    seen = stored(inspection.inspect_files(spark, path), "archivos")
    apart = materialise(seen.filter(F.col("problema").isNotNull()).select("archivo"))
    lines = _lines(spark, spark.read.option("ignoreCorruptFiles", "true"), path)
    apart = None if apart.isEmpty() else apart
    read, headed, counts = _read(lines, header_row, skip_rows, separator, null_tokens, apart)
    headed = headed.withColumn("__cabeza", F.lit(True))
    problem = F.coalesce("problema", F.when(F.col("__cabeza").isNull(), inspection.NO_HEADER))
    files = seen.join(headed, "archivo", "left").join(counts, "archivo", "left")
    files = files.select("archivo", "bytes", F.coalesce("n", F.lit(0)).alias("filas"), problem.alias("problema"))
    return FilesRead(read.rows, read.bad, files)


def _lines(spark: SparkSession, reader: DataFrameReader, path: str) -> DataFrame:
    """The lines with their file and the split they are read from.

    Every later pass reads them anew, so the lines of many files are stored, batch by batch: opening many
    small files takes longer than reading them. A task writes the lines of a split one after the other; what
    is read back of them by one task is then a split by itself.
    """
    many = inspection.by_batches(spark, path, lambda files: _placed(reader.text(files)), "lineas", MANY_FILES)
    if many is None:
        return _placed(reader.text(path))
    place = F.struct("bloque", F.col("_metadata.file_block_start").alias("parte"))
    return many.select("registro", "archivo", place.alias("bloque"))


def _placed(read: DataFrame) -> DataFrame:
    return read.select(
        F.col("value").alias("registro"),
        F.col("_metadata.file_path").alias("archivo"),
        F.col("_metadata.file_block_start").alias("bloque"),
    )


def _read(
    lines: DataFrame, header_row: int, skip_rows: Collection[int], separator: str, null_tokens: bool,
    apart: DataFrame | None = None,
) -> tuple[Delimited, DataFrame, DataFrame]:
    """The table, the files that have a header (archivo), and records per file (archivo, n).

    Lines are numbered in the order of their split, so files that are set ``apart`` go afterwards: they
    may be too many for a broadcast.
    """
    bad_files = None if apart is None else F.broadcast(apart) if is_small(apart) else apart

    def good(df: DataFrame) -> DataFrame:
        return df if bad_files is None else df.join(bad_files, "archivo", "left_anti")

    opens, _ = _quote_states(F.col("registro"), separator)
    filled = F.col("registro").rlike(U.NOT_SPACE)
    kept = filled & ~F.col("registro_n").isin(*skip_rows) if skip_rows else filled
    tests = {"abiertas": opens, "vacias": ~filled}
    numbered = number_lines(lines, F.lit(True), "registro_n", tests)
    files = good(numbered.files)
    seen = files.agg(F.sum("abiertas").alias("abiertas"), F.sum("vacias").alias("vacias")).first()
    if skip_rows or seen["vacias"]:
        again = numbered.lines if skip_rows else lines
        placed = number_lines(again, kept, "pos").lines.select("archivo", "pos", "registro")
    else:
        placed = numbered.lines.select("archivo", F.col("registro_n").alias("pos"), "registro")
    placed = good(placed).withColumn("rota", F.lit(False))
    if seen["abiertas"]:
        several = materialise(files.filter("abiertas > 0").select("archivo"))
        several = F.broadcast(several) if is_small(several) else several
        apart = numbered.lines.withColumnRenamed("registro_n", "orden").join(several, "archivo", "left_semi")
        # Stored: header, counts and rows read them, and finding them takes several shuffles.
        joined = materialise(_join_records(apart, separator).filter(kept))
        joined = joined.withColumns(
            {"bloque": F.floor(F.col("registro_n") / BLOCK), "orden": F.col("registro_n"), "__uno": F.lit(1)}
        )
        joined = _running(joined, "__uno", "pos").select("archivo", F.col("pos") - 1, "registro", "rota")
        placed = placed.join(several, "archivo", "left_anti").union(joined)
    first = materialise(placed.filter(F.col("pos") == header_row).select("archivo", "registro"))
    headers = _headers(first, separator)
    if not headers:
        raise ValueError(f"no header in row {header_row}")
    data = placed.filter(F.col("pos") > header_row).withColumn("pos", F.col("pos") - header_row - 1)
    counts = data.groupBy("archivo").agg(F.count(F.lit(1)).alias("n"))
    rows = number_across_files(data, "archivo", "pos", counts, "fila", keep_file=len(headers) > 1)
    parts = []
    for names, records in headers.items():
        own = rows
        if len(headers) > 1:
            these = first.filter(F.col("registro").isin(*records)).select("archivo")
            these = F.broadcast(these) if is_small(these) else these
            own = rows.join(these, "archivo", "left_semi").select("fila", "registro", "rota")
        parts.append(_split_records(own, names, separator, null_tokens))
    every, bad = parts[0].rows, parts[0].bad
    for part in parts[1:]:
        every = every.unionByName(part.rows, allowMissingColumns=True)
        bad = bad.unionByName(part.bad)
    return Delimited(every, bad), first.select("archivo"), counts


def is_empty(table: Delimited) -> bool:
    """Whether a file was read but holds no rows."""
    return table.rows.isEmpty()
