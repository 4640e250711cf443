"""Workbooks (.xlsx): many files read in parallel, each cell as text.

One task reads one workbook; the format itself bounds a sheet to 1,048,576 rows. Rows leave the
task in batches.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import sys
import zipfile
from collections.abc import Collection, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import materialise
from .delimited import column_names
from .numbering import number_across_files

CELLS = (
    "path string, sheet_index int, sheet string, row_no int, cells array<string>, error string"
)
BATCH = 5_000

# Built-in number formats that show dates or times. Fixed values.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _children(node, name: str):
    return [child for child in node.iter() if _local(child.tag) == name]


def _xml(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in the order of the workbook."""
    links = _xml(archive, "xl/_rels/workbook.xml.rels")
    targets = {r.get("Id"): r.get("Target") for r in _children(links, "Relationship")}
    found = []
    for sheet in _children(_xml(archive, "xl/workbook.xml"), "sheet"):
        link = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
        target = targets[link]
        part = target.lstrip("/") if target.startswith("/") else "xl/" + target
        found.append((sheet.get("name"), part))
    return found


def _text_runs(node) -> str:
    """Text of a string item, without its phonetic hints."""
    pieces = []
    for child in node:
        if _local(child.tag) == "t":
            pieces.append(child.text or "")
        elif _local(child.tag) == "r":
            pieces += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(pieces)


def _shared_texts(archive: zipfile.ZipFile) -> list[str]:
    root = _xml(archive, "xl/sharedStrings.xml")
    return [] if root is None else [_text_runs(n) for n in root if _local(n.tag) == "si"]


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date or time."""
    root = _xml(archive, "xl/styles.xml")
    if root is None:
        return set()
    codes = {int(n.get("numFmtId")): n.get("formatCode") or "" for n in _children(root, "numFmt")}

    def shows_date(number: int) -> bool:
        if number in codes:
            plain = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", codes[number].lower())
            return plain != "general" and bool(re.search("[dmyhs]", plain))
        return number in DATE_FORMATS

    formats = next((n for n in root if _local(n.tag) == "cellXfs"), ())
    return {i for i, xf in enumerate(formats) if shows_date(int(xf.get("numFmtId", 0)))}


def _moment(serial: float, since_1904: bool) -> str:
    if 0 <= serial < 1:
        seconds = round(serial * 86400)
        return str((dt.datetime(1900, 1, 1) + dt.timedelta(seconds=seconds)).time())
    base = dt.datetime(1904, 1, 1) if since_1904 else dt.datetime(1899, 12, 30)
    if not since_1904 and serial < 60:
        serial += 1
    return str(base + dt.timedelta(days=int(serial), seconds=round(serial % 1 * 86400)))


def _number(raw: str) -> str:
    value = float(raw)
    return str(int(value)) if value.is_integer() and abs(value) < 1e300 else repr(value)


def _cell_text(cell, shared: list[str], dates: set[int], since_1904: bool) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = next((n for n in cell if _local(n.tag) == "is"), None)
        return None if inline is None else _text_runs(inline)
    value = next((n.text for n in cell if _local(n.tag) == "v"), None)
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind in ("str", "d"):
        return value
    if int(cell.get("s", 0)) in dates:
        return _moment(float(value), since_1904)
    return _number(value)


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _sheet_rows(archive, part: str, shared, dates, since_1904) -> Iterator[tuple[int, list]]:
    """(row number, cells), rows left out of the file included as empty ones."""
    expected = 0
    with archive.open(part) as stream:
        for _, node in ElementTree.iterparse(stream):
            if _local(node.tag) != "row":
                continue
            number = int(node.get("r", expected + 1)) - 1
            for missing in range(expected, number):
                yield missing, []
            cells: list[str | None] = []
            for cell in node:
                at = _column_index(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                cells.append(_cell_text(cell, shared, dates, since_1904))
            yield number, cells
            expected = number + 1
            node.clear()


def _read_one(path: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared, dates = _shared_texts(archive), _date_styles(archive)
        setup = _children(_xml(archive, "xl/workbook.xml"), "workbookPr")
        since_1904 = any(n.get("date1904") in ("1", "true") for n in setup)
        for index, (name, part) in enumerate(_sheets(archive)):
            empty = True
            for number, cells in _sheet_rows(archive, part, shared, dates, since_1904):
                empty = False
                yield path, index, name, number, cells, None
            if empty:
                yield path, index, name, None, None, None


def _read_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "sheet_index", "sheet", "row_no", "cells", "error"]
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            rows = []
            try:
                for row in _read_one(path, content):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=names, dtype=object)
                        rows = []
            except Exception as error:  # a broken file is reported, the others go on
                rows.append((path, None, None, None, None, f"{type(error).__name__}: {error}"))
            if rows:
                yield pd.DataFrame(rows, columns=names, dtype=object)


def workbook_cells(files: DataFrame) -> DataFrame:
    """All cells of all workbooks of a table (path, content), one row per sheet row.

    A file that cannot be read yields one row with its ``error``.
    """
    # Ships this module with the job, so executors need no installation of it.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return files.select("path", "content").mapInPandas(_read_batches, CELLS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the workbooks below a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)


def list_sheets(cells: DataFrame) -> DataFrame:
    """path, sheet_index, sheet of every sheet."""
    return (
        cells.filter("error is null")
        .groupBy("path", "sheet_index")
        .agg(F.first("sheet").alias("sheet"))
    )


def read_errors(cells: DataFrame) -> DataFrame:
    """path, error of the files that could not be read."""
    return cells.filter("error is not null").select("path", "error")


def sheet_table(
    cells: DataFrame,
    sheet: str | None = None,
    header_row: int = 0,
    skip_rows: Collection[int] = (),
    null_tokens: bool = True,
) -> DataFrame:
    """Rows of one sheet of every workbook as a text table with ``fila``.

    Without a name the first sheet is taken. The header of the first file names the columns.
    """
    chosen = F.col("sheet") == sheet if sheet is not None else F.col("sheet_index") == 0
    rows = cells.filter(chosen & F.col("row_no").isNotNull()).select("path", "row_no", "cells")
    skipped = sorted(set(skip_rows))
    if skipped:
        rows = rows.filter(~F.col("row_no").isin(*skipped))
        before = F.lit(0)
        for number in skipped:
            before = before + (F.col("row_no") > number).cast("int")
        rows = rows.withColumn("row_no", F.col("row_no") - before)
    rows = materialise(rows)
    first = rows.filter(F.col("row_no") == header_row).orderBy("path").limit(1).collect()
    if not first:
        raise ValueError(f"no header in row {header_row}")
    names = column_names(first[0]["cells"])
    data = rows.filter(F.col("row_no") > header_row).withColumn(
        "row_no", (F.col("row_no") - header_row - 1).cast("long")
    )
    counts = data.groupBy("path").agg((F.max("row_no") + 1).alias("n"))
    numbered = number_across_files(data, "path", "row_no", counts, "fila")
    values = [F.get("cells", F.lit(i)) for i in range(len(names))]
    if null_tokens:
        values = [text.null_tokens_to_null(v) for v in values]
    return numbered.select("fila", *[v.alias(n) for v, n in zip(values, names)])
