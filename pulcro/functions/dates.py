"""Free-form dates to one text format.

Each accepted shape is rewritten by one anchored regular expression to ``year, month, day, swap``;
the calendar is then checked by arithmetic. No date parser runs on values that are not dates, so a
column of arbitrary text raises no exception inside the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

# Target formats by their display names: order of the parts and separator. Fixed values.
TARGETS = {
    "DD/MM/YYYY": ("dmy", "/"),
    "MM/DD/YYYY": ("mdy", "/"),
    "YYYY-MM-DD": ("ymd", "-"),
    "DD-MM-YYYY": ("dmy", "-"),
    "YYYY/MM/DD": ("ymd", "/"),
}
DEFAULT_TARGET = "DD/MM/YYYY"

#: Reads ISO dates as year-month-day.
DEFAULT = "default"
#: Day first wherever both readings are possible, in ISO dates too; also bare years and quarters.
DAYFIRST_COMPAT = "dayfirst_compat"

#: First of the hundred years that two-digit years stand for.
CENTURY_START = 1976

# Range of nanosecond timestamps as yyyymmdd; dates beyond it stay unrecognised. Fixed values.
FIRST_DATE, LAST_DATE = 16770922, 22620411

# English month names. Fixed values.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

_MARK = "\x01"
_NAME = "|".join(sorted({m[:3] for m in MONTHS} | set(MONTHS) | {"sept"}, key=len, reverse=True))
_WEEKDAY = "(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?,? +"
_TIME = (
    r"(?:[t ] *[0-2]?\d:[0-5]\d(?::[0-5]\d(?:\.\d+)?)?(?: *[ap]m)?"
    r"(?: *(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?)?"
)
_SEP = r" *[/.\- ] *"
_TH = "(?:st|nd|rd|th)?"


def _shapes(preset: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(shape, rewrite) pairs of values that start with a digit, and with a month name.

    A rewrite lists year, month, day and whether the last two may swap.
    """
    year_first = "$1,$3,$2,1" if preset == DAYFIRST_COMPAT else "$1,$2,$3,1"
    digit_first = [
        (rf"(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}}|\d{{2}}){_TIME}", "$3,$2,$1,1"),
        (rf"(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}}){_TIME}", year_first),
        (rf"(\d{{4}})(\d{{2}})(\d{{2}}){_TIME}", "$1,$2,$3,0"),
        (
            rf"(\d{{1,2}}){_TH}[ \-./,]*({_NAME})\.?[ \-./,]*(\d{{4}}|\d{{2}}){_TIME}",
            "$3,$2,$1,0",
        ),
        (r"(\d{4})[/.\-](\d{1,2})", "$1,$2,1,0"),
        (r"(\d{1,2})[/.\-](\d{4})", "$2,$1,1,0"),
    ]
    if preset == DAYFIRST_COMPAT:
        digit_first.append((r"(\d{4})", "$1,1,1,0"))
        digit_first += [(rf"(\d{{4}})-?q{n}", f"$1,{3 * n - 2},1,0") for n in (1, 2, 3, 4)]
    name_first = [
        (rf"({_NAME})\.?[ \-./]*(\d{{1,2}}){_TH}(?:, *| +)(\d{{4}}){_TIME}", "$3,$1,$2,0"),
        (rf"({_NAME})\.?[ \-./,]*(\d{{4}})", "$2,$1,1,0"),
    ]
    return digit_first, name_first


def _rewrite(t: Column, shapes: list[tuple[str, str]]) -> Column:
    """Mark-separated parts by the first shape that fits; null when none does."""
    chain = None
    for body, new in shapes:
        shape = rf"(?i)^{body}\z"
        parts = F.regexp_replace(t, shape, new.replace(",", _MARK))
        chain = (F if chain is None else chain).when(t.rlike(shape), parts)
    return chain


def _is_date(year: Column, month: Column, day: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = (
        F.when(month.isin(4, 6, 9, 11), 30)
        .when(month == 2, F.when(leap, 29).otherwise(28))
        .otherwise(31)
    )
    return (
        month.between(1, 12)
        & day.between(1, last)
        & (year * 10000 + month * 100 + day).between(FIRST_DATE, LAST_DATE)
    )


def _year(digits: Column) -> Column:
    number = digits.try_cast("int")
    short = F.pmod(number - CENTURY_START % 100, F.lit(100)) + CENTURY_START
    return F.when(F.length(digits) == 2, short).otherwise(number)


def _month(token: Column) -> Column:
    names = F.lit("".join(m[:3] for m in MONTHS))
    named = ((F.instr(names, F.lower(F.substring(token, 1, 3))) + 2) / 3).cast("int")
    return F.when(token.rlike(r"^\d"), token.try_cast("int")).otherwise(named)


def _with_parsed(df: DataFrame, columns: list[str], preset: str) -> tuple[DataFrame, list[str]]:
    """Adds, for each column, the date in its values as eight digits (``__fecha_n_i``), null where there is none.

    Every step is a projection of its own, so nothing is computed twice per value. Also returns the
    columns that were added.
    """
    if preset not in (DEFAULT, DAYFIRST_COMPAT):
        raise ValueError(f"unknown date preset: {preset}")
    digit_first, name_first = _shapes(preset)
    steps: list[dict[str, Column]] = [{} for _ in range(4)]
    helpers: list[str] = []
    for i, name in enumerate(columns):
        value = F.col(f"`{name}`").cast("string")
        names = [f"__fecha_{part}_{i}" for part in ("texto", "partes", "a", "m", "d", "n")]
        helpers += names
        t, found, year, month, day, _ = map(F.col, names)
        steps[0][names[0]] = F.regexp_replace(text.strip(value), _WEEKDAY, "")
        steps[1][names[1]] = F.split(
            F.when(t.rlike(r"^\d"), _rewrite(t, digit_first)).otherwise(_rewrite(t, name_first)),
            _MARK,
        )
        steps[2][names[2]] = _year(F.get(found, 0))
        steps[2][names[3]] = _month(F.get(found, 1))
        steps[2][names[4]] = F.get(found, 2).try_cast("int")
        may_swap = F.get(found, 3) == "1"
        steps[3][names[5]] = (
            F.when(_is_date(year, month, day), year * 10000 + month * 100 + day)
            .when(may_swap & _is_date(year, day, month), year * 10000 + day * 100 + month)
            .cast("string")
        )
    for step in steps:
        df = df.withColumns(step)
    return df, helpers


def _formatted(value: Column, number: Column, target: str) -> Column:
    """The date in the target format; values without a date stay as they are."""
    order, separator = TARGETS.get(target, TARGETS[DEFAULT_TARGET])
    pieces = {
        "y": F.substring(number, 1, 4),
        "m": F.substring(number, 5, 2),
        "d": F.substring(number, 7, 2),
    }
    written = F.concat_ws(separator, *[pieces[part] for part in order])
    return F.when(number.isNotNull(), written).otherwise(value)


def standardise(
    df: DataFrame, columns: Iterable[str], target: str = DEFAULT_TARGET, preset: str = DEFAULT
) -> DataFrame:
    """Rewrites the dates of the columns; values that are not dates stay as they are."""
    columns = list(columns)
    if not columns:
        return df
    parsed, helpers = _with_parsed(df, columns, preset)
    values = [F.col(f"`{name}`").cast("string") for name in columns]
    written = {name: _formatted(v, F.col(f"__fecha_n_{i}"), target) for i, (name, v) in enumerate(zip(columns, values))}
    return parsed.withColumns(written).drop(*helpers)


def to_formats(df: DataFrame, column: str, outputs: Mapping[str, str], preset: str = DEFAULT) -> DataFrame:
    """Adds the dates of a column in several formats, ``outputs``: new column -> format; parsed once."""
    parsed, helpers = _with_parsed(df, [column], preset)
    value, number = F.col(f"`{column}`").cast("string"), F.col("__fecha_n_0")
    return parsed.withColumns({name: _formatted(value, number, target) for name, target in outputs.items()}).drop(*helpers)
