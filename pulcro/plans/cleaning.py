"""Cleaning of a table: chosen steps in a fixed order, one lazily built plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import country as countries
from ..functions import dates as calendar
from ..functions import text
from ..operators import rows
from ..operators.columns import as_text, column, text_columns

#: Stands for every text column where a step takes a column.
ALL_TEXT = "*"

UPPER, LOWER = "upper", "lower"


@dataclass(frozen=True)
class Replacement:
    find: str
    new: str
    column: str = ALL_TEXT
    exact: bool = True


@dataclass(frozen=True)
class CleaningPlan:
    """Steps run in the order of the fields, whatever order they are given in.

    Columns are named as in the input, also in steps that run after ``clean_names``.
    """

    keep: tuple[str, Sequence] | None = None
    drop: Sequence[str] = ()
    clean_names: bool = False
    clean_text: bool = False
    upper: bool = False
    lower: bool = False
    fill: str | None = None
    country: str | None = None
    country_output: str = "pais_codigo"
    split_name: str | None = None
    split_outputs: tuple[str, str] = ("nombre", "apellido")
    dates: str | None = None
    date_format: str = calendar.DEFAULT_TARGET
    date_preset: str = calendar.DEFAULT
    replace: Replacement | None = None
    #: Columns that identify rows: never renamed, filled or rewritten.
    untouched: Sequence[str] = field(default=("fila",))

    def __post_init__(self):
        if self.upper and self.lower:
            raise ValueError("upper and lower case exclude each other")

    def filtered(self, df: DataFrame) -> DataFrame:
        return rows.keep_values(df, *self.keep) if self.keep else df

    def apply(self, df: DataFrame) -> DataFrame:
        """The cleaned table."""
        df = rows.drop_columns(self.filtered(df), self.drop)
        renamed = {name: name for name in df.columns}
        if self.clean_names:
            free = [n for n in df.columns if n not in self.untouched]
            renamed.update(zip(free, rows.clean_names(free, df, self.untouched)))
            df = df.toDF(*[renamed[n] for n in df.columns])

        def current(name: str) -> str:
            if name not in renamed:
                raise ValueError(f"unknown column: {name}")
            return renamed[name]

        def texts() -> list[str]:
            return [n for n in text_columns(df) if n not in self.untouched]

        names = texts()
        if self.clean_text:
            df = _each(df, names, text.clean_text)
        if self.upper or self.lower:
            df = _each(df, names, F.upper if self.upper else F.lower)
        if self.fill is not None:
            df = rows.fill_nulls(df, self.fill, skip=self.untouched)
        if self.country:
            df = countries.with_country_code(df, current(self.country), self.country_output)
        if self.split_name:
            whole = as_text(df, current(self.split_name))
            first, rest = self.split_outputs
            df = df.withColumns({first: text.first_word(whole), rest: text.other_words(whole)})
        if self.dates:
            chosen = texts() if self.dates == ALL_TEXT else [current(self.dates)]
            df = calendar.standardise(df, chosen, self.date_format, self.date_preset)
        if self.replace and self.replace.find:
            change = self.replace
            chosen = texts() if change.column == ALL_TEXT else [current(change.column)]
            df = rows.replace_values(df, change.find, change.new, chosen, change.exact)
        return df

    def impact(self, df: DataFrame) -> DataFrame:
        """Rows and columns before (after the filter) and after the plan."""
        return rows.impact(self.filtered(df), self.apply(df))


def _each(df: DataFrame, names: Sequence[str], function) -> DataFrame:
    return df.withColumns({n: function(column(df, n)) for n in names}) if names else df
