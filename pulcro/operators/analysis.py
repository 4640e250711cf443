"""Rule analysis of a table: category of every row and column, counts, rates and error rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import TEXT, apply_rules, check_parameter, get_rule
from .columns import as_text, column, compute_once

# Category of a row that breaks no rule, and the two shares of the overall result. Fixed values.
CORRECT = "Correcto"
GOOD = "Bueno"
BAD = "Malo"


@dataclass(frozen=True)
class Checked:
    """One analysed column: its name, its rules in order and the column holding its category."""

    name: str
    rules: tuple[tuple[str, object], ...]
    category: str


def percentage(part: Column, whole: Column, decimals: int = 2) -> Column:
    return F.when(whole > 0, F.bround(part / whole * 100, decimals)).otherwise(F.lit(0.0))


def _compile(
    df: DataFrame, assignments: Mapping[str, Sequence[str]], parameters: Mapping
) -> tuple[list[Checked], list[tuple[str, str]]]:
    """Checked columns, and (column, error) of those that cannot be analysed."""
    checked, problems = [], []
    for name, rule_names in assignments.items():
        try:
            as_text(df, name)
            rules = []
            for rule_name in dict.fromkeys(rule_names):
                rule = get_rule(rule_name)
                parameter = check_parameter(rule, parameters.get((name, rule_name)))
                if rule.parameter == TEXT and parameter is None:
                    continue
                rules.append((rule_name, parameter))
        except (ValueError, TypeError) as error:
            problems.append((name, str(error)))
            continue
        if rules:
            checked.append(Checked(name, tuple(rules), f"__categoria_{len(checked)}"))
    return checked, problems


class Analysis:
    """Analysis of the rows of ``df`` by an assignment column -> rule names, in order.

    ``parameters`` maps (column, rule) to the text or number of the rule. A column that cannot be
    analysed does not stop the others; see ``problems``. All counts come from one aggregation over
    one scan. ``df`` is expected to be filtered already: percentages refer to the rows given.
    """

    def __init__(
        self,
        df: DataFrame,
        assignments: Mapping[str, Sequence[str]],
        parameters: Mapping[tuple[str, str], object] | None = None,
        null_as_text: str | None = None,
    ):
        self.source = df
        self.columns, self._problems = _compile(df, assignments, parameters or {})
        self._null_as_text = null_as_text

    @cached_property
    def rows(self) -> DataFrame:
        """The rows with one category column per analysed column."""
        df = self.source
        flags = {
            (c.name, rule): f"__marca_{i}_{j}"
            for i, c in enumerate(self.columns)
            for j, (rule, _) in enumerate(c.rules)
        }
        rules = {c.name: list(c.rules) for c in self.columns}
        flagged = apply_rules(df, rules, flags, self._null_as_text)
        categories = [
            F.coalesce(
                *[F.when(F.col(flags[(c.name, rule)]), F.lit(rule)) for rule, _ in c.rules],
                F.lit(CORRECT),
            ).alias(c.category)
            for c in self.columns
        ]
        return flagged.select(*[column(df, name) for name in df.columns], *categories)

    @property
    def any_error(self) -> Column:
        bad = F.lit(False)
        for c in self.columns:
            bad = bad | (F.col(c.category) != CORRECT)
        return bad

    def problems(self) -> DataFrame:
        return self.source.sparkSession.createDataFrame(
            self._problems, "columna string, error string"
        )

    def row_categories(self, *keep: str) -> DataFrame:
        """``keep`` columns, the category of each analysed column, and whether any is bad."""
        return self.rows.select(
            *[column(self.source, name) for name in keep],
            *[F.col(c.category).alias(f"categoria_{c.name}") for c in self.columns],
            self.any_error.alias("algun_error"),
        )

    def detail(self, name: str, only_errors: bool = True) -> DataFrame:
        """Rows of one analysed column: sheet row first, its category last."""
        checked = next(c for c in self.columns if c.name == name)
        rows = compute_once(self.rows, {"categoria_error": F.col(checked.category)})
        if only_errors:
            rows = rows.filter(F.col("categoria_error") != CORRECT)
        return rows.select(
            (F.col("fila") + 2).alias("fila_excel"),
            *[column(self.source, n) for n in self.source.columns],
            "categoria_error",
        )

    def errors(self) -> DataFrame:
        """One row per bad cell: columna, all columns of the row, categoria_error."""
        cells = F.array(
            *[
                F.struct(F.lit(c.name).alias("columna"), F.col(c.category).alias("categoria_error"))
                for c in self.columns
            ]
        )
        bad = F.filter(cells, lambda cell: cell["categoria_error"] != CORRECT)
        return self.rows.select(
            *[column(self.source, name) for name in self.source.columns],
            F.inline(bad).alias("columna", "categoria_error"),
        ).select("columna", *[column(self.source, n) for n in self.source.columns], "categoria_error")

    @cached_property
    def totals(self) -> DataFrame:
        """One row: all rows, bad rows, and rows per analysed column and category."""
        counts = [
            F.count_if(F.col(c.category) == rule).alias(f"n_{i}_{j}")
            for i, c in enumerate(self.columns)
            for j, (rule, _) in enumerate(c.rules)
        ]
        return self.rows.agg(
            F.count(F.lit(1)).alias("total"), F.count_if(self.any_error).alias("malas"), *counts
        )

    def _bad_cells(self, i: int) -> Column:
        parts = [F.col(f"n_{i}_{j}") for j in range(len(self.columns[i].rules))]
        return sum(parts[1:], parts[0])

    def category_distribution(self) -> DataFrame:
        """columna, categoria, cantidad, porcentaje of the categories that occur."""
        entries = []
        for i, c in enumerate(self.columns):
            counts = [(rule, F.col(f"n_{i}_{j}")) for j, (rule, _) in enumerate(c.rules)]
            counts.append((CORRECT, F.col("total") - self._bad_cells(i)))
            for category, count in counts:
                entries.append(
                    F.struct(
                        F.lit(i).alias("pos"),
                        F.lit(c.name).alias("columna"),
                        F.lit(category).alias("categoria"),
                        count.alias("cantidad"),
                        percentage(count, F.col("total")).alias("porcentaje"),
                    )
                )
        return (
            self.totals.select(F.inline(F.array(*entries)))
            .filter("cantidad > 0")
            .orderBy("pos", F.desc("cantidad"), "categoria")
            .drop("pos")
        )

    def column_error_rate(self) -> DataFrame:
        """columna, errores, porcentaje_error in the order of the assignment."""
        entries = [
            F.struct(
                F.lit(c.name).alias("columna"),
                self._bad_cells(i).alias("errores"),
                percentage(self._bad_cells(i), F.col("total")).alias("porcentaje_error"),
            )
            for i, c in enumerate(self.columns)
        ]
        return self.totals.select(F.inline(F.array(*entries)))

    def clean_columns(self) -> DataFrame:
        """Columns whose error rate, as shown, is zero."""
        return self.column_error_rate().filter("porcentaje_error = 0").select("columna")

    def overall(self) -> DataFrame:
        """Good and bad rows, each row counted once, and the share of good rows."""
        good = F.col("total") - F.col("malas")
        return self.totals.select(
            "total",
            good.alias("buenas"),
            "malas",
            percentage(good, F.col("total"), 1).alias("porcentaje_bueno"),
        )

    def overall_shares(self) -> DataFrame:
        """categoria (good or bad), cantidad: the two shares of the overall result."""
        return self.overall().select(
            F.inline(
                F.array(
                    F.struct(F.lit(GOOD).alias("categoria"), F.col("buenas").alias("cantidad")),
                    F.struct(F.lit(BAD).alias("categoria"), F.col("malas").alias("cantidad")),
                )
            )
        )

    def summary(self) -> DataFrame:
        """Columns analysed, bad cells (a row counts once per bad column), bad and all rows."""
        cells = F.lit(0).cast("long")
        for i in range(len(self.columns)):
            cells = cells + self._bad_cells(i)
        return self.totals.select(
            F.lit(len(self.columns)).cast("long").alias("columnas_revisadas"),
            cells.alias("errores_por_celda"),
            F.col("malas").alias("filas_malas"),
            F.col("total").alias("filas"),
        )


def diagnosis_summary(
    df: DataFrame, valid: str, blank: str, diagnosis: str = "diagnostico"
) -> DataFrame:
    """total, validos, vacios, invalidos, porcentaje_validos of a diagnosis column."""
    label = column(df, diagnosis)
    return (
        df.agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(label == valid).alias("validos"),
            F.count_if(label == blank).alias("vacios"),
        )
        .withColumn("invalidos", F.col("total") - F.col("validos") - F.col("vacios"))
        .withColumn("porcentaje_validos", percentage(F.col("validos"), F.col("total")))
    )


def diagnosis_detail(
    df: DataFrame, valid: str, blank: str, diagnosis: str = "diagnostico"
) -> DataFrame:
    """Rows that are neither valid nor blank: sheet row first, diagnosis last."""
    label = "__etiqueta"
    return (
        compute_once(df, {label: column(df, diagnosis)})
        .filter(~F.col(label).isin(valid, blank))
        .select(
            (F.col("fila") + 2).alias("fila_excel"),
            *[column(df, name) for name in df.columns if name != diagnosis],
            F.col(label).alias(diagnosis),
        )
    )
