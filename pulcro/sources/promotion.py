"""Types of text columns: leading zeros stay text, numbers become numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators.columns import column, text_columns

# Forms of a number. Fixed values.
LEADING_ZERO = r"^0\p{Nd}+\z"
INTEGER = r"^[+-]?[0-9]+\z"
DECIMAL = (
    r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?"
    r"|(?i:inf(?:inity)?))\z"
)


@dataclass(frozen=True)
class Promotion:
    """What becomes of one text column."""

    column: str
    protected: bool
    target: str


def _tests(trimmed: Column) -> dict[str, Column]:
    filled = F.when(trimmed != "", trimmed)
    whole = filled.rlike(INTEGER)
    return {
        "cero": F.coalesce(F.bool_or(filled.rlike(LEADING_ZERO)), F.lit(False)),
        "numero": F.coalesce(F.bool_and(filled.rlike(DECIMAL)), F.lit(True)),
        "entero": F.bool_and(whole),
        "cabe": F.coalesce(
            F.bool_and(F.when(whole, filled.try_cast("bigint").isNotNull())), F.lit(True)
        ),
    }


def _findings(df: DataFrame) -> DataFrame:
    """One row with the tests of every text column: one scan, no shuffle of rows."""
    names = text_columns(df)
    trimmed = df.select(*[text.strip(column(df, n)).alias(f"t{i}") for i, n in enumerate(names)])
    return trimmed.agg(
        *[
            test.alias(f"{kind}_{i}")
            for i in range(len(names))
            for kind, test in _tests(F.col(f"t{i}")).items()
        ]
    )


def leading_zeros(df: DataFrame) -> DataFrame:
    """columna, cero_inicial: does any value of the text column start with a zero digit?"""
    names = text_columns(df)
    return _findings(df).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("columna"), F.col(f"cero_{i}").alias("cero_inicial"))
                    for i, n in enumerate(names)
                ]
            )
        )
    )


def plan_promotion(df: DataFrame) -> list[Promotion]:
    """Decides the type of each text column; the one step whose schema depends on the data."""
    names = text_columns(df)
    if not names:
        return []
    found = _findings(df).first()
    plan = []
    for i, name in enumerate(names):
        protected = bool(found[f"cero_{i}"])
        target = "string"
        if not protected and found[f"numero_{i}"] and found[f"cabe_{i}"]:
            # A column of nulls only counts as decimal.
            target = "bigint" if found[f"entero_{i}"] else "double"
        plan.append(Promotion(name, protected, target))
    return plan


def apply_promotion(df: DataFrame, plan: list[Promotion]) -> DataFrame:
    changed = {}
    for step in plan:
        trimmed = text.strip(column(df, step.column))
        if step.protected:
            changed[step.column] = trimmed
        elif step.target != "string":
            changed[step.column] = trimmed.try_cast(step.target)
    return df.withColumns(changed) if changed else df


def promote_types(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The typed table, and (columna, protegida, tipo_destino) of its text columns."""
    plan = plan_promotion(df)
    notice = df.sparkSession.createDataFrame(
        [(p.column, p.protected, p.target) for p in plan],
        "columna string, protegida boolean, tipo_destino string",
    )
    return apply_promotion(df, plan), notice
