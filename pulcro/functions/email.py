"""E-mail diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

# Diagnosis labels. Fixed values.
VALID = "Válido"
BLANK = "Vacío"
EXTRA_SPACE = "Espacios extra"
NO_AT = "Falta @"
MANY_AT = "Más de un @"
NO_USER = "Falta usuario antes del @"
NO_DOMAIN = "Falta dominio después del @"
NO_EXTENSION = "Dominio sin extensión (falta .com, .net, etc.)"
BAD_EXTENSION = "Extensión de dominio inválida"
BAD_CHARACTERS = "Caracteres inválidos"

# Accepted address form. Fixed value.
ADDRESS = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"


def diagnose(c: Column, trimmed: Column | None = None) -> Column:
    """Label of one address. ``trimmed`` may name an already computed ``strip(c)``."""
    t = text.strip(c) if trimmed is None else trimmed
    # One anchored pattern per question keeps every branch a single native regex test; the
    # first branch settles the common case, a well-formed address.
    return (
        F.when(c.rlike(ADDRESS), VALID)
        .when(c.isNull() | (t == ""), BLANK)
        .when(c != t, EXTRA_SPACE)
        .when(~c.contains("@"), NO_AT)
        .when(c.rlike("(?s)@.*@"), MANY_AT)
        .when(c.startswith("@"), NO_USER)
        .when(c.endswith("@"), NO_DOMAIN)
        .when(~c.rlike(r"(?s)@.*\."), NO_EXTENSION)
        .when(~c.rlike(r"\.\p{L}{2,}\z"), BAD_EXTENSION)
        .otherwise(BAD_CHARACTERS)
    )


def with_diagnosis(df: DataFrame, column: str, output: str = "diagnostico") -> DataFrame:
    """Adds the diagnosis of a column; its trimmed text is computed once per row."""
    c = F.col(f"`{column}`").cast("string")
    return (
        df.withColumn("__correo", text.strip(c))
        .withColumn(output, diagnose(c, F.col("__correo")))
        .drop("__correo")
    )


def is_invalid(diagnosis: Column) -> Column:
    """A blank cell is not an invalid address."""
    return ~diagnosis.isin(VALID, BLANK)
