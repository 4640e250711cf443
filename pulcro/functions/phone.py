"""Telephone diagnosis: Honduran eight-digit numbers and international ones.

The built-in numbering plan is compiled into one regular expression. Calling codes are prefix-free,
so an alternation over the whole number decides both the country and its national pattern without a
join or a per-row pattern look-up. A plan that comes as a table is joined by its prefixes.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import is_small
from . import phone_plan, text
from . import unicode_tables as U

# Diagnosis labels. Fixed values.
VALID = "Válido"
BLANK = "Vacío"
BAD_CHARACTERS = "Contiene caracteres inválidos"
HN_TOO_SHORT = "Muy corto (menos de 8 dígitos)"
HN_TOO_LONG = "Muy largo (más de 8 dígitos)"
HN_BAD_PREFIX = "Prefijo no reconocido en Honduras"
BAD_FORMAT = "Formato no permitido (use solo espacios, guiones o paréntesis)"
TRAILING_SEPARATOR = "Formato inválido (termina en separador sin dígito)"
UNKNOWN_COUNTRY = "Código de país inválido"
NOT_A_NUMBER = "No es un número válido"
TOO_SHORT = "Muy corto"
TOO_LONG = "Muy largo"
UNRECOGNISED = "Formato no reconocido"
BAD_FOR_COUNTRY = "Número con formato inválido para su país"

# First digits of Honduran numbers. Fixed values.
HN_FIRST_DIGITS = "23789"

SEPARATORS = rf"[{U.SPACE_CLASS}\-()]"
ALLOWED = rf"^\+?[\p{{Nd}}{U.SPACE_CLASS}\-()]+\z"
LONGEST_INPUT = 250
LONGEST_NATIONAL = 17


@lru_cache(maxsize=None)
def numbering_plan() -> dict[str, str]:
    """Calling code -> pattern of the national number."""
    return {code: phone_plan.national_pattern(code) for code in phone_plan.national_ranges()}


def _alternation(plan: dict[str, str]) -> str:
    """One branch per next digit, so that a number is matched in as many steps as its code has."""
    if "" in plan:
        return f"(?:{plan['']})"
    branches = []
    for digit in sorted({code[0] for code in plan}):
        rest = {code[1:]: national for code, national in plan.items() if code[0] == digit}
        branches.append(digit + _alternation(rest))
    return f"(?:{'|'.join(branches)})"


@lru_cache(maxsize=None)
def known_code_pattern() -> str:
    return "^" + _alternation(dict.fromkeys(numbering_plan(), ""))


@lru_cache(maxsize=None)
def valid_number_pattern() -> str:
    return "^" + _alternation(numbering_plan()) + r"\z"


def _ascii_digits(c: Column) -> Column:
    scripts, ascii_forms = U.decimal_digits()
    return F.when(c.rlike("[^0-9]"), F.translate(c, scripts, ascii_forms)).otherwise(c)


def digits(trimmed: Column) -> Column:
    """The number without separators and plus sign."""
    return F.regexp_replace(trimmed, rf"[{U.SPACE_CLASS}\-()+]", "")


def international(number: Column) -> Column:
    """Digits from the calling code on, without the ``00`` dialled instead of the plus sign."""
    return F.regexp_replace(_ascii_digits(number), "^00([1-9])", "$1")


def _hn_length_and_prefix(number: Column) -> Column:
    return (
        F.when(F.length(number) < 8, HN_TOO_SHORT)
        .when(F.length(number) > 8, HN_TOO_LONG)
        .when(~F.substring(number, 1, 1).isin(*HN_FIRST_DIGITS), HN_BAD_PREFIX)
        .otherwise(VALID)
    )


def diagnose_hn(c: Column) -> Column:
    """Strict diagnosis of a Honduran number, with or without its calling code."""
    t = text.strip(c)
    bare = F.regexp_replace(t, rf"[{U.SPACE_CLASS}\-.()]", "")
    number = (
        F.when(bare.startswith("+504"), F.substring(bare, 5, 1 << 30))
        .when(bare.startswith("504") & (F.length(bare) > 8), F.substring(bare, 4, 1 << 30))
        .otherwise(bare)
    )
    return (
        F.when(c.isNull() | (t == ""), BLANK)
        .when(~number.rlike(rf"^{U.digit()}+\z"), BAD_CHARACTERS)
        .otherwise(_hn_length_and_prefix(number))
    )


def _diagnose_international(
    t: Column, number: Column, full: Column, code: Column | None = None, valid: Column | None = None
) -> Column:
    """``code`` (empty if unknown) and ``valid`` come from the built-in plan unless they are given."""
    code = F.regexp_extract(full, known_code_pattern(), 0) if code is None else code
    valid = full.rlike(valid_number_pattern()) if valid is None else valid
    national_length = F.length(full) - F.length(code)
    typed_length = F.when(t.startswith("+"), F.length(t)).otherwise(F.length(number) + 1)
    return (
        F.when(typed_length > LONGEST_INPUT, TOO_LONG)
        .when(valid, VALID)
        .when(F.length(number) < 3, NOT_A_NUMBER)
        .when((F.length(full) <= 2) & (F.length(number) > 2), UNRECOGNISED)
        .when(code == "", UNKNOWN_COUNTRY)
        .when(national_length < 2, TOO_SHORT)
        .when(national_length > LONGEST_NATIONAL, TOO_LONG)
        .otherwise(BAD_FOR_COUNTRY)
    )


def _diagnose(c: Column, t: Column, n: Column, international_case: Column) -> Column:
    return (
        F.when(c.isNull() | (t == ""), BLANK)
        .when(~t.rlike(ALLOWED), BAD_FORMAT)
        .when(t.rlike(SEPARATORS + r"\z"), TRAILING_SEPARATOR)
        .when(_is_international(t, n), international_case)
        .otherwise(_hn_length_and_prefix(n))
    )


def _is_international(t: Column, n: Column) -> Column:
    return t.startswith("+") | (F.length(n) > 8)


def diagnose(
    c: Column,
    trimmed: Column | None = None,
    number: Column | None = None,
    full: Column | None = None,
) -> Column:
    """Label of one number; up to eight digits without ``+`` are judged as Honduran.

    ``trimmed``, ``number`` and ``full`` may name already computed ``strip(c)``,
    ``digits(trimmed)`` and ``international(number)``.
    """
    t = text.strip(c) if trimmed is None else trimmed
    n = digits(t) if number is None else number
    f = international(n) if full is None else full
    return _diagnose(c, t, n, _diagnose_international(t, n, f))


def with_diagnosis(df: DataFrame, column: str, output: str = "diagnostico") -> DataFrame:
    """Adds the diagnosis of a column; its trimmed text and digits are computed once per row."""
    c = F.col(f"`{column}`").cast("string")
    trimmed, number, full = (F.col(f"__telefono_{i}") for i in range(3))
    return (
        df.withColumn("__telefono_0", text.strip(c))
        .withColumn("__telefono_1", digits(trimmed))
        .withColumn("__telefono_2", international(number))
        .withColumn(output, diagnose(c, trimmed, number, full))
        .drop("__telefono_0", "__telefono_1", "__telefono_2")
    )


def with_plan_diagnosis(
    df: DataFrame, column: str, plan: DataFrame | None = None, output: str = "diagnostico", basis: str = "criterio"
) -> DataFrame:
    """Adds the diagnosis of a column by a plan that is a table, and what a valid number was judged by.

    ``plan`` has prefijo (digits from the calling code on, each once), codigo, minimo and maximo
    (digits of the whole number; null: no such numbers) and criterio. The longest prefix of a number
    decides: one equi-join for each length of prefix the plan has, broadcast if the plan is counted
    to be small. Numbers without the plus sign and with up to eight digits are judged as Honduran;
    ``basis`` is null for them and for numbers that are not valid.
    """
    plan = phone_plan.default_plan(df.sparkSession) if plan is None else plan
    small = is_small(plan)
    sizes = sorted(r[0] for r in plan.select(F.length("prefijo")).distinct().collect())
    c = F.col(f"`{column}`").cast("string")
    trimmed, number, full = (F.col(f"__telefono_{i}") for i in range(3))
    rows = (
        df.withColumn("__telefono_0", text.strip(c))
        .withColumn("__telefono_1", digits(trimmed))
        .withColumn("__telefono_2", international(number))
    )
    asked = F.when(trimmed.rlike(ALLOWED) & _is_international(trimmed, number), full)
    for size in sizes:
        of_size = plan.filter(F.length("prefijo") == size).select(
            F.col("prefijo").alias(f"__prefijo_{size}"),
            F.struct("codigo", "minimo", "maximo", "criterio").alias(f"__rango_{size}"),
        )
        of_size = F.broadcast(of_size) if small else of_size
        prefix = F.when(F.length(asked) >= size, F.substring(asked, 1, size))
        rows = rows.join(of_size, prefix == F.col(f"__prefijo_{size}"), "left").drop(f"__prefijo_{size}")
    found = F.coalesce(*[F.col(f"__rango_{size}") for size in reversed(sizes)])
    rows = rows.withColumn("__rango", found)
    known = F.coalesce(F.col("__rango.codigo"), F.lit(""))
    valid = F.coalesce(F.length(full).between(F.col("__rango.minimo"), F.col("__rango.maximo")), F.lit(False))
    label = _diagnose(c, trimmed, number, _diagnose_international(trimmed, number, full, known, valid))
    judged = rows.withColumn("__etiqueta", label)
    return judged.select(
        *df.columns,
        F.col("__etiqueta").alias(output),
        F.when((F.col("__etiqueta") == VALID) & _is_international(trimmed, number), F.col("__rango.criterio")).alias(basis),
    )


def is_invalid(diagnosis: Column) -> Column:
    """A blank cell is not an invalid number."""
    return ~diagnosis.isin(VALID, BLANK)
