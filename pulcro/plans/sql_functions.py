"""The rules and diagnoses as SQL functions, so that plain SQL text can use them."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import email, phone, text
from ..operators.catalogue import NUMBER, RULES, Cell, Rule, violates

#: Prefix of the functions that test a rule.
RULE_PREFIX = "regla_"


def function_name(rule: str) -> str:
    """Name of the function of a rule: plain letters, digits and underscores."""
    plain = unicodedata.normalize("NFKD", rule).encode("ascii", "ignore").decode().lower()
    return RULE_PREFIX + re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def _cell(value: Column) -> Cell:
    trimmed = text.strip(value)
    digits = phone.digits(trimmed)
    return Cell(
        value=value, raw=value, text=value, trimmed=trimmed, digits=digits,
        international=phone.international(digits), repeated=F.lit(False),
    )


def sql_of(spark: SparkSession, expression: Column, parameters: str) -> str:
    """SQL text of an expression over the columns that ``parameters`` declares."""
    frame = spark.createDataFrame([], parameters).select(expression.alias("resultado"))
    named = frame._jdf.queryExecution().analyzed().expressions().apply(0)
    return named.child().sql()


def definitions() -> dict[str, tuple[str, str, Column]]:
    """Function name -> (parameters, type of the result, expression).

    A rule is a function of the cell's text and its parameter, if it has one. Rules that look at
    other rows have no function, and folding accents has none: its lambdas have no SQL text.
    """
    v, p = F.col("v"), F.col("p")

    def tested(rule: Rule) -> tuple[str, str, Column]:
        parameters = "v STRING"
        if rule.parameter:
            parameters += ", p INT" if rule.parameter == NUMBER else ", p STRING"
        return parameters, "BOOLEAN", violates(rule, _cell(v), p)

    found = {function_name(name): tested(rule) for name, rule in RULES.items() if not rule.uses_duplicates}
    texts = {
        "diagnostico_email": email.diagnose(v),
        "diagnostico_telefono": phone.diagnose(v),
        "diagnostico_telefono_hn": phone.diagnose_hn(v),
        "texto_sin_espacios": text.strip(v),
        "primera_palabra": text.first_word(v),
        "otras_palabras": text.other_words(v),
        "nombre_seguro": text.safe_name(v),
    }
    found.update({name: ("v STRING", "STRING", e) for name, e in texts.items()})
    return found


def register_functions(spark: SparkSession) -> list[str]:
    """Makes every function known to the session's SQL; returns their names.

    They are SQL functions: the optimizer puts their expressions in place of the calls, so a query
    that uses them is planned like one written with columns, without Python. Rules registered later
    need another call.
    """
    names = []
    for name, (parameters, result, expression) in definitions().items():
        body = sql_of(spark, expression, parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
        names.append(name)
    return names
