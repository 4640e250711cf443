"""The catalogue of row rules: name -> boolean ``Column``, True where a row breaks the rule."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import email, phone, text
from ..functions import unicode_tables as U
from .columns import as_text, column
from .duplicates import flag_duplicates

# Kinds of rule parameter, and the value a number takes when none is given. Fixed values.
TEXT = "texto"
NUMBER = "numero"
DEFAULT_NUMBER = 10

# What the character rules look for. Fixed values.
HAS_DIGIT = r"\p{Nd}"
HAS_LETTER = "[A-Za-z]"
ONLY_LETTERS = r"^\p{L}+\z"
SPECIAL = "[^A-Za-z0-9 ]"


def only_digits_pattern() -> str:
    return rf"^{U.numeric()}+\z"


@dataclass(frozen=True)
class Cell:
    """Expressions a rule may use; those from ``trimmed`` on are computed once per row.

    ``text`` is ``raw`` unless nulls are to be read as a text.
    """

    value: Column
    raw: Column
    text: Column
    trimmed: Column
    digits: Column
    international: Column
    repeated: Column

    @property
    def blank(self) -> Column:
        return self.value.isNull() | F.coalesce(self.trimmed == "", F.lit(False))


@dataclass(frozen=True)
class Rule:
    name: str
    build: Callable[[Cell, object], Column]
    parameter: str | None = None
    description: str = ""
    uses_duplicates: bool = False
    uses_digits: bool = False


def _contains(cell: Cell, wanted: str) -> Column:
    return F.coalesce(F.upper(cell.text).contains(F.upper(F.lit(wanted))), F.lit(False))


RULES: dict[str, Rule] = {}


def register_rule(rule: Rule) -> Rule:
    """Adds a rule; it can be assigned by its name from then on."""
    if rule.parameter not in (None, TEXT, NUMBER):
        raise ValueError(f"unknown parameter kind: {rule.parameter}")
    RULES[rule.name] = rule
    return rule


def get_rule(name: str) -> Rule:
    if name not in RULES:
        raise ValueError(f"unknown rule: {name}")
    return RULES[name]


def check_parameter(rule: Rule, parameter: object) -> object:
    """Typed parameter of a rule; None when a text rule has no text and is to be skipped."""
    if rule.parameter == TEXT:
        return str(parameter) if parameter not in (None, "") else None
    if rule.parameter == NUMBER:
        number = DEFAULT_NUMBER if parameter in (None, "") else int(parameter)
        if number < 1:
            raise ValueError(f"rule {rule.name}: N must be at least 1")
        return number
    return None


def violates(rule: Rule, cell: Cell, parameter: object = None) -> Column:
    """The rule as a two-valued predicate: null never breaks a rule by itself."""
    return F.coalesce(rule.build(cell, parameter), F.lit(False))


# Rule names. Fixed values.
for _rule in (
    Rule(
        "Email",
        lambda cell, _: email.is_invalid(email.diagnose(cell.raw, cell.trimmed)),
        description="Direcciones de correo mal formadas; una celda vacía no cuenta",
    ),
    Rule(
        "Teléfono",
        lambda cell, _: phone.is_invalid(phone.diagnose(cell.raw, cell.trimmed, cell.digits, cell.international)),
        description="Números que no son de Honduras ni internacionales válidos",
        uses_digits=True,
    ),
    Rule(
        "ID (vacíos + duplicados)",
        lambda cell, _: cell.blank | cell.repeated,
        description="Identificadores que faltan o se repiten",
        uses_duplicates=True,
    ),
    Rule(
        "Texto general (vacíos + símbolos)",
        lambda cell, _: cell.blank | F.coalesce(cell.text.rlike(SPECIAL), F.lit(False)),
        description="Textos que faltan o llevan símbolos o tildes",
    ),
    Rule("Vacíos", lambda cell, _: cell.blank),
    Rule("Duplicados", lambda cell, _: cell.repeated, uses_duplicates=True),
    Rule("Contiene un valor específico", _contains, parameter=TEXT),
    Rule(
        "No contiene un valor específico",
        lambda cell, wanted: ~_contains(cell, wanted),
        parameter=TEXT,
    ),
    Rule("Longitud mayor a N", lambda cell, n: F.length(cell.text) > n, parameter=NUMBER),
    Rule("Longitud menor a N", lambda cell, n: F.length(cell.text) < n, parameter=NUMBER),
    Rule("Contiene números", lambda cell, _: cell.text.rlike(HAS_DIGIT)),
    Rule("Contiene letras", lambda cell, _: cell.text.rlike(HAS_LETTER)),
    Rule("Solo números", lambda cell, _: cell.text.rlike(only_digits_pattern())),
    Rule("Solo letras", lambda cell, _: cell.text.rlike(ONLY_LETTERS)),
    Rule("Caracteres especiales / símbolos", lambda cell, _: cell.text.rlike(SPECIAL)),
    Rule(
        "Teléfono Honduras",
        lambda cell, _: phone.is_invalid(phone.diagnose_hn(cell.raw)),
        description="Números que no son de Honduras",
    ),
):
    register_rule(_rule)


def apply_rules(
    df: DataFrame,
    cells: dict[str, list[tuple[str, object]]],
    outputs: dict[tuple[str, str], str],
    null_as_text: str | None = None,
) -> DataFrame:
    """Adds one boolean column per (column, rule).

    Trimmed texts and phone digits are projected once per column, repeated values come from one
    aggregation for all columns, and every rule is evaluated in one projection.
    """
    rules = {name: [get_rule(rule) for rule, _ in assigned] for name, assigned in cells.items()}
    position = {name: i for i, name in enumerate(cells)}
    flags = {
        name: f"__repetido_{position[name]}"
        for name, assigned in rules.items()
        if any(rule.uses_duplicates for rule in assigned)
    }
    original = df.columns
    df = flag_duplicates(df, flags)
    raw = {name: as_text(df, name) for name in cells}
    df = df.withColumns({f"__recorte_{i}": text.strip(raw[n]) for n, i in position.items()})
    phones = [
        position[name]
        for name, assigned in rules.items()
        if any(rule.uses_digits for rule in assigned)
    ]
    if phones:
        digits = {f"__digitos_{i}": phone.digits(F.col(f"__recorte_{i}")) for i in phones}
        full = {f"__completo_{i}": phone.international(F.col(f"__digitos_{i}")) for i in phones}
        df = df.withColumns(digits).withColumns(full)
    computed = []
    for name, assigned in cells.items():
        i = position[name]
        cell = Cell(
            value=column(df, name),
            raw=raw[name],
            text=raw[name] if null_as_text is None else F.coalesce(raw[name], F.lit(null_as_text)),
            trimmed=F.col(f"__recorte_{i}"),
            digits=F.col(f"__digitos_{i}"),
            international=F.col(f"__completo_{i}"),
            repeated=F.col(flags[name]) if name in flags else F.lit(False),
        )
        for rule_name, parameter in assigned:
            computed.append(
                violates(get_rule(rule_name), cell, parameter).alias(outputs[(name, rule_name)])
            )
    return df.select(*[column(df, name) for name in original], *computed)


def flag_rule(
    df: DataFrame,
    name: str,
    rule_name: str,
    parameter: object = None,
    output: str = "marca",
    null_as_text: str | None = None,
) -> DataFrame:
    """Rows with one boolean column: does the row break the rule?"""
    checked = check_parameter(get_rule(rule_name), parameter)
    if get_rule(rule_name).parameter == TEXT and checked is None:
        raise ValueError(f"rule {rule_name} needs a text")
    return apply_rules(
        df, {name: [(rule_name, checked)]}, {(name, rule_name): output}, null_as_text
    )
