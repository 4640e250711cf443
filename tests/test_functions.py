"""Expected values of the column functions."""

import re
import string
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pulcro.functions import country, dates, email, phone, phone_plan, text
from pulcro.functions import unicode_tables as U

@pytest.mark.parametrize(
    "value, label",
    [
        (None, "Vacío"),
        ("", "Vacío"),
        (" \t", "Vacío"),
        (" a@b.com", "Espacios extra"),
        ("a@b.com\n", "Espacios extra"),
        ("ab.com", "Falta @"),
        ("a@@b.com", "Más de un @"),
        ("a@b@c.com", "Más de un @"),
        ("@b.com", "Falta usuario antes del @"),
        ("a@", "Falta dominio después del @"),
        ("a@b", "Dominio sin extensión (falta .com, .net, etc.)"),
        ("a.b@c", "Dominio sin extensión (falta .com, .net, etc.)"),
        ("a@b.c", "Extensión de dominio inválida"),
        ("a@b.c0m", "Extensión de dominio inválida"),
        ("a@b.", "Extensión de dominio inválida"),
        ("a b@c.com", "Caracteres inválidos"),
        ("josé@c.com", "Caracteres inválidos"),
        ("a@b.cñm", "Caracteres inválidos"),
        ("user2@mail.example.com", "Válido"),
    ],
)
def test_email(apply, value, label):
    assert apply([value], email.diagnose) == [label]


PHONES = {
    None: "Vacío",
    "  ": "Vacío",
    "9999-8888": "Válido",
    "2222 3333": "Válido",
    "5555-1234": "Prefijo no reconocido en Honduras",
    "999-888": "Muy corto (menos de 8 dígitos)",
    "+504 9999-8888": "Válido",
    "50422223333": "Válido",
    "(504) 9999-8888": "Válido",
    "+504 2222-3333": "Válido",
    "0050499998888": "Válido",
    "+00504 9999 8888": "Válido",
    "+٥٠٤99998888": "Válido",
    "+1 202 555 0123": "Válido",
    "+44 (0)20 7946 0958": "Válido",
    "9999.8888": "Formato no permitido (use solo espacios, guiones o paréntesis)",
    "abc": "Formato no permitido (use solo espacios, guiones o paréntesis)",
    "9999-8888-": "Formato inválido (termina en separador sin dígito)",
    "+504 123": "Número con formato inválido para su país",
    "+999 123456": "Código de país inválido",
    "+5": "No es un número válido",
    "+504 1": "Muy corto",
    "+504" + "1" * 18: "Muy largo",
    "+504" + " " * 260 + "99998888": "Muy largo",
    "+0012": "Formato no reconocido",
}


def test_phone(apply):
    assert apply(list(PHONES), phone.diagnose) == list(PHONES.values())


def test_phone_staged_equals_expression(texts):
    df = phone.with_diagnosis(texts(list(PHONES)), "v")
    assert [r["diagnostico"] for r in df.orderBy("fila").collect()] == list(PHONES.values())


def test_phone_hn(apply):
    cases = {
        None: "Vacío",
        "9999.8888": "Válido",
        "+504 9999-8888": "Válido",
        "50499998888": "Válido",
        "504 1234": "Muy corto (menos de 8 dígitos)",
        "999988887": "Muy largo (más de 8 dígitos)",
        "12345678": "Prefijo no reconocido en Honduras",
        "abc": "Contiene caracteres inválidos",
        "---": "Contiene caracteres inválidos",
    }
    assert apply(list(cases), phone.diagnose_hn) == list(cases.values())


def test_calling_codes_are_prefix_free():
    codes = set(phone.numbering_plan())
    assert not [(a, b) for a in codes for b in codes if a != b and b.startswith(a)]
    listed = [c for group in phone_plan.LENGTHS.values() for c in group.split()]
    assert len(listed) == len(set(listed))
    assert not set(listed) & set(phone_plan.RANGES)


ADDRESSES = {
    "Col. Palmira, Tegucigalpa": "HN",
    "San Pedro Sula": "HN",
    "Av. Reforma 222, México D.F.": "MX",
    "5th Ave, New York, U.S.A.": "US",
    "Ciudad de Panamá": "PA",
    "Calle Mayor 1, España": "ES",
    "Road Town, British Virgin Islands": "VG",
    "Zürich, Switzerland": "CH",
    "Jerusalem": "US",
    "Kyiv, Ukraine": "GB",
    "Sin dato": None,
    None: None,
}


def test_country(texts):
    df = country.with_country_code(texts(list(ADDRESSES)), "v")
    assert [r["pais_codigo"] for r in df.orderBy("fila").collect()] == list(ADDRESSES.values())


def test_country_word_boundary(texts):
    df = country.with_country_code(texts(["Jerusalem", "Miami, USA"]), "v", word_boundary=True)
    assert [r["pais_codigo"] for r in df.orderBy("fila").collect()] == [None, "US"]


def test_country_table(spark, texts):
    rows = [(name, code, i) for i, (name, code) in enumerate(country.PLACES.items())]
    gazetteer = spark.createDataFrame([*rows, ("", "X", -1), ("sin dato", None, -1)], "nombre string, codigo string, pos int")
    df = country.with_country_code_from(texts(list(ADDRESSES)), "v", gazetteer)
    assert [r["pais_codigo"] for r in df.orderBy("fila").collect()] == list(ADDRESSES.values())


@pytest.mark.parametrize("few", [100_000, 0])
def test_country_table_of_any_size_with_repeated_and_long_texts(spark, texts, monkeypatch, few):
    """Names broadcast or shuffled, told apart by their beginnings or by the join."""
    monkeypatch.setattr(country, "is_small", lambda df: df.count() <= few)
    monkeypatch.setattr(country, "BEGINNINGS", 4096 if few else 2)
    names = [("peru", "PE", 0), ("chile", "CL", 1), ("peru", "XX", 2), ("republica de chile del sur", "RC", 3)]
    gazetteer = spark.createDataFrame(names, "nombre string, codigo string, pos int")
    given = ["de Perú", "a chile", None, "en peru", "x" * 50 + "chile" + "y" * 50, "a chile", "República de Chile del Sur", "per", ""]
    df = country.with_country_code_from(texts(given), "v", gazetteer)
    assert [r["pais_codigo"] for r in df.orderBy("fila").collect()] == ["PE", "CL", None, "PE", "CL", "CL", "RC", None, None]
    whole = country.with_country_code_from(texts(["perus", "un peru.", "xchile chile"]), "v", gazetteer, word_boundary=True)
    assert [r["pais_codigo"] for r in whole.orderBy("fila").collect()] == [None, "PE", "CL"]
    assert country.with_country_code_from(texts(given), "v", gazetteer.limit(0)).filter("pais_codigo is not null").count() == 0


def test_rows_of_the_name_search_follow_the_hits(spark):
    names = spark.createDataFrame([(f"calle {i} norte",) for i in range(20_000)] + [("uk",), ("u.s.a.",)], "nombre string")
    index = country.name_index(names)
    assert len(index.pattern) < 500_000
    texts = [("a", "avenida " * 25_000, 0), ("b", "calle 7 norte uk x" * 3, 6), ("c", "u.s.a. uxsxax cal le", 1), ("d", "", 0)]
    df = spark.createDataFrame(texts, "__texto string, __plegado string, n int")
    found = country.places_of_names(df, index).groupBy("__texto").count()
    assert {r[0]: r[1] for r in found.collect()} == {t: n for t, _, n in texts if n}
    inside = country.places_of_names(df, country.name_index(names, word_boundary=True)).groupBy("__texto").count()
    assert {r[0]: r[1] for r in inside.collect()} == {"b": 4, "c": 1}


def clean_in_python(value):
    if value is None:
        return None
    folded = unicodedata.normalize("NFKD", value.strip())
    folded = "".join(c for c in folded if not unicodedata.combining(c))
    return " ".join(folded.translate(str.maketrans("", "", string.punctuation)).split())


TEXTS = [
    "José Núñez Peña", "  Ana  María   López ", "ACME, S.A. de C.V.", "Empresa 24/7 (Honduras)",
    "   ", None, "ﬁn ½ … ™ Ａ１ ² º", "한국어 각", "Ŀ ǅ", "x́ y", "हिन्दी", "a\xa0b", "l1\nl2", "´a`",
    "̈́", "{x}", "！fullwidth，", "Ⅷ ㎏ №",
]


def test_clean_text(apply):
    assert apply(TEXTS, text.clean_text) == [clean_in_python(t) for t in TEXTS]


def test_clean_text_over_all_of_unicode(apply):
    """Every character that folds to something else, forty to a text."""
    one, _, many = U.foldings()
    chars = list(one) + list(many) + [chr(c) for c in range(0xAC00, 0xD7A4, 97)]
    values = ["x".join(chars[i : i + 40]) for i in range(0, len(chars), 40)]
    assert apply(values, text.clean_text) == [clean_in_python(v) for v in values]


def test_clean_text_is_idempotent(apply):
    once = apply(TEXTS, text.clean_text)
    assert apply(once, text.clean_text) == once


def test_fold_text(apply):
    assert apply(["ÑANDÚ São", None], text.fold_text) == ["nandu sao", None]


def test_split_name(apply):
    names = ["  Ana  María   López ", "Cher", "  ", None, "Ana\tLópez"]
    assert apply(names, text.first_word) == ["Ana", "Cher", None, None, "Ana"]
    assert apply(names, text.other_words) == ["María   López", None, None, None, "López"]


def test_replace(apply):
    part = apply(["a.b", "a", None], lambda c: text.replace_part(c, ".", "$1\\"))
    assert part == ["a$1\\b", "a", None]
    exact = apply(["CF", "CFx", None], lambda c: text.replace_exact(c, "CF", "x"))
    assert exact == ["x", "CFx", None]


def test_safe_name(apply):
    assert apply([" Año 1/2-b_c "], text.safe_name) == ["A_o_1_2-b_c"]


def test_null_tokens(apply):
    kept = apply(["NA", "na", "", " ", "null", "-nan", None], text.null_tokens_to_null)
    assert kept == [None, "na", None, " ", None, None, None]


DATES = [
    "25/12/2024", "03/04/2024", "2024-03-04", "12/25/2024", "4 Mar 2024", "31/02/2024", "sin fecha",
    "", "03.04.2024", None, "20240304", "2024-3", "3/4/24", "4-Mar-2024", "March 4, 2024",
    "Mon 4 Mar 2024", "2024-03-04T10:30:00Z", "04 March 2024 10:30 PM", "1/2024", "13/2024",
    "4 Mar 24", "Mar 2024", "2024-25-12", "03 04 2024", "5/6", "1234-01-01", "1.5", "123", "45000",
    "29/02/2023", "29/02/2024", " 25/12/2024 ", "2024", "2024Q2", "0/5/2024",
]


def by_pandas(value):
    """Day first where possible, as the guessing parser of pandas reads a single text."""
    if value is None or not value.strip():
        return value
    for options in ({"dayfirst": True}, {"dayfirst": False}, {"yearfirst": True}):
        try:
            return pd.to_datetime(value.strip(), **options).strftime("%d/%m/%Y")
        except Exception:
            continue
    return value


@pytest.mark.filterwarnings("ignore")
def test_dates_dayfirst_preset_equals_pandas(texts):
    df = dates.standardise(texts(DATES), ["v"], preset=dates.DAYFIRST_COMPAT)
    assert [r["v"] for r in df.orderBy("fila").collect()] == [by_pandas(d) for d in DATES]


def test_dates_default_preset_reads_iso_as_year_month_day(texts):
    df = dates.standardise(texts(["2024-03-04", "2024", "2024-25-12", "4/3/2024"]), ["v"])
    found = [r["v"] for r in df.orderBy("fila").collect()]
    assert found == ["04/03/2024", "2024", "25/12/2024", "04/03/2024"]


@pytest.mark.parametrize(
    "target, expected",
    [
        ("DD/MM/YYYY", "25/12/2024"),
        ("MM/DD/YYYY", "12/25/2024"),
        ("YYYY-MM-DD", "2024-12-25"),
        ("DD-MM-YYYY", "25-12-2024"),
        ("YYYY/MM/DD", "2024/12/25"),
        ("otro", "25/12/2024"),
    ],
)
def test_date_targets(texts, target, expected):
    once = dates.standardise(texts(["25 dec 2024"]), ["v"], target)
    assert once.first()["v"] == expected
    assert dates.standardise(once, ["v"], target).first()["v"] == expected


def test_unknown_date_preset(texts):
    with pytest.raises(ValueError):
        dates.standardise(texts(["1/1/2024"]), ["v"], preset="x")


def test_both_forms_of_the_numbering_plan_agree(spark, apply):
    import random

    from checks import phone_numbers

    rng = random.Random(5)
    codes = sorted(phone_plan.national_ranges())
    numbers = [f"+{c} {n}" for c, both in phone_numbers.BY_HAND.items() for n in both]
    numbers += [f"+{rng.choice(codes)}{rng.choice(['', '0', '1'])}{rng.randrange(10 ** rng.randrange(1, 12))}" for _ in range(3000)]
    numbers += ["", None, "9999-8888", "+", "+1", "0044 20 7946 0018", "abc", "22", "+504 2222-3333-"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, t string")
    rows = phone.with_plan_diagnosis(df, "t").withColumn("r", phone.diagnose(F.col("t"))).collect()
    assert len(rows) == len(numbers)
    assert [r for r in rows if r["diagnostico"] != r["r"]] == []
    by = {r["t"]: r["criterio"] for r in rows}
    assert by["+504 9123 4567"] == phone_plan.BY_RANGE and by["9999-8888"] is None and by["+1"] is None
    assert {r["criterio"] for r in rows} == {None, phone_plan.BY_RANGE, phone_plan.BY_LENGTH}


def test_a_range_added_to_the_plan_decides(spark):

    more = spark.createDataFrame([("50499", "504", 12, 12, "portados")], phone_plan.PLAN_SCHEMA)
    plan = phone_plan.default_plan(spark).unionByName(more)
    df = spark.createDataFrame([("+504 9912 34567",), ("+504 9912 3456",), ("+504 9812 3456",)], "t string")
    rows = phone.with_plan_diagnosis(df, "t", plan).collect()
    assert [r["criterio"] for r in rows] == ["portados", None, phone_plan.BY_RANGE]


def test_names_that_share_a_beginning_do_not_meet_every_place(spark, texts, monkeypatch):
    """Places are joined with whole names, so rows do not grow with the names of one beginning."""
    monkeypatch.setattr(country, "is_small", lambda df: False)
    monkeypatch.setattr(country, "BEGINNINGS", 1)
    names = spark.range(3000).select(
        F.concat(F.lit("calle "), "id").alias("nombre"), F.concat(F.lit("C"), "id").alias("codigo"), F.col("id").alias("pos")
    )
    df = country.with_country_code_from(texts([f"Cálle {i}, x" for i in range(500)] + ["calle", "calle 29991"]), "v", names)
    rows = {r["v"]: r["pais_codigo"] for r in df.collect()}
    assert rows["Cálle 499, x"] == "C499" and rows["calle 29991"] == "C2999" and rows["calle"] is None
    assert sum(code is not None for code in rows.values()) == 501
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert any("nombre" in line for line in joins) and not any("StartsWith" in line for line in joins)


def test_folding_cuts_texts_only_where_characters_expand(apply):
    many = U.foldings()[2]
    ranges = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{([0-9a-f]+)\}-\\x\{([0-9a-f]+)\}", U.never_expanded())]
    assert not any(a <= ord(c) <= b for c in [*many, "\uac00", "\ub098", "\ud7a3"] for a, b in ranges)
    assert all(any(a <= ord(c) <= b for a, b in ranges) for c in "aéñ中я")
    every = "".join(chr(c) for c in range(0xA0, 0x3000) if c not in (0xF73, 0xF75, 0xF81))
    texts = [every, "é" * 300 + "ﬁ½각", "中" * 300 + "…", "\U0001d400\U0001f100", ""]
    bare = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    assert apply(texts, text.fold_accents) == bare
