"""Rules, categories, counts."""

import pytest
from pyspark.sql import functions as F

from checks.views import ASSIGNMENTS, clientes, proveedores
from pulcro.operators import catalogue, duplicates
from pulcro.operators.analysis import Analysis
from pulcro.sinks import tables


def flags(df, rule, parameter=None, **options):
    rows = catalogue.flag_rule(df, "v", rule, parameter, **options).orderBy("fila").collect()
    return [row["marca"] for row in rows]


VALUES = [None, "", "  ", "abc", "a1", "12", "ñandú", "a-b", "²", "一", "STRASSE", "abc"]

EXPECTED = {
    ("Vacíos", None): [1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    ("Duplicados", None): [0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1],
    ("Contiene un valor específico", "B"): [0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1],
    ("Contiene un valor específico", "straße"): [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0],
    ("No contiene un valor específico", "b"): [1, 1, 1, 0, 1, 1, 1, 0, 1, 1, 1, 0],
    ("Longitud mayor a N", 3): [0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 1, 0],
    ("Longitud menor a N", 3): [0, 1, 1, 0, 1, 1, 0, 0, 1, 1, 0, 0],
    ("Contiene números", None): [0, 0, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0],
    ("Contiene letras", None): [0, 0, 0, 1, 1, 0, 1, 1, 0, 0, 1, 1],
    ("Solo números", None): [0, 0, 0, 0, 0, 1, 0, 0, 1, 1, 0, 0],
    ("Solo letras", None): [0, 0, 0, 1, 0, 0, 1, 0, 0, 1, 1, 1],
    ("Caracteres especiales / símbolos", None): [0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0, 0],
    ("ID (vacíos + duplicados)", None): [1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 1],
    ("Texto general (vacíos + símbolos)", None): [1, 1, 1, 0, 0, 0, 1, 1, 1, 1, 0, 0],
}


@pytest.mark.parametrize("rule, parameter", EXPECTED)
def test_rule(texts, rule, parameter):
    assert flags(texts(VALUES), rule, parameter) == [bool(x) for x in EXPECTED[(rule, parameter)]]


def test_null_read_as_text(texts):
    df = texts([None, "x"])
    assert flags(df, "Solo letras", null_as_text="nan") == [True, True]
    assert flags(df, "Longitud menor a N", 3, null_as_text="nan") == [False, True]
    assert flags(df, "Email", null_as_text="nan") == [False, True]
    assert flags(df, "Vacíos", null_as_text="nan") == [True, False]


def test_parameters(texts):
    df = texts(["x"])
    with pytest.raises(ValueError):
        flags(df, "Longitud mayor a N", 0)
    with pytest.raises(ValueError):
        flags(df, "Contiene un valor específico", "")
    with pytest.raises(ValueError):
        flags(df, "no existe")
    assert flags(texts(["x" * 11, "x" * 10]), "Longitud mayor a N") == [True, False]


def test_registered_rule(texts):
    rule = catalogue.Rule("Empieza con x", lambda cell, _: cell.text.startswith("x"))
    catalogue.register_rule(rule)
    try:
        assert flags(texts(["xa", "a", None]), "Empieza con x") == [True, False, False]
    finally:
        del catalogue.RULES[rule.name]


def test_nested_column_has_no_rules(spark):
    df = spark.createDataFrame([(0, ["a"])], "fila long, v array<string>")
    analysis = Analysis(df, {"v": ["Vacíos"], "fila": ["Vacíos"], "otra": ["Vacíos"]})
    assert {r["columna"] for r in analysis.problems().collect()} == {"v", "otra"}
    assert [c.name for c in analysis.columns] == ["fila"]


def test_duplicates_of_every_kind(spark):
    long_text = "y" * 5000
    rows = [(i, v, d) for i, (v, d) in enumerate(
        [(None, 0.0), (None, -0.0), (long_text, 1.5), (long_text, 2.5), (long_text + "z", None),
         ("", None), ("~", 3.0), ("=", 4.0)])]
    df = spark.createDataFrame(rows, "fila long, v string, d double")
    flagged = duplicates.flag_duplicates(df, {"v": "dv", "d": "dd"}).orderBy("fila").collect()
    assert [r["dv"] for r in flagged] == [True, True, True, True, False, False, False, False]
    assert [r["dd"] for r in flagged] == [True, True, False, False, True, True, False, False]


def test_duplicates_by_shuffle_with_a_hot_value(spark, monkeypatch):
    """A third of all rows share one value, more are null; values repeat beyond the hot ones."""
    monkeypatch.setattr(duplicates, "HOT_VALUES", 2)
    df = spark.range(30_000).select(
        F.col("id").alias("fila"),
        F.when(F.col("id") % 3 == 0, "caliente")
        .when(F.col("id") % 10 == 1, None)
        .otherwise(F.concat(F.lit("v"), F.floor(F.col("id") / 4)))
        .alias("v"),
    )
    expected = {
        r["fila"]: r["n"] > 1
        for r in df.selectExpr("fila", "count(*) over (partition by v) n").collect()
    }
    for limit in (0, duplicates.BROADCAST_BYTES):
        flagged = duplicates.flag_duplicates(df, {"v": "d"}, broadcast_bytes=limit)
        assert {r["fila"]: r["d"] for r in flagged.collect()} == expected


def test_category_is_the_first_broken_rule(texts):
    df = texts(["a-1", "1", "", "ab"])
    rules = {"v": ["Contiene números", "Caracteres especiales / símbolos", "Vacíos"]}
    rows = Analysis(df, rules).row_categories("fila").orderBy("fila").collect()
    assert [r["categoria_v"] for r in rows] == [
        "Contiene números", "Contiene números", "Vacíos", "Correcto",
    ]
    assert [r["algun_error"] for r in rows] == [True, True, True, False]


def test_text_rule_without_text_is_skipped(texts):
    skipped = Analysis(texts(["a"]), {"v": ["Contiene un valor específico"]})
    assert skipped.columns == []
    assert skipped.summary().first()["columnas_revisadas"] == 0
    assert skipped.overall().first()["malas"] == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "fila long, v string")
    analysis = Analysis(df, {"v": ["Vacíos", "Duplicados"]})
    assert analysis.column_error_rate().first()["porcentaje_error"] == 0.0
    assert analysis.overall().first().asDict() == {
        "total": 0, "buenas": 0, "malas": 0, "porcentaje_bueno": 0.0,
    }


def test_rounding_is_half_even(spark):
    df = spark.range(800).select(
        F.col("id").alias("fila"), F.when(F.col("id") > 0, "x").alias("v")
    )
    assert Analysis(df, {"v": ["Vacíos"]}).column_error_rate().first()["porcentaje_error"] == 0.12


@pytest.mark.parametrize("name", ["clientes_full", "clientes_small", "proveedores_full"])
def test_counts_agree(spark, sf, name):
    source = (proveedores if name.startswith("prov") else clientes)(spark, sf)
    analysis = Analysis(source, ASSIGNMENTS[name])
    total = source.count()
    by_column = {}
    for row in analysis.category_distribution().collect():
        by_column[row["columna"]] = by_column.get(row["columna"], 0) + row["cantidad"]
    assert by_column == {c: total for c in ASSIGNMENTS[name]}
    summary = analysis.summary().first()
    assert summary["filas_malas"] <= summary["errores_por_celda"] == analysis.errors().count()
    overall = analysis.overall().first()
    assert overall["buenas"] + overall["malas"] == total


def test_result_does_not_depend_on_partitions(spark, sf):
    source = clientes(spark, sf)
    rules = ASSIGNMENTS["clientes_small"]
    found = [
        sorted(map(tuple, Analysis(source.repartition(n), rules).category_distribution().collect()))
        for n in (1, 8)
    ]
    assert found[0] == found[1]


def test_report_labels():
    same = "x" * 40
    labels = tables.report_labels([same, same + "y", "a/b", "a:b", "  ", "[]", "hoja"])
    assert list(labels.values()) == [
        "x" * 31, "x" * 29 + "_1", "a_b", "a_b_1", "hoja", "__", "hoja_1",
    ]


def test_error_report_is_written_by_section(spark, sf, tmp_path):
    path = str(tmp_path / "informe")
    analysis = Analysis(clientes(spark, sf), ASSIGNMENTS["clientes_small"])
    tables.write_error_report(analysis, path)
    written = spark.read.parquet(path)
    assert written.count() == analysis.errors().count()
    assert {p.name for p in (tmp_path / "informe").glob("hoja=*")} == {
        "hoja=cli_codigo", "hoja=cli_email",
    }
