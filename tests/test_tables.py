"""Metrics, profiles, row operations and the cleaning plan."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.views import clientes, table
from pulcro.operators.columns import as_text
from pulcro.operators import metrics, profile, quantiles, rows
from pulcro.plans import master
from pulcro.plans.cleaning import ALL_TEXT, CleaningPlan, Replacement


def test_metrics_of_one_and_of_all_columns_agree(spark, sf):
    for df in (clientes(spark, sf), table(spark, sf, "documents"), table(spark, sf, "orders")):
        every = {r["columna"]: r.asDict() for r in metrics.quality_metrics_all(df).collect()}
        for name in df.columns[:5]:
            one = metrics.quality_metrics(df, name).first().asDict()
            assert one == {k: every[name][k] for k in one}


def test_metrics_against_pandas(texts):
    values = [None, None, "a", "a", "b1", "", "x" * 200, "x" * 200, "12", "ñ"]
    series = pd.Series(values, dtype=object)
    found = metrics.quality_metrics(texts(values), "v").first()
    assert found["vacios"] == series.isna().sum()
    assert found["duplicados"] == series.duplicated().sum()
    assert found["unicos"] == series.nunique()
    assert found["longitud_mayor"] == 2


def test_approximate_metrics(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("v"))
    found = metrics.quality_metrics(df, "v", approximate=True).first()
    assert abs(found["unicos"] - 5000) < 500


def test_nested_columns_are_left_out_of_the_metrics(spark, sf):
    df = table(spark, sf, "embeddings")
    names = {r["columna"] for r in metrics.quality_metrics_all(df).collect()}
    assert names == {"vec_id", "label"}
    with pytest.raises(TypeError):
        metrics.quality_metrics(df, "embedding")


def test_sort_keys_are_the_bits_of_doubles(spark):
    import math
    import struct

    random.seed(9)
    values = [0.0, 5e-324, 2.0**-1022, 2.0**-1023, 1.0, math.inf, 1.7976931348623157e308]
    values += [2.0**k for k in range(-1074, 1024, 7)] + [random.uniform(-1, 1) * 10.0 ** random.randrange(-320, 308) for _ in range(3000)]
    values += [math.nextafter(2.0**k, s) for k in range(-1070, 1023, 11) for s in (0.0, math.inf)]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for v, (k,) in zip(values, quantiles.sort_keys(df).collect()):
        (bits,) = struct.unpack("<q", struct.pack("<d", abs(v)))
        assert k == (-bits if v < 0 else bits) and quantiles.from_sort_key(k) == v


def test_text_tests_are_the_patterns(spark):
    import math

    doubles = [0.0, -0.0, 1.5, -2.0, 1e7, 9999999.0, -1e-4, 0.001, 5e-324, math.inf, -math.inf, math.nan, None, 1e300]
    wholes = [0, 1, -1, 2**31 - 1, -(2**31), None, 7, 10, -10, 99, 100, 5, 6, 8]
    df = spark.createDataFrame([(d, d, w, w) for d, w in zip(doubles, wholes)], "d double, f float, i int, l long")
    for name in df.columns:
        text = as_text(df, name)
        tests = metrics.text_tests(df.schema[name].dataType, text)
        for metric, pattern in metrics.pattern_tests().items():
            wrong = df.where(~tests[metric].eqNullSafe(text.rlike(pattern)))
            assert "RLIKE" not in str(tests[metric]).upper() and wrong.count() == 0


def test_quantiles_read_the_table_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(len(batch))
            yield batch

    df = spark.range(1000).selectExpr("cast(id % 50 AS double) AS a", "cast(id AS double) AS b")
    df = df.mapInPandas(counted, df.schema)
    assert quantiles.exact_quantiles(df, ["a", "b"], [0.0, 0.5, 1.0]) == {"a": [0.0, 24.5, 49.0], "b": [0.0, 499.5, 999.0]}
    assert rows.value == 1000


def test_quantiles_are_three_scans(spark, monkeypatch):
    levels = []
    real = quantiles._level
    monkeypatch.setattr(quantiles, "_level", lambda *a: levels.append(a) or real(*a))
    df = spark.createDataFrame([(float(i % 97), -1.0 / (i + 1), float("inf") if i > 90 else i * 1e300) for i in range(100)], "a double, b double, c double")
    found = quantiles.exact_quantiles(df, ["a", "b", "c"], [0.0, 0.5, 1.0])
    assert len(levels) == 3
    assert found["b"] == [-1.0, pytest.approx((-1 / 50 - 1 / 51) / 2), -0.01]
    assert found["c"][0] == 0.0 and found["c"][2] == float("inf")


def test_quantiles(spark):
    """With ties, heavy tails, nulls and negative numbers."""
    random.seed(7)
    data = {
        "a": [random.lognormvariate(0, 5) * random.choice([-1, 1, 1]) for _ in range(4000)],
        "b": [float(random.choice([1, 1, 1, 2, 3])) for _ in range(4000)],
        "c": [None if i % 3 else float(i) for i in range(4000)],
        "d": [None] * 4000,
    }
    df = spark.createDataFrame(
        list(zip(*data.values())), "a double, b double, c double, d double"
    ).repartition(4)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    found = quantiles.exact_quantiles(df, list(data), probabilities)
    for name in "abc":
        known = [x for x in data[name] if x is not None]
        assert found[name] == pytest.approx(list(np.quantile(known, probabilities)))
    assert found["d"] == [None] * 6


def test_profile_against_pandas(spark):
    pdf = pd.DataFrame({"x": [1.5, 2.5, None, 4.0, 4.0], "n": [1, 2, 3, 4, 5], "t": list("aabbc")})
    df = spark.createDataFrame(
        [(None if pd.isna(x) else x, n, t) for x, n, t in pdf.itertuples(index=False)],
        "x double, n long, t string",
    )
    found = {r["columna"]: r for r in profile.columns_profile(df).collect()}
    for name in ("x", "n"):
        described = pdf[name].describe()
        row = found[name]
        measured = [row[k] for k in ("cantidad", "media", "desviacion", "minimo", "p25", "p50",
                                     "p75", "maximo")]
        assert measured == pytest.approx(list(described))
    assert found["t"]["cantidad"] is None and found["t"]["unicos"] == 3


def test_histogram_against_numpy(spark):
    values = [float(x) for x in [0, 0, 1, 2, 3, 5, 8, 9.99, 10, 10]]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    counts, edges = np.histogram(values, bins=10)
    found = profile.histogram(df, "v").collect()
    assert [r["cantidad"] for r in found] == list(counts)
    assert [r["desde"] for r in found] == pytest.approx(list(edges[:-1]))
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert sum(r["cantidad"] for r in profile.histogram(same, "v").collect()) == 2
    assert profile.histogram(spark.createDataFrame([], "v double"), "v").count() == 0


def test_prefilter_without_values_keeps_all(texts):
    df = texts(["a", "b", None])
    assert rows.keep_values(df, "v", []).count() == 3
    assert rows.keep_values(df, "v", ["a"]).count() == 1


def test_prefilter_reaches_the_scan(spark, sf):
    df = rows.keep_values(table(spark, sf, "events"), "event_type", ["click"]).select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_clean_names(spark):
    raw = ["Cuenta Contable", "cli_codigo", "Año (%)", "***", "cli-codigo", "columna_4"]
    df = spark.createDataFrame([tuple("abcdef")], ", ".join(f"`{n}` string" for n in raw))
    assert rows.clean_column_names(df).columns == [
        "cuenta_contable", "clicodigo", "ano", "columna_4", "clicodigo_2", "columna4",
    ]


def test_fill_nulls_by_type(spark):
    df = spark.createDataFrame([(None, None, None)], "t string, n int, d double")
    assert rows.fill_nulls(df, "N/A").first().asDict() == {"t": "N/A", "n": "N/A", "d": "N/A"}
    assert rows.fill_nulls(df, "7").first().asDict() == {"t": "7", "n": 7, "d": 7.0}
    mixed = spark.createDataFrame([(1, 1.5), (None, None)], "n int, d double")
    assert rows.fill_nulls(mixed, "0.5").orderBy("d").first()["n"] in ("0.5", "1")


def test_exact_replacement_leaves_numbers_alone(spark):
    df = spark.createDataFrame([("1", 1)], "t string, n int")
    assert rows.replace_values(df, "1", "x").first().asDict() == {"t": "x", "n": 1}
    partial = rows.replace_values(df, "1", "x", ["t", "n"], exact=False)
    assert partial.first().asDict() == {"t": "x", "n": "x"}


def test_drop_empty_rows(spark):
    df = spark.createDataFrame([("a", 1), (" ", None), (None, 2), ("", 3)], "t string, n int")
    assert rows.drop_empty_rows(df).count() == 3
    assert rows.drop_empty_rows(df, how="any").count() == 1


def test_drop_duplicate_rows_keeps_the_first(spark):
    data = [(5, "a", 1), (2, "a", 2), (3, "b", 3), (9, None, 4), (7, None, 5)]
    df = spark.createDataFrame(data, "fila long, k string, x int").repartition(3)
    kept = rows.drop_duplicate_rows(df, ["k"]).orderBy("fila").collect()
    assert [(r["fila"], r["k"], r["x"]) for r in kept] == [(2, "a", 2), (3, "b", 3), (7, None, 5)]
    whole = rows.drop_duplicate_rows(df.select("fila", "k")).orderBy("fila").collect()
    assert [r["fila"] for r in whole] == [2, 3, 7]


def test_duplicate_rows_need_no_window(spark):
    df = spark.createDataFrame([(1, "a", 1)], "fila long, k string, x int")
    plan = rows.drop_duplicate_rows(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_cleaning_order_and_names(spark):
    df = spark.createDataFrame(
        [(0, " José  Núñez ", "Tegucigalpa", "4 Mar 2024", None), (1, None, "x", "y", "CF")],
        "fila long, `Nombre Completo` string, `Dirección` string, Fecha string, NIT string",
    )
    plan = CleaningPlan(
        clean_names=True, clean_text=True, upper=True, fill="cf", country="Dirección",
        split_name="Nombre Completo", dates="Fecha", replace=Replacement("cf", "N/D"),
    )
    found = [r.asDict() for r in plan.apply(df).orderBy("fila").collect()]
    assert found[0] == {
        "fila": 0, "nombre_completo": "JOSE NUNEZ", "direccion": "TEGUCIGALPA",
        "fecha": "04/03/2024", "nit": "N/D", "pais_codigo": "HN", "nombre": "JOSE",
        "apellido": "NUNEZ",
    }
    assert found[1]["nombre_completo"] == "N/D" and found[1]["nit"] == "CF"


def test_cleaning_of_new_columns_by_later_steps(texts):
    df = texts(["Ana 1/2/2024", "1/2/2024"])
    plan = CleaningPlan(split_name="v", split_outputs=("a", "b"), dates=ALL_TEXT,
                        date_format="YYYY-MM-DD")
    found = plan.apply(df).orderBy("fila").collect()
    assert [(r["v"], r["a"], r["b"]) for r in found] == [
        ("Ana 1/2/2024", "Ana", "2024-02-01"), ("2024-02-01", "2024-02-01", None),
    ]


def test_cleaning_conflicts(texts):
    with pytest.raises(ValueError):
        CleaningPlan(upper=True, lower=True)
    with pytest.raises(ValueError):
        CleaningPlan(country="otra").apply(texts(["a"]))


def test_impact(texts):
    plan = CleaningPlan(keep=("v", ["a"]), country="v")
    assert plan.impact(texts(["a", "b", "a"])).first().asDict() == {
        "filas_antes": 2, "filas_despues": 2, "filas_delta": 0,
        "columnas_antes": 2, "columnas_despues": 3, "columnas_delta": 1,
    }


def test_master_products(spark):
    df = spark.createDataFrame(
        [(0, "a", 1.0), (1, " ", 1.0), (2, "b", 0.0), (3, "c", None)],
        "fila long, codigo string, precio double",
    )
    found = master.products(df, "codigo", "precio").orderBy("fila").collect()
    assert [r["valido"] for r in found] == [True, False, False, False]


def test_profiles_merge_in_any_grouping(spark, tmp_path):
    from pulcro.operators import incremental

    data = [(i, None if i % 7 == 0 else i * 0.5 if i % 5 else float("nan"), "x" * (i % 13) if i % 11 else None) for i in range(600)]
    df = spark.createDataFrame(data, "k long, v double, t string")
    parts = [incremental.load_profile(df.filter(F.col("k") % 4 == n)) for n in range(4)]
    flat = incremental.merge_profiles(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    pair = incremental.merge_profiles(parts[2].unionByName(parts[0]))
    nested = incremental.merge_profiles(pair.unionByName(parts[3]).unionByName(parts[1]))
    exact = {r["columna"]: r for r in profile.columns_profile(df).collect()}
    for state in (flat, nested):
        for row in incremental.finish_profile(state).collect():
            own = exact[row["columna"]]
            for name in ("tipo", "vacios", "cantidad", "minimo", "maximo"):
                assert row[name] == own[name]
            assert abs(row["unicos"] - own["unicos"]) <= 0.03 * own["unicos"] + 1
            for name in ("media", "desviacion"):
                assert row[name] == pytest.approx(own[name])
    told = {r["columna"]: r for r in incremental.finish_metrics(flat).collect()}
    for row in metrics.quality_metrics_all(df).collect():
        for name in ("vacios", "longitud_mayor", "contiene_numeros", "solo_letras", "longitud_minima", "longitud_maxima"):
            assert told[row["columna"]][name] == row[name]


def test_loads_are_replaced_and_may_be_empty(spark, tmp_path):
    from pulcro.operators import incremental

    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "k long, v double")
    path = str(tmp_path / "cargas")
    for rows, load in ((df, "a"), (df.filter("k > 1"), "b"), (df.limit(0), "c"), (df.filter("k = 1"), "a")):
        incremental.store_load(rows, path, load)
    rows = {r["columna"]: r for r in incremental.finish_profile(incremental.read_loads(spark, path)).collect()}
    assert (rows["v"]["cantidad"], rows["v"]["vacios"], rows["v"]["media"], rows["v"]["maximo"]) == (2, 1, 3.0, 4.0)
    only = incremental.finish_profile(incremental.read_loads(spark, path, ["c"])).first()
    assert only["cantidad"] == 0 and only["media"] is None and only["p50"] is None


def test_dates_in_several_formats_are_parsed_once(spark):
    from pulcro.functions import dates

    df = spark.createDataFrame([("3 de enero",), ("2024-03-04 10:00",), (None,), ("04/03/2024",)], "f string")
    first, second = list(dates.TARGETS)[:2]
    both = dates.to_formats(df, "f", {"a": first, "b": second})
    one, two = dates.standardise(df, ["f"], first), dates.standardise(df, ["f"], second)
    assert [r["a"] for r in both.collect()] == [r["f"] for r in one.collect()]
    assert [r["b"] for r in both.collect()] == [r["f"] for r in two.collect()]
    assert [r["f"] for r in both.collect()] == [r["f"] for r in df.collect()]
