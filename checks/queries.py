"""One query per operator, each over whole tables."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulcro.functions import country, dates, email, phone, text
from pulcro.operators import analysis, catalogue, incremental, metrics, profile, quantiles, rows
from pulcro.operators.analysis import Analysis
from pulcro.operators.duplicates import flag_duplicates
from pulcro.plans import master, rulesets, sql_functions
from pulcro.plans.cleaning import ALL_TEXT, CleaningPlan, Replacement
from pulcro.session import scratch_path
from pulcro.sinks import tables
from pulcro.sources import delimited, numbering, promotion, workbook
from pulcro.streaming import loads

from . import phone_numbers
from .views import ASSIGNMENTS, clientes, faltantes, proveedores, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---------------------------------------------------------------- row rules


def _rule(name: str, column: str, rule: str, parameter=None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        flagged = catalogue.flag_rule(clientes(spark, folder), column, rule, parameter)
        return flagged.select("fila", "marca")

    run.__name__ = name
    query(run)


_rule("rule_blank", "cli_nombre", "Vacíos")
_rule("rule_contains", "cli_direccion", "Contiene un valor específico", "MÉXICO")
_rule("rule_not_contains", "cli_direccion", "No contiene un valor específico", "a")
_rule("rule_len_gt", "cli_nombre", "Longitud mayor a N", 10)
_rule("rule_len_lt", "cli_nombre", "Longitud menor a N", 10)
_rule("rule_has_digit", "cli_nombre", "Contiene números")
_rule("rule_has_letter", "cli_telefono", "Contiene letras")
_rule("rule_only_digits", "cli_nit", "Solo números")
_rule("rule_only_letters", "cli_nombre", "Solo letras")
_rule("rule_special_chars", "cli_nombre", "Caracteres especiales / símbolos")
_rule("rule_text", "cli_direccion", "Texto general (vacíos + símbolos)")
_rule("rule_email", "cli_email", "Email")
_rule("rule_phone", "cli_telefono", "Teléfono")
_rule("rule_id", "cli_codigo", "ID (vacíos + duplicados)")


@query
def rule_duplicates(spark, folder):
    flagged = catalogue.flag_rule(table(spark, folder, "part"), "p_name", "Duplicados")
    return flagged.select("p_partkey", "p_name", "marca")


@query
def rule_duplicates_lineitem(spark, folder):
    """Two columns of the largest table, flagged by one aggregation."""
    rows_of = ("l_orderkey", "l_linenumber", "l_extendedprice")
    flagged = flag_duplicates(
        table(spark, folder, "lineitem").select(*rows_of), {"l_orderkey": "orden", "l_extendedprice": "precio"}
    )
    return flagged.select("l_orderkey", "l_linenumber", "l_extendedprice", "orden", "precio")


@query
def rule_duplicates_documents(spark, folder):
    flagged = flag_duplicates(table(spark, folder, "documents"), {"text": "repetido"})
    return flagged.select("doc_id", "repetido")


# ---------------------------------------------------------------- diagnoses


def _email_rows(spark, folder):
    return clientes(spark, folder).select("fila", "cli_nombre", "cli_email")


def _phone_rows(spark, folder):
    customers = clientes(spark, folder).select(
        F.lit("cliente").alias("origen"), "fila", F.col("cli_telefono").alias("telefono")
    )
    suppliers = proveedores(spark, folder).select(
        F.lit("proveedor").alias("origen"), "fila", F.col("pro_telefono").alias("telefono")
    )
    return customers.unionByName(suppliers)


def _emails(spark, folder):
    return email.with_diagnosis(_email_rows(spark, folder), "cli_email")


def _phones(spark, folder):
    return phone.with_diagnosis(_phone_rows(spark, folder), "telefono")


@query
def email_diagnosis(spark, folder):
    return _emails(spark, folder).select("fila", "cli_email", "diagnostico")


@query
def email_summary(spark, folder):
    return analysis.diagnosis_summary(_emails(spark, folder), email.VALID, email.BLANK)


@query
def email_detail(spark, folder):
    return analysis.diagnosis_detail(_emails(spark, folder), email.VALID, email.BLANK)


@query
def phone_hn_diagnosis(spark, folder):
    return _phone_rows(spark, folder).select(
        "origen", "fila", phone.diagnose_hn(F.col("telefono")).alias("diagnostico")
    )


@query
def phone_diagnosis(spark, folder):
    return _phones(spark, folder).select("origen", "fila", "diagnostico")


@query
def phone_plan_diagnosis(spark, folder):
    """Every customer has one of the numbers judged by hand; the plan is joined as a table."""
    numbers = [f"+{code} {n}" for plan in (phone_numbers.BY_HAND, phone_numbers.BY_LENGTH) for code in plan for n in plan[code]]
    numbers += [f"+{n}" for n in phone_numbers.UNASSIGNED]
    one = F.element_at(F.array(*map(F.lit, numbers)), (F.col("c_custkey") % len(numbers) + 1).cast("int"))
    given = table(spark, folder, "customer").select(F.col("c_custkey").alias("fila"), one.alias("telefono"))
    return phone.with_plan_diagnosis(given, "telefono")


@query
def phone_summary(spark, folder):
    return analysis.diagnosis_summary(_phones(spark, folder), phone.VALID, phone.BLANK)


@query
def phone_detail(spark, folder):
    return analysis.diagnosis_detail(_phones(spark, folder), phone.VALID, phone.BLANK)


# ---------------------------------------------------------------- analysis


def _clientes_analysis(spark, folder, name="clientes_full") -> Analysis:
    return Analysis(clientes(spark, folder), ASSIGNMENTS[name])


def _proveedores_analysis(spark, folder) -> Analysis:
    return Analysis(proveedores(spark, folder), ASSIGNMENTS["proveedores_full"])


@query
def row_category(spark, folder):
    return _clientes_analysis(spark, folder).row_categories("fila").drop("algun_error")


@query
def sql_row_category(spark, folder):
    """The categories of all analysed columns from SQL text alone."""
    names = sql_functions.function_name
    sql_functions.register_functions(spark)
    cases = []
    for c, rules in ASSIGNMENTS["clientes_full"].items():
        tests = " ".join(f"WHEN {names(rule)}({c}) THEN '{rule}'" for rule in rules)
        cases.append(f"CASE {tests} ELSE 'Correcto' END AS categoria_{c}")
    return spark.sql(f"SELECT fila, {', '.join(cases)} FROM {{clientes}}", clientes=clientes(spark, folder))


@query
def sql_diagnoses(spark, folder):
    """Diagnoses, safe names and rules with a parameter, in SQL; a filter by a rule."""
    sql_functions.register_functions(spark)
    return spark.sql(
        "SELECT fila, diagnostico_email(cli_email) AS email, diagnostico_telefono(cli_telefono) AS telefono, "
        "nombre_seguro(cli_nombre) AS nombre, regla_longitud_mayor_a_n(cli_nombre, 10) AS largo, "
        "regla_contiene_un_valor_especifico(cli_direccion, 'méxico') AS mexico FROM {clientes} "
        "WHERE NOT regla_vacios(cli_nombre)",
        clientes=clientes(spark, folder),
    )


@query
def row_any_error(spark, folder):
    small = _clientes_analysis(spark, folder, "clientes_small")
    return small.row_categories("fila").select("fila", "algun_error")


@query
def error_rows(spark, folder):
    detail = _proveedores_analysis(spark, folder).detail("pro_codigo")
    return detail.select("fila_excel", "pro_codigo", "pro_nombrech", "categoria_error")


@query
def error_report(spark, folder):
    report = tables.error_report(_proveedores_analysis(spark, folder))
    return report.select("hoja", "columna", "fila", "pro_codigo", "pro_nit", "categoria_error")


@query
def error_report_written(spark, folder):
    """The written report, read back."""
    path = scratch_path(spark, "informe")
    tables.write_error_report(_clientes_analysis(spark, folder), path)
    return spark.read.parquet(path).groupBy("hoja", "categoria_error").agg(
        F.count(F.lit(1)).alias("filas")
    )


@query
def category_distribution(spark, folder):
    return _clientes_analysis(spark, folder).category_distribution()


@query
def column_error_rate(spark, folder):
    return _clientes_analysis(spark, folder).column_error_rate()


@query
def stream_error_rate(spark, folder):
    """Customers that arrive in two loads; the second run starts anew from the checkpoint."""
    given, target = clientes(spark, folder), scratch_path(spark, "flujo")
    rules = ASSIGNMENTS["clientes_full"]
    for part in (0, 1):
        given.filter(F.col("fila") % 2 == part).write.mode("append").parquet(f"{target}/llegadas")
        loads.StreamedAnalysis(spark, given.schema, rules, target).run_available(f"{target}/llegadas")
    return loads.StreamedAnalysis(spark, given.schema, rules, target).column_error_rate()


@query
def column_error_rate_prefiltered(spark, folder):
    """Filter first, then rules: duplicates and percentages refer to the rows kept."""
    kept = rows.keep_values(clientes(spark, folder), "segmento", ["BUILDING", "MACHINERY"])
    return Analysis(kept, ASSIGNMENTS["clientes_small"]).column_error_rate()


@query
def overall_good_bad(spark, folder):
    return _clientes_analysis(spark, folder, "clientes_small").overall()


@query
def overall_shares(spark, folder):
    return _clientes_analysis(spark, folder, "clientes_small").overall_shares()


@query
def analysis_summary(spark, folder):
    return _proveedores_analysis(spark, folder).summary()


@query
def clean_columns(spark, folder):
    return _clientes_analysis(spark, folder, "clientes_clean").clean_columns()


@query
def report_labels(spark, folder):
    """Sections of a report over columns whose names are no sheet names."""
    awkward = {
        "cli_codigo": "Código: cliente / cuenta contable principal",
        "cli_nombre": "Código: cliente / cuenta contable auxiliar",
        "cli_direccion": "Código? cliente * cuenta contable de mayor",
        "cli_nit": "[ ]",
        "cli_email": "   ",
    }
    df = clientes(spark, folder).withColumnsRenamed(awkward)
    rules = {new: ["Vacíos"] for new in awkward.values()}
    return tables.error_report(Analysis(df, rules)).groupBy("columna", "hoja").agg(
        F.count(F.lit(1)).alias("filas")
    )


@query
def dynamic_rules(spark, folder):
    rules = {
        "text": ["Vacíos", "Longitud mayor a N", "Longitud menor a N"],
        "lang": ["Duplicados", "Solo letras"],
        "source": ["Contiene un valor específico", "Solo números", "Contiene letras"],
        "doc_id": ["ID (vacíos + duplicados)", "Longitud mayor a N"],
    }
    parameters = {
        ("text", "Longitud mayor a N"): 2000,
        ("text", "Longitud menor a N"): 200,
        ("source", "Contiene un valor específico"): "web",
        ("doc_id", "Longitud mayor a N"): 2,
    }
    return Analysis(table(spark, folder, "documents"), rules, parameters).category_distribution()


# ---------------------------------------------------------------- metrics and profile


@query
def quality_metrics(spark, folder):
    return metrics.quality_metrics(clientes(spark, folder), "cli_nombre")


@query
def quality_metrics_documents(spark, folder):
    return metrics.quality_metrics(table(spark, folder, "documents").select("text"), "text")


@query
def quality_metrics_all(spark, folder):
    return metrics.quality_metrics_all(clientes(spark, folder).drop("fila"))


@query
def quality_metrics_all_documents(spark, folder):
    return metrics.quality_metrics_all(table(spark, folder, "documents"))


@query
def profile_overview(spark, folder):
    return profile.overview(clientes(spark, folder))


@query
def profile_types(spark, folder):
    return profile.types(table(spark, folder, "lineitem"))


@query
def profile_histogram(spark, folder):
    return profile.histogram(table(spark, folder, "lineitem"), "l_quantity").select(
        "tramo", F.round("desde", 6).alias("desde"), F.round("hasta", 6).alias("hasta"), "cantidad"
    )


def _with_gaps(spark, folder) -> DataFrame:
    """Line items with NaN, infinite and null prices."""
    k = F.col("l_orderkey")
    price = (
        F.when(k % 50 == 3, F.lit(float("nan")))
        .when(k % 50 == 4, F.lit(float("inf")))
        .when(k % 50 == 5, F.lit(float("-inf")))
        .when(k % 50 != 6, F.col("l_extendedprice"))
    )
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", price.alias("precio"))


@query
def profile_histogram_gaps(spark, folder):
    return profile.histogram(_with_gaps(spark, folder), "precio").select(
        "tramo", F.round("desde", 6).alias("desde"), F.round("hasta", 6).alias("hasta"), "cantidad", "fuera"
    )


@query
def profile_overview_gaps(spark, folder):
    return profile.overview(_with_gaps(spark, folder))


@query
def quality_metrics_gaps(spark, folder):
    return metrics.quality_metrics_all(_with_gaps(spark, folder), ["precio"])


@query
def profile_columns_gaps(spark, folder):
    """NaN is missing; infinite prices are left out here, their mean is not a number."""
    df = _with_gaps(spark, folder).filter(~F.col("precio").isin(float("inf"), float("-inf")) | F.col("precio").isNull())
    found = _rounded(profile.columns_profile(df)).filter("columna = 'precio'")
    return found.select("columna", "vacios", "unicos", "duplicados", "cantidad", "minimo", "maximo")


@query
def profile_lengths(spark, folder):
    return profile.lengths(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"])


def _rounded(df: DataFrame) -> DataFrame:
    measures = ("media", "desviacion", "minimo", "p25", "p50", "p75", "maximo")
    return df.withColumns({m: F.round(m, 4) for m in measures})


@query
def profile_columns(spark, folder):
    return _rounded(profile.columns_profile(table(spark, folder, "orders")))


@query
def profile_columns_lineitem(spark, folder):
    return _rounded(profile.columns_profile(table(spark, folder, "lineitem")))


def _merged_loads(spark, folder, name: str, key: str) -> DataFrame:
    """State of a table that came in three loads, the last of them stored twice."""
    path, df = scratch_path(spark, "cargas"), table(spark, folder, name)
    for k in (0, 1, 2, 2):
        incremental.store_load(df.filter(F.col(key) % 3 == k), path, f"carga_{k}")
    return incremental.read_loads(spark, path)


def _near(exact: str):
    return F.abs(F.col("unicos") - F.col(exact)) <= 0.03 * F.col(exact)


@query
def profile_merged_loads(spark, folder):
    """Merged loads equal the whole table: counts and moments exactly, distinct values within 3 %,
    quartiles within 1 % of the ranks."""
    df = table(spark, folder, "lineitem")
    found = _rounded(incremental.finish_profile(_merged_loads(spark, folder, "lineitem", "l_orderkey")))
    exact = profile.columns_profile(df).select("columna", F.col("unicos").alias("exactos"))
    numbers = [r["columna"] for r in found.filter("cantidad IS NOT NULL").select("columna").collect()]
    edges = quantiles.exact_quantiles(df, numbers, [0.24, 0.26, 0.49, 0.51, 0.74, 0.76])
    bounds = spark.createDataFrame([(c, e) for c, e in edges.items()], "columna string, e array<double>")
    inside = [F.col(p).between(F.round(F.col("e")[2 * i], 4), F.round(F.col("e")[2 * i + 1], 4)) for i, p in enumerate(("p25", "p50", "p75"))]
    joined = found.join(exact, "columna").join(F.broadcast(bounds), "columna", "left")
    return joined.select(
        "columna", "tipo", "vacios", "cantidad", "media", "desviacion", "minimo", "maximo",
        _near("exactos").alias("unicos_dentro"),
        F.coalesce(inside[0] & inside[1] & inside[2], F.lit(True)).alias("cuartiles_dentro"),
    )


@query
def metrics_merged_loads(spark, folder):
    """The metrics of merged loads; distinct values within 3 %, repeats follow from them."""
    found = incremental.finish_metrics(_merged_loads(spark, folder, "documents", "doc_id"))
    exact = metrics.quality_metrics_all(table(spark, folder, "documents")).select("columna", F.col("unicos").alias("exactos"))
    near = found.join(exact, "columna").withColumn("unicos_dentro", _near("exactos"))
    return near.drop("unicos", "duplicados", "exactos")


@query
def report_columns(spark, folder):
    rules = {"p_name": ["Duplicados"], "p_brand": ["Caracteres especiales / símbolos"]}
    return _rounded(profile.columns_report(table(spark, folder, "part"), rules))


# ---------------------------------------------------------------- text, names, countries, dates


def _documents_text(name: str, function) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, "documents").select("doc_id", "text").select(
            "doc_id", function(F.col("text")).alias("texto")
        )

    run.__name__ = name
    query(run)


_documents_text("text_upper", F.upper)
_documents_text("text_lower", F.lower)
_documents_text("text_clean", text.clean_text)
_documents_text("text_fold", text.fold_text)
_documents_text("text_fold_expanding", lambda c: text.fold_text(F.concat(c, F.lit(" … ½ ﬁn №"), c)))
_documents_text("replace_substring", lambda c: text.replace_part(c, ". ", " $1\\ "))


@query
def split_name(spark, folder):
    name = F.col("cli_nombre")
    return clientes(spark, folder).select(
        "fila", text.first_word(name).alias("nombre"), text.other_words(name).alias("apellido")
    )


@query
def safe_name(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", text.safe_name(F.concat(F.lit(" "), "url", F.lit(" "))).alias("clave")
    )


@query
def replace_exact(spark, folder):
    replaced = rows.replace_values(
        table(spark, folder, "orders"), "1-URGENT", "URGENTE", ["o_orderpriority"]
    )
    return replaced.select("o_orderkey", "o_orderpriority")


@query
def replace_all_columns(spark, folder):
    df = clientes(spark, folder)
    exact = rows.replace_values(df, "Cher", "CHER")
    return rows.replace_values(exact, "a", "(a)", exact=False)


@query
def country_code(spark, folder):
    coded = country.with_country_code(clientes(spark, folder), "cli_direccion")
    return coded.select("fila", "cli_direccion", "pais_codigo")


def _gazetteer(spark, folder) -> DataFrame:
    """Nation names and city names of the customers, numbered."""
    nations = table(spark, folder, "nation")
    return nations.select(
        F.lower("n_name").alias("nombre"), F.concat(F.lit("N"), "n_nationkey").alias("codigo"),
        F.col("n_nationkey").alias("pos"),
    )


@query
def country_code_table(spark, folder):
    """Names from a table: the nation of each customer written into an address."""
    addresses = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("fila"),
        F.concat(F.lit("Av. Núñez, NATION_"), "c_nationkey", F.lit(", piso 3")).alias("direccion"),
    )
    return country.with_country_code_from(addresses, "direccion", _gazetteer(spark, folder))


@query
def country_code_many_names(spark, folder):
    """A street for every order, some repeated or without a code, in long and repeated addresses."""
    k = F.col("o_orderkey")
    streets = table(spark, folder, "orders").select(
        F.concat(F.lit("calle "), k).alias("nombre"),
        F.when(k % 10 != 3, F.concat(F.lit("O"), k % 1000)).alias("codigo"),
        k.alias("pos"),
    )
    again = streets.select("nombre", F.lit("repetido").alias("codigo"), (F.col("pos") + 10_000_000).alias("pos"))
    addresses = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("fila"),
        F.when(
            F.col("c_custkey") % 11 != 0,
            F.concat(
                F.repeat(F.lit("Niño perdido; "), (F.col("c_custkey") % 97).cast("int")),
                F.lit("CÁLLE "), F.col("c_custkey") * 3, F.lit(", calle "), F.col("c_nationkey") * 7,
            ),
        ).alias("direccion"),
    )
    return country.with_country_code_from(addresses, "direccion", streets.unionByName(again))


@query
def country_unmatched(spark, folder):
    coded = country.with_country_code(clientes(spark, folder), "cli_direccion")
    return country.count_unmatched(coded)


@query
def dates_column(spark, folder):
    df = clientes(spark, folder).select("fila", F.col("cli_fecha").alias("fecha"))
    return dates.standardise(df, ["fecha"])


@query
def dates_column_dayfirst(spark, folder):
    """Day before month wherever that makes a date, also in dates that begin with the year."""
    df = clientes(spark, folder).select("fila", F.col("cli_fecha").alias("fecha"))
    return dates.standardise(df, ["fecha"], preset=dates.DAYFIRST_COMPAT)


@query
def dates_all_columns(spark, folder):
    plan = CleaningPlan(dates=ALL_TEXT, date_format="YYYY-MM-DD")
    return plan.apply(
        clientes(spark, folder).select("fila", "cli_fecha", "cli_telefono", "cli_codigo", "segmento")
    )


@query
def dates_formats(spark, folder):
    """Order dates as text, read once and written in every target format."""
    text_date = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("fecha")
    df = table(spark, folder, "orders").select("o_orderkey", text_date)
    return dates.to_formats(df, "fecha", {f"f{i}": t for i, t in enumerate(dates.TARGETS)}).drop("fecha")


# ---------------------------------------------------------------- rows and columns


@query
def prefilter_isin(spark, folder):
    kept = rows.keep_values(table(spark, folder, "events"), "event_type", ["click", "error"])
    return kept.select("event_id", "event_type", "user_id")


@query
def prefilter_count(spark, folder):
    return rows.count_kept(table(spark, folder, "events"), "event_type", ["click", "error"])


@query
def distinct_values(spark, folder):
    return rows.distinct_values(table(spark, folder, "documents"), "source", "doc_id")


@query
def preview_rows(spark, folder):
    return rows.preview(clientes(spark, folder), 20)


@query
def drop_columns(spark, folder):
    return rows.drop_columns(clientes(spark, folder), ["cli_fecha", "cli_email", "no_existe"])


@query
def clean_column_names(spark, folder):
    df = clientes(spark, folder).select(
        "fila",
        F.col("cli_codigo").alias("Código del Cliente"),
        F.col("cli_nit").alias("cli_nit"),
        F.col("segmento").alias("Año / Señal  (%)"),
        F.col("entero_txt").alias("CLI-NIT"),
        F.col("decimal_txt").alias("%%"),
    )
    return rows.clean_column_names(df)


@query
def fill_nulls(spark, folder):
    return rows.fill_nulls(clientes(spark, folder), "N/A", skip=["fila"])


@query
def row_number_excel(spark, folder):
    numbered = numbering.read_parquet_numbered(spark, f"{folder}/orders.parquet")
    return numbered.select(
        numbering.sheet_row(F.col("fila")).alias("fila_excel"), "fila", "o_orderkey"
    )


@query
def row_number_stored(spark, folder):
    """Rows after a shuffle have no order of their own: their numbers are a permutation."""
    rows = table(spark, folder, "lineitem")
    shuffled = rows.repartition(max(5, -(-rows.count() // 500_000)), "l_partkey")
    return numbering.with_row_number(shuffled).agg(
        F.count(F.lit(1)).alias("filas"),
        F.count_distinct("fila").alias("distintas"),
        F.min("fila").alias("primera"),
        F.max("fila").alias("ultima"),
    )


@query
def drop_empty_rows(spark, folder):
    df = clientes(spark, folder).select("fila", "cli_nombre", "cli_email", "cli_telefono")
    return rows.drop_empty_rows(df, ["cli_nombre", "cli_email", "cli_telefono"], how="any")


@query
def drop_duplicate_rows(spark, folder):
    return rows.drop_duplicate_rows(
        table(spark, folder, "documents").select("doc_id", "text"), order="doc_id"
    )


@query
def drop_duplicate_rows_by_key(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    return rows.drop_duplicate_rows(df, ["p_name", "p_brand"], order="p_partkey")


@query
def drop_duplicate_rows_ties(spark, folder):
    """Order null for whole groups, partly null, and tied; cells follow from key and order."""
    k = F.col("l_partkey")
    order = F.when((k % 3 != 0) & (F.col("l_linenumber") != 2), F.col("l_linenumber"))
    df = table(spark, folder, "lineitem").select(
        k.alias("clave"), order.alias("orden"),
        F.concat_ws("/", k, F.coalesce(order.cast("string"), F.lit("sin"))).alias("celda"),
    )
    return rows.drop_duplicate_rows(df, ["clave"], order="orden")


@query
def etl_impact(spark, folder):
    plan = CleaningPlan(
        keep=("segmento", ["BUILDING"]), drop=["cli_fecha"], country="cli_direccion",
        split_name="cli_nombre",
    )
    return plan.impact(clientes(spark, folder))


def _full_plan() -> CleaningPlan:
    return CleaningPlan(
        keep=("segmento", ["BUILDING", "MACHINERY", "AUTOMOBILE"]),
        drop=["mixto_txt", "decimal_txt", "entero_txt", "cod_con_ceros", "cli_email"],
        clean_names=True,
        clean_text=True,
        upper=True,
        fill="N/A",
        country="cli_direccion",
        split_name="cli_nombre",
        dates="cli_fecha",
        replace=Replacement("CF", "CONSUMIDOR FINAL", "cli_nit"),
    )


@query
def clean_table(spark, folder):
    return _full_plan().apply(clientes(spark, folder))


@query
def clean_then_validate(spark, folder):
    cleaned = tables.publish(_full_plan().apply(clientes(spark, folder)), "clientes_limpios")
    rules = {
        "clicodigo": ["Vacíos", "Duplicados"],
        "clitelefono": ["Teléfono"],
        "apellido": ["Vacíos"],
    }
    return Analysis(cleaned, rules).category_distribution()


@query
def master_customers(spark, folder):
    return master.customers(clientes(spark, folder), "cli_nombre", "cli_email")


@query
def master_suppliers(spark, folder):
    return master.suppliers(proveedores(spark, folder), "pro_nit", "pro_pais")


@query
def master_products(spark, folder):
    priced = table(spark, folder, "part").select(
        F.col("p_partkey").alias("fila"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("codigo"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice") - 1000).alias("precio"),
    )
    return master.products(priced, "codigo", "precio")


# ---------------------------------------------------------------- ingest and sinks


@query
def normalize_null_tokens(spark, folder):
    df = faltantes(spark, folder)
    return df.select(
        "fila", *[text.null_tokens_to_null(F.col(c)).alias(c) for c in ("estado", "prioridad")]
    )


@query
def detect_leading_zero(spark, folder):
    return promotion.leading_zeros(
        clientes(spark, folder).select("cod_con_ceros", "entero_txt", "decimal_txt", "mixto_txt")
    )


@query
def promote_types(spark, folder):
    typed, _ = promotion.promote_types(
        clientes(spark, folder).select(
            "fila", "cod_con_ceros", "entero_txt", "decimal_txt", "mixto_txt"
        )
    )
    return typed


@query
def promote_types_notice(spark, folder):
    return promotion.promote_types(clientes(spark, folder))[1]


def _written(spark, df: DataFrame, order: str, name: str) -> str:
    """The table as delimited files whose paths follow ``order``."""
    path = scratch_path(spark, name)
    files = max(4, -(-df.count() // 50_000))
    tables.write_csv(df.repartitionByRange(files, order).sortWithinPartitions(order), path)
    return path


@query
def ingest_csv_text(spark, folder):
    """A written table read back as text; its own row number column is kept as ``id``."""
    df = clientes(spark, folder).withColumnRenamed("fila", "id")
    return delimited.read_delimited(spark, _written(spark, df, "id", "clientes")).rows


@query
def ingest_csv_rows(spark, folder):
    """Row numbers over all files of an ingested table."""
    path = _written(spark, table(spark, folder, "orders"), "o_orderkey", "orders")
    return delimited.read_delimited(spark, path).rows.select("fila", "o_orderkey")


@query
def ingest_csv_multiline(spark, folder):
    """Whole texts with line breaks and quotes inside."""
    df = table(spark, folder, "documents").select("doc_id", "lang", "text")
    path = _written(spark, df, "doc_id", "documents")
    return delimited.read_delimited(spark, path, null_tokens=False).rows


@query
def ingest_header_offset_multiline(spark, folder):
    """A title with a line break, a blank line and a skipped record above texts with line breaks."""
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines = table(spark, folder, "documents").select(
        F.col("doc_id").alias("orden"),
        F.to_csv(F.struct("doc_id", "lang", "text"), options).alias("linea"),
    )
    preamble = ['"Informe\nde textos",', "", "doc_id,lang,text", '-,"-\n\n-",-']
    path = _write_lines(spark, lines, preamble)
    read = delimited.read_delimited(spark, path, header_row=1, skip_rows=(3,), null_tokens=False)
    return read.rows


@query
def ingest_stray_quote(spark, folder):
    """Inch marks in plain fields beside files with quoted line breaks."""
    k = F.col("p_partkey")
    cell = (
        F.when(k % 7 == 0, F.concat((k % 40).cast("string"), F.lit('" pipe')))
        .when(k % 50 == 1, F.concat(F.lit('"two\nlines '), k, F.lit('"')))
        .otherwise(F.col("p_name"))
    )
    lines = table(spark, folder, "part").select(
        k.alias("orden"), F.concat(k, F.lit(","), cell, F.lit(","), "p_size").alias("linea")
    )
    path = _write_lines(spark, lines, ["k,nombre,medida"], per_file=500)
    return delimited.read_delimited(spark, path).rows


@query
def ingest_mixed_headers(spark, folder):
    """Files with their columns in another order, and with one more."""
    path = scratch_path(spark, "mezcla")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    for part, columns in enumerate((("o_orderkey", "o_orderstatus"), ("o_orderstatus", "o_orderkey", "o_orderpriority"))):
        chosen = orders.filter(F.col("o_orderkey") % 2 == part).select(*columns)
        ordered = chosen.coalesce(1).sortWithinPartitions("o_orderkey")
        tables.write_csv(ordered, f"{path}/parte={part}")
    return delimited.read_delimited(spark, path).rows


def _write_lines(spark, lines: DataFrame, preamble: list[str], per_file: int = 100_000) -> str:
    """Writes (orden, linea) as text files that each start with the preamble."""
    path = scratch_path(spark, "lineas")
    data = lines.select(
        F.lpad(F.floor(F.col("orden") / per_file).cast("string"), 8, "0").alias("cubo"), "orden", "linea"
    )
    first = data.select("cubo").distinct()
    heads = first.select(
        "cubo", F.posexplode(F.array(*[F.lit(p) for p in preamble])).alias("p", "linea")
    ).select("cubo", (F.col("p") - len(preamble)).cast("long").alias("orden"), "linea")
    (
        heads.unionByName(data)
        .repartition("cubo")
        .sortWithinPartitions("cubo", "orden")
        .select("cubo", "linea")
        .write.partitionBy("cubo")
        .text(path)
    )
    return path


def _client_lines(spark, folder) -> DataFrame:
    df = clientes(spark, folder)
    cells = F.struct(F.col("fila").alias("id"), "cli_codigo", "cli_nombre", "cli_direccion")
    options = {
        "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    return df.select(F.col("fila").alias("orden"), F.to_csv(cells, options).alias("linea"))


_HEADER = "id,cli_codigo,cli_nombre,cli_direccion"


@query
def ingest_header_offset(spark, folder):
    path = _write_lines(spark, _client_lines(spark, folder), ["Informe", "", "Hoja 1", _HEADER])
    return delimited.read_delimited(spark, path, header_row=2).rows


@query
def ingest_skip_rows(spark, folder):
    preamble = ["Informe", _HEADER, "unidades,-,-,-", "tipos,-,-,-"]
    path = _write_lines(spark, _client_lines(spark, folder), preamble)
    read = delimited.read_delimited(spark, path, header_row=1, skip_rows=(2, 3))
    return read.rows


def _uneven_lines(spark, folder) -> DataFrame:
    uneven = (
        F.when(F.col("o_orderkey") % 11 == 3, F.concat("o_orderkey", F.lit(',"a, b",x,sobra')))
        .when(F.col("o_orderkey") % 11 == 5, F.concat("o_orderkey", F.lit(",corta")))
        .otherwise(F.concat_ws(",", "o_orderkey", "o_orderstatus", "o_orderpriority"))
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("orden"), uneven.alias("linea")
    )


@query
def ingest_bad_records(spark, folder):
    path = _write_lines(spark, _uneven_lines(spark, folder), ["a,b,c"])
    return delimited.read_delimited(spark, path).bad


@query
def ingest_good_records(spark, folder):
    path = _write_lines(spark, _uneven_lines(spark, folder), ["a,b,c"])
    return delimited.read_delimited(spark, path).rows


def _quoted_lines(spark, folder) -> DataFrame:
    """Quoted line breaks, and near the end of each file two fields that open quotes and never close them."""
    k, size = F.col("p_partkey"), F.col("p_size")
    cell = (
        F.when(k % 50 == 1, F.concat(F.lit('"two\nlines '), k, F.lit('"')))
        .when(k % 100 == 80, F.lit('"abierta'))
        .when(k % 100 == 90, F.lit('x","y'))
        .otherwise(F.col("p_name"))
    )
    line = F.concat(k, F.lit(","), cell, F.lit(","), size)
    return table(spark, folder, "part").select(k.alias("orden"), line.alias("linea"))


@query
def ingest_unclosed_quote(spark, folder):
    """Rows behind a quote that is never closed are read as rows."""
    path = _write_lines(spark, _quoted_lines(spark, folder), ["k,nombre,medida"], per_file=100)
    return delimited.read_delimited(spark, path).rows


@query
def ingest_unclosed_quote_bad(spark, folder):
    path = _write_lines(spark, _quoted_lines(spark, folder), ["k,nombre,medida"], per_file=100)
    return delimited.read_delimited(spark, path).bad


def _odd_files(spark, folder) -> str:
    """Files of 25 customers: plain, marked UTF-8, UTF-16 with and without mark, Latin-1; one cut and
    one whole compressed copy of the first, an empty one, one without its header row."""
    k = F.col("c_custkey")
    lines = table(spark, folder, "customer").select(
        F.floor(k / 25).alias("n"), F.struct(k, F.concat_ws(",", k, F.lit("José"), "c_name").alias("l")).alias("linea")
    )
    whole = F.concat(
        F.lit("Informe\nid,descripción,nombre\n"), F.array_join(F.sort_array(F.collect_list("linea"))["l"], "\n"), F.lit("\n")
    )
    files = lines.groupBy("n").agg(whole.alias("texto"))
    mark, t = F.unhex(F.lit("EFBBBF")), F.col("texto")
    stored = (
        F.when(F.col("n") % 5 == 1, F.concat(mark, F.encode(t, "UTF-8")))
        .when(F.col("n") % 5 == 2, F.encode(t, "UTF-16"))
        .when(F.col("n") % 5 == 3, F.encode(t, "UTF-16BE"))
        .when(F.col("n") % 5 == 4, F.encode(t, "ISO-8859-1"))
        .otherwise(F.encode(t, "UTF-8"))
    )
    path = scratch_path(spark, "archivos")
    # The sink adds the last byte, a line end in all of these.
    value = F.expr("cast(substring(datos, 1, octet_length(datos) - 1) as string)")
    parts = files.withColumn("datos", stored).select(F.lpad(F.col("n").cast("string"), 8, "0").alias("cubo"), value.alias("v"))
    parts.repartition("cubo").write.partitionBy("cubo").option("lineSep", "\n").text(path)
    first = files.filter("n = 0").select(F.expr("left(texto, length(texto) - 1)"))
    first.write.option("compression", "gzip").text(f"{path}/cubo=zz_entero")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    (packed,) = [f.getPath() for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/cubo=zz_entero/part-*"))]
    source = fs.open(packed)
    half = source.readNBytes(fs.getFileStatus(packed).getLen() // 2)
    source.close()
    for name, data in (("zz_cortado/a.csv.gz", half), ("zz_vacio/a.csv", b""), ("zz_corto/a.csv", "Informe\n".encode())):
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/cubo={name}"))
        out.write(bytearray(data))
        out.close()
    return path


@query
def ingest_bad_files(spark, folder):
    """Every file with what is wrong with it and the rows read from it."""
    read = delimited.read_delimited_files(spark, _odd_files(spark, folder), header_row=1)
    return read.files.select(F.regexp_extract("archivo", "cubo=([a-z0-9_]+)", 1).alias("cubo"), "filas", "problema")


@query
def ingest_bad_files_rows(spark, folder):
    """The rows of the good files, numbered over them."""
    return delimited.read_delimited_files(spark, _odd_files(spark, folder), header_row=1).rows


def _xlsx(sheets: dict[str, pd.DataFrame]) -> bytes:
    """A small workbook with inline texts, for tests of the reader."""
    names = list(sheets)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        entries = "".join(
            f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1)
        )
        out.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{links}"><sheets>{entries}</sheets></workbook>',
        )
        targets = "".join(
            f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>'
            for i, _ in enumerate(names, 1)
        )
        out.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{targets}</Relationships>")
        for i, name in enumerate(names, 1):
            frame = sheets[name]
            body = []
            for r, row in enumerate([list(frame.columns), *frame.values.tolist()], 1):
                cells = []
                for c, value in enumerate(row):
                    at = f"{chr(65 + c)}{r}"
                    if value is None or value != value:
                        continue
                    if isinstance(value, (int, float)):
                        cells.append(f'<c r="{at}"><v>{value}</v></c>')
                    else:
                        cells.append(
                            f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">'
                            f"{escape(value)}</t></is></c>"
                        )
                body.append(f'<row r="{r}">{"".join(cells)}</row>')
            out.writestr(
                f"xl/worksheets/sheet{i}.xml",
                f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>',
            )
    return buffer.getvalue()


@query
def sink_csv(spark, folder):
    path = scratch_path(spark, "part")
    tables.write_csv(table(spark, folder, "part"), path)
    return spark.read.schema(table(spark, folder, "part").schema).csv(path, header=True, escape='"')


@query
def sink_parquet(spark, folder):
    path = scratch_path(spark, "part")
    tables.write_table(table(spark, folder, "part"), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- rule sets


def _documents(spark, folder) -> DataFrame:
    """One rule-set document per customer; every fifth is broken."""
    k, name = F.col("c_custkey"), F.col("c_name")
    rules = (
        '"asignaciones":{"cli_nit":["Vacíos","Longitud mayor a N"],"cli_codigo":["Duplicados"]}'
    )
    body = (
        F.when(k % 5 == 0, F.lit('{"tipo":"dashboard","nombre":'))
        .when(
            k % 5 == 1,
            F.concat(
                F.lit('{"tipo":"calidad","nombre":"'), name,
                F.lit('","fecha":"01/02/2026 10:00","columna":"cli_email","validar_email":true}'),
            ),
        )
        .when(k % 5 == 4, F.lit('{"tipo":"dashboard",' + rules + "}"))
        .otherwise(
            F.concat(
                F.lit('{"tipo":"dashboard","nombre":"'), name,
                F.lit('","fecha":"02/02/2026 10:00",' + rules
                      + ',"parametros":{"cli_nit":{"Longitud mayor a N":"'),
                (k % 20).cast("string"), F.lit('"}}}'),
            )
        )
    )
    return table(spark, folder, "customer").select(
        text.safe_name(name).alias("archivo"), body.alias("cuerpo")
    )


def _parsed(spark, folder) -> DataFrame:
    return rulesets.parse(_documents(spark, folder))


@query
def ruleset_rules(spark, folder):
    return rulesets.dashboard_rules(_parsed(spark, folder))


@query
def ruleset_quality(spark, folder):
    return rulesets.quality_settings(_parsed(spark, folder))


@query
def ruleset_list(spark, folder):
    return rulesets.listing(_parsed(spark, folder))


@query
def ruleset_list_kind(spark, folder):
    return rulesets.listing(_parsed(spark, folder), rulesets.QUALITY)


def _incoming(spark, folder) -> DataFrame:
    """Every third customer saves a rule set anew, every customer number 7 modulo 10 a new one."""
    k = F.col("c_custkey")
    chosen = table(spark, folder, "customer").filter((k % 3 == 0) | (k % 10 == 7))
    fields = chosen.select(
        F.lit(rulesets.DASHBOARD).alias("tipo"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), "c_name")).otherwise(
            F.concat(F.lit("nuevo/"), "c_name")
        ).alias("nombre"),
        F.lit("segmento").alias("columna"),
        F.lit(0).alias("pos"),
        F.lit("Vacíos").alias("regla"),
        F.lit(None).cast("string").alias("parametro"),
        F.lit(None).cast("boolean").alias("validar_email"),
        F.lit(None).cast("boolean").alias("validar_telefono"),
    )
    return rulesets.stamp(fields, F.lit("2026-03-04 05:06:07").cast("timestamp"))


@query
def ruleset_upsert(spark, folder):
    """The new version is written and read back."""
    path = scratch_path(spark, "reglas")
    stored = rulesets.as_table(_parsed(spark, folder))
    tables.write_table(rulesets.upsert(stored, _incoming(spark, folder)), path)
    return spark.read.parquet(path)


@query
def ruleset_upsert_last_wins(spark, folder):
    """Incoming rule sets whose names give one key, and the same names twice: the later one is stored."""
    first = _incoming(spark, folder)
    k = F.regexp_replace("nombre", "/", "_")
    later = first.filter(F.col("nombre").startswith("nuevo/")).withColumns({"nombre": k, "regla": F.lit("Email")})
    stored = rulesets.as_table(_parsed(spark, folder)).limit(0)
    both = [first.withColumn("orden", F.lit(2)), later.withColumn("orden", F.lit(3))]
    again = first.withColumns({"regla": F.lit("Duplicados"), "orden": F.lit(1)})
    incoming = both[1].unionByName(both[0]).unionByName(again)
    return rulesets.upsert(stored, incoming, "orden").select("clave", "nombre", "regla")


@query
def ruleset_saved(spark, folder):
    """Saved key by key: the second call replaces its own keys only."""
    path = scratch_path(spark, "reglas")
    rulesets.save(rulesets.as_table(_parsed(spark, folder)), path)
    rulesets.save(_incoming(spark, folder), path)
    return rulesets.saved(spark, path)


@query
def ruleset_apply_dashboard(spark, folder):
    """A stored rule set, read by its name and applied to the customers."""
    name = table(spark, folder, "customer").filter("c_custkey = 7").first()["c_name"]
    assignments, parameters = rulesets.load_assignments(_parsed(spark, folder), name)
    return Analysis(clientes(spark, folder), assignments, parameters).category_distribution()


@query
def ruleset_apply_quality(spark, folder):
    name = table(spark, folder, "customer").filter("c_custkey = 6").first()["c_name"]
    assignments = rulesets.quality_assignments(_parsed(spark, folder), name)
    return Analysis(clientes(spark, folder), assignments).category_distribution()


@query
def ruleset_exists(spark, folder):
    """Whether rule sets are stored under the names of all customers, written with spaces, and under another."""
    stored = _parsed(spark, folder).withColumnRenamed("archivo", "clave")
    names = table(spark, folder, "customer").select(F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("nombre"))
    names = names.unionByName(spark.range(1).select(F.lit("no hay").alias("nombre")))
    return rulesets.which_exist(stored, names)


def _unwanted(spark, folder) -> DataFrame:
    return (
        table(spark, folder, "customer")
        .filter(F.col("c_custkey") % 6 == 1)
        .select(F.concat("c_name", F.lit(" ")).alias("nombre"))
    )


@query
def ruleset_delete(spark, folder):
    stored = rulesets.as_table(_parsed(spark, folder))
    return rulesets.delete(stored, _unwanted(spark, folder))[0]


@query
def ruleset_delete_outcome(spark, folder):
    stored = rulesets.as_table(_parsed(spark, folder))
    return rulesets.delete(stored, _unwanted(spark, folder))[1]
