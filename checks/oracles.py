"""The same results in SQL, by query name.

Written from the meaning of each operator: plain windows, CASE chains and string functions, not a
rendering of the Spark plans.
"""

from __future__ import annotations

from pulcro.functions import email, phone
from pulcro.operators import analysis

from . import phone_numbers
from .views import ASSIGNMENTS, ctes

W = ctes()
ORACLES: dict[str, str] = {}

SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def add(name: str, sql: str) -> None:
    ORACLES[name] = f"{W} {sql}"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def blank(c: str) -> str:
    return f"({c} IS NULL OR {strip(c)} = '')"


def matches(c: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({c}, {q(pattern)}), false)"


HAS_DIGIT, HAS_LETTER, SPECIAL = r"\p{Nd}", "[A-Za-z]", "[^A-Za-z0-9 ]"
ONLY_DIGITS, ONLY_LETTERS = r"^\p{N}+$", r"^\p{L}+$"

# ---------------------------------------------------------------- row rules


def rule(name: str, test: str) -> None:
    add(name, f"SELECT fila, {test} AS marca FROM clientes")


rule("rule_blank", blank("cli_nombre"))
rule("rule_contains", "coalesce(contains(upper(cli_direccion), 'MÉXICO'), false)")
rule("rule_not_contains", "NOT coalesce(contains(upper(cli_direccion), 'A'), false)")
rule("rule_len_gt", "coalesce(length(cli_nombre) > 10, false)")
rule("rule_len_lt", "coalesce(length(cli_nombre) < 10, false)")
rule("rule_has_digit", matches("cli_nombre", HAS_DIGIT))
rule("rule_has_letter", matches("cli_telefono", HAS_LETTER))
rule("rule_only_digits", matches("cli_nit", ONLY_DIGITS))
rule("rule_only_letters", matches("cli_nombre", ONLY_LETTERS))
rule("rule_special_chars", matches("cli_nombre", SPECIAL))
rule("rule_text", f"({blank('cli_direccion')} OR {matches('cli_direccion', SPECIAL)})")
rule(
    "rule_id",
    f"({blank('cli_codigo')} OR count(*) OVER (PARTITION BY cli_codigo) > 1)",
)
add(
    "rule_duplicates",
    "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) > 1 AS marca FROM part",
)
add(
    "rule_duplicates_lineitem",
    "SELECT l_orderkey, l_linenumber, l_extendedprice, "
    "count(*) OVER (PARTITION BY l_orderkey) > 1 AS orden, "
    "count(*) OVER (PARTITION BY l_extendedprice) > 1 AS precio FROM lineitem",
)
add(
    "rule_duplicates_documents",
    "SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS repetido FROM documents",
)

# ---------------------------------------------------------------- diagnoses


def email_case(c: str) -> str:
    domain, ats = f"split_part({c}, '@', 2)", f"length({c}) - length(replace({c}, '@', ''))"
    ending = f"regexp_extract({domain}, '[^.]*$')"
    address = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
    return (
        f"CASE WHEN {blank(c)} THEN {q(email.BLANK)} "
        f"WHEN {c} <> {strip(c)} THEN {q(email.EXTRA_SPACE)} "
        f"WHEN {ats} = 0 THEN {q(email.NO_AT)} WHEN {ats} > 1 THEN {q(email.MANY_AT)} "
        f"WHEN split_part({c}, '@', 1) = '' THEN {q(email.NO_USER)} "
        f"WHEN {domain} = '' THEN {q(email.NO_DOMAIN)} "
        f"WHEN NOT contains({domain}, '.') THEN {q(email.NO_EXTENSION)} "
        f"WHEN length({ending}) < 2 OR NOT regexp_matches({ending}, '^\\p{{L}}+$') "
        f"THEN {q(email.BAD_EXTENSION)} "
        f"WHEN NOT regexp_matches({c}, {q(address)}) THEN {q(email.BAD_CHARACTERS)} "
        f"ELSE {q(email.VALID)} END"
    )


def hn_digits_case(n: str) -> str:
    firsts = ", ".join(q(d) for d in phone.HN_FIRST_DIGITS)
    return (
        f"WHEN length({n}) < 8 THEN {q(phone.HN_TOO_SHORT)} "
        f"WHEN length({n}) > 8 THEN {q(phone.HN_TOO_LONG)} "
        f"WHEN {n}[1] NOT IN ({firsts}) THEN {q(phone.HN_BAD_PREFIX)} ELSE {q(phone.VALID)} END"
    )


BOTH_VIEWS = (
    "SELECT 'cliente' AS origen, fila, cli_telefono AS telefono FROM clientes "
    "UNION ALL SELECT 'proveedor', fila, pro_telefono FROM proveedores"
)


def phones(columns: str, source: str = BOTH_VIEWS) -> str:
    """Phone numbers, by default of both views, with their steps as columns."""
    return (
        f"telefonos AS ({source}), "
        f"limpios AS (SELECT *, {strip('telefono')} AS t, "
        f"regexp_replace({strip('telefono')}, '[\\s.()-]', '', 'g') AS hn0, "
        f"regexp_replace({strip('telefono')}, '[\\s()-]', '', 'g') AS n FROM telefonos), "
        "partes AS (SELECT *, CASE WHEN hn0 LIKE '+504%' THEN hn0[5:] "
        "WHEN hn0 LIKE '504%' AND length(hn0) > 8 THEN hn0[4:] ELSE hn0 END AS hn, "
        "ltrim(n, '+') AS d FROM limpios), "
        f"diagnosticos AS (SELECT origen, fila, telefono, {columns} FROM partes)"
    )


HN_CASE = (
    f"CASE WHEN {blank('telefono')} THEN {q(phone.BLANK)} "
    f"WHEN NOT regexp_matches(hn, '^[0-9]+$') THEN {q(phone.BAD_CHARACTERS)} "
    + hn_digits_case("hn")
)
#: Expected labels, by hand, of every number of the views and of their cleaned form. A number with
#: a plus or of more than eight digits is international, others are numbers of Honduras.
PHONE_LABELS = {
    "9999-8888": "Válido", "2222 3333": "Válido", "22334455": "Válido", "99998888": "Válido",
    "+504 9999-8888": "Válido", "50422223333": "Válido", "+504 2222-3333": "Válido",
    "+504 3344-5566": "Válido", "(504) 9999-8888": "Válido", "504 99998888": "Válido",
    "504 22223333": "Válido", "504 33445566": "Válido",
    "5555-1234": "Prefijo no reconocido en Honduras", "55551234": "Prefijo no reconocido en Honduras",
    "999-888": "Muy corto (menos de 8 dígitos)", "999888": "Muy corto (menos de 8 dígitos)",
    "123": "Muy corto (menos de 8 dígitos)", "504 123": "Muy corto (menos de 8 dígitos)",
    "9999.8888": "Formato no permitido (use solo espacios, guiones o paréntesis)",
    "abc": "Formato no permitido (use solo espacios, guiones o paréntesis)",
    "ABC": "Formato no permitido (use solo espacios, guiones o paréntesis)",
    "N/A": "Formato no permitido (use solo espacios, guiones o paréntesis)",
    "9999-8888-": "Formato inválido (termina en separador sin dígito)",
    "+504 123": "Número con formato inválido para su país",
    "+999 123456": "Código de país inválido", "999 123456": "Código de país inválido",
}
PHONE_CASE = (
    f"CASE WHEN {blank('telefono')} THEN 'Vacío' "
    + " ".join(f"WHEN telefono = {q(n)} THEN {q(label)}" for n, label in PHONE_LABELS.items())
    + " END"
)


def summary_sql(source: str, valid: str, blank_label: str) -> str:
    return (
        f"SELECT count(*) AS total, count(*) FILTER (diagnostico = {q(valid)}) AS validos, "
        f"count(*) FILTER (diagnostico = {q(blank_label)}) AS vacios, "
        f"count(*) FILTER (diagnostico NOT IN ({q(valid)}, {q(blank_label)})) AS invalidos, "
        f"round_even((count(*) FILTER (diagnostico = {q(valid)}) / count(*) * 100)::DOUBLE, 2) "
        f"AS porcentaje_validos FROM {source}"
    )


EMAILS = f", correos AS (SELECT fila, cli_nombre, cli_email, {email_case('cli_email')} AS diagnostico FROM clientes)"
add("rule_email", f"SELECT fila, diagnostico NOT IN ('Válido', 'Vacío') AS marca FROM (SELECT fila, {email_case('cli_email')} AS diagnostico FROM clientes)")
ORACLES["email_diagnosis"] = f"{W}{EMAILS} SELECT fila, cli_email, diagnostico FROM correos"
ORACLES["email_summary"] = f"{W}{EMAILS} {summary_sql('correos', email.VALID, email.BLANK)}"
ORACLES["email_detail"] = (
    f"{W}{EMAILS} SELECT fila + 2 AS fila_excel, * FROM correos "
    "WHERE diagnostico NOT IN ('Válido', 'Vacío')"
)
ORACLES["phone_hn_diagnosis"] = (
    f"{W}, {phones(HN_CASE + ' AS diagnostico')} SELECT origen, fila, diagnostico FROM diagnosticos"
)
BAD_THERE, VALID_THERE = "Número con formato inválido para su país", "Válido"
JUDGED = [
    (f"+{code} {n}", label, basis if label == VALID_THERE else None)
    for plan, basis in ((phone_numbers.BY_HAND, "rango nacional"), (phone_numbers.BY_LENGTH, "solo longitud"))
    for code in plan
    for n, label in zip(plan[code], (VALID_THERE, BAD_THERE))
] + [(f"+{n}", "Código de país inválido", None) for n in phone_numbers.UNASSIGNED]
ORACLES["phone_plan_diagnosis"] = (
    "SELECT c_custkey AS fila, telefono, diagnostico, criterio FROM customer JOIN (VALUES "
    + ", ".join(f"({i}, {q(n)}, {q(label)}, {q(basis) if basis else 'NULL'})" for i, (n, label, basis) in enumerate(JUDGED))
    + f") AS v(i, telefono, diagnostico, criterio) ON i = c_custkey % {len(JUDGED)}"
)
PHONES = f", {phones(PHONE_CASE + ' AS diagnostico')}"
ORACLES["phone_diagnosis"] = f"{W}{PHONES} SELECT origen, fila, diagnostico FROM diagnosticos"
ORACLES["phone_summary"] = f"{W}{PHONES} {summary_sql('diagnosticos', phone.VALID, phone.BLANK)}"
ORACLES["phone_detail"] = (
    f"{W}{PHONES} SELECT fila + 2 AS fila_excel, origen, fila, telefono, diagnostico "
    "FROM diagnosticos WHERE diagnostico NOT IN ('Válido', 'Vacío')"
)
ORACLES["rule_phone"] = (
    f"{W}{PHONES} SELECT fila, diagnostico NOT IN ('Válido', 'Vacío') AS marca "
    "FROM diagnosticos WHERE origen = 'cliente'"
)

# ---------------------------------------------------------------- analysis


def test_of(name: str, c: str, parameter=None) -> str:
    cast = f"CAST({c} AS VARCHAR)"
    return {
        "Vacíos": blank(cast),
        "Duplicados": f"(count(*) OVER (PARTITION BY {c}) > 1)",
        "ID (vacíos + duplicados)": f"({blank(cast)} OR count(*) OVER (PARTITION BY {c}) > 1)",
        "Email": f"({email_case(c)} NOT IN ('Válido', 'Vacío'))",
        "Contiene letras": matches(cast, HAS_LETTER),
        "Solo letras": matches(cast, ONLY_LETTERS),
        "Solo números": matches(cast, ONLY_DIGITS),
        "Caracteres especiales / símbolos": matches(cast, SPECIAL),
        "Longitud mayor a N": f"coalesce(length({cast}) > {parameter}, false)",
        "Longitud menor a N": f"coalesce(length({cast}) < {parameter}, false)",
        "Contiene un valor específico": f"coalesce(contains(upper({cast}), upper('{parameter}')), false)",
    }[name]


def category(c: str, rules: list[str], parameters=None) -> str:
    branches = "".join(
        f"WHEN {test_of(r, c, (parameters or {}).get((c, r)))} THEN {q(r)} " for r in rules
    )
    return f"CASE {branches}ELSE '{analysis.CORRECT}' END"


def categories(source: str, assigned: dict, parameters=None, extra="*") -> str:
    """CTE ``cat``: the source rows with one category column per analysed column."""
    columns = ", ".join(
        f"{category(c, rules, parameters)} AS categoria_{c}" for c, rules in assigned.items()
    )
    return f"cat AS (SELECT {extra}, {columns} FROM {source})"


def long_form(assigned: dict) -> str:
    return "largo AS (" + " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS columna, categoria_{c} AS categoria FROM cat"
        for i, c in enumerate(assigned)
    ) + ")"


def distribution(source: str, assigned: dict, parameters=None) -> str:
    return (
        f"{categories(source, assigned, parameters)}, {long_form(assigned)} "
        "SELECT columna, categoria, count(*) AS cantidad, round_even((count(*) / "
        "(sum(count(*)) OVER (PARTITION BY columna)) * 100)::DOUBLE, 2) AS porcentaje "
        "FROM largo GROUP BY columna, categoria"
    )


def rates(source: str, assigned: dict) -> str:
    return (
        f"{categories(source, assigned)}, {long_form(assigned)}, "
        "tasas AS (SELECT columna, count(*) FILTER (categoria <> 'Correcto') AS errores, "
        "round_even((count(*) FILTER (categoria <> 'Correcto') / count(*) * 100)::DOUBLE, 2) "
        "AS porcentaje_error FROM largo GROUP BY columna)"
    )


FULL, SMALL = ASSIGNMENTS["clientes_full"], ASSIGNMENTS["clientes_small"]
SUPPLIERS, CLEAN = ASSIGNMENTS["proveedores_full"], ASSIGNMENTS["clientes_clean"]

SUPPLIER_PHONE = (
    f"{phones(PHONE_CASE + ' AS diagnostico')}, prov AS (SELECT p.*, d.diagnostico AS tel "
    "FROM proveedores p JOIN diagnosticos d ON d.fila = p.fila AND d.origen = 'proveedor')"
)


def supplier_categories() -> str:
    columns = []
    for c, rules in SUPPLIERS.items():
        if rules == ["Teléfono"]:
            columns.append(
                f"CASE WHEN tel NOT IN ('Válido', 'Vacío') THEN 'Teléfono' "
                f"ELSE 'Correcto' END AS categoria_{c}"
            )
        else:
            columns.append(f"{category(c, rules)} AS categoria_{c}")
    return f"cat AS (SELECT *, {', '.join(columns)} FROM prov)"


ORACLES["row_category"] = (
    f"{W}, {categories('clientes', FULL)} SELECT fila, "
    + ", ".join(f"categoria_{c}" for c in FULL)
    + " FROM cat"
)
ORACLES["sql_row_category"] = ORACLES["row_category"]
ORACLES["sql_diagnoses"] = (
    f"{W}{PHONES} SELECT c.fila, {email_case('cli_email')} AS email, d.diagnostico AS telefono, "
    "regexp_replace(trim(cli_nombre), '[^a-zA-Z0-9_-]', '_', 'g') AS nombre, length(cli_nombre) > 10 AS largo, "
    "coalesce(contains(upper(cli_direccion), 'MÉXICO'), false) AS mexico FROM clientes c JOIN diagnosticos d "
    f"ON d.origen = 'cliente' AND d.fila = c.fila WHERE NOT ({blank('cli_nombre')})"
)
ORACLES["row_any_error"] = (
    f"{W}, {categories('clientes', SMALL)} SELECT fila, "
    + " OR ".join(f"categoria_{c} <> 'Correcto'" for c in SMALL)
    + " AS algun_error FROM cat"
)
ORACLES["error_rows"] = (
    f"{W}, {SUPPLIER_PHONE}, {supplier_categories()} SELECT fila + 2 AS fila_excel, pro_codigo, "
    "pro_nombrech, categoria_pro_codigo AS categoria_error FROM cat "
    "WHERE categoria_pro_codigo <> 'Correcto'"
)
ORACLES["error_report"] = f"{W}, {SUPPLIER_PHONE}, {supplier_categories()} " + " UNION ALL ".join(
    f"SELECT '{c}' AS hoja, '{c}' AS columna, fila, pro_codigo, pro_nit, "
    f"categoria_{c} AS categoria_error FROM cat WHERE categoria_{c} <> 'Correcto'"
    for c in SUPPLIERS
)
ORACLES["error_report_written"] = (
    f"{W}, {categories('clientes', FULL)}, {long_form(FULL)} SELECT columna AS hoja, "
    "categoria AS categoria_error, count(*) AS filas FROM largo WHERE categoria <> 'Correcto' "
    "GROUP BY ALL"
)
ORACLES["category_distribution"] = f"{W}, {distribution('clientes', FULL)}"
ORACLES["column_error_rate"] = f"{W}, {rates('clientes', FULL)} SELECT * FROM tasas"
ORACLES["stream_error_rate"] = ORACLES["column_error_rate"]
ORACLES["column_error_rate_prefiltered"] = (
    f"{W}, elegidos AS (SELECT * FROM clientes WHERE segmento IN ('BUILDING', 'MACHINERY')), "
    f"{rates('elegidos', SMALL)} SELECT * FROM tasas"
)
BAD_SMALL = " OR ".join(f"categoria_{c} <> 'Correcto'" for c in SMALL)
ORACLES["overall_good_bad"] = (
    f"{W}, {categories('clientes', SMALL)} SELECT count(*) AS total, "
    f"count(*) FILTER (NOT ({BAD_SMALL})) AS buenas, count(*) FILTER ({BAD_SMALL}) AS malas, "
    f"round_even((count(*) FILTER (NOT ({BAD_SMALL})) / count(*) * 100)::DOUBLE, 1) "
    "AS porcentaje_bueno FROM cat"
)
ORACLES["overall_shares"] = (
    f"{W}, {categories('clientes', SMALL)} SELECT CASE WHEN {BAD_SMALL} THEN 'Malo' ELSE 'Bueno' "
    "END AS categoria, count(*) AS cantidad FROM cat GROUP BY 1"
)
BAD_SUPPLIER = " OR ".join(f"categoria_{c} <> 'Correcto'" for c in SUPPLIERS)
CELLS_SUPPLIER = " + ".join(f"count(*) FILTER (categoria_{c} <> 'Correcto')" for c in SUPPLIERS)
ORACLES["analysis_summary"] = (
    f"{W}, {SUPPLIER_PHONE}, {supplier_categories()} SELECT {len(SUPPLIERS)}::BIGINT "
    f"AS columnas_revisadas, {CELLS_SUPPLIER} AS errores_por_celda, "
    f"count(*) FILTER ({BAD_SUPPLIER}) AS filas_malas, count(*) AS filas FROM cat"
)
ORACLES["clean_columns"] = (
    f"{W}, {rates('clientes', CLEAN)} SELECT columna FROM tasas WHERE porcentaje_error = 0"
)
LABELS = (
    ("Código: cliente / cuenta contable principal", "Código_ cliente _ cuenta contab", "cli_codigo"),
    ("Código: cliente / cuenta contable auxiliar", "Código_ cliente _ cuenta cont_1", "cli_nombre"),
    ("Código? cliente * cuenta contable de mayor", "Código_ cliente _ cuenta cont_2", "cli_direccion"),
    ("[ ]", "_ _", "cli_nit"),
    ("   ", "hoja", "cli_email"),
)
add(
    "report_labels",
    " UNION ALL ".join(
        f"SELECT {q(name)} AS columna, {q(label)} AS hoja, count(*) AS filas FROM clientes "
        f"WHERE {blank(c)}"
        for name, label, c in LABELS
    ),
)
DYNAMIC = {
    "text": ["Vacíos", "Longitud mayor a N", "Longitud menor a N"],
    "lang": ["Duplicados", "Solo letras"],
    "source": ["Contiene un valor específico", "Solo números", "Contiene letras"],
    "doc_id": ["ID (vacíos + duplicados)", "Longitud mayor a N"],
}
ORACLES["dynamic_rules"] = f"{W}, " + distribution(
    "documents",
    DYNAMIC,
    {
        ("text", "Longitud mayor a N"): 2000,
        ("text", "Longitud menor a N"): 200,
        ("source", "Contiene un valor específico"): "web",
        ("doc_id", "Longitud mayor a N"): 2,
    },
)

# ---------------------------------------------------------------- metrics and profile


def metrics_sql(source: str, c: str, lengths: bool = False) -> str:
    t = f"CAST({c} AS VARCHAR)"
    counted = {
        "longitud_mayor": f"length({t}) > 10",
        "contiene_numeros": matches(t, HAS_DIGIT),
        "contiene_letras": matches(t, HAS_LETTER),
        "solo_numeros": matches(t, ONLY_DIGITS),
        "solo_letras": matches(t, ONLY_LETTERS),
        "caracteres_especiales": matches(t, SPECIAL),
    }
    named = f"'{c}' AS columna, " if lengths else ""
    bounds = (
        f", min(length({t}))::INTEGER AS longitud_minima, "
        f"max(length({t}))::INTEGER AS longitud_maxima"
        if lengths
        else ""
    )
    return (
        f"SELECT {named}count(*) FILTER ({c} IS NULL) AS vacios, "
        f"count(*) - count(DISTINCT {c}) - CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END "
        f"AS duplicados, count(DISTINCT {c}) AS unicos, "
        + ", ".join(f"count(*) FILTER ({test}) AS {name}" for name, test in counted.items())
        + f"{bounds} FROM {source}"
    )


CLIENT_COLUMNS = (
    "cli_codigo", "cli_nombre", "cli_direccion", "cli_nit", "cli_email", "cli_telefono",
    "cli_fecha", "cod_con_ceros", "entero_txt", "decimal_txt", "mixto_txt", "segmento",
)
add("quality_metrics", metrics_sql("clientes", "cli_nombre"))
add("quality_metrics_documents", metrics_sql("documents", "text"))
add(
    "quality_metrics_all",
    " UNION ALL ".join(metrics_sql("clientes", c, True) for c in CLIENT_COLUMNS),
)
add(
    "quality_metrics_all_documents",
    " UNION ALL ".join(
        metrics_sql("documents", c, True) for c in ("doc_id", "text", "lang", "source", "n_chars")
    ),
)
add(
    "profile_overview",
    "SELECT count(*) AS filas, 13::BIGINT AS columnas, "
    + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in ("fila", *CLIENT_COLUMNS))
    + " AS celdas_vacias FROM clientes",
)
LINE_TYPES = {
    "bigint": ("l_orderkey", "l_partkey", "l_suppkey"),
    "int": ("l_linenumber",),
    "double": ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    "string": ("l_returnflag", "l_linestatus"),
    "timestamp": ("l_shipdate",),
}
add(
    "profile_histogram",
    "SELECT tramo::INTEGER AS tramo, round(lo + tramo * w, 6) AS desde, "
    "round(lo + (tramo + 1) * w, 6) AS hasta, count(l_quantity) AS cantidad FROM "
    "(SELECT unnest(range(10)) AS tramo), "
    "(SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 10 AS w FROM lineitem) "
    "LEFT JOIN lineitem ON least(floor((l_quantity - lo) / w), 9) = tramo GROUP BY tramo, lo, w",
)
GAPS = (
    "(SELECT CASE l_orderkey % 50 WHEN 3 THEN 'nan'::DOUBLE WHEN 4 THEN 'inf'::DOUBLE "
    "WHEN 5 THEN '-inf'::DOUBLE WHEN 6 THEN NULL ELSE l_extendedprice END AS precio FROM lineitem)"
)
FINITE = f"(SELECT precio FROM {GAPS} WHERE isfinite(precio))"
add(
    "profile_histogram_gaps",
    "SELECT tramo::INTEGER AS tramo, round(lo + tramo * w, 6) AS desde, "
    "round(lo + (tramo + 1) * w, 6) AS hasta, count(precio) AS cantidad, "
    f"(SELECT count(*) FROM {GAPS} WHERE isinf(precio)) AS fuera FROM "
    "(SELECT unnest(range(10)) AS tramo), "
    f"(SELECT min(precio) AS lo, (max(precio) - min(precio)) / 10 AS w FROM {FINITE}) "
    f"LEFT JOIN {FINITE} ON least(floor((precio - lo) / w), 9) = tramo GROUP BY tramo, lo, w",
)
add(
    "profile_overview_gaps",
    "SELECT count(*) AS filas, 3::BIGINT AS columnas, "
    f"count(*) FILTER (precio IS NULL OR isnan(precio)) AS celdas_vacias FROM {GAPS}",
)
SHOWN = f"(SELECT CASE WHEN NOT isnan(precio) THEN precio END AS p FROM {GAPS})"
PRICE_TEXT = "(CASE WHEN isinf(p) THEN CASE WHEN p > 0 THEN 'Infinity' ELSE '-Infinity' END ELSE p::VARCHAR END)"
add(
    "quality_metrics_gaps",
    "SELECT 'precio' AS columna, count(*) FILTER (t IS NULL) AS vacios, "
    "count(*) - count(DISTINCT t) - CASE WHEN bool_or(t IS NULL) THEN 1 ELSE 0 END AS duplicados, "
    "count(DISTINCT t) AS unicos, count(*) FILTER (length(t) > 10) AS longitud_mayor, "
    "count(*) FILTER (regexp_matches(t, '[0-9]')) AS contiene_numeros, "
    "count(*) FILTER (regexp_matches(t, '[A-Za-z]')) AS contiene_letras, "
    "count(*) FILTER (regexp_matches(t, '^[0-9]+$')) AS solo_numeros, "
    "count(*) FILTER (regexp_matches(t, '^[A-Za-z]+$')) AS solo_letras, "
    "count(*) FILTER (regexp_matches(t, '[^A-Za-z0-9 ]')) AS caracteres_especiales, "
    "min(length(t))::INTEGER AS longitud_minima, max(length(t))::INTEGER AS longitud_maxima "
    f"FROM (SELECT {PRICE_TEXT} AS t FROM {SHOWN})",
)
add(
    "profile_columns_gaps",
    "SELECT 'precio' AS columna, count(*) FILTER (p IS NULL) AS vacios, "
    "count(DISTINCT p) AS unicos, count(*) - count(DISTINCT p) - "
    "CASE WHEN bool_or(p IS NULL) THEN 1 ELSE 0 END AS duplicados, count(p) AS cantidad, "
    f"min(p) AS minimo, max(p) AS maximo FROM {SHOWN} WHERE p IS NULL OR NOT isinf(p)",
)
add(
    "profile_lengths",
    " UNION ALL ".join(
        f"SELECT '{c}' AS columna, min(length({c}))::INTEGER AS longitud_minima, "
        f"max(length({c}))::INTEGER AS longitud_maxima FROM part"
        for c in ("p_name", "p_brand", "p_type")
    ),
)


def profile_sql(source: str, kinds: dict[str, tuple[str, ...]]) -> str:
    parts = []
    for kind, columns in kinds.items():
        for c in columns:
            base = (
                f"SELECT '{c}' AS columna, '{kind}' AS tipo, count(*) FILTER ({c} IS NULL) AS vacios, "
                f"count(DISTINCT {c}) AS unicos, count(*) - count(DISTINCT {c}) AS duplicados, "
            )
            if kind in ("bigint", "int", "double"):
                v = f"CAST({c} AS DOUBLE)"
                numbers = (
                    f"count({c}) AS cantidad, round(avg({v}), 4) AS media, "
                    f"round(stddev_samp({v}), 4) AS desviacion, round(min({v}), 4) AS minimo, "
                    + "".join(
                        f"round(quantile_cont({v}, {p}), 4) AS p{int(p * 100)}, "
                        for p in (0.25, 0.5, 0.75)
                    )
                    + f"round(max({v}), 4) AS maximo"
                )
            else:
                numbers = "NULL::BIGINT AS cantidad, " + ", ".join(
                    f"NULL::DOUBLE AS {m}"
                    for m in ("media", "desviacion", "minimo", "p25", "p50", "p75", "maximo")
                )
            parts.append(f"{base}{numbers} FROM {source}")
    return " UNION ALL ".join(parts)


ORDER_TYPES = {
    "bigint": ("o_orderkey", "o_custkey"),
    "double": ("o_totalprice",),
    "string": ("o_orderstatus", "o_orderpriority"),
    "timestamp": ("o_orderdate",),
}
add("profile_columns", profile_sql("orders", ORDER_TYPES))
add("profile_columns_lineitem", profile_sql("lineitem", LINE_TYPES))
ORACLES["profile_merged_loads"] = (
    "SELECT columna, tipo, vacios, cantidad, media, desviacion, minimo, maximo, true AS unicos_dentro, "
    f"true AS cuartiles_dentro FROM ({profile_sql('lineitem', LINE_TYPES)})"
)
ORACLES["metrics_merged_loads"] = (
    "SELECT * EXCLUDE (unicos, duplicados), true AS unicos_dentro FROM ("
    + " UNION ALL ".join(metrics_sql("documents", c, True) for c in ("doc_id", "text", "lang", "source", "n_chars"))
    + ")"
)
add(
    "profile_types",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS tipo, {len(cs)}::BIGINT AS columnas, "
        + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in cs)
        + " AS celdas_vacias FROM lineitem"
        for kind, cs in LINE_TYPES.items()
    ),
)
PART_TYPES = {
    "bigint": ("p_partkey",),
    "int": ("p_size",),
    "double": ("p_retailprice",),
    "string": ("p_name", "p_brand", "p_type"),
}
PART_RULES = {"p_name": ["Duplicados"], "p_brand": ["Caracteres especiales / símbolos"]}
ORACLES["report_columns"] = (
    f"{W}, {rates('part', PART_RULES)}, perfil AS ({profile_sql('part', PART_TYPES)}) "
    "SELECT perfil.*, errores, porcentaje_error FROM perfil LEFT JOIN tasas USING (columna)"
)

# ---------------------------------------------------------------- text, names, countries, dates


def documents(name: str, expression: str) -> None:
    add(name, f"SELECT doc_id, {expression} AS texto FROM documents")


documents("text_upper", "upper(replace(text, 'ß', 'SS'))")
documents("text_lower", "lower(text)")
CLEANED = "regexp_replace(strip_accents({c}), '[[:punct:]]', '', 'g')"


def clean(c: str) -> str:
    return f"trim(regexp_replace({CLEANED.format(c=c)}, '{SPACE}+', ' ', 'g'))"


documents("text_clean", clean("text"))
documents("text_fold", "strip_accents(lower(text))")
documents(
    "text_fold_expanding",
    "strip_accents(lower(text)) || ' ... 1' || chr(8260) || '2 fin No' || strip_accents(lower(text))",
)
documents("replace_substring", r"replace(text, '. ', ' $1\ ')")
NAME = strip("cli_nombre")
add(
    "split_name",
    f"SELECT fila, nullif(regexp_extract({NAME}, '^{NOT_SPACE}+'), '') AS nombre, "
    f"nullif(regexp_replace({NAME}, '^{NOT_SPACE}+{SPACE}*', ''), '') AS apellido FROM clientes",
)
add("safe_name", "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS clave FROM pages")
add(
    "replace_exact",
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENTE' "
    "ELSE o_orderpriority END AS o_orderpriority FROM orders",
)
add(
    "replace_all_columns",
    "SELECT fila, "
    + ", ".join(
        f"replace(CASE WHEN {c} = 'Cher' THEN 'CHER' ELSE {c} END, 'a', '(a)') AS {c}"
        for c in CLIENT_COLUMNS
    )
    + " FROM clientes",
)


#: Expected codes, by hand, of the addresses in the order of the view; `usa` is in Jerusalem and
#: `uk` in Ukraine.
COUNTRY = (
    "CASE fila % 12 WHEN 1 THEN 'HN' WHEN 2 THEN 'MX' WHEN 3 THEN 'US' WHEN 4 THEN 'PA' "
    "WHEN 5 THEN 'ES' WHEN 6 THEN 'US' WHEN 7 THEN 'GB' WHEN 9 THEN 'VG' WHEN 10 THEN 'HN' "
    "WHEN 11 THEN 'CH' END"
)
add(
    "country_code",
    f"SELECT fila, cli_direccion, {COUNTRY} AS pais_codigo FROM clientes",
)
add(
    "country_unmatched",
    f"SELECT count(*) AS total, count(*) FILTER ({COUNTRY} IS NULL) "
    "AS sin_pais FROM clientes",
)
add(
    "country_code_table",
    "SELECT c_custkey AS fila, 'Av. Núñez, NATION_' || c_nationkey || ', piso 3' AS direccion, "
    "(SELECT 'N' || n_nationkey FROM nation "
    "WHERE contains('av. nunez, nation_' || c_nationkey || ', piso 3', lower(n_name)) "
    "ORDER BY length(n_name) DESC, n_nationkey LIMIT 1) AS pais_codigo FROM customer",
)

add(
    "country_code_many_names",
    "WITH x AS (SELECT 1), calles AS (SELECT 'calle ' || o_orderkey AS nombre, "
    "'O' || (o_orderkey % 1000) AS codigo, o_orderkey AS pos FROM orders WHERE o_orderkey % 10 <> 3 "
    "UNION ALL SELECT 'calle ' || o_orderkey, 'repetido', o_orderkey + 10000000 FROM orders WHERE o_orderkey % 10 = 3), "
    "direcciones AS (SELECT c_custkey AS fila, CASE WHEN c_custkey % 11 <> 0 THEN "
    "repeat('Niño perdido; ', c_custkey % 97) || 'CÁLLE ' || c_custkey * 3 || ', calle ' || "
    "c_nationkey * 7 END AS direccion, 'calle ' || c_custkey * 3 || ', calle ' || c_nationkey * 7 "
    "AS final FROM customer), "
    "halladas AS (SELECT fila, codigo, row_number() OVER (PARTITION BY fila ORDER BY "
    "length(nombre) DESC, pos) AS k FROM direcciones JOIN calles "
    "ON contains(final, nombre) WHERE direccion IS NOT NULL) "
    "SELECT d.fila, d.direccion, h.codigo AS pais_codigo FROM direcciones d "
    "LEFT JOIN halladas h ON h.fila = d.fila AND h.k = 1",
)
ORACLES["country_code_many_names"] = ORACLES["country_code_many_names"].removeprefix(W).replace(
    " WITH x AS (SELECT 1), ", "WITH ", 1
)

DATE_INPUTS = ("%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d", "%d %b %Y", "%d.%m.%Y")


def dated(c: str, target: str) -> str:
    tries = ", ".join(f"try_strptime({c}, '{f}')" for f in DATE_INPUTS)
    return f"coalesce(strftime(coalesce({tries}), '{target}'), {c})"


add("dates_column", f"SELECT fila, {dated('cli_fecha', '%d/%m/%Y')} AS fecha FROM clientes")
add(
    "dates_column_dayfirst",
    "SELECT fila, CASE cli_fecha WHEN '2024-03-04' THEN '03/04/2024' WHEN '12/25/2024' "
    "THEN '25/12/2024' WHEN '4 Mar 2024' THEN '04/03/2024' WHEN '03.04.2024' THEN '03/04/2024' "
    "ELSE cli_fecha END AS fecha FROM clientes",
)
add(
    "dates_all_columns",
    "SELECT fila, "
    + ", ".join(
        f"{dated(c, '%Y-%m-%d')} AS {c}"
        for c in ("cli_fecha", "cli_telefono", "cli_codigo", "segmento")
    )
    + " FROM clientes",
)
STRFTIME = ("%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d", "%d-%m-%Y", "%Y/%m/%d")
add(
    "dates_formats",
    "SELECT o_orderkey, "
    + ", ".join(f"strftime(o_orderdate, '{f}') AS f{i}" for i, f in enumerate(STRFTIME))
    + " FROM orders",
)

# ---------------------------------------------------------------- rows and columns

EVENT = "event_type IN ('click', 'error')"
add("prefilter_isin", f"SELECT event_id, event_type, user_id FROM events WHERE {EVENT}")
add("prefilter_count", f"SELECT count(*) AS filas FROM events WHERE {EVENT}")
add("distinct_values", "SELECT source, min(doc_id) AS primera FROM documents GROUP BY source")
add("preview_rows", "SELECT * FROM clientes ORDER BY fila LIMIT 20")
add("drop_columns", "SELECT * EXCLUDE (cli_fecha, cli_email) FROM clientes")
add(
    "clean_column_names",
    "SELECT fila, cli_codigo AS codigo_del_cliente, cli_nit AS clinit, segmento AS ano_senal, "
    "entero_txt AS clinit_2, decimal_txt AS columna_6 FROM clientes",
)
add(
    "fill_nulls",
    "SELECT fila, " + ", ".join(f"coalesce({c}, 'N/A') AS {c}" for c in CLIENT_COLUMNS)
    + " FROM clientes",
)
add(
    "row_number_excel",
    "SELECT row_number() OVER (ORDER BY o_orderkey) + 1 AS fila_excel, "
    "row_number() OVER (ORDER BY o_orderkey) - 1 AS fila, o_orderkey FROM orders",
)
PERMUTATION = (
    "SELECT count(*) AS filas, count(*) AS distintas, 0::BIGINT AS primera, "
    "count(*) - 1 AS ultima FROM {}"
)
add("row_number_stored", PERMUTATION.format("lineitem"))
add(
    "drop_empty_rows",
    "SELECT fila, cli_nombre, cli_email, cli_telefono FROM clientes WHERE NOT "
    f"({blank('cli_nombre')} OR {blank('cli_email')} OR {blank('cli_telefono')})",
)
add("drop_duplicate_rows", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
add(
    "drop_duplicate_rows_by_key",
    "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part "
    "QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) = 1",
)
add(
    "drop_duplicate_rows_ties",
    "SELECT clave, min(orden) AS orden, clave || '/' || coalesce(min(orden)::VARCHAR, 'sin') AS celda "
    "FROM (SELECT l_partkey AS clave, CASE WHEN l_partkey % 3 <> 0 AND l_linenumber <> 2 "
    "THEN l_linenumber END AS orden FROM lineitem) GROUP BY clave",
)
add(
    "etl_impact",
    "SELECT count(*) AS filas_antes, count(*) AS filas_despues, 0::BIGINT AS filas_delta, "
    "13::BIGINT AS columnas_antes, 15::BIGINT AS columnas_despues, 2::BIGINT AS columnas_delta "
    "FROM clientes WHERE segmento = 'BUILDING'",
)


def tidy(c: str) -> str:
    return f"coalesce(upper({clean(c)}), 'N/A')"


CLEAN_TABLE = (
    "tidy AS (SELECT fila, "
    + ", ".join(
        f"{tidy(c)} AS {c}"
        for c in ("cli_codigo", "cli_nombre", "cli_direccion", "cli_nit", "cli_telefono",
                  "cli_fecha", "segmento")
    )
    + " FROM clientes WHERE segmento IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')), "
    "limpia AS (SELECT fila, cli_codigo AS clicodigo, cli_nombre AS clinombre, "
    "cli_direccion AS clidireccion, "
    "CASE WHEN cli_nit = 'CF' THEN 'CONSUMIDOR FINAL' ELSE cli_nit END AS clinit, "
    "cli_telefono AS clitelefono, "
    "coalesce(strftime(coalesce(CASE WHEN length(cli_fecha) = 8 "
    "THEN try_strptime(cli_fecha, '%Y%m%d') END, try_strptime(cli_fecha, '%d %b %Y')), "
    "'%d/%m/%Y'), cli_fecha) AS clifecha, segmento, "
    f"{COUNTRY} AS pais_codigo, "
    "nullif(split_part(cli_nombre, ' ', 1), '') AS nombre, "
    "nullif(regexp_replace(cli_nombre, '^[^ ]* ?', ''), '') AS apellido FROM tidy)"
)
# Dates without their separators are eight digits; read as year, month and day they lie beyond
# the range of timestamps (years 312, 2512, ...), save those written year first.
ORACLES["clean_table"] = (
    f"{W}, {CLEAN_TABLE} SELECT * REPLACE (CASE WHEN regexp_matches(clifecha, '^\\d\\d/\\d\\d/') "
    "AND NOT clifecha[7:10] BETWEEN '1678' AND '2261' THEN (SELECT tidy.cli_fecha FROM tidy "
    "WHERE tidy.fila = limpia.fila) ELSE clifecha END AS clifecha) FROM limpia"
)


CLEANED_PHONES = phones(
    PHONE_CASE + " AS diagnostico",
    "SELECT 'limpia' AS origen, fila, clitelefono AS telefono FROM limpia",
)
CLEANED_CATEGORIES = (
    "cat AS (SELECT CASE WHEN " + blank("clicodigo") + " THEN 'Vacíos' "
    "WHEN count(*) OVER (PARTITION BY clicodigo) > 1 THEN 'Duplicados' ELSE 'Correcto' END "
    "AS categoria_clicodigo, CASE WHEN diagnostico NOT IN ('Válido', 'Vacío') THEN 'Teléfono' "
    "ELSE 'Correcto' END AS categoria_clitelefono, CASE WHEN " + blank("apellido") + " THEN "
    "'Vacíos' ELSE 'Correcto' END AS categoria_apellido FROM limpia JOIN diagnosticos USING (fila))"
)
ORACLES["clean_then_validate"] = (
    f"{W}, {CLEAN_TABLE}, {CLEANED_PHONES}, {CLEANED_CATEGORIES}, "
    + long_form({"clicodigo": [], "clitelefono": [], "apellido": []})
    + " SELECT columna, categoria, count(*) AS cantidad, round_even((count(*) / "
    "(sum(count(*)) OVER (PARTITION BY columna)) * 100)::DOUBLE, 2) AS porcentaje "
    "FROM largo GROUP BY columna, categoria"
)


def required(name: str, source: str, columns: tuple[str, ...]) -> None:
    tests = ", ".join(f"{blank(c)} AS falta_{c}" for c in columns)
    valid = " AND ".join(f"NOT {blank(c)}" for c in columns)
    add(name, f"SELECT fila, {tests}, {valid} AS valido FROM {source}")


required("master_customers", "clientes", ("cli_nombre", "cli_email"))
required("master_suppliers", "proveedores", ("pro_nit", "pro_pais"))
add(
    "master_products",
    "SELECT p_partkey AS fila, p_partkey % 7 = 0 AS falta_codigo, "
    "(p_partkey % 11 = 0 OR p_retailprice <= 1000) AS precio_invalido, "
    "(p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_retailprice > 1000) AS valido FROM part",
)

# ---------------------------------------------------------------- ingest and sinks

MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TOKENS = ", ".join(q(t) for t in MISSING)


def no_tokens(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({TOKENS}) THEN {c} END"


add(
    "normalize_null_tokens",
    f"SELECT fila, {no_tokens('estado')} AS estado, {no_tokens('prioridad')} AS prioridad "
    "FROM faltantes",
)
add(
    "detect_leading_zero",
    " UNION ALL ".join(
        f"SELECT '{c}' AS columna, bool_or({matches(c, '^0[0-9]+$')}) AS cero_inicial FROM clientes"
        for c in ("cod_con_ceros", "entero_txt", "decimal_txt", "mixto_txt")
    ),
)
add(
    "promote_types",
    "SELECT fila, cod_con_ceros, entero_txt::BIGINT AS entero_txt, "
    "decimal_txt::DOUBLE AS decimal_txt, mixto_txt FROM clientes",
)
PROMOTED = {"cod_con_ceros": "string", "cli_nit": "string"}
add(
    "promote_types_notice",
    " UNION ALL ".join(
        f"SELECT '{c}' AS columna, bool_or({matches(c, '^0[0-9]+$')}) AS protegida, "
        f"CASE WHEN bool_or({matches(c, '^0[0-9]+$')}) THEN 'string' "
        f"WHEN bool_and(try_cast({c} AS BIGINT) IS NOT NULL) FILTER ({c} <> '' AND NOT contains({c}, '.')) "
        f"AND bool_and(try_cast({c} AS DOUBLE) IS NOT NULL) FILTER ({c} <> '') "
        f"THEN CASE WHEN bool_or(contains({c}, '.')) THEN 'double' ELSE 'bigint' END "
        f"ELSE 'string' END AS tipo_destino FROM clientes"
        for c in CLIENT_COLUMNS
    ),
)
def place(key: str) -> str:
    return f"row_number() OVER (ORDER BY {key}) - 1 AS fila"


add(
    "ingest_csv_text",
    f"SELECT {place('fila')}, fila::VARCHAR AS id, "
    + ", ".join(f"{no_tokens(c)} AS {c}" for c in CLIENT_COLUMNS)
    + " FROM clientes",
)
add("ingest_csv_rows", f"SELECT {place('o_orderkey')}, o_orderkey::VARCHAR AS o_orderkey FROM orders")
TEXTS = f"SELECT {place('doc_id')}, doc_id::VARCHAR AS doc_id, lang, text FROM documents"
add("ingest_csv_multiline", TEXTS)
add("ingest_header_offset_multiline", TEXTS)
add(
    "ingest_stray_quote",
    f"SELECT {place('p_partkey')}, p_partkey::VARCHAR AS k, CASE WHEN p_partkey % 7 = 0 "
    "THEN (p_partkey % 40) || '\" pipe' WHEN p_partkey % 50 = 1 "
    "THEN 'two' || chr(10) || 'lines ' || p_partkey ELSE p_name END AS nombre, "
    "p_size::VARCHAR AS medida FROM part",
)
add(
    "ingest_mixed_headers",
    "SELECT row_number() OVER (ORDER BY o_orderkey % 2, o_orderkey) - 1 AS fila, "
    "o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, "
    "CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS o_orderpriority FROM orders",
)
LINES = (
    f"SELECT {place('fila')}, fila::VARCHAR AS id, "
    + ", ".join(f"{no_tokens(c)} AS {c}" for c in ("cli_codigo", "cli_nombre", "cli_direccion"))
    + " FROM clientes"
)
add("ingest_header_offset", LINES)
add("ingest_skip_rows", LINES)
add(
    "ingest_bad_records",
    f"SELECT fila, registro FROM (SELECT {place('o_orderkey')}, o_orderkey, "
    "o_orderkey || ',\"a, b\",x,sobra' AS registro FROM orders) WHERE o_orderkey % 11 = 3",
)
add(
    "ingest_good_records",
    f"SELECT fila, a, b, c FROM (SELECT {place('o_orderkey')}, o_orderkey, "
    "o_orderkey::VARCHAR AS a, CASE WHEN o_orderkey % 11 = 5 THEN 'corta' "
    "ELSE o_orderstatus END AS b, CASE WHEN o_orderkey % 11 <> 5 THEN o_orderpriority END AS c "
    "FROM orders) WHERE o_orderkey % 11 <> 3",
)
QUOTED = (
    f"(SELECT {place('p_partkey')}, p_partkey AS p, CASE WHEN p_partkey % 50 = 1 THEN 'two' || chr(10) || 'lines ' || "
    "p_partkey ELSE p_name END AS nombre, p_size::VARCHAR AS medida FROM part)"
)
add(
    "ingest_unclosed_quote",
    f"SELECT fila, p::VARCHAR AS k, nombre, medida FROM {QUOTED} WHERE p % 100 NOT IN (80, 90)",
)
add(
    "ingest_unclosed_quote_bad",
    "SELECT fila, p || ',' || CASE p % 100 WHEN 80 THEN '\"abierta' ELSE 'x\",\"y' END || ',' || medida AS registro "
    f"FROM {QUOTED} WHERE p % 100 IN (80, 90)",
)
add(
    "ingest_bad_files",
    "SELECT lpad((c_custkey // 25)::VARCHAR, 8, '0') AS cubo, CASE WHEN any_value(c_custkey // 25 % 5) < 2 "
    "THEN count(*) ELSE 0 END AS filas, CASE any_value(c_custkey // 25 % 5) WHEN 2 THEN 'Codificación UTF-16' "
    "WHEN 3 THEN 'Contiene bytes nulos (binario o UTF-16 sin marca)' WHEN 4 THEN 'Codificación distinta de UTF-8' "
    "END AS problema FROM customer GROUP BY c_custkey // 25 UNION ALL "
    "SELECT 'zz_entero', count(*), NULL FROM customer WHERE c_custkey < 25 UNION ALL "
    "VALUES ('zz_cortado', 0, 'Comprimido truncado o dañado'), ('zz_vacio', 0, 'Archivo vacío'), "
    "('zz_corto', 0, 'Sin fila de encabezado')",
)
add(
    "ingest_bad_files_rows",
    f"SELECT {place('copia, c_custkey')}, c_custkey::VARCHAR AS id, 'José' AS descripción, c_name AS nombre FROM ("
    "SELECT 0 AS copia, * FROM customer WHERE c_custkey // 25 % 5 < 2 UNION ALL "
    "SELECT 1, * FROM customer WHERE c_custkey < 25)",
)
add("sink_csv", "SELECT * FROM part")
add("sink_parquet", "SELECT * FROM part")

# ---------------------------------------------------------------- rule sets

KEY = "regexp_replace(trim({}), '[^a-zA-Z0-9_-]', '_', 'g')"
NAME_KEY = KEY.format("c_name")
PARAMETER = (
    "CASE WHEN regla = 'Longitud mayor a N' THEN CASE WHEN c_custkey % 5 = 4 THEN '10' "
    "ELSE (c_custkey % 20)::VARCHAR END END"
)
RULES = (
    "reglas AS (SELECT c_custkey, c_name, columna, pos, regla FROM customer, "
    "(VALUES ('cli_nit', 0, 'Vacíos'), ('cli_nit', 1, 'Longitud mayor a N'), "
    "('cli_codigo', 0, 'Duplicados')) AS r(columna, pos, regla) WHERE c_custkey % 5 IN (2, 3, 4))"
)
ORACLES["ruleset_rules"] = (
    f"{W}, {RULES} SELECT {NAME_KEY} AS clave, columna, pos, regla, {PARAMETER} AS parametro "
    "FROM reglas"
)
add(
    "ruleset_quality",
    f"SELECT {NAME_KEY} AS clave, 'cli_email' AS columna, true AS validar_email, "
    "false AS validar_telefono FROM customer WHERE c_custkey % 5 = 1",
)
DATED = (
    "CASE c_custkey % 5 WHEN 1 THEN '01/02/2026 10:00' WHEN 4 THEN {missing} "
    "ELSE '02/02/2026 10:00' END"
)
add(
    "ruleset_list",
    f"SELECT CASE WHEN c_custkey % 5 = 4 THEN {NAME_KEY} ELSE c_name END AS nombre, "
    "CASE WHEN c_custkey % 5 = 1 THEN 'calidad' ELSE 'dashboard' END AS tipo, "
    f"{DATED.format(missing=q('—'))} AS fecha FROM customer WHERE c_custkey % 5 <> 0",
)
add(
    "ruleset_list_kind",
    "SELECT c_name AS nombre, 'calidad' AS tipo, '01/02/2026 10:00' AS fecha FROM customer "
    "WHERE c_custkey % 5 = 1",
)
STORED = (
    f"{RULES}, guardadas AS (SELECT {NAME_KEY} AS clave, 'dashboard' AS tipo, "
    "CASE WHEN c_custkey % 5 <> 4 THEN c_name END AS nombre, "
    f"{DATED.format(missing='NULL')} AS fecha, columna, pos, regla, {PARAMETER} AS parametro, "
    "NULL::BOOLEAN AS validar_email, NULL::BOOLEAN AS validar_telefono FROM reglas "
    f"UNION ALL SELECT {NAME_KEY}, 'calidad', c_name, '01/02/2026 10:00', 'cli_email', 0, NULL, "
    "NULL, true, false FROM customer WHERE c_custkey % 5 = 1)"
)
INCOMING = (
    "nuevas AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'nuevo/' || c_name END "
    "AS nombre FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 10 = 7)"
)
ORACLES["ruleset_upsert"] = (
    f"{W}, {STORED}, {INCOMING} SELECT * FROM guardadas WHERE clave NOT IN "
    f"(SELECT {KEY.format('nombre')} FROM nuevas) UNION ALL "
    f"SELECT {KEY.format('nombre')}, 'dashboard', nombre, '04/03/2026 05:06', 'segmento', 0, "
    "'Vacíos', NULL, NULL, NULL FROM nuevas"
)
UNWANTED = f"(SELECT {NAME_KEY} FROM customer WHERE c_custkey % 6 = 1)"
ORACLES["ruleset_delete"] = f"{W}, {STORED} SELECT * FROM guardadas WHERE clave NOT IN {UNWANTED}"
ORACLES["ruleset_delete_outcome"] = (
    f"{W}, {STORED} SELECT c_name || ' ' AS nombre, "
    f"{NAME_KEY} IN (SELECT clave FROM guardadas) AS eliminado "
    "FROM customer WHERE c_custkey % 6 = 1"
)

LATER = "(SELECT 'nuevo_' || c_name AS clave FROM customer WHERE c_custkey % 10 = 7 AND c_custkey % 3 <> 0)"
ORACLES["ruleset_saved"] = ORACLES["ruleset_upsert"]
ORACLES["ruleset_upsert_last_wins"] = (
    f"{W}, {INCOMING} SELECT {KEY.format('nombre')} AS clave, nombre, 'Vacíos' AS regla FROM nuevas "
    f"WHERE {KEY.format('nombre')} NOT IN (SELECT {KEY.format('clave')} FROM {LATER}) "
    f"UNION ALL SELECT {KEY.format('clave')}, clave, 'Email' FROM {LATER}"
)
# Customer 7 asks for lengths above 7 (7 modulo 20), customer 6 for the e-mail rule.
STORED_RULES = {"cli_nit": ["Vacíos", "Longitud mayor a N"], "cli_codigo": ["Duplicados"]}
ORACLES["ruleset_apply_dashboard"] = (
    f"{W}, {distribution('clientes', STORED_RULES, {('cli_nit', 'Longitud mayor a N'): 7})}"
)
ORACLES["ruleset_apply_quality"] = f"{W}, {distribution('clientes', {'cli_email': ['Email']})}"
add(
    "ruleset_exists",
    "SELECT ' ' || c_name || ' ' AS nombre, c_custkey % 5 <> 0 AS existe FROM customer "
    "UNION ALL SELECT 'no hay', false",
)
