"""Tables with dirty cells, derived from the given ones by the same SQL text in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLIENTES = """
SELECT c_custkey AS fila,
  CASE WHEN c_custkey % 97 = 5 THEN NULL
       WHEN c_custkey % 50 = 7 THEN 'C-0007'
       ELSE concat('C-', lpad(CAST(c_custkey AS STRING), 6, '0')) END AS cli_codigo,
  CASE c_custkey % 9
       WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN 'José Núñez Peña'
       WHEN 3 THEN '  Ana  María   López ' WHEN 4 THEN 'ACME, S.A. de C.V.'
       WHEN 5 THEN 'Cher' WHEN 6 THEN 'Empresa 24/7 (Honduras)'
       ELSE c_name END AS cli_nombre,
  CASE c_custkey % 12
       WHEN 0 THEN NULL WHEN 1 THEN 'Col. Palmira, Tegucigalpa'
       WHEN 2 THEN 'Av. Reforma 222, México D.F.' WHEN 3 THEN '5th Ave, New York, U.S.A.'
       WHEN 4 THEN 'Ciudad de Panamá' WHEN 5 THEN 'Calle Mayor 1, España'
       WHEN 6 THEN 'Jerusalem' WHEN 7 THEN 'Kyiv, Ukraine' WHEN 8 THEN 'Sin dato'
       WHEN 9 THEN 'Road Town, British Virgin Islands' WHEN 10 THEN 'San Pedro Sula'
       ELSE 'Zürich, Switzerland' END AS cli_direccion,
  CASE c_custkey % 7
       WHEN 0 THEN NULL WHEN 1 THEN '0801-1990-12345' WHEN 2 THEN 'CF'
       ELSE lpad(CAST(c_custkey AS STRING), 14, '0') END AS cli_nit,
  CASE c_custkey % 13
       WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' a@b.com' WHEN 3 THEN 'ab.com'
       WHEN 4 THEN 'a@@b.com' WHEN 5 THEN '@b.com' WHEN 6 THEN 'a@' WHEN 7 THEN 'a@b'
       WHEN 8 THEN 'a@b.c' WHEN 9 THEN 'a@b.c0m' WHEN 10 THEN 'a b@c.com'
       WHEN 11 THEN 'josé@c.com'
       ELSE concat('user', CAST(c_custkey AS STRING), '@mail.example.com') END AS cli_email,
  CASE c_custkey % 15
       WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN '9999-8888' WHEN 3 THEN '2222 3333'
       WHEN 4 THEN '5555-1234' WHEN 5 THEN '999-888' WHEN 6 THEN '+504 9999-8888'
       WHEN 7 THEN '50422223333' WHEN 8 THEN '9999.8888' WHEN 9 THEN '9999-8888-'
       WHEN 10 THEN '+504 123' WHEN 11 THEN '+999 123456' WHEN 12 THEN 'abc'
       WHEN 13 THEN '(504) 9999-8888' ELSE '+504 2222-3333' END AS cli_telefono,
  CASE c_custkey % 10
       WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '25/12/2024' WHEN 3 THEN '03/04/2024'
       WHEN 4 THEN '2024-03-04' WHEN 5 THEN '12/25/2024' WHEN 6 THEN '4 Mar 2024'
       WHEN 7 THEN '31/02/2024' WHEN 8 THEN 'sin fecha' ELSE '03.04.2024' END AS cli_fecha,
  CASE WHEN c_custkey % 4 = 0 THEN lpad(CAST(c_custkey AS STRING), 6, '0')
       ELSE CAST(c_custkey AS STRING) END AS cod_con_ceros,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey % 100 AS STRING) END AS entero_txt,
  CASE WHEN c_custkey % 8 = 1 THEN '1.5' ELSE CAST(c_custkey % 100 AS STRING) END AS decimal_txt,
  CASE WHEN c_custkey % 8 = 1 THEN 'x1' ELSE CAST(c_custkey % 100 AS STRING) END AS mixto_txt,
  c_mktsegment AS segmento
FROM {customer}
"""

PROVEEDORES = """
SELECT s_suppkey AS fila,
  CASE WHEN s_suppkey % 10 = 3 THEN NULL
       ELSE concat('P', CAST(s_suppkey % 60 AS STRING)) END AS pro_codigo,
  CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'RTN-08011' ELSE '08011990123456' END AS pro_nit,
  CASE s_suppkey % 4 WHEN 0 THEN '22334455' WHEN 1 THEN '+504 3344-5566'
       WHEN 2 THEN '123' ELSE NULL END AS pro_telefono,
  CASE s_suppkey % 3 WHEN 0 THEN 'ventas@proveedor.hn' WHEN 1 THEN 'sin correo'
       ELSE NULL END AS pro_email,
  CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE s_name END AS pro_nombrech,
  CASE s_suppkey % 4 WHEN 0 THEN 'Honduras' WHEN 1 THEN 'Guatemala' WHEN 2 THEN ''
       ELSE NULL END AS pro_pais
FROM {supplier}
"""

# Cells that a reader takes for missing, among others that it does not.
FALTANTES = """
SELECT o_orderkey AS fila,
  CASE o_orderkey % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN 'null' WHEN 2 THEN '' WHEN 3 THEN 'nan'
       WHEN 4 THEN ' NA ' WHEN 5 THEN '#N/A N/A' WHEN 6 THEN 'na' WHEN 7 THEN '-1.#IND'
       ELSE o_orderstatus END AS estado,
  CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE o_orderpriority END AS prioridad
FROM {orders}
"""

#: Rules by column, chosen so that rules meet in either order, every cell of a column can break
#: one, and repeats are counted in some assignments only.
ASSIGNMENTS = {
    "clientes_full": {
        "cli_email": ["Vacíos", "Email"],
        "cli_telefono": ["Solo números", "Contiene letras"],
        "cli_nit": ["Solo letras", "Solo números", "Vacíos"],
        "cli_nombre": ["Caracteres especiales / símbolos", "Vacíos"],
        "cli_direccion": ["Contiene letras"],
        "cli_codigo": ["Solo letras", "Vacíos"],
    },
    "clientes_small": {"cli_email": ["Email", "Duplicados"], "cli_codigo": ["ID (vacíos + duplicados)"]},
    "clientes_clean": {"segmento": ["Vacíos", "Solo números"], "cli_nombre": ["Vacíos"]},
    "proveedores_full": {
        "pro_telefono": ["Teléfono"],
        "pro_pais": ["Vacíos"],
        "pro_email": ["Duplicados", "Email"],
        "pro_codigo": ["ID (vacíos + duplicados)"],
        "pro_nit": ["Contiene letras", "Solo números"],
    },
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def clientes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(CLIENTES, customer=table(spark, folder, "customer"))


def proveedores(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(PROVEEDORES, supplier=table(spark, folder, "supplier"))


def faltantes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(FALTANTES, orders=table(spark, folder, "orders"))


def ctes() -> str:
    """The derived tables as common table expressions."""
    return (
        f"WITH clientes AS ({CLIENTES.format(customer='customer')}), "
        f"proveedores AS ({PROVEEDORES.format(supplier='supplier')}), "
        f"faltantes AS ({FALTANTES.format(orders='orders')})"
    )
