"""Rule sets: which rules apply to which columns, kept as JSON documents or as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.catalogue import DEFAULT_NUMBER, NUMBER, RULES, TEXT

# Kinds of rule set and what a listing shows for missing fields. Fixed values.
DASHBOARD = "dashboard"
QUALITY = "calidad"
UNKNOWN_KIND = "desconocido"
NO_DATE = "—"
DATE_FORMAT = "dd/MM/yyyy HH:mm"

DOCUMENT = (
    "tipo string, nombre string, fecha string, asignaciones map<string, array<string>>, "
    "columna string, validar_email boolean, validar_telefono boolean, "
    "parametros map<string, map<string, string>>, __danado string"
)

#: Columns of the rule-set table: one row per column and rule, or per quality rule set.
TABLE = (
    "clave", "tipo", "nombre", "fecha", "columna", "pos", "regla", "parametro",
    "validar_email", "validar_telefono",
)
TABLE_SCHEMA = (
    "clave string, tipo string, nombre string, fecha string, columna string, pos int, regla string, "
    "parametro string, validar_email boolean, validar_telefono boolean"
)

#: Column that names the save a row came with; later saves have greater names.
SAVE = "guardado"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(archivo, cuerpo) of the JSON files of a folder, one rule set each."""
    return (
        spark.read.option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)  # a rule set is a few lines
        .select(
            F.regexp_replace("_metadata.file_name", r"\.json\z", "").alias("archivo"),
            F.col("value").alias("cuerpo"),
        )
    )


def parse(documents: DataFrame) -> DataFrame:
    """The fields of every document; broken ones are left out."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__danado"}
    # A generator, so that the filter on broken documents does not parse them once more.
    fields = F.inline(F.array(F.from_json("cuerpo", DOCUMENT, options)))
    return (
        documents.filter(F.col("cuerpo").isNotNull())
        .select("archivo", fields)
        .filter(F.col("__danado").isNull())
        .drop("__danado")
    )


def listing(parsed: DataFrame, kind: str | None = None) -> DataFrame:
    """nombre, tipo, fecha of all rule sets, or those of one kind, in the order of their files."""
    chosen = parsed if kind is None else parsed.filter(F.col("tipo") == kind)
    return chosen.orderBy("archivo").select(
        F.coalesce("nombre", "archivo").alias("nombre"),
        F.coalesce("tipo", F.lit(UNKNOWN_KIND)).alias("tipo"),
        F.coalesce("fecha", F.lit(NO_DATE)).alias("fecha"),
    )


def _parameter(kind: str, given: Column) -> Column:
    """Parameter of a rule, or the value it has when the rule set names none."""
    numeric = [name for name, rule in RULES.items() if rule.parameter == NUMBER]
    textual = [name for name, rule in RULES.items() if rule.parameter == TEXT]
    return (
        F.when(F.col(kind).isin(*numeric), F.coalesce(given, F.lit(str(DEFAULT_NUMBER))))
        .when(F.col(kind).isin(*textual), F.coalesce(given, F.lit("")))
    )


def dashboard_rules(parsed: DataFrame) -> DataFrame:
    """clave, columna, pos, regla, parametro of the dashboard rule sets; pos keeps the order."""
    return (
        parsed.filter(F.col("tipo") == DASHBOARD)
        .select(F.col("archivo").alias("clave"), F.explode("asignaciones").alias("columna", "r"),
                "parametros")
        .select("clave", "columna", F.posexplode("r").alias("pos", "regla"), "parametros")
        .select(
            "clave", "columna", "pos", "regla",
            _parameter("regla", F.try_element_at(
                F.try_element_at("parametros", F.col("columna")), F.col("regla"))
            ).alias("parametro"),
        )
    )


def quality_settings(parsed: DataFrame) -> DataFrame:
    """clave, columna, validar_email, validar_telefono of the quality rule sets."""
    return parsed.filter(F.col("tipo") == QUALITY).select(
        F.col("archivo").alias("clave"),
        "columna",
        F.coalesce("validar_email", F.lit(False)).alias("validar_email"),
        F.coalesce("validar_telefono", F.lit(False)).alias("validar_telefono"),
    )


def load_assignments(parsed: DataFrame, name: str) -> tuple[dict, dict] | None:
    """Assignment and parameters of one dashboard rule set, or None when there is none."""
    key = text.safe_name(F.lit(name))
    rows = (
        dashboard_rules(parsed.filter(F.col("archivo") == key))
        .orderBy("pos")
        .collect()  # one rule set: a handful of rows
    )
    if not rows:
        return None
    assignments: dict[str, list[str]] = {}
    parameters: dict[tuple[str, str], str] = {}
    for row in rows:
        assignments.setdefault(row["columna"], []).append(row["regla"])
        if row["parametro"]:
            parameters[(row["columna"], row["regla"])] = row["parametro"]
    return assignments, parameters


def quality_assignments(parsed: DataFrame, name: str) -> dict[str, list[str]] | None:
    """Assignment of one quality rule set, the rules its flags ask for; None when there is none."""
    key = text.safe_name(F.lit(name))
    row = quality_settings(parsed.filter(F.col("archivo") == key)).first()
    if row is None or row["columna"] is None:
        return None
    flags = (("validar_email", "Email"), ("validar_telefono", "Teléfono"))
    return {row["columna"]: [rule for flag, rule in flags if row[flag]]}


def exists(keyed: DataFrame, name: str, key: str = "clave") -> bool:
    """Whether a rule set is stored under the safe form of the name."""
    return not keyed.filter(F.col(key) == text.safe_name(F.lit(name))).isEmpty()


def as_table(parsed: DataFrame) -> DataFrame:
    """All rule sets as one table, see ``TABLE``."""
    rules = (
        parsed.filter(F.col("tipo") == DASHBOARD)
        .select(F.col("archivo").alias("clave"), "tipo", "nombre", "fecha", "parametros",
                F.explode("asignaciones").alias("columna", "r"))
        .select("*", F.posexplode("r").alias("pos", "regla"))
        .withColumn("parametro", _parameter("regla", F.try_element_at(
            F.try_element_at("parametros", F.col("columna")), F.col("regla"))))
        .withColumn("validar_email", F.lit(None).cast("boolean"))
        .withColumn("validar_telefono", F.lit(None).cast("boolean"))
        .select(*TABLE)
    )
    quality = (
        parsed.filter(F.col("tipo") == QUALITY)
        .withColumn("clave", F.col("archivo"))
        .withColumn("pos", F.lit(0))
        .withColumn("regla", F.lit(None).cast("string"))
        .withColumn("parametro", F.lit(None).cast("string"))
        .withColumn("validar_email", F.coalesce("validar_email", F.lit(False)))
        .withColumn("validar_telefono", F.coalesce("validar_telefono", F.lit(False)))
        .select(*TABLE)
    )
    return rules.unionByName(quality)


def stamp(rule_sets: DataFrame, moment: Column | None = None) -> DataFrame:
    """Rule sets about to be stored: trimmed name, safe key and time of storing."""
    moment = F.current_timestamp() if moment is None else moment
    return (
        rule_sets.withColumn("nombre", text.strip(F.col("nombre")))
        .withColumn("clave", text.safe_name(F.col("nombre")))
        .withColumn("fecha", F.date_format(moment, DATE_FORMAT))
        .select(*TABLE)
    )


def last_of_key(incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Of incoming rule sets with one key, also those of one name, the last; without ``order`` after.

    ``order`` is a column of ``incoming``, the same in all rows of a rule set; null is first. Of rule
    sets of one place in it, or without it, the greatest name is the last.
    """
    place = F.struct(F.col(order) if order else F.lit(0), "nombre").alias("__lugar")
    placed = incoming.select("*", place)
    last = placed.groupBy("clave").agg(F.max("__lugar").alias("__ultimo"))
    chosen = placed.join(last, "clave").where(F.col("__lugar").eqNullSafe(F.col("__ultimo")))
    return chosen.select(*TABLE)


def upsert(stored: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """The table with the incoming rule sets put in place of those stored under the same key.

    Names that differ can share a key; of such incoming rule sets the last one by ``order`` is
    stored, see ``last_of_key``.
    """
    keys = incoming.select("clave").distinct()
    return stored.join(keys, "clave", "left_anti").unionByName(last_of_key(incoming, order))


def _next_save(spark: SparkSession, path: str) -> str:
    """Name of a new save below ``path``, greater than those of all finished ones."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    last = max([name for name in found if name.startswith(f"{SAVE}=")], default=f"{SAVE}=0")
    number = int(last.removeprefix(f"{SAVE}=").split("-")[0]) + 1
    return f"{number:012d}-{uuid.uuid4().hex}"


def save(incoming: DataFrame, path: str, order: str | None = None) -> None:
    """Writes incoming rule sets below ``path``, a folder a save; other rule sets are not read or written.

    A rule set takes the place of the one under its key as a whole; saving again changes nothing.
    """
    name = _next_save(incoming.sparkSession, path)
    last_of_key(incoming, order).write.parquet(f"{path}/{SAVE}={name}")


def saved(spark: SparkSession, path: str) -> DataFrame:
    """All rule sets saved below ``path``: of each key the rows of its last save; an empty key is null."""
    every = spark.read.schema(f"{TABLE_SCHEMA}, {SAVE} string").parquet(path)
    last = every.groupBy("clave").agg(F.max(SAVE).alias(SAVE))
    rows = every.join(last, ["clave", SAVE])
    return rows.withColumn("clave", F.nullif("clave", F.lit(""))).select(*TABLE)


def which_exist(keyed: DataFrame, names: DataFrame, key: str = "clave") -> DataFrame:
    """(nombre, existe) for every name asked for, by one join."""
    keys = keyed.select(F.col(key).alias("__clave")).distinct().withColumn("__hay", F.lit(True))
    asked = names.select("nombre", text.safe_name(F.col("nombre")).alias("__clave"))
    return asked.join(keys, "__clave", "left").select("nombre", F.col("__hay").isNotNull().alias("existe"))


def delete(stored: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table without the named rule sets, and (nombre, eliminado) per name asked for."""
    asked = names.select("nombre", text.safe_name(F.col("nombre")).alias("clave"))
    keys = stored.select("clave").distinct().withColumn("__hay", F.lit(True))
    outcome = asked.join(keys, "clave", "left").select(
        "nombre", F.col("__hay").isNotNull().alias("eliminado")
    )
    return stored.join(asked.select("clave").distinct(), "clave", "left_anti"), outcome
