"""Readers, type promotion, row numbers, rule sets, sinks."""

import gzip
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.queries import _xlsx
from checks.views import table
from pulcro import session
from pulcro.plans import rulesets
from pulcro.sinks import tables
from pulcro.sources import delimited, inspection, numbering, promotion, workbook


def write(folder, name, content):
    path = folder / name
    path.write_text(content, encoding="utf-8")
    return str(path)


def read(spark, path, **options):
    table = delimited.read_delimited(spark, path, **options)
    return table, [tuple(r) for r in table.rows.orderBy("fila").collect()]


def test_csv_text(spark, tmp_path):
    path = write(tmp_path, "a.csv", '﻿cod,nombre\n0006,"a ""b"", c"\n\n  \n7,NA\n8\n')
    found, rows = read(spark, path)
    assert found.rows.columns == ["fila", "cod", "nombre"]
    assert rows == [(0, "0006", 'a "b", c'), (1, "7", None), (2, "8", None)]
    assert found.bad.count() == 0


def test_csv_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path, "a.csv", '\ufeffa,b\n1,"x\ny"\n2,z\n')
    found, rows = read(spark, path)
    assert found.rows.columns == ["fila", "a", "b"]
    assert rows == [(0, "1", "x\ny"), (1, "2", "z")]


def test_csv_line_breaks_with_header_offset_blank_and_skipped_rows(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'Informe,"de\n\nvarias"\n\na,b\n-,"x\ny"\n   \n1,"x\n\n""y"""\n2,z\n')
    _, rows = read(spark, path, header_row=1, skip_rows=(3,))
    assert rows == [(0, "1", 'x\n\n"y"'), (1, "2", "z")]


def test_csv_stray_quotes_open_nothing(spark, tmp_path):
    write(tmp_path, "a.csv", 'a,b\n5" pipe,1\n x"y",2\n"q""r" s",3\n')
    write(tmp_path, "b.csv", 'a,b\n"two\nlines",4\n6" pipe,"5\n7"\n')
    found, rows = read(spark, str(tmp_path), header_row=0)
    assert [r[0] for r in rows] == list(range(5))
    assert [r[2] for r in rows] == ["1", "2", "3", "4", "5\n7"]
    assert [rows[k][1] for k in (0, 1, 3, 4)] == ['5" pipe', ' x"y"', "two\nlines", '6" pipe']


def test_csv_columns_follow_the_header_of_each_file(spark, tmp_path):
    write(tmp_path, "a.csv", "id,n\n1,x\n2,y\n")
    write(tmp_path, "b.csv", "n,id,más\nz,3,k\n")
    found, rows = read(spark, str(tmp_path))
    assert found.rows.columns == ["fila", "id", "n", "más"]
    assert rows == [(0, "1", "x", None), (1, "2", "y", None), (2, "3", "z", "k")]


def test_csv_line_breaks_over_many_splits(spark, tmp_path):
    """Records that cross splits, splits that begin and end inside quotes."""
    texts = [f"{i}\n{'línea ' * (i % 7)}\n\"\"{i}\"\"" if i % 3 else f'{i}\' {"x" * (i % 50)}' for i in range(1500)]
    texts[700] = "largo\n" * 3000
    body = "".join(f'{i},"{t}"\n' for i, t in enumerate(texts))
    write(tmp_path, "a.csv", "i,t\n" + body)
    write(tmp_path, "b.csv", "i,t\n" + "1,plain\n" * 500)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        rows = delimited.read_delimited(spark, str(tmp_path), null_tokens=False).rows.orderBy("fila").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["fila"] for r in rows] == list(range(2000))
    assert [(r["i"], r["t"]) for r in rows[:1500]] == [(str(i), t.replace('""', '"')) for i, t in enumerate(texts)]


def test_csv_rows_with_too_many_fields(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b\n1,2\n1,"2,3",4\n5\n6,"7,8"\n')
    found, rows = read(spark, path)
    assert rows == [(0, "1", "2"), (2, "5", None), (3, "6", "7,8")]
    assert [tuple(r) for r in found.bad.collect()] == [(1, '1,"2,3",4')]
    assert found.bad_count().first()["malos"] == 1


def test_csv_header_and_skipped_rows(spark, tmp_path):
    path = write(tmp_path, "a.csv", "Informe\n\nx,y\n-,-\n=,=\n1,2\n3,4\n")
    _, rows = read(spark, path, header_row=1, skip_rows=(3, 4))
    assert rows == [(0, "1", "2"), (1, "3", "4")]
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, path, header_row=40)


def test_csv_header_names():
    names = delimited.column_names(["a", "a", "", None, "a", "a.1"])
    assert names == ["a", "a.1", "Unnamed: 2", "Unnamed: 3", "a.2", "a.1.1"]


def test_csv_without_rows(spark, tmp_path):
    found, rows = read(spark, write(tmp_path, "a.csv", "a,b\n"))
    assert rows == [] and delimited.is_empty(found)


def test_csv_rows_are_numbered_over_splits_and_files(spark, tmp_path):
    """Several files, each cut into splits far smaller than the file."""
    for f in range(3):
        lines = "".join(f"{f},{i}\n" for i in range(4000))
        write(tmp_path, f"part-{f}.csv", "f,i\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        numbered = delimited.read_delimited(spark, str(tmp_path)).rows
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        wrong = numbered.filter("fila <> cast(f as int) * 4000 + cast(i as int)")
        assert numbered.count() == 12_000 and wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_cut_differently_are_an_error(spark, tmp_path):
    write(tmp_path, "a.csv", "f\n" + "x\n" * 20_000)
    rows = delimited.read_delimited(spark, str(tmp_path)).rows
    assert rows.count() == 20_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        with pytest.raises(Exception, match="split differently"):
            rows.select("fila").filter("fila >= 0").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_round_trip_keeps_spaces_and_quotes(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([('a "b", c', "  x "), ("\\", "y\nz")], "a string, b string")
    tables.write_csv(df, path)
    found = {tuple(r) for r in delimited.read_delimited(spark, path).rows.drop("fila").collect()}
    assert found == {('a "b", c', "  x "), ("\\", "y\nz")}


@pytest.mark.parametrize("partitions", [1, 7])
def test_row_numbers_are_dense(spark, partitions):
    df = spark.range(1000).repartition(partitions).select("id")
    found = sorted(r["fila"] for r in numbering.with_row_number(df).collect())
    assert found == list(range(1000))


def test_parquet_row_numbers_follow_files(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(0, 1000, 1, 5).write.parquet(path)
    df = numbering.read_parquet_numbered(spark, path)
    assert df.filter("fila <> id").count() == 0 and df.count() == 1000


def test_promotion(spark):
    rows = [
        ("0006", "1", "1.5", "x1", "+5", "1e5", " 12 ", "9" * 19, None, "inf", "1", "1,000"),
        ("12", None, "2", "2", "-7", ".5", "", "1", None, "1", "0", "2"),
    ]
    names = ["cero", "entero", "decimal", "mixto", "signo", "exp", "blanco", "grande", "nulo",
             "inf", "sin", "miles"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    typed, notice = promotion.promote_types(df)
    assert dict(typed.dtypes) == {
        "cero": "string", "entero": "bigint", "decimal": "double", "mixto": "string",
        "signo": "bigint", "exp": "double", "blanco": "bigint", "grande": "string",
        "nulo": "double", "inf": "double", "sin": "bigint", "miles": "string",
    }
    assert [r["columna"] for r in notice.filter("protegida").collect()] == ["cero"]
    first = typed.first()
    assert (first["exp"], first["blanco"], first["signo"]) == (100000.0, 12, 5)


def test_promotion_rejects_java_number_forms(spark):
    df = spark.createDataFrame([("1d", "0x1F", "1_000", "NaN")], "a string, b string, c string, d string")
    assert set(dict(promotion.promote_types(df)[0].dtypes).values()) == {"string"}


STYLES = (
    '<styleSheet xmlns="m"><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/>'
    '<numFmt numFmtId="165" formatCode="0.00&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/>'
    '<xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="20"/></cellXfs>'
    "</styleSheet>"
)
SHARED = "<sst><si><t>codigo</t></si><si><r><t>a</t></r><r><t>b</t></r><rPh><t>z</t></rPh></si></sst>"
SHEET = (
    '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is>'
    '<t>fecha</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" t="b"><v>1</v></c>'
    '<c r="C3" s="1"><v>45355</v></c></row><row r="4"><c r="A4"><v>1.0</v></c><c r="B4" t="e">'
    '<v>#N/A</v></c><c r="C4" s="2"><v>45355.5</v></c></row><row r="5"><c r="A5" s="3"><v>2.5</v>'
    '</c><c r="B5" t="str"><f>1+1</f><v>dos</v></c><c r="C5" s="4"><v>0.4375</v></c></row>'
    "</sheetData></worksheet>"
)


def real_workbook(path):
    with zipfile.ZipFile(path, "w") as out:
        out.writestr(
            "xl/workbook.xml",
            '<workbook xmlns:r="x"><sheets><sheet name="Datos" sheetId="1" r:id="a"/>'
            '<sheet name="Otra" sheetId="2" r:id="b"/></sheets></workbook>',
        )
        out.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships><Relationship Id="b" Target="worksheets/s2.xml"/>'
            '<Relationship Id="a" Target="/xl/worksheets/s1.xml"/></Relationships>',
        )
        out.writestr("xl/styles.xml", STYLES)
        out.writestr("xl/sharedStrings.xml", SHARED)
        out.writestr("xl/worksheets/s1.xml", SHEET)
        out.writestr("xl/worksheets/s2.xml", "<worksheet><sheetData/></worksheet>")


def test_workbook_files(spark, tmp_path):
    real_workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"no es un libro")
    cells = workbook.workbook_cells(workbook.read_files(spark, str(tmp_path)))
    sheets = workbook.list_sheets(cells).orderBy("sheet_index").collect()
    assert [(r["sheet_index"], r["sheet"]) for r in sheets] == [(0, "Datos"), (1, "Otra")]
    errors = workbook.read_errors(cells).collect()
    assert len(errors) == 1 and errors[0]["path"].endswith("b.xlsx")
    df = workbook.sheet_table(cells).orderBy("fila")
    assert df.columns == ["fila", "codigo", "Unnamed: 1", "fecha"]
    assert [tuple(r) for r in df.collect()] == [
        (0, None, None, None),
        (1, "ab", "True", "2024-03-04 00:00:00"),
        (2, "1", None, "2024-03-04 12:00:00"),
        (3, "2.5", "dos", "10:30:00"),
    ]


def test_workbook_header_and_skipped_rows(spark, tmp_path):
    import pandas as pd

    frame = pd.DataFrame([["a", "b"], ["-", "-"], ["1", "2"]], columns=["Informe", None])
    (tmp_path / "a.xlsx").write_bytes(_xlsx({"H": frame}))
    cells = workbook.workbook_cells(workbook.read_files(spark, str(tmp_path)))
    df = workbook.sheet_table(cells, "H", header_row=1, skip_rows=(2,))
    assert df.columns == ["fila", "a", "b"]
    assert [tuple(r) for r in df.collect()] == [(0, "1", "2")]


def rule_set_folder(tmp_path):
    documents = {
        "Clientes": {"tipo": "dashboard", "nombre": "Clientes", "fecha": "04/07/2026 09:49",
                     "asignaciones": {"b": ["Vacíos", "Longitud mayor a N"], "a": ["Email"]}},
        "Contactos": {"tipo": "calidad", "nombre": "Contactos", "columna": "c",
                      "validar_email": True},
        "vacio": {},
        "limite": {"tipo": "dashboard", "asignaciones": {"a": ["Longitud mayor a N"]},
                   "parametros": {"a": {"Longitud mayor a N": "5"}}},
    }
    for name, body in documents.items():
        write(tmp_path, f"{name}.json", json.dumps(body, ensure_ascii=False, indent=2))
    write(tmp_path, "danado.json", "{ no es json")
    write(tmp_path, "lista.json", "[1, 2]")
    write(tmp_path, "notas.txt", "{}")
    return str(tmp_path)


def test_rule_sets_from_files(spark, tmp_path):
    parsed = rulesets.parse(rulesets.read_documents(spark, rule_set_folder(tmp_path)))
    assert [tuple(r) for r in rulesets.listing(parsed).collect()] == [
        ("Clientes", "dashboard", "04/07/2026 09:49"),
        ("Contactos", "calidad", "—"),
        ("limite", "dashboard", "—"),
        ("vacio", "desconocido", "—"),
    ]
    assert [r["nombre"] for r in rulesets.listing(parsed, "calidad").collect()] == ["Contactos"]
    assert rulesets.load_assignments(parsed, " Clientes ") == (
        {"b": ["Vacíos", "Longitud mayor a N"], "a": ["Email"]},
        {("b", "Longitud mayor a N"): "10"},
    )
    assert rulesets.load_assignments(parsed, "limite")[1] == {("a", "Longitud mayor a N"): "5"}
    assert rulesets.load_assignments(parsed, "Contactos") is None
    assert rulesets.load_assignments(parsed, "otra") is None
    quality = rulesets.quality_settings(parsed).first()
    assert (quality["validar_email"], quality["validar_telefono"]) == (True, False)
    assert rulesets.exists(parsed, " Clientes", "archivo")
    assert not rulesets.exists(parsed, "Cliente", "archivo")


def test_rule_set_upsert_and_delete(spark, tmp_path):
    stored = rulesets.as_table(
        rulesets.parse(rulesets.read_documents(spark, rule_set_folder(tmp_path)))
    )
    fields = "tipo string, nombre string, columna string, pos int, regla string, " \
             "parametro string, validar_email boolean, validar_telefono boolean"  # fmt: skip
    new = spark.createDataFrame(
        [("dashboard", " Clientes", "z", 0, "Vacíos", None, None, None),
         ("calidad", "Año 1", "z", 0, None, None, True, False)], fields
    )
    after = rulesets.upsert(stored, rulesets.stamp(new))
    by_key = {}
    for row in after.collect():
        by_key.setdefault(row["clave"], []).append(row["columna"])
    assert by_key == {"Clientes": ["z"], "A_o_1": ["z"], "Contactos": ["c"], "limite": ["a"]}
    names = spark.createDataFrame([("Año 1",), ("nada",)], "nombre string")
    kept, outcome = rulesets.delete(after, names)
    assert {r["clave"] for r in kept.collect()} == {"Clientes", "Contactos", "limite"}
    assert {tuple(r) for r in outcome.collect()} == {("Año 1", True), ("nada", False)}


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.checkpoint_dir(spark) == folder
    assert session.scratch_path(spark, "x").startswith(folder)


def test_decimals_are_numbers(spark):
    from pulcro.operators import profile

    df = spark.createDataFrame([(Decimal("1.50"),), (Decimal("2.50"),)], "d decimal(10,2)")
    assert profile.columns_profile(df).select(F.round("p50", 2)).first()[0] == 2.0


def test_quotes_that_are_never_closed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x\ny"\n2,"abierta\n3,x","y\n4,z\n7,u\n')
    (tmp_path / "b.csv").write_text('k,v\n9,"todo\nbien"\n')
    read = delimited.read_delimited(spark, str(tmp_path))
    rows = {r["k"]: (r["fila"], r["v"]) for r in read.rows.collect()}
    assert rows["1"] == (0, "x\ny") and rows["4"] == (3, "z") and rows["9"][1] == "todo\nbien"
    bad = {r["fila"]: r["registro"] for r in read.bad.collect()}
    # The second one shows only when the lines behind the first are read anew.
    assert bad == {1: '2,"abierta', 2: '3,x","y'} and rows["7"] == (4, "u")
    assert sorted([r[0] for r in rows.values()] + list(bad)) == list(range(len(rows) + len(bad)))


def test_files_that_cannot_be_read_are_set_apart(spark, tmp_path):
    import gzip

    text = "k,v\n" + "".join(f"{i},año\n" for i in range(3000))
    whole = gzip.compress(text.encode())
    stored = {
        "a.csv": text.encode(), "b.csv.gz": whole[:-9], "c.csv.gz": whole + gzip.compress(b"9000,dos\n"),
        "d.csv": text.encode("latin-1"), "e.csv": text.encode("utf-16"), "f.csv": text.encode("utf-16-le"),
        "g.csv": b"", "h.csv": "\ufeffk,v\n1,x".encode(), "i.csv": text.encode("utf-32"), "j.csv.gz": b"no gzip",
    }
    for name, data in stored.items():
        (tmp_path / name).write_bytes(data)
    read = delimited.read_delimited_files(spark, str(tmp_path))
    files = {r["archivo"].rsplit("/", 1)[1]: (r["bytes"], r["filas"], r["problema"]) for r in read.files.collect()}
    assert {n: f[0] for n, f in files.items()} == {n: len(d) for n, d in stored.items()}
    assert {n: f[1] for n, f in files.items() if f[1]} == {"a.csv": 3000, "c.csv.gz": 3001, "h.csv": 1}
    assert {n: f[2] for n, f in files.items() if f[2]} == {
        "b.csv.gz": inspection.TRUNCATED, "d.csv": inspection.NOT_UTF_8, "e.csv": inspection.UTF_16,
        "f.csv": inspection.BINARY, "g.csv": inspection.EMPTY, "i.csv": inspection.UTF_32, "j.csv.gz": inspection.TRUNCATED,
    }
    assert read.rows.count() == 6002 and read.bad.count() == 0
    assert sorted(r["fila"] for r in read.rows.select("fila").collect()) == list(range(6002))


def test_rule_sets_are_saved_in_a_folder_a_save(spark, tmp_path):
    path = str(tmp_path / "reglas")
    fields = "clave string, nombre string, regla string"
    empty = spark.createDataFrame([], rulesets.TABLE_SCHEMA)

    def save(rows):
        rulesets.save(empty.unionByName(spark.createDataFrame(rows, fields), allowMissingColumns=True), path)

    save([(f"k{i}", "a", "Email") for i in range(300)] + [("", "sin", "Email"), (None, "nunca", "Email")])
    assert len([p for p in (tmp_path / "reglas").iterdir() if p.is_dir()]) == 1
    for _ in range(2):  # saving again changes nothing
        save([("k1", "b", "Vacíos"), ("k1", "b", "Texto"), ("007", "c", "Vacíos")])
    rows = [(r["clave"], r["nombre"], r["regla"]) for r in rulesets.saved(spark, path).collect()]
    assert len(rows) == 299 + 2 + 1 + 1 and ("007", "c", "Vacíos") in rows and (None, "sin", "Email") in rows
    assert sorted(r for r in rows if r[0] == "k1") == [("k1", "b", "Texto"), ("k1", "b", "Vacíos")]


@pytest.mark.parametrize("many", [1_000, 0])
def test_many_files_bad_ones_too_many_for_a_broadcast(spark, tmp_path, monkeypatch, many):
    """Lines stored once or read where they lie, and joins by shuffle, give the same rows."""
    for i in range(6):
        (tmp_path / f"a{i}.csv").write_text(f'k,v\n{i},x\n\n{i}1,"two\nlines"\n{i}2,"open\n{i}3,z\n')
        (tmp_path / f"b{i}.csv").write_bytes(f"k,v\n{i},é\n".encode("ISO-8859-1"))
    monkeypatch.setattr(delimited, "MANY_FILES", many, raising=False)
    monkeypatch.setattr(delimited, "is_small", lambda *_: False)
    read = delimited.read_delimited_files(spark, str(tmp_path))
    rows = sorted(tuple(r) for r in read.rows.collect())
    cells = [[(f"{i}", "x"), (f"{i}1", "two\nlines"), None, (f"{i}3", "z")] for i in range(6)]
    assert rows == [(n, *c) for n, c in enumerate(sum(cells, [])) if c]
    assert sorted(r["registro"] for r in read.bad.collect()) == [f'{i}2,"open' for i in range(6)]
    files = {r["archivo"].rsplit("/", 1)[1]: (r["filas"], r["problema"]) for r in read.files.collect()}
    good, bad = (4, None), (0, inspection.NOT_UTF_8)
    assert files == {f"{c}{i}.csv": good if c == "a" else bad for c in "ab" for i in range(6)}


def test_many_files_are_read_in_batches(spark, tmp_path, monkeypatch):
    """No index holds more files than a batch; odd names, hidden ones and empty files are as in one reading."""
    for i, name in enumerate(["d=1/a.csv", "d=1/b.csv", "d=2/[c].csv", "d=3/x*y{z}.csv", "e/f/g h.csv", "top.csv", "z?.csv"]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"k,v\n{i},x\n{i},y\n")
    for name in ("_SUCCESS", ".hidden.csv", "_tmp/h.csv", "d=1/.part.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("k,v\n9,hidden\n")
    (tmp_path / "d=2/none.csv").write_text("")
    (tmp_path / "d=3/cut.csv.gz").write_bytes(gzip.compress(b"k,v\n8,z\n")[:-6])
    sizes = []
    inspect = inspection._inspected
    monkeypatch.setattr(inspection, "_inspected", lambda s, files: sizes.append(len(files)) or inspect(s, files))
    monkeypatch.setattr(inspection, "BATCH_FILES", 2)
    monkeypatch.setattr(inspection, "MANY_FILES", 3)
    monkeypatch.setattr(delimited, "MANY_FILES", 3)
    before = spark.conf.get(inspection.LISTING_SETTING)
    read = delimited.read_delimited_files(spark, str(tmp_path))
    assert sorted((r["k"], r["v"]) for r in read.rows.collect()) == [(str(i), v) for i in range(7) for v in "xy"]
    assert [r["fila"] for r in read.rows.orderBy("fila").collect()] == list(range(14))
    problems = sorted(r["problema"] for r in read.files.collect() if r["problema"])
    assert problems == [inspection.EMPTY, inspection.TRUNCATED] and read.files.count() == 9
    assert sorted(sizes) == [1, 2, 2, 2, 2] and spark.conf.get(inspection.LISTING_SETTING) == before
