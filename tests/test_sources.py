"""Readers and sinks on small files: encodings, yearly lists, providers, loading under rules."""

import pytest
from pyspark.sql import functions as F

from regspark.operators import merge
from regspark.sources import lists, loading, readers, tourism


@pytest.mark.parametrize("cut", [1, 2, 3])
@pytest.mark.parametrize("mark", ["é", "€", "😀"])
def test_no_character_is_cut(spark, tmp_path, cut, mark):
    """A file of more than 64 KB with a character of two to four bytes across each of the first bounds one could sample to."""
    lead = "a" * (65_536 - cut)
    (tmp_path / "long.txt").write_bytes((lead + mark + " cañón\n" + "é cañón\n" * 9).encode())
    got = [r["value"] for r in readers.read_text_any(spark, [str(tmp_path)]).collect()]
    assert got == [lead + mark + " cañón"] + ["é cañón"] * 9


def test_encodings_side_by_side(spark, tmp_path):
    (tmp_path / "mark.txt").write_bytes(b"\xef\xbb\xbf" + "Ñandú\nÉ\n".encode())
    (tmp_path / "utf.txt").write_bytes("Ñandú\r\nÉ".encode())
    (tmp_path / "latin.txt").write_bytes("plain\nÑandú\n".encode("latin-1"))
    (tmp_path / "empty.txt").write_bytes(b"")
    got = {}
    for r in readers.text_lines(spark, [str(tmp_path)]).orderBy("file", "place").collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append(r["value"])
    assert got == {"mark.txt": ["Ñandú", "É"], "utf.txt": ["Ñandú", "É"], "latin.txt": ["plain", "Ñandú"]}


def test_a_file_in_many_splits(spark, tmp_path):
    """Lines keep their order over the splits of a file, and its first block decides for all."""
    lines = [f"{k} Ñandú" for k in range(4000)]
    (tmp_path / "latin.txt").write_bytes("\n".join(lines).encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        df = readers.text_lines(spark, [str(tmp_path)])
        assert [r["value"] for r in df.orderBy("place").collect()] == lines and df.select("place.block").distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def write(folder, **files):
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("\n".join(lines), encoding="utf-8")
    return [str(folder)]


def test_yearly_lists(spark, tmp_path):
    head = "No.;RUC;Razón Social;Año aplicación"
    paths = write(
        tmp_path,
        bienes_2023=["Catastro de EXPORTADORES HABITUALES DE BIENES", "", head, "1;1790000000001;Uno;", "2;1790000000001;Uno otra vez;", "3;1790000000002;Dos;2025", "4;;Sin ruc;2023", "Nota: rebaja de tres puntos;;", ";;;"],
        rebaja_2023=["Exportadores habituales de bienes, rebaja de tres puntos", head, "1;1790000000001;Uno;"],
        servicios=["Exportación de servicios", "al 2024", head, "1;1790000000003;Tres;", "2;1790000000004;Cuatro;2024"],
        nada_2020=["texto", "1;1790000000001;Uno;2020"],
        raro_2021=["Otra lista", head, "1;1790000000001;Uno;"],
    )
    parsed = lists.yearly_lists(readers.text_lines(spark, paths)).persist()
    rows = {(r["list"], r["year"], r["tax_id"], r["name"]) for r in lists.list_rows(parsed).collect()}
    assert rows == {("goods", 2023, "1790000000001", "Uno otra vez"), ("goods", 2025, "1790000000002", "Dos"), ("rebate", 2023, "1790000000001", "Uno"), ("services", 2024, "1790000000004", "Cuatro")}
    rejects = {(r["label"], r["reason"], r["text"][:1]) for r in parsed.where("outcome = 'reject'").collect()}
    assert rejects == {("bienes_2023.csv", "no_tax_id", "4"), ("servicios.csv", "no_year", "1"), ("nada_2020.csv", "no_header", "t"), ("nada_2020.csv", "no_header", "1"), ("raro_2021.csv", "unknown_title", "1")}
    assert {r["text"] for r in parsed.where("outcome = 'note' AND label LIKE 'bienes%'").collect()} == {"Catastro de EXPORTADORES HABITUALES DE BIENES", "Nota: rebaja de tres puntos;;"}


def test_digital_providers(spark, tmp_path):
    paths = write(tmp_path, a=["Catastro", "Proveedor;Descripción;Registrado SRI", "NETFLIX;video;SI", "Netflix;video;NO", "NETFLIX;films;NO", ";nada;", "Fecha de publicación;1/2/2024", "Catastro publicado en;"])
    parsed = lists.digital_providers(readers.text_lines(spark, paths))
    assert {(r["provider"], r["description"], r["registered"]) for r in lists.provider_rows(parsed).collect()} == {("NETFLIX", "films", False), ("Netflix", "video", False)}
    assert {r["text"] for r in parsed.where("outcome = 'note'").collect()} == {"Catastro", "Fecha de publicación;1/2/2024", "Catastro publicado en;"}


def rules():
    return [loading.Rule("x", "negative", F.col("x") < 0), loading.Rule("name", "blank", F.col("name") == ""), loading.Rule("x", "odd", F.col("x") % 2 == 1, reject=False)]


def test_loading(spark, tmp_path):
    rows = [(1, 1, 2, "a"), (1, 2, 4, "later"), (2, 1, -1, ""), (3, 1, None, None), (4, 1, 5, "b"), (5, 1, -3, "c"), (6, 1, 3, "c")]
    got = loading.load(spark.createDataFrame(rows, "id int, n int, x int, name string"), rules(), ["id"], "n", str(tmp_path / "run"), most_rejects=1)
    assert {tuple(r) for r in got.rows.collect()} == {(1, 2, 4, "later"), (3, 1, None, None), (4, 1, 5, "b"), (6, 1, 3, "c")}
    assert got.metrics == {"read": 7, "rejected": 2, "warned": 2, "copied": 4, "duplicates": 1}  # exact, though one reject is kept
    assert [(r["id"], r["column"], r["reason"]) for r in got.rejects.orderBy("column").collect()] == [(2, "name", "blank"), (2, "x", "negative")]
    assert got.rejects.first()["raw"] == '{"id":2,"n":1,"x":-1,"name":""}' and {r["id"] for r in got.warnings.collect()} == {4, 6}


def test_loading_nothing_and_without_rules(spark, tmp_path):
    empty = spark.createDataFrame([], "id int, n int, x int, name string")
    assert loading.load(empty, rules(), ["id"], "n", str(tmp_path / "a")).metrics == {"read": 0, "rejected": 0, "warned": 0, "copied": 0, "duplicates": 0}
    one = spark.createDataFrame([(1, 1, -1, "")], empty.schema)
    assert loading.load(one, [], ["id"], "n", str(tmp_path / "b")).metrics["copied"] == 1


def test_loading_deals_out_rows_by_their_number(spark, tmp_path, monkeypatch):
    """A task's share is bounded, whatever the number of shuffle partitions."""
    monkeypatch.setattr(merge, "ROWS_A_TASK", 10)
    rows = spark.range(300).selectExpr("CAST(id % 200 AS INT) AS id", "CAST(id AS INT) AS n", "2 AS x", "'a' AS name")
    got = loading.load(rows, rules(), ["id"], "n", str(tmp_path / "run"))
    assert {(r["id"], r["n"]) for r in got.rows.collect()} == {(k, k + 200 if k < 100 else k) for k in range(200)} and got.metrics["duplicates"] == 100
    assert len(list((tmp_path / "run" / "rows").glob("*.parquet"))) > 20


def test_tourism_register(spark):
    columns = "n int, `Número de Registro` string, RUC string, Actividad string, `Fecha de registro` string, Extra string"
    rows = [(1, "R1", "1790000000001", "Hotel", "05/03/2021", "a"), (2, "R1", "1790000000001", "Hostal", "05/03/2021", "b"), (3, "R2", "9990000000001", "Bar", "6/07/2026; 28/07/2026", None), (4, None, "1790000000001", "Bar", None, None), (5, "R3", "S/N", "Bar", None, None), (6, "R4", "1790000000001", " - ", None, None), (7, None, None, "", None, None), (8, "R5", "1790000000001", "Bar", "", None), (9, "R5", "1790000000001", "Bar", "", None)]
    parsed = tourism.entries(spark.createDataFrame(rows, columns), "n")
    got = {(r["register"], r["n"], r["activity"], str(r["registered"]), r["registered_raw"]) for r in tourism.rows(parsed, "n").collect()}
    assert got == {("R1", 2, "Hostal", "2021-03-05", None), ("R2", 3, "Bar", "None", "6/07/2026; 28/07/2026"), ("R5", 9, "Bar", "None", None)}
    assert {tuple(r)[0:1] + tuple(r)[3:] for r in tourism.rejects(parsed, "n").collect()} == {(4, "register", "missing"), (5, "tax_id", "missing"), (6, "activity", "missing")}
    assert {tuple(r) for r in tourism.warnings(parsed, "n").collect()} == {(2, "R1", "register", "duplicate_with_other_data"), (3, "R2", "tax_id", "province"), (3, "R2", "registered", "unreadable")}
    with pytest.raises(readers.UnusableFile):
        tourism.entries(spark.createDataFrame([(1, "x")], "n int, RUC string"), "n")


def test_wide_statement_cells(spark):
    cells = {f"CUENTA_{k}": None for k in range(1, 623)} | {"CUENTA_1": "1.234,5", "CUENTA_2": "0", "CUENTA_3": " ", "CUENTA_622": ",5"}
    df = spark.createDataFrame([("2024", "7", *cells.values())], "ANIO string, EXP string, " + ", ".join(f"{c} string" for c in cells))
    assert [(r["company"], r["account"], float(r["value"])) for r in readers.wide_statements(df, "ANIO", "EXP").collect()] == [("7", "622", 0.5)]
    assert [(r["account"], r["raw"], r["reason"]) for r in readers.wide_statement_errors(df, "ANIO", "EXP").collect()] == [("1", "1.234,5", "INVALID")]


def test_segment_file(spark, tmp_path):
    rows = spark.createDataFrame([(k, 'say; "hi"' if k == 3 else None if k == 2 else "plain") for k in range(5)], "id int, what string")
    readers.write_segment(rows, str(tmp_path / "cut"), [F.desc("id")], 3)
    assert [r[0] for r in spark.read.text(str(tmp_path / "cut")).collect()] == ["id;what", "4;plain", '3;"say; ""hi"""', "2;", "# 2 rows left out"]
    readers.write_segment(rows.limit(0), str(tmp_path / "none"), [F.desc("id")], 3)
    assert [r[0] for r in spark.read.text(str(tmp_path / "none")).collect()] == ["id;what"]
