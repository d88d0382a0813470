"""Literal cases of cleaning and readers, laws of merges, streams, and queries against DuckDB."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regspark.functions import cleaning as c
from regspark.operators import finance, joins, merge, peers, presence
from regspark.sources import readers

SF = "/root/testdata/sf0.001"


def values(spark, cases, function):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, x string")
    return [r[0] for r in df.orderBy("k").select(function(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "function, cases",
    [
        (c.date, {"03/04/1998": dt.date(1998, 4, 3), "31/02/1998": None, "1-2-05": dt.date(2005, 2, 1), "7 SEPT 1999": dt.date(1999, 9, 7), "36526": dt.date(2000, 1, 1), "60": None, "2001-12-31T00:00": dt.date(2001, 12, 31), "n/a": None, None: None}),
        (c.number, {"1.234.567,89": decimal.Decimal("1234567.89"), "1,234,567.89": decimal.Decimal("1234567.89"), "1.234": decimal.Decimal(1234), "12,5": decimal.Decimal("12.50"), "USD 7.25": decimal.Decimal("7.25"), "abc": None, "99999999999999999": None}),
        (c.amount, {",63": decimal.Decimal("0.63"), "0,00": None, "": None, "1234567890123456,78": decimal.Decimal("1234567890123456.78"), "x": None}),
        (c.tax_id, {"190123456001": "0190123456001", "12345678901234": None, "": None}),
        (c.boolean, {"Sí": True, "no": False, "quizás": None}),
        (c.nullify, {"S/N": None, " a\u0000b  c ": "a b c", "Sin Información": None}),
        (c.repair_mojibake, {"CARREÃ‘O": "CARREÑO", "RECOLECCIÃ“N": "RECOLECCIÓN", "CARREÑO": "CARREÑO", "日本Ã“": "日本Ã“", "": ""}),
        (c.year, {"Año 1999": 1999, "999999": None, "1850": None}),
        (c.activity_dotted, {"G461001": "G4610.01", "G46": None}),
        (c.header_key, {" Situación  Legal": "SITUACION_LEGAL", "Nº (x)": "N_X"}),
    ],
)
def test_cleaning(spark, function, cases):
    assert values(spark, list(cases), function) == list(cases.values())


def test_aliases_and_wide_statements(spark):
    df = spark.createDataFrame([("1", "a")], ["Expediente ", "Razón Social"])
    out, report = readers.read_aliased(df, {"file": ["EXPEDIENTE"], "name": ["NOMBRE", "RAZON SOCIAL"], "city": ["CIUDAD"]}, ("file",))
    assert out.columns == ["file", "name"] and report == {"unknown": [], "missing": ["city"]}
    with pytest.raises(readers.UnusableFile):
        readers.read_aliased(df, {"id": ["RUC"]}, ("id",))
    names = ["year", "company", *(f"CUENTA_{k}" for k in range(622))]
    wide = spark.createDataFrame([("2020", "7", *("1,50" if k == 3 else "0" for k in range(622)))], names)
    assert [tuple(r) for r in readers.wide_statements(wide, "year", "company").collect()] == [(2020, 1, "7", "3", decimal.Decimal("1.50"))]
    with pytest.raises(readers.UnusableFile):
        readers.wide_statements(wide.drop("CUENTA_0"), "year", "company")


def test_pipe_registry(spark):
    lines = spark.createDataFrame([("a|b|c",), ('a|"b|x"|c',), ("a|b",)], ["value"])
    assert [(r["fields"], r["reason"]) for r in readers.pipe_registry(lines, 3).collect()] == [(["a", "b", "c"], None), (["a", "b|x", "c"], None), (None, "fields:2")]


def test_staircase_and_matrix(spark):
    df = spark.createDataFrame([("A01", "x", "deep", 1), ("A01", None, "last", 2), ("?", "n", None, 3)], ["code", "l1", "l2", "n"])
    assert [tuple(r) for r in readers.staircase_codes(df, "code", ["l1", "l2"], "n").collect()] == [("A01", "last", 2)]
    m = spark.createDataFrame([("A011", "0.05", "0"), ("bad", "1", "1")], ["code", "2020", "2021"])
    assert [tuple(r) for r in readers.year_matrix(m, "code").collect()] == [("A011", 2020, decimal.Decimal("0.0500"))]


def test_text_in_either_encoding(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Ñandú\n".encode())
    (tmp_path / "b.txt").write_bytes("Ñandú\n".encode("latin-1"))
    assert [r[0] for r in readers.read_text_any(spark, [str(tmp_path)]).collect()] == ["Ñandú", "Ñandú"]


def test_merge_laws(spark):
    v = ["x"]
    one = spark.createDataFrame([(k, str(k)) for k in range(10)], "id int, x string")
    target = merge.target_of(one, v, 1)
    assert merge.counters(merge.snapshot(target, one, ["id"], v, 2)).first().asDict() == {"inserted": 0, "updated": 0, "resurrected": 0, "unchanged": 10, "missing": 0, "kept": 0}
    fewer = merge.snapshot(target, one.where("id <> 3"), ["id"], v, 2)
    assert fewer.where("id = 3").first()["missing_since"] == 2 and fewer.count() == 10
    assert merge.snapshot(fewer.drop("status"), one, ["id"], v, 3).where("id = 3").first()["status"] == "resurrected"
    with pytest.raises(merge.TruncatedSnapshot):
        merge.guard(merge.snapshot(target, one.where("id < 5"), ["id"], v, 2))


def test_percentiles_have_mean_half(spark):
    rows = spark.createDataFrame([("g", float(k % 7)) for k in range(100)] + [("h", None)], "g string, v double")
    assert abs(peers.midrank(rows, ["g"], "v").agg(F.avg("midrank")).first()[0] - 0.5) < 1e-9


def test_prefix_parents(spark):
    codes = spark.createDataFrame([("1",), ("101",), ("10103",), ("2",)], ["code"])
    assert {tuple(r) for r in joins.prefix_parents(codes).collect()} == {("1", None, 1, False), ("101", "1", 2, False), ("10103", "101", 3, True), ("2", None, 1, True)}


def test_presence(spark):
    df = spark.createDataFrame([(1, "ACME del Pacífico S.A.", "x@gmail.com"), (2, "Uno", "a@Propio.ec")], ["id", "name", "email"])
    got = {(r["id"], r["rank"], r["domain"], r["origin"]) for r in presence.domain_candidates(df, "id", "name", "email").collect()}
    assert (1, 1, "acmepacifico.com.ec", "name") in got and (2, 1, "propio.ec", "email") in got
    assert presence.domain_candidates(df, "id", "name", "email").where("domain like '%gmail%'").count() == 0


def test_formulas_name_known_concepts():
    from regspark.plans.domain import CONCEPTS

    assert all(set(f.plus + f.minus + f.over) <= set(CONCEPTS) for f in finance.INDICATORS.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["pl_company_percentiles", "ag_sector_cuts", "pl_risk_profile", "mg_snapshot", "pl_segment_run", "pl_domain_candidates"])
def test_queries_count_as_the_oracle(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    expected = con.execute(entry.oracle_sql()[name]).fetchall()
    assert entry.queries()[name](spark, SF).count() == len(expected)


def test_presence_sheet_gathers_no_more_than_it_shows(spark, tmp_path):
    rows = [(1, k // 2, k) for k in range(2000)] + [(2, 5, 7), (None, 1, 8), (None, None, 9)]
    spark.createDataFrame(rows, "user_id long, ts long, event_id long").write.parquet(f"{tmp_path}/events.parquet")
    df = entry.queries()["pl_presence_sheet"](spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {(1, 2000, "1999,1998,1997,1996,1995"), (2, 1, "7"), (None, 2, "8,9")}
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()  # rows are left out before they are gathered


def test_distribution_against_brute_force(spark):
    import random

    r = random.Random(6)
    values = [0.0, -0.0, 1e-300, -1e-300, 5e300, float("inf"), float("-inf"), float("nan"), 3.0, 3.0000000001, None] + [r.choice((1, -1)) * 10 ** r.uniform(-3, 6) for _ in range(300)] + [r.randint(-3, 3) * 1.0 for _ in range(300)]
    rows = [(r.choice(("a", None)), v) for v in values]
    got = {(x["g"], str(x["v"] + 0.0)): (x["ties"], x["below"], x["n"]) for x in peers.distribution(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    place = lambda v: (v != v, v)  # noqa: E731  NaN is the largest
    for g, v in rows:
        if v is not None:
            own = [place(x) for h, x in rows if h == g and x is not None]
            same = [x for x in own if (x[0] and v != v) or x == place(v)]
            assert got[g, str(v + 0.0)] == (len(same), sum((not x[0]) if v != v else (not x[0] and x[1] < v) for x in own), len(own))


def test_mojibake_of_every_continuation_byte(spark):
    """All letters, alone in their text, and correct texts in which a letter precedes a quote or dash."""
    texts = [chr(n) for n in range(0xA0, 0x250)] + ["Èonoioi", "à demain…", "« café»", "Ouaux—é–è", "œuvre’ é’"]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    latin = F.decode(F.col("t").cast("binary"), "ISO-8859-1")
    broken = F.translate(latin, "".join(chr(b) for b in c.CP1252.values()), "".join(c.CP1252))
    assert table.where(~c.repair_mojibake(broken).eqNullSafe(F.col("t"))).collect() == []
    left = ["CORONA QUÃ?M", "GARCÃA", "CarreÃƒÂ±o", "Ouaux—é–è"]
    kept = spark.createDataFrame([(t,) for t in left], "t string").select(c.repair_mojibake(F.col("t")).alias("t")).collect()
    assert [r.t for r in kept] == left


def test_cuts_count_values_only_in_ranges_that_hold_one(spark):
    """Exact cuts, with ties, zeros and signs; values are counted one by one only where an order statistic lies."""
    groups = {"wide": [k * k / 7 - 900 for k in range(400)], "ties": [0.0] * 50 + [2.5] * 50, "one": [-3.0], "two": [1.0, 2.0]}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)], "g string, v double")
    found = peers.cuts(rows, ["g"], "v")
    got = {r["g"]: r for r in found.collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        want = duckdb.connect().execute(f"SELECT count(*), {', '.join(f'quantile_cont(v, {p})' for p in (0.1, 0.25, 0.5, 0.75, 0.9))}, avg(v) FROM (SELECT unnest({vs}::DOUBLE[]) AS v)").fetchone()
        assert tuple(got[g])[1:] == pytest.approx(want, abs=1e-6)
    assert {f.rsplit("/", 2)[1].split("-")[0] for f in found.inputFiles()} == {"ranges", "held"}  # both are stored, so that few rows are shuffled


def test_percentile_against_midrank(spark):
    import random

    r = random.Random(9)
    values = [0.0, -0.0, 1e-300, -1e-300, 5e300, float("inf"), float("-inf"), float("nan"), float("nan"), None] + [r.uniform(0.60, 0.61) for _ in range(900)] + [r.choice((1, -1)) * 10 ** r.uniform(-3, 6) for _ in range(300)] + [r.choice((0.5, 0.8, 1.0)) for _ in range(300)]
    rows = [(k, r.choice(("a", "a", "a", "b", None)), v) for k, v in enumerate(values)] + [(-1, "one", 4.0), (-2, "none", None)]
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(3)
    got = {x["id"]: x["percentile"] for x in peers.percentile(df, ["g"], "v").collect()}
    assert len(got) == len(rows)
    place = lambda v: (v != v, 0.0 if v != v else v)  # noqa: E731  NaN is the largest
    for k, g, v in rows:
        if v is None:
            assert got[k] is None
            continue
        own = [place(x) for _, h, x in rows if h == g and x is not None]
        share = 100 * (sum(x < place(v) for x in own) + own.count(place(v)) / 2) / len(own)
        assert got[k] == math.floor(share + 0.5), (g, v, share)
    assert peers.percentile(df.where("id > 10000"), ["g"], "v").collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_company_percentiles_equal_their_sql(spark):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    df = entry.queries()["pl_company_percentiles"](spark, SF)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()['pl_company_percentiles']})").fetchall()
    assert sorted(tuple(x) for x in df.collect()) == sorted(expected)
