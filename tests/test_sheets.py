"""Pages, sheets, trees, checks and guards: literal cases, empty inputs, hot keys, and queries against DuckDB."""

import json
import os
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regspark.operators import peers, presence, risk, sheets
from regspark.plans import sheet_queries

SF = "/root/testdata/sf0.001"
SITES = "id int, number int, province string, activity string, code string"


def test_pages_follow_each_other_and_end(spark):
    holders = spark.createDataFrame([(k, f"n{k}") for k in range(1, 8)] + [(None, "no key")], "id int, name string")
    sites = spark.createDataFrame([(1, 2, "b", "late", "x"), (1, 1, "a", "first", None), (1, 3, "b", None, None), (6, 1, None, "six", "y")], SITES)
    seen, after = [], None
    while True:
        rows = sheets.page(holders, sites, size=3, after=after).orderBy("id").collect()
        seen += rows
        after = rows[-1]["next"]
        if after is None:
            break
    assert [r["id"] for r in seen] == list(range(1, 8)) and [r["next"] for r in seen] == [3, 3, 3, 6, 6, 6, None]
    assert tuple(seen[0])[2:5] == ("a, b", "first", None) and tuple(seen[1])[2:5] == (None, None, None) and tuple(seen[5])[2:5] == ("", "six", "y")
    assert sheets.page(holders, sites, size=7).where("next IS NOT NULL").count() == 0  # just full, nothing follows
    assert sheets.page(holders, sites, after=7).count() == 0 and sheets.page(holders.where("false"), sites).count() == 0


def test_a_page_aggregates_only_its_own_sites(spark):
    holders, sites = spark.range(100), spark.range(1000).selectExpr("id % 100 AS id", "id AS number", "'p' AS province", "'a' AS activity", "'c' AS code")
    plan = sheets.page(holders, sites, size=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "LeftSemi" in plan


def test_children_of_every_kind(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, name string")
    years = spark.createDataFrame([(1, 2001, 5), (1, 1999, None), (3, 2000, 1), (None, 1998, 1)], "id int, year int, v int")
    out = {r["name"]: (r["years"], r["none"]) for r in sheets.with_children(parents, "id", {"years": (years, ["year", "v"]), "none": (years.where("false"), ["v"])}).collect()}
    assert [tuple(x) for x in out["a"][0]] == [(1999, None), (2001, 5)] and out["b"] == ([], []) and out["c"] == ([], [])


def test_tree_counts_every_level(spark):
    rows = spark.createDataFrame([("u", "p", "s")] * 3 + [("u", "p", "t"), ("u", "q", None), (None, "p", "s")], "a string, b string, c string")
    got = {r["a"]: (r["n"], json.loads(r["j"])) for r in sheets.tree(rows, ["a", "b", "c"]).withColumn("j", F.to_json("children")).collect()}
    assert got["u"] == (5, [{"name": "p", "n": 4, "children": [{"name": "s", "n": 3}, {"name": "t", "n": 1}]}, {"name": "q", "n": 1, "children": [{"n": 1}]}])
    assert got[None][0] == 1 and sheets.tree(rows.where("false"), ["a", "b"]).count() == 0
    assert {tuple(r) for r in sheets.tree(rows, ["a"]).collect()} == {("u", 5), (None, 1)}


def test_checks_show_the_least_ids_and_name_what_found_nothing(spark):
    many = spark.range(5000)
    report = {r["check"]: (r["n"], r["sample"]) for r in sheets.check_report({"many": (many, F.lpad(F.col("id").cast("string"), 5, "0")), "few": (many.where("id < 2"), F.col("id")), "no": (many.where("false"), F.col("id"))}, sample=3).collect()}
    assert report == {"many": (5000, "00000, 00001, 00002"), "few": (2, "0, 1"), "no": (0, None)}


def test_guard_stops_lost_and_new_rows(spark):
    before = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "kind string")
    assert {tuple(r) for r in sheets.population_guard(before, before).collect()} == {("a", 2, 2), ("b", 1, 1), (None, 1, 1)}
    with pytest.raises(sheets.PopulationChanged, match="b: 1 before, 0 after"):
        sheets.population_guard(before, before.where("kind = 'a' OR kind IS NULL"))
    with pytest.raises(sheets.PopulationChanged, match="c: 0 before, 1 after"):
        sheets.population_guard(before, before.union(spark.createDataFrame([("c",)], "kind string")))
    assert sheets.population_guard(before.where("false"), before.where("false")).count() == 0


def test_presence_of_a_subject_with_most_events(spark):
    channels = spark.createDataFrame([(1, "web", "w", "proposed"), (1, "mail", "m", "confirmed"), (1, "fax", "f", "confirmed"), (2, "web", "x", "discarded")], "s int, channel string, value string, state string")
    history = spark.range(3000).selectExpr("1 AS s", "id div 2 AS ts", "id AS event_id", "'edit' AS action").union(spark.createDataFrame([(3, 1, 1, "delete")], "s int, ts long, event_id long, action string"))
    out = sheets.presence(channels, history, "s")
    got = {r["s"]: r for r in out.collect()}
    assert [c["channel"] for c in got[1]["channels"]] == ["fax", "mail", "web"] and [h["event_id"] for h in got[1]["history"]] == list(range(2999, 2949, -1))
    assert got[2]["history"] is None and got[3]["channels"] is None
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def test_median_against_brute_force(spark):
    groups = {"odd": [3.0, 1.0, 2.0], "even": [4.0, -1.0, 2.0, 9.5], "ties": [1.0] * 7 + [2.0] * 7, "one": [0.1], "none": [None]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    assert {r["g"]: r["m"] for r in peers.median(df, ["g"], "v", "m").collect()} == {g: statistics.median(vs) for g, vs in groups.items() if g != "none"}


def test_credit_summary_counts_positive_balances_only(spark):
    m = spark.createDataFrame([(2000, 5, None), (2000, -1, 0), (2000, None, None), (2001, 2, 3)], "year int, vat_credit decimal(18,2), income_tax_credit decimal(18,2)".replace("decimal(18,2)", "int"))
    assert {tuple(map(int, r)) for r in risk.credit_summary(m).collect()} == {(2000, 3, 1, 0, 5, 0), (2001, 1, 1, 1, 2, 3)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(sheet_queries.QUERIES) - {"pl_risk_persistence", "pl_risk_credits"}))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    expected = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    got = entry.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected.fetchall()))


def test_description_of_a_page(spark):
    cases = {
        '<meta name="description" content="plain"><meta property="og:description" content="shared">': "shared",
        "<META NAME='description' lang=x CONTENT='  a\n b '>": "a b",
        '<meta name="description" content="one"><meta name="description" content="two">': "one",
        '<meta property="og:description" content=""><meta name="description" content="plain">': None,
        f'<meta name="description" content="{"x" * 501}">': None,
        '<meta name="keywords" content="k"><p content="c">description</p>': None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, html string")
    assert [r["description"] for r in presence.page_reading(df, "k", "html").orderBy("k").collect()] == list(cases.values())
