"""Filters: what reaches the scan, tri-state conditions, joins only where asked for, names in any script."""

import pytest
from pyspark.sql import functions as F

from regspark.operators import filters


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("filters") / "rows")
    made = [(k, f"Ñandú {k} S.A.", f"17900{k:08d}", "QUITO" if k % 2 else "LOJA", "ACTIVE" if k % 3 else None, ["a", "b"][k % 2], "S1", None if k % 5 else 4, f"G47{k % 3}1.0{k % 10}", "p", [True, False, None][k % 3], k % 4 == 0, k % 8 == 0) for k in range(40)]
    spark.createDataFrame(made, "id long, name string, tax_id string, place string, state string, kind string, section string, missing_since int, activity string, population string, flag boolean, touristic boolean, ratified boolean").write.parquet(at)
    return spark.read.parquet(at)


def test_conditions_reach_the_scan(rows):
    shown = plan(filters.directory(rows, tax_id="1790", place="QUITO", kinds=["b"], section="S1"))
    pushed = shown[shown.index("PushedFilters: [") :].split("]")[0]
    for part in ("IsNull(missing_since)", "StringStartsWith(tax_id,1790)", "EqualTo(place,QUITO)", "EqualTo(section,S1)", "kind"):
        assert part in pushed
    # What reads inside a text does not reach it.
    assert "name" not in plan(filters.directory(rows, name="x")).split("PushedFilters: [")[1].split("]")[0].replace("IsNotNull(name)", "")
    assert "Join" not in plan(filters.registry(rows, state="ACTIVE")) and filters.directory(rows, missing=True) is rows


def test_directory_conditions(rows):
    def ids(**c):
        return {r["id"] for r in filters.directory(rows, **c).collect()}

    assert ids() == {k for k in range(40) if k % 5} and ids(missing=True) == set(range(40))
    assert ids(activity="G.471", missing=True) == {k for k in range(40) if k % 3 == 1} and ids(activity="G4711.01", missing=True) == {k for k in range(40) if k % 3 == 1 and k % 10 == 1}
    assert ids(name="NANDU 3 s.a", missing=True) == {3} and ids(name="ñÁNDÚ 1", kinds=["a"], missing=True) == {k for k in range(10, 20) if k % 2 == 0}


def test_tri_state(rows, spark):
    def ids(**c):
        return {r["id"] for r in filters.registry(rows, spark.createDataFrame([(k, f" p{k % 2} ") for k in range(0, 40, 4)], "id long, province string"), **c).collect()}

    assert [ids(flag=v) for v in (True, False, filters.UNKNOWN)] == [{k for k in range(40) if k % 3 == n} for n in range(3)]
    assert ids(inactive=True) == {k for k in range(40) if k % 3 == 0} and ids(inactive=False) | ids(inactive=True) == set(range(40))
    assert ids(province="P0") == set(range(0, 40, 4)) and ids(province="P1") == set()


def test_lists(rows, spark):
    lists = spark.createDataFrame([(k, "L" if k % 2 else "M", 2020 + k % 3) for k in range(20)] * 2, "id long, list string, year int")

    def ids(**c):
        return {r["id"] for r in filters.list_membership(rows, lists, key="id", **c).collect()}

    assert ids() == set(range(40)) and ids(any_list=True) == set(range(20)) and ids(on="L", year=2021) == {k for k in range(20) if k % 2 and k % 3 == 1}
    assert ids(none=True) == {k for k in range(20, 40) if k % 4} and ids(none=True, ratified=True, on="M") == {k for k in range(20, 40) if k % 4} | {k for k in range(40) if k % 8 == 0} | {k for k in range(20) if k % 2 == 0}
    assert filters.list_membership(rows, lists, key="id", any_list=True).count() == 20  # a row once, however often it is listed


@pytest.mark.parametrize("stored, asked", [("Ελληνική Εταιρεία ΑΕ", "ελληνικη εταιρεια"), ("Ważna Spółka Łódź", "SPOŁKA"), ("Công ty Cổ phần Điện lực Hà Nội", "co phan"), ("Ñandú y Compañía", "nandu Y companIa"), ("Straße 5", "strasse")])
def test_names_in_any_script(spark, stored, asked):
    df = spark.createDataFrame([(1, stored), (2, "other")], "id int, name string")
    assert [r["id"] for r in df.where(filters.contains("name", asked)).collect()] == [1]
    joined = df.select(filters.same_name(F.col("name")).alias("n")).join(spark.createDataFrame([(stored.upper(),)], "m string").select(filters.same_name(F.col("m")).alias("m")), F.col("n") == F.col("m"))
    assert joined.count() == 1  # by sort or hash on collation keys


def test_risk_last_year(spark):
    rows = spark.createDataFrame([(1, 2020, "c", 5.0, 2), (1, 2021, "c", 1.0, 2), (2, 2020, "d", 9.0, 0)], "company long, year int, population string, gap double, persistence int").withColumns({"name": F.lit("Uno"), "tax_id": F.lit("17"), "activity": F.lit("G47")})
    assert {(r["company"], r["year"]) for r in filters.risk(rows, last_year=True).collect()} == {(1, 2021), (2, 2020)}
    assert filters.risk(rows, last_year=True, gap=4).count() == 1 and filters.risk(rows, search="uNO", persistence=1).count() == 2
