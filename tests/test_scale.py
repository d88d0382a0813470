"""Work that is dealt out by its size, whatever the number of shuffle partitions."""

from pyspark.sql import functions as F

from regspark.operators import merge
from regspark.plans import domain, finance_queries, sheet_queries, source_queries, window_queries
from regspark.sources import scratch

SF = "/root/testdata/sf0.001"


def test_two_fingerprints_deal_out_lines_by_their_number(spark, monkeypatch, capsys):
    monkeypatch.setattr(merge, "ROWS_A_TASK", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    done = window_queries.mg_two_fingerprints(spark, SF)
    done.explain()
    parts = -(-lines.count() // 500)
    assert parts > 8 and f", {parts}), REPARTITION_BY_NUM" in capsys.readouterr().out
    rows = {r["of"]: (r["updated"], r["unchanged"]) for r in done.collect()}
    every = lines.select("l_orderkey", "l_linenumber").distinct()
    assert rows["establishment"] == (every.where("l_orderkey % 4 = 0").count(), every.where("l_orderkey % 4 <> 0").count())


def _scans(df, capsys, table):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.count(f"{table}.parquet")


def test_comparable_companies_read_lines_once_and_look_for_no_peers(spark, capsys):
    done = window_queries.jn_semi_comparable(spark, SF)
    assert _scans(done, capsys, "lineitem") == 1
    risk = finance_queries.pl_risk_year(spark, SF).where("population = 'comparable'").select("company").distinct()
    assert {r["company"] for r in done.collect()} == {r["company"] for r in risk.collect()}


def test_risk_works_its_bases_out_once(spark, capsys):
    assert _scans(sheet_queries.pl_risk_persistence(spark, SF), capsys, "lineitem") == 0


def test_tourism_warnings_parse_the_register_once(spark, capsys):
    assert _scans(source_queries.src_tourism_warnings(spark, SF), capsys, "part") == 0


def test_wide_file_is_written_by_as_many_tasks_as_its_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(source_queries, "WIDE_ROWS", 8, raising=False)
    wide = source_queries._wide(spark, SF)
    companies = spark.read.parquet(f"{SF}/orders.parquet").where("year(o_orderdate) = 1998").select("o_custkey").distinct().count()
    assert wide.count() == companies and len(wide.inputFiles()) > companies // 16 > 2


def test_company_percentiles_move_no_row_by_its_value(spark, capsys):
    capsys.readouterr()
    finance_queries.pl_company_percentiles(spark, SF).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_company_percentiles_deal_lines_and_orders_out_once_by_their_number(spark, capsys, monkeypatch):
    monkeypatch.setattr(merge, "ROWS_A_TASK", 100)
    parts = {t: -(-spark.read.parquet(f"{SF}/{t}.parquet").count() // 100) for t in ("lineitem", "orders")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        capsys.readouterr()
        finance_queries._company_magnitudes(spark, SF).explain()
        plan = capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.index("REPARTITION_BY_NUM")].splitlines()  # from the join with companies down to the dealt orders
    assert [line.split("Exchange ")[1].split("#")[0] for line in above if "Exchange" in line] == ["hashpartitioning(company"]
    assert all(f", {n}), REPARTITION_BY_NUM" in plan for n in parts.values())


def test_amounts_by_company_are_the_same(spark):
    usual, by_company = (domain.statements(spark, SF, **x) for x in ({}, {"by_company": True}))
    assert usual.exceptAll(by_company).count() == by_company.exceptAll(usual).count() == 0 < usual.count()


def test_peer_sizes_are_broadcast(spark, capsys):
    capsys.readouterr()
    window_queries.wn_peer_fallback(spark, SF).explain()
    assert "SortMergeJoin" not in capsys.readouterr().out


def test_stored_tables_leave_no_shuffle_files(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        before = spark.conf.get(scratch.SHUFFLE_CLEANUP, None)
        rows = spark.range(1000).groupBy((F.col("id") % 300).alias("k")).agg(F.count("*").alias("n"))
        tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
        known = tracker.shuffleStatuses().size()
        stored = scratch.stored(rows, "counts")
        assert tracker.shuffleStatuses().size() <= known
        assert stored.count() == 300 and stored.agg(F.sum("n")).first()[0] == 1000
        assert spark.conf.get(scratch.SHUFFLE_CLEANUP, None) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
