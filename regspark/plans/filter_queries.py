"""Registered queries over the filters: each applies a table of combinations and returns (combination, id)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.operators import filters
from regspark.plans import finance_queries as fin
from regspark.plans.domain import COMPANIES_SQL, companies, read
from regspark.sources import scratch

#: Combinations of conditions by label.
DIRECTORY = {
    "all": {}, "live_and_missing": {"missing": True}, "name": {"name": "cÚstomer#00000001"}, "tax": {"tax_id": "00000000000"}, "place_status": {"place": "NATION_3", "status": "BUILDING"},
    "kinds": {"kinds": ["debtor", "large"], "section": "ASIA"}, "activity": {"activity": "C0.5"}, "everything": {"name": "#", "tax_id": "0", "status": "MACHINERY", "kinds": ["large"], "activity": "C", "population": "even", "missing": True},
}
REGISTRY = {"all": {}, "state": {"state": "SUSPENDED"}, "inactive": {"inactive": True}, "active": {"inactive": False}, "books": {"keeps_books": True}, "no_books": {"keeps_books": False}, "books_unknown": {"keeps_books": filters.UNKNOWN, "agent": True}, "province": {"province": " 1-urgent", "inactive": True, "keeps_books": False}}
MEMBERSHIP = {"all": {}, "touristic": {"touristic": True}, "ratified": {"ratified": True}, "any": {"any_list": True}, "any_1998": {"any_list": True, "year": 1998}, "one": {"on": "P"}, "one_1996": {"on": "P", "year": 1996}, "none": {"none": True}, "touristic_or_none": {"touristic": True, "none": True, "on": "P", "year": 1997}}
CODES = {"all": {}, "missing": {"missing": True}, "prefix": {"search": "B1.2"}, "name": {"search": "RÍNG"}, "level": {"level": 2}, "leaves": {"leaves": True, "search": "red"}}
STATEMENTS = {"all": {}, "year": {"year": 1997}, "company": {"name": "#0000000", "section": "ASIA"}, "tax": {"year": 1998, "tax_id": "00000000001", "missing": True}}
RISK = {"all": {}, "population": {"population": "comparable", "year": 1997}, "last": {"last_year": True, "gap": 1000}, "search": {"search": "000000000012"}, "activity": {"activity": "C1", "last_year": True, "persistence": 2}}


def _every(table: dict[str, dict], apply, ids: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (apply(c).select(F.lit(label).alias("combination"), *ids) for label, c in table.items()))


def _register(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = companies(spark, sf_dir)
    code = F.concat(F.lit("C"), F.lpad(F.col("nation").cast("string"), 2, "0"), F.lit("."), (F.col("company") % 10).cast("string"))
    return c.select("company", "name", "tax_id", "section", F.col("division").alias("place"), F.col("segment").alias("status"), F.when(F.col("capital") < 0, "debtor").when(F.col("capital") > 5000, "large").otherwise("small").alias("kind"), F.when(F.col("company") % 13 == 0, 2).alias("missing_since"), code.alias("activity"), F.when(F.col("company") % 2 == 0, "even").otherwise("odd").alias("population"))


def flt_directory_combinations(spark, sf_dir):
    rows = _register(spark, sf_dir)
    return _every(DIRECTORY, lambda c: filters.directory(rows, **c), ["company"])


def flt_registry_combinations(spark, sf_dir):
    """Customers with a state that may be unknown, two tri-state flags, and establishments by the priority of their orders."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "SUSPENDED").when(F.col("c_custkey") % 5 < 4, "ACTIVE").alias("state"), F.when(F.col("c_custkey") % 3 < 2, F.col("c_custkey") % 3 == 1).alias("keeps_books"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_custkey") % 4 == 1).alias("agent"))
    sites = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lower("o_orderpriority"), F.lit(" ")).alias("province"))
    return _every(REGISTRY, lambda c: filters.registry(rows, sites, **c), ["id"])


def flt_list_membership_combinations(spark, sf_dir):
    rows = companies(spark, sf_dir).select("company", F.when(F.col("company") % 7 < 2, F.col("company") % 7 == 0).alias("touristic"), (F.col("company") % 14 == 0).alias("ratified"))
    lists = read(spark, sf_dir, "orders").where("o_custkey % 2 = 0").select(F.col("o_custkey").alias("company"), F.col("o_orderstatus").alias("list"), F.year("o_orderdate").alias("year"))
    return _every(MEMBERSHIP, lambda c: filters.list_membership(rows, lists, key="company", **c), ["company"])


def flt_codes_combinations(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("B"), F.regexp_extract("p_brand", "([0-9]+)", 1), F.lit("."), F.col("p_size").cast("string")).alias("code"), F.col("p_name").alias("name"), (F.col("p_partkey") % 3 + 1).cast("int").alias("level"), (F.col("p_partkey") % 3 == 2).alias("leaf"), F.when(F.col("p_partkey") % 11 == 0, 4).alias("missing_since"))
    return _every(CODES, lambda c: filters.codes(rows, **c), ["id"])


def flt_statements_combinations(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year")).distinct().withColumn("missing_since", F.when((F.col("company") + F.col("year")) % 9 == 0, 3))
    c = companies(spark, sf_dir)
    return _every(STATEMENTS, lambda x: filters.statements(o, c, **x), ["company", "year"])


def flt_risk_combinations(spark, sf_dir):
    c = _register(spark, sf_dir).select("company", "name", "tax_id", "activity")
    rows = fin.pl_risk_year(spark, sf_dir).join(c, "company").withColumn("persistence", (F.col("company") % 4).cast("int"))
    at = scratch.new_folder(spark, "risk")  # the risk of all years is worked out once for all combinations
    rows.write.parquet(at)
    rows = spark.read.schema(rows.schema).parquet(at)
    return _every(RISK, lambda x: filters.risk(rows, **x), ["company", "year"])


def _sql(prefix: str, table: dict[str, str], ids: str, source: str) -> str:
    return prefix + " UNION ALL ".join(f"SELECT '{label}' AS combination, {ids} FROM {source} WHERE {rule}" for label, rule in table.items())


_REG = f"WITH {COMPANIES_SQL}, reg AS (SELECT company, name, tax_id, section, division AS place, segment AS status, CASE WHEN capital < 0 THEN 'debtor' WHEN capital > 5000 THEN 'large' ELSE 'small' END AS kind, company % 13 = 0 AS missing, 'C' || lpad(CAST(nation AS VARCHAR), 2, '0') || (company % 10) AS activity FROM companies)"
_LISTED = f"WITH {COMPANIES_SQL}, l AS (SELECT o_custkey AS company, o_orderstatus AS list, year(o_orderdate) AS year FROM orders WHERE o_custkey % 2 = 0) "

ORACLE_SQL = {
    "flt_directory_combinations": _sql(_REG + " ", {"all": "NOT missing", "live_and_missing": "true", "name": "NOT missing AND contains(lower(name), 'customer#00000001')", "tax": "NOT missing AND starts_with(tax_id, '00000000000')", "place_status": "NOT missing AND place = 'NATION_3' AND status = 'BUILDING'", "kinds": "NOT missing AND kind IN ('debtor', 'large') AND section = 'ASIA'", "activity": "NOT missing AND starts_with(activity, 'C05')", "everything": "contains(name, '#') AND starts_with(tax_id, '0') AND status = 'MACHINERY' AND kind = 'large' AND company % 2 = 0"}, "company", "reg"),
    "flt_registry_combinations": _sql("", {"all": "true", "state": "c_custkey % 5 = 0", "inactive": "c_custkey % 5 IN (0, 4)", "active": "c_custkey % 5 BETWEEN 1 AND 3", "books": "c_custkey % 3 = 1", "no_books": "c_custkey % 3 = 0", "books_unknown": "c_custkey % 3 = 2 AND c_custkey % 4 = 1", "province": "c_custkey % 5 IN (0, 4) AND c_custkey % 3 = 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"}, "c_custkey AS id", "customer"),
    "flt_list_membership_combinations": _sql(_LISTED, {"all": "true", "touristic": "company % 7 = 0", "ratified": "company % 14 = 0", "any": "company IN (SELECT company FROM l)", "any_1998": "company IN (SELECT company FROM l WHERE year = 1998)", "one": "company IN (SELECT company FROM l WHERE list = 'P')", "one_1996": "company IN (SELECT company FROM l WHERE list = 'P' AND year = 1996)", "none": "company % 7 <> 0 AND company NOT IN (SELECT company FROM l)", "touristic_or_none": "company % 7 = 0 OR company NOT IN (SELECT company FROM l) OR company IN (SELECT company FROM l WHERE list = 'P' AND year = 1997)"}, "company", "companies"),
    "flt_codes_combinations": _sql("", {"all": "p_partkey % 11 <> 0", "missing": "true", "prefix": "p_partkey % 11 <> 0 AND starts_with('B' || regexp_extract(p_brand, '([0-9]+)', 1) || p_size, 'B12')", "name": "p_partkey % 11 <> 0 AND contains(p_name, 'ring')", "level": "p_partkey % 11 <> 0 AND p_partkey % 3 = 1", "leaves": "p_partkey % 11 <> 0 AND p_partkey % 3 = 2 AND contains(p_name, 'red')"}, "p_partkey AS id", "part"),
    "flt_statements_combinations": _sql(f"WITH {COMPANIES_SQL}, s AS (SELECT DISTINCT o_custkey AS company, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) ", {"all": "(company + year) % 9 <> 0", "year": "(company + year) % 9 <> 0 AND year = 1997", "company": "(company + year) % 9 <> 0 AND company IN (SELECT company FROM companies WHERE contains(name, '#0000000') AND section = 'ASIA')", "tax": "year = 1998 AND company IN (SELECT company FROM companies WHERE starts_with(tax_id, '00000000001'))"}, "company, year", "s"),
    "flt_risk_combinations": fin._RISK + ", r AS (SELECT risk.company, risk.year, population, gap, tax_id, name, 'C' || lpad(CAST(nation AS VARCHAR), 2, '0') || (risk.company % 10) AS activity, max(risk.year) OVER (PARTITION BY risk.company) AS last FROM risk JOIN companies ON risk.company = companies.company) " + _sql("", {"all": "true", "population": "population = 'comparable' AND year = 1997", "last": "year = last AND gap >= 1000", "search": "starts_with(tax_id, '000000000012') OR contains(name, '000000000012')", "activity": "year = last AND company % 4 >= 2 AND starts_with(activity, 'C1')"}, "company, year", "r"),
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
