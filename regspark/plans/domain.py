"""Derives the register's domain tables from the driver's star-schema tables.

Companies come from customers, statements from their orders and lines, unsupervised entities
from suppliers and natural persons from the users of events. The amounts are expressions over
yearly sums; every amount is decimal(18,2), and an account whose amount is zero is absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.operators.merge import dealt

MONEY = "decimal(18,2)"

#: Account code of each concept in form 1 and in form 3, null where the form lacks it.
CONCEPTS = {
    "assets": ("1", "499"),
    "current_assets": ("101", "361"),
    "noncurrent_assets": ("102", "449"),
    "liabilities": ("2", "599"),
    "current_liabilities": ("201", "550"),
    "noncurrent_liabilities": ("202", "589"),
    "equity": ("3", "698"),
    "retained_gains": ("30601", "611"),
    "retained_losses": ("30602", "612"),
    "retained_total": ("306", None),
    "retained_ifrs": ("30603", "614"),
    "vat_credit": ("1010501", "336"),
    "income_tax_credit": ("1010502", "337"),
    "income": ("401", "1005"),
    "gross_profit": ("402", "1025"),
    "cost_of_sales": ("501", "7991"),
    "expenses": ("502", "1030"),
    "profit_before_tax": ("600", "1065"),
    "net_profit": ("707", "1099"),
    "inventories": ("10103", None),
    "financial_expenses": ("50203", None),
}

#: Amount of each concept over the yearly sums of a company (SQL, decimal arithmetic).
AMOUNTS = {
    "assets": "a",
    "current_assets": "a * 0.40",
    "noncurrent_assets": "a * 0.60",
    "liabilities": "l",
    "current_liabilities": "l * 0.50",
    "noncurrent_liabilities": "l * 0.50",
    "equity": "a - l",
    "retained_gains": "CASE WHEN company % 3 = 0 THEN a * 0.05 END",
    "retained_losses": "CASE WHEN company % 7 = 0 THEN a * -0.02 END",
    "retained_total": "CASE WHEN company % 2 = 0 THEN a * 0.04 END",
    "retained_ifrs": "CASE WHEN company % 6 = 0 THEN a * 0.01 END",
    "vat_credit": "CASE WHEN (company + year) % 4 <> 1 THEN a * 0.01 END",
    "income_tax_credit": "CASE WHEN (company + year) % 5 <> 2 THEN i * 0.02 END",
    "income": "i",
    "gross_profit": "i - c",
    "cost_of_sales": "c",
    "expenses": "e",
    "profit_before_tax": "i - c - e",
    "net_profit": "(i - c - e) * 0.75",
    "inventories": "c * 0.10",
    "financial_expenses": "e * 0.20",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """company, name, tax_id, section (region), division (nation), grp (a part of the division), segment, capital."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").alias("company"),
        F.col("c_name").alias("name"),
        F.lpad((F.col("c_custkey") % 1400).cast("string"), 13, "0").alias("tax_id"),
        F.col("r_name").alias("section"),
        F.col("n_name").alias("division"),
        F.concat("n_name", F.when(F.col("c_custkey") % 8 == 0, ".b").otherwise(".a")).alias("grp"),
        F.col("n_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").cast(MONEY).alias("capital"),
    )


def yearly_sums(spark: SparkSession, sf_dir: str, by_company: bool = False) -> DataFrame:
    """year, company, i (income), c (cost), e (expenses), a (assets), l (liabilities).

    Lines are summed per order before the join, so the join moves one row an order. With `by_company`
    orders are dealt out by company alone, for those who join companies to the sums and need not deal them out again;
    both tables are dealt out as they are and by their number, since sums of few rows take more room than the rows
    and spill on a large table.
    """
    price = F.col("l_extendedprice").cast(MONEY)
    lines = read(spark, sf_dir, "lineitem")
    if by_company:
        moved = lines.select("l_orderkey", price.alias("l_extendedprice"), *(F.col(c).cast("decimal(4,2)").alias(c) for c in ("l_discount", "l_tax")))
        lines = dealt(moved, lines.count(), ["l_orderkey"])
    lines = lines.groupBy("l_orderkey").agg(
        F.sum(price * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("i"), F.sum(price).alias("p"), F.sum(price * F.col("l_tax").cast("decimal(4,2)")).alias("e")
    )
    total = F.col("o_totalprice").cast(MONEY)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year"), total.alias("t"), F.when(F.col("o_orderstatus") != "F", total).otherwise(F.lit(0)).alias("open"))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    if by_company:
        joined = dealt(joined.select("year", "company", "i", "p", "e", "t", "open"), read(spark, sf_dir, "orders").count(), ["company"])
    zero = F.lit(0).cast(MONEY)
    return joined.groupBy("year", "company").agg(
        F.coalesce(F.sum("i"), zero).cast(MONEY).alias("i"),
        (F.coalesce(F.sum("p"), zero) * F.lit("0.60").cast("decimal(3,2)")).cast(MONEY).alias("c"),
        F.coalesce(F.sum("e"), zero).cast(MONEY).alias("e"),
        F.sum("t").cast(MONEY).alias("a"),
        F.sum("open").cast(MONEY).alias("l"),
    )


def statements(spark: SparkSession, sf_dir: str, by_company: bool = False) -> DataFrame:
    """Long detail: year, form, company, account, value. Companies divisible by 5 file form 3,
    those divisible by 10 both forms; zero and missing amounts have no row."""
    sums = yearly_sums(spark, sf_dir, by_company).withColumn("form", F.explode(F.expr("CASE WHEN company % 10 = 0 THEN array(1, 3) WHEN company % 5 = 0 THEN array(3) ELSE array(1) END")))
    cells = F.array(
        *(
            F.struct(F.when(F.col("form") == 1, F.lit(one)).otherwise(F.lit(three)).alias("account"), F.expr(f"CAST({AMOUNTS[concept]} AS {MONEY})").alias("value"))
            for concept, (one, three) in CONCEPTS.items()
        )
    )
    return sums.select("year", "form", "company", F.inline(cells)).where("account IS NOT NULL AND value <> 0")


def _sql_cells() -> str:
    return " UNION ALL ".join(
        f"SELECT year, form, company, CASE WHEN form = 1 THEN {_text(one)} ELSE {_text(three)} END AS account, CAST({AMOUNTS[concept]} AS {MONEY}) AS value FROM sums"
        for concept, (one, three) in CONCEPTS.items()
    )


def _text(code: str | None) -> str:
    return "NULL" if code is None else f"'{code}'"


#: The same tables as DuckDB common table expressions.
COMPANIES_SQL = """companies AS (
  SELECT c_custkey AS company, c_name AS name, lpad(CAST(c_custkey % 1400 AS VARCHAR), 13, '0') AS tax_id, r_name AS section, n_name AS division, n_name || CASE WHEN c_custkey % 8 = 0 THEN '.b' ELSE '.a' END AS grp, n_nationkey AS nation, c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(18,2)) AS capital
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SUMS_SQL = """lines AS (
  SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS i, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS p, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))) AS e
  FROM lineitem GROUP BY l_orderkey),
yearly AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS company, CAST(coalesce(sum(i), 0) AS DECIMAL(18,2)) AS i, CAST(coalesce(sum(p), 0) * 0.60 AS DECIMAL(18,2)) AS c, CAST(coalesce(sum(e), 0) AS DECIMAL(18,2)) AS e,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS a, CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS l
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey GROUP BY ALL)"""
DETAIL_SQL = f"""{SUMS_SQL},
sums AS (SELECT *, unnest(CASE WHEN company % 10 = 0 THEN [1, 3] WHEN company % 5 = 0 THEN [3] ELSE [1] END) AS form FROM yearly),
detail AS (SELECT * FROM ({_sql_cells()}) WHERE account IS NOT NULL AND value <> 0)"""
