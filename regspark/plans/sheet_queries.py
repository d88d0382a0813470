"""Registered queries over pages, sheets, checks and guards of the register."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.functions import cleaning
from regspark.operators import filters, presence, risk, sheets
from regspark.plans import finance_queries as fin
from regspark.plans import merge_queries as mq
from regspark.plans import register_queries as reg
from regspark.plans import workflow_queries as wf
from regspark.plans.domain import COMPANIES_SQL, MONEY, companies, read

#: Pages by label: the key they follow, and conditions of filters.registry.
PAGES = {"first": (None, {}), "second": (50, {}), "inactive_in_a_province": (None, {"inactive": True, "province": "1-Urgent"}), "books_unknown": (100, {"keeps_books": filters.UNKNOWN}), "last": (1_000_000_000, {})}


def _holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 5 == 0, "SUSPENDED").when(k % 5 < 4, "ACTIVE").alias("state"), F.when(k % 3 < 2, k % 3 == 1).alias("keeps_books"))


def pl_registry_page(spark, sf_dir):
    """Pages of holders with the places and the first activity of their sites, which are orders."""
    holders = _holders(spark, sf_dir)
    sites = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("number"), F.col("o_orderpriority").alias("province"), F.col("o_orderstatus").alias("activity"), (F.col("o_orderkey") % 21).cast("string").alias("code"))
    made = (sheets.page(filters.registry(holders, sites, **conditions), sites, after=after).withColumn("page", F.lit(label)) for label, (after, conditions) in PAGES.items())
    return reduce(DataFrame.unionByName, made)


def jn_entity_children(spark, sf_dir):
    """Every company with its statement years, the lists it was on and its kinds of events, as JSON."""
    o, e = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "company"), read(spark, sf_dir, "events").withColumnRenamed("user_id", "company")
    years = o.groupBy("company", F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast(MONEY).cast("string").alias("assets"))
    lists = o.groupBy("company", F.col("o_orderpriority").alias("list")).agg(F.min(F.year("o_orderdate")).alias("since"), F.count("*").alias("n"))
    kinds = e.groupBy("company", F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    sheet = sheets.with_children(companies(spark, sf_dir).select("company", "name"), "company", {"years": (years, ["year", "assets"]), "lists": (lists, ["list", "since", "n"]), "events": (kinds, ["kind", "n"])})
    return sheet.select("company", "name", *(F.to_json(c).alias(c) for c in ("years", "lists", "events")))


def ag_catalog_levels(spark, sf_dir):
    """Sections with their divisions and these with their segments, each with its number of companies."""
    return sheets.tree(companies(spark, sf_dir), ["section", "division", "segment"]).select("section", "n", F.to_json("children").alias("children"))


def pl_quality_checks(spark, sf_dir):
    """Six checks with how much they found and the least five ids: codes that the catalogue lacks, orders without a
    company, statements that do not balance, ambiguous tax ids, texts with repairs, repeated parts of an order."""
    orphans = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").where("c_custkey % 9 <> 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    name = F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 6 == 0, F.lit("Ã‘")).otherwise(F.lit("Ñ")))
    repaired = read(spark, sf_dir, "customer").where(name != cleaning.repair_mojibake(name))
    repeated = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")
    return sheets.check_report({
        "unknown_codes": (mq.jn_anti_unknown_codes(spark, sf_dir), F.col("l_partkey")),
        "orphans": (orphans, F.col("o_orderkey")),
        "equation_breaks": (fin.ag_equation_check(spark, sf_dir), F.concat_ws("/", "company", "year", "form")),
        "ambiguous_ids": (mq.ag_ambiguous(spark, sf_dir), F.col("tax_id")),
        "repaired": (repaired, F.col("c_custkey")),
        "duplicates": (repeated, F.concat_ws("/", "l_orderkey", "l_partkey")),
        "none": (orphans.where("o_custkey IS NULL"), F.col("o_orderkey")),
    })


def st_population_guard(spark, sf_dir):
    """Rows of each population before and after they are put into one shape; a difference would stop it."""
    kinds = {"company": read(spark, sf_dir, "customer"), "supplier": read(spark, sf_dir, "supplier"), "person": read(spark, sf_dir, "events").select("user_id").distinct()}
    before = reduce(DataFrame.unionByName, (rows.select(F.lit(kind).alias("kind")) for kind, rows in kinds.items()))
    return sheets.population_guard(before, reg.pl_profile(spark, sf_dir))


def pl_presence_channels(spark, sf_dir):
    """Each subject's channels after all decisions, confirmed ones first, and its last fifty audit events."""
    s = sheets.presence(wf.mg_apply_decisions(spark, sf_dir), wf.mg_decision_audit(spark, sf_dir), "subject")
    channel = lambda x: F.concat_ws(":", x["channel"].cast("string"), x["state"], x["value"])
    event = lambda x: F.concat_ws(":", x["event_id"].cast("string"), x["action"])
    return s.select("subject", F.array_join(F.transform("channels", channel), " ").alias("channels"), F.array_join(F.transform("history", event), " ").alias("history"))


def pl_risk_credits(spark, sf_dir):
    """Statements with a positive tax credit and the sums of these, by year."""
    return risk.credit_summary(fin.pl_magnitudes(spark, sf_dir))


def pl_risk_persistence(spark, sf_dir):
    """Companies by in how many of their years the risk was high."""
    return risk.persistence(fin.pl_risk_profile(spark, sf_dir))


def pl_page_description(spark, sf_dir):
    """The description of each page, which is given one, both, none or too long a tag by its number."""
    k = F.col("page_id").cast("string")
    plain = F.concat(F.lit('<META data-x=1 name="description" content=" About  page '), k, F.lit(' ">'))
    og = F.concat(F.lit("<meta property='og:description' lang='es' content='Shared "), k, F.lit("'/>"))
    head = F.when(F.col("page_id") % 4 == 0, F.concat(plain, og)).when(F.col("page_id") % 4 == 1, plain).when(F.col("page_id") % 4 == 2, F.concat(F.lit('<meta property="og:description" content="'), F.repeat(F.lit("x"), 501), F.lit('">'), plain)).otherwise(F.lit('<meta name="keywords" content="description">'))
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat(head, "html").alias("html"))
    return presence.page_reading(pages, "page_id", "html").select("page_id", "description")


_PAGE_RULES = {"first": "true", "second": "id > 50", "inactive_in_a_province": "id % 5 IN (0, 4) AND id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", "books_unknown": "id > 100 AND id % 3 = 2", "last": "id > 1000000000"}
_PAGES_SQL = " UNION ALL ".join(f"(SELECT '{label}' AS page, *, row_number() OVER (ORDER BY id) AS k, count(*) OVER () AS n FROM holders WHERE {rule})" for label, rule in _PAGE_RULES.items())
_FINDINGS = {
    "unknown_codes": "SELECT l_partkey AS id FROM (" + mq.ORACLE_SQL["jn_anti_unknown_codes"] + ")",
    "orphans": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)",
    "equation_breaks": "SELECT company || '/' || year || '/' || form FROM (" + fin.ORACLE_SQL["ag_equation_check"] + ")",
    "ambiguous_ids": "SELECT tax_id FROM (" + mq.ORACLE_SQL["ag_ambiguous"] + ")",
    "repaired": "SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0",
    "duplicates": "SELECT l_orderkey || '/' || l_partkey FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1",
}

ORACLE_SQL = {
    "pl_registry_page": f"""WITH holders AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'SUSPENDED' WHEN c_custkey % 5 < 4 THEN 'ACTIVE' END AS state, CASE WHEN c_custkey % 3 < 2 THEN c_custkey % 3 = 1 END AS keeps_books FROM customer),
pages AS ({_PAGES_SQL}),
s AS (SELECT o_custkey AS id, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS places, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS main_activity, arg_min(CAST(o_orderkey % 21 AS VARCHAR), (o_orderdate, o_orderkey)) AS main_code FROM orders GROUP BY 1)
SELECT page, p.id, name, state, keeps_books, places, main_activity, main_code, CASE WHEN n > 50 THEN max(CASE WHEN k = 50 THEN p.id END) OVER (PARTITION BY page) END AS next FROM pages p LEFT JOIN s ON p.id = s.id WHERE k <= 50""",
    "jn_entity_children": f"""WITH {COMPANIES_SQL},
y AS (SELECT company, '[' || string_agg('{{"year":' || year || ',"assets":"' || assets || '"}}', ',' ORDER BY year) || ']' AS years FROM (SELECT o_custkey AS company, year(o_orderdate) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS assets FROM orders GROUP BY ALL) GROUP BY 1),
l AS (SELECT company, '[' || string_agg('{{"list":"' || list || '","since":' || since || ',"n":' || n || '}}', ',' ORDER BY list) || ']' AS lists FROM (SELECT o_custkey AS company, o_orderpriority AS list, min(year(o_orderdate)) AS since, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1),
e AS (SELECT company, '[' || string_agg('{{"kind":"' || kind || '","n":' || n || '}}', ',' ORDER BY kind) || ']' AS events FROM (SELECT user_id AS company, event_type AS kind, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1)
SELECT c.company, name, coalesce(years, '[]') AS years, coalesce(lists, '[]') AS lists, coalesce(events, '[]') AS events FROM companies c LEFT JOIN y ON c.company = y.company LEFT JOIN l ON c.company = l.company LEFT JOIN e ON c.company = e.company""",
    "ag_catalog_levels": f"""WITH {COMPANIES_SQL}, a AS (SELECT section, division, segment, count(*) AS n FROM companies GROUP BY ALL),
b AS (SELECT section, division, CAST(sum(n) AS BIGINT) AS n, '[' || string_agg('{{"name":"' || segment || '","n":' || n || '}}', ',' ORDER BY segment) || ']' AS children FROM a GROUP BY ALL)
SELECT section, CAST(sum(n) AS BIGINT) AS n, '[' || string_agg('{{"name":"' || division || '","n":' || n || ',"children":' || children || '}}', ',' ORDER BY division) || ']' AS children FROM b GROUP BY section""",
    "pl_quality_checks": " UNION ALL ".join(f"SELECT '{name}' AS check, count(*) AS n, array_to_string(list_sort(list(CAST(id AS VARCHAR)))[1:5], ', ') AS sample FROM ({sql}) AS t(id)" for name, sql in _FINDINGS.items()) + " UNION ALL SELECT 'none', 0, NULL",
    "st_population_guard": "SELECT 'company' AS kind, count(*) AS before, count(*) AS after FROM customer UNION ALL SELECT 'supplier', count(*), count(*) FROM supplier UNION ALL SELECT 'person', count(DISTINCT user_id), count(DISTINCT user_id) FROM events",
    "pl_presence_channels": "WITH c AS (SELECT subject, string_agg(concat_ws(':', channel, state, value), ' ' ORDER BY state <> 'confirmed', channel, value) AS channels FROM (" + wf.ORACLE_SQL["mg_apply_decisions"] + ") GROUP BY 1), h AS (SELECT subject, string_agg(event_id || ':' || action, ' ' ORDER BY ts DESC, event_id DESC) AS history FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY ts DESC, event_id DESC) AS k FROM (" + wf.ORACLE_SQL["mg_decision_audit"] + ")) WHERE k <= 50 GROUP BY 1) SELECT coalesce(c.subject, h.subject) AS subject, channels, history FROM c FULL JOIN h ON c.subject = h.subject",
    "pl_page_description": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Shared ' || page_id WHEN 3 THEN NULL ELSE 'About page ' || page_id END AS description FROM pages",
    "pl_risk_credits": fin._MAG + " SELECT year, count(*) AS statements, count(*) FILTER (WHERE vat_credit > 0) AS n_vat_credit, count(*) FILTER (WHERE income_tax_credit > 0) AS n_income_tax_credit, CAST(coalesce(sum(vat_credit) FILTER (WHERE vat_credit > 0), 0) AS DECIMAL(24,2)) AS sum_vat_credit, CAST(coalesce(sum(income_tax_credit) FILTER (WHERE income_tax_credit > 0), 0) AS DECIMAL(24,2)) AS sum_income_tax_credit FROM mag GROUP BY year",
    "pl_risk_persistence": fin._RISK + " SELECT years_high, years, count(*) AS companies, CAST(sum(gap_total) AS DECIMAL(30,6)) AS gap_total FROM profile GROUP BY ALL",
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
