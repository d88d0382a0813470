"""Registered queries over windows, remaining joins and aggregates, and the presence workflow, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from regspark.functions import cleaning
from regspark.operators import finance, joins, merge, peers, risk, segments
from regspark.plans import finance_queries as fin
from regspark.plans import register_queries as reg
from regspark.plans.domain import COMPANIES_SQL, DETAIL_SQL, MONEY, companies, read, statements


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast(MONEY).alias("price"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("priority"))


def wn_midrank_unit(spark, sf_dir):
    """Midrank of finished orders' prices within a year; others count for nothing and get NULL."""
    o = _orders(spark, sf_dir).withColumn("measured", F.when(F.col("state") == "F", F.col("price")))
    return peers.midrank(o, ["year"], "measured").select("id", "year", F.col("midrank").alias("percentile"))


def wn_midrank_pct(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return peers.midrank(o, ["year", "priority"], "price").select("id", F.round("midrank_100").cast("int").alias("percentile"))


def wn_conditional_count(spark, sf_dir):
    """Each order with the number of finished orders of its year, by aggregation and join."""
    o = _orders(spark, sf_dir)
    n = o.groupBy("year").agg(F.count_if(F.col("state") == "F").alias("finished"))
    return o.join(n, "year").select("id", "finished")


def wn_peer_fallback(spark, sf_dir):
    c = companies(spark, sf_dir).withColumn("year", F.lit(2000))
    return peers.peer_level(c, ["division"], "section", counts=F.col("capital") > 0, least=40).select("company", "peer_level", "peer_key")


def wn_lag_delta(spark, sf_dir):
    h = _orders(spark, sf_dir).groupBy("company", "year").agg(F.sum("price").cast(MONEY).alias("assets"))
    before = F.lag("assets").over(W.partitionBy("company").orderBy("year"))
    return h.select("company", "year", "assets", before.alias("before"), (F.col("assets") - before).cast(MONEY).alias("delta"))


def wn_last_two(spark, sf_dir):
    h = _orders(spark, sf_dir).groupBy("company", "year").agg(F.sum("price").cast(MONEY).alias("assets"))
    return segments.last_two(h, ["assets"])


def wn_first_last_series(spark, sf_dir):
    h = wn_lag_delta(spark, sf_dir)
    return h.groupBy("company").agg(F.min_by("assets", "year").alias("first"), F.max_by("assets", "year").alias("last"), F.max("assets").alias("top"), F.count_if(F.col("delta") > 0).alias("rises"), F.count_if(F.col("delta") < 0).alias("falls"))


def so_nulls(spark, sf_dir):
    """The 60 first by value, NULL last, with their rank."""
    c = companies(spark, sf_dir).select("company", F.when(F.col("company") % 3 != 0, F.col("capital")).alias("capital"))
    top = c.orderBy(F.desc_nulls_last("capital"), "company").limit(60)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("capital"), "company")))


def so_accounting(spark, sf_dir):
    """Account codes in byte order: a parent comes before its children."""
    codes = statements(spark, sf_dir).where("form = 1").select("account").distinct()
    return codes.withColumn("place", F.row_number().over(W.orderBy("account")))


def st_union_populations(spark, sf_dir):
    return reg.pl_profile(spark, sf_dir).groupBy("kind", "in_force").agg(F.count("*").alias("n"), F.count("name").alias("named"))


def st_map_overlay(spark, sf_dir):
    """Concepts that the form has but the company left out are 0; those it lacks are NULL."""
    m = finance.magnitudes(statements(spark, sf_dir))
    return m.groupBy("form").agg(F.count_if(F.col("inventories").isNull()).alias("null_inventories"), F.count_if(F.col("retained_losses") == 0).alias("zero_losses"), F.count("*").alias("n"))


def flt_statements(spark, sf_dir):
    m = finance.magnitudes(statements(spark, sf_dir)).where("year = 1998")
    return m.join(companies(spark, sf_dir).where(F.col("section") == "ASIA"), "company").select("company", "name", "form")


def flt_in_force(spark, sf_dir):
    c = companies(spark, sf_dir)
    rule = F.expr("CASE WHEN company % 4 = 0 THEN segment = 'BUILDING' ELSE segment IN ('BUILDING', 'AUTOMOBILE') OR segment IS NULL END")
    return c.where(rule).select("company")


def flt_risk(spark, sf_dir):
    """Each company's last year, where the gap is 1000 or more."""
    r = fin.pl_risk_year(spark, sf_dir)
    last = r.groupBy("company").agg(F.max_by(F.struct("year", "gap", "population"), "year").alias("s")).select("company", "s.*")
    return last.where("gap >= 1000")


def jn_semi_comparable(spark, sf_dir):
    """Companies with a comparable year; peers, which are of no account here, are not looked for."""
    r = risk.populations(fin._base(spark, sf_dir))
    return companies(spark, sf_dir).join(r.where("population = 'comparable'"), "company", "left_semi").select("company", "name")


def jn_fallback_per_base(spark, sf_dir):
    """How many bases used a specific coefficient and which base rules, by nation."""
    b = fin.pl_presumptive_base(spark, sf_dir)
    return b.groupBy("nation").agg(F.count_if("any_specific").alias("specific"), *(F.count_if(F.col("ruling_base") == k).alias(f"by_{k}") for k in ("income", "costs", "assets")))


def jn_activity_name(spark, sf_dir):
    """Parts with their activity's name by the dotted code; unmatched ones stay, with NULL."""
    code = F.concat(F.substring("p_type", 1, 1), F.lpad(F.pmod(F.col("p_partkey"), F.lit(50)).cast("string"), 6, "0"))
    p = read(spark, sf_dir, "part").select("p_partkey", cleaning.activity_dotted(code).alias("dotted"))
    names = p.where("p_partkey % 3 = 0").groupBy("dotted").agg(F.concat(F.lit("activity "), F.min("p_partkey")).alias("activity"))
    return p.join(names, "dotted", "left")


def jn_products_for_subject(spark, sf_dir):
    """Segments of each subject with their products, by priority."""
    products = F.explode(F.array(*(F.struct(F.lit(s).alias("segment"), F.lit(p).alias("product"), F.lit(k).alias("priority")) for s, p, k in (("large_assets", "audit", 1), ("crossed_threshold", "audit", 2), ("reachable", "newsletter", 3), ("bookkeepers", "software", 1)))))
    table = spark.range(1).select(products.alias("p")).select("p.*")
    j = segments.evaluate(reg.pl_profile(spark, sf_dir), 2000).join(table, "segment")
    return j.groupBy("kind", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("priority", "product"))), lambda x: x["product"]), ",").alias("products"))


def ag_pivot_last_two(spark, sf_dir):
    d = statements(spark, sf_dir).where("form = 1 AND account IN ('1', '401')")
    years = d.groupBy("company", "year").agg(F.max(F.when(F.col("account") == "1", F.col("value"))).alias("assets"), F.max(F.when(F.col("account") == "401", F.col("value"))).alias("income"))
    return segments.last_two(years, ["assets", "income"])


def ag_object_by_year(spark, sf_dir):
    m = finance.magnitudes(statements(spark, sf_dir)).where("vat_credit > 0")
    return m.groupBy("company").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", "vat_credit"))), lambda x: F.concat_ws("=", x["year"].cast("string"), x["vat_credit"].cast("string"))), ";").alias("credits"))


def ag_crawl_motives(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type", (F.col("value") > 50).alias("confirmed")).agg(F.count("*").alias("n"), F.count_if(F.col("props").contains('"k": 1')).alias("motive_one"))


def mg_mark_missing(spark, sf_dir):
    from regspark.plans.merge_queries import mg_snapshot

    return mg_snapshot(spark, sf_dir).where("missing_since IS NOT NULL").select("id", "missing_since")


def mg_two_fingerprints(spark, sf_dir):
    """Holders (orders) and their establishments (lines) merged under separate fingerprints: a changed line does not rewrite its holder."""
    orders = _orders(spark, sf_dir)
    holders = merge.dealt(orders.select("id", "company"), orders.count(), ["id"])
    every = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "l_quantity")
    lines = merge.dealt(every, every.count(), ["id", "line"]).groupBy("id", "line").agg(F.max("l_quantity").cast(MONEY).alias("quantity"))
    changed = lines.withColumn("quantity", F.when(F.col("id") % 4 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")).cast(MONEY))
    h = merge.snapshot(merge.target_of(holders, ["company"], 1), holders, ["id"], ["company"], 2)
    s = merge.snapshot(merge.target_of(lines, ["quantity"], 1), changed, ["id", "line"], ["quantity"], 2)
    return merge.counters(h).withColumn("of", F.lit("holder")).unionByName(merge.counters(s).withColumn("of", F.lit("establishment")))


def mg_reclassify(spark, sf_dir):
    """Users whose kind changed lose the row of the old kind."""
    e = read(spark, sf_dir, "events")
    old = e.groupBy("user_id").agg(F.when(F.count_if(F.col("event_type") == "purchase") > 13, "keeps").otherwise("plain").alias("kind"))
    new = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.when(F.count_if(F.col("event_type") == "purchase") > 6, "keeps").otherwise("plain").alias("kind"))
    stays = old.join(new.withColumnRenamed("kind", "_new"), "user_id", "left").where("_new IS NULL OR _new = kind").select("user_id", "kind")
    return stays.unionByName(new.join(stays, ["user_id", "kind"], "left_anti"))


def mg_scope_province(spark, sf_dir):
    return companies(spark, sf_dir).where(F.upper(F.trim(F.concat(F.lit(" "), F.lower("division")))) == "NATION_1").select("company")


def mg_content_change(spark, sf_dir):
    """Pages fetched again: only those whose content hash differs are written."""
    p = read(spark, sf_dir, "pages").select("page_id", "html")
    again = p.withColumn("html", F.when(F.col("page_id") % 6 == 0, F.concat("html", F.lit("<!-- new -->"))).otherwise(F.col("html")))
    m = merge.snapshot(merge.target_of(p, ["html"], 1), again, ["page_id"], ["html"], 2, full=False)
    return m.where("status = 'updated'").select("page_id", "last_job")


def pl_company_sector_view(spark, sf_dir):
    """Each company's return on assets over the years beside its section's median."""
    own = fin.pl_indicators(spark, sf_dir).select("year", "company", F.col("roa").alias("value")).where("value IS NOT NULL").join(companies(spark, sf_dir).select("company", "section"), "company")
    return own.join(peers.cuts(own, ["year", "section"], "value", (0.5,)).select("year", "section", "p50"), ["year", "section"])


def pl_risk_sheet(spark, sf_dir):
    """The years of every company at risk, with its name."""
    yearly = fin.pl_risk_year(spark, sf_dir)
    name = companies(spark, sf_dir).select("company", "name")
    return yearly.join(name, "company").select("company", "name", "year", "population", "gap", "percentile")


def pl_site_merge(spark, sf_dir):
    """Registry rows (one a site) to holders: their kind, number of sites and first site."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("holder"), F.col("l_orderkey").alias("site"), F.col("l_returnflag").alias("flag"))
    h = rows.groupBy("holder").agg(F.count_distinct("site").alias("sites"), F.min_by("flag", F.struct("site", "flag")).alias("main"))
    known = {"company": read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("holder")).where("holder % 2 = 0"), "supplier": read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("holder"))}
    return joins.first_population(h, "holder", known).select("holder", "kind", "sites", "main")


def pl_presence_sheet(spark, sf_dir):
    """Each user's number of events and last five event ids."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    # Each task leaves out all but a user's last five before they are shuffled.
    k = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    last = e.withColumn("k", k).where("k <= 5").groupBy(F.col("user_id").alias("_user")).agg(F.sort_array(F.collect_list(F.struct("k", "event_id"))).alias("s"))
    return n.join(last, n["user_id"].eqNullSafe(last["_user"])).select("user_id", "n", F.array_join(F.transform("s", lambda x: x["event_id"].cast("string")), ",").alias("last_five"))


def pl_payload_status(spark, sf_dir):
    """States of the work-list among the members of a segment."""
    members = segments.evaluate(reg.pl_profile(spark, sf_dir), 2000).where("segment = 'bookkeepers'").select(F.col("id").alias("user_id"))
    e = read(spark, sf_dir, "events").join(members, "user_id", "left_semi")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


def pl_quality_report(spark, sf_dir):
    """One row a check: its name and how many it found."""
    from regspark.plans import merge_queries as mq

    parts = {"unknown_codes": mq.jn_anti_unknown_codes(spark, sf_dir), "equation_breaks": fin.ag_equation_check(spark, sf_dir), "ambiguous_ids": mq.ag_ambiguous(spark, sf_dir)}
    rows = [df.agg(F.count("*").alias("n")).withColumn("check", F.lit(k)) for k, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_O = "WITH o AS (SELECT o_orderkey AS id, o_custkey AS company, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderstatus AS state, o_orderpriority AS priority FROM orders), h AS (SELECT company, year, CAST(sum(price) AS DECIMAL(18,2)) AS assets FROM o GROUP BY ALL), l AS (SELECT *, lag(assets) OVER (PARTITION BY company ORDER BY year) AS before, row_number() OVER (PARTITION BY company ORDER BY year DESC) AS k FROM h)"
_C = f"WITH {COMPANIES_SQL} "

ORACLE_SQL = {
    "wn_midrank_unit": _O + " SELECT id, year, CASE WHEN state = 'F' THEN (rank() OVER (PARTITION BY year, state ORDER BY price) - 1 + CAST(count(*) OVER (PARTITION BY year, state, price) AS DOUBLE) / 2) / count(*) OVER (PARTITION BY year, state) END AS percentile FROM o",
    "wn_midrank_pct": _O + " SELECT id, CAST(round(100 * (rank() OVER (PARTITION BY year, priority ORDER BY price) - 1 + CAST(count(*) OVER (PARTITION BY year, priority, price) AS DOUBLE) / 2) / count(*) OVER (PARTITION BY year, priority)) AS INTEGER) AS percentile FROM o",
    "wn_conditional_count": _O + " SELECT id, count(*) FILTER (WHERE state = 'F') OVER (PARTITION BY year) AS finished FROM o",
    "wn_peer_fallback": _C + ", n AS (SELECT division, count(*) FILTER (WHERE capital > 0) AS n FROM companies GROUP BY 1) SELECT company, CASE WHEN n >= 40 THEN 'division' ELSE 'section' END AS peer_level, CASE WHEN n >= 40 THEN c.division ELSE section END AS peer_key FROM companies c JOIN n ON c.division = n.division",
    "wn_lag_delta": _O + " SELECT company, year, assets, before, CAST(assets - before AS DECIMAL(18,2)) AS delta FROM l",
    "wn_last_two": _O + " SELECT company, min(year) AS first_year, max(year) AS last_year, max(CASE WHEN k = 2 THEN year END) AS previous_year, max(CASE WHEN k = 1 THEN assets END) AS last_assets, max(CASE WHEN k = 2 THEN assets END) AS previous_assets FROM l GROUP BY company",
    "wn_first_last_series": _O + " SELECT company, arg_min(assets, year) AS first, arg_max(assets, year) AS last, max(assets) AS top, count(*) FILTER (WHERE assets > before) AS rises, count(*) FILTER (WHERE assets < before) AS falls FROM l GROUP BY company",
    "so_nulls": _C + "SELECT company, CASE WHEN company % 3 <> 0 THEN capital END AS capital, CAST(row_number() OVER (ORDER BY CASE WHEN company % 3 <> 0 THEN capital END DESC NULLS LAST, company) AS INTEGER) AS rank FROM companies ORDER BY rank LIMIT 60",
    "so_accounting": f"WITH {DETAIL_SQL} SELECT account, CAST(row_number() OVER (ORDER BY account) AS INTEGER) AS place FROM (SELECT DISTINCT account FROM detail WHERE form = 1)",
    "st_union_populations": reg._PROFILE_SQL + " SELECT kind, in_force, count(*) AS n, count(name) AS named FROM profile GROUP BY ALL",
    "st_map_overlay": fin._MAG + " SELECT form, count(*) FILTER (WHERE inventories IS NULL) AS null_inventories, count(*) FILTER (WHERE retained_losses = 0) AS zero_losses, count(*) AS n FROM mag GROUP BY form",
    "flt_statements": fin._MAG + " SELECT company, name, form FROM mag JOIN companies USING (company) WHERE year = 1998 AND section = 'ASIA'",
    "flt_in_force": _C + "SELECT company FROM companies WHERE CASE WHEN company % 4 = 0 THEN segment = 'BUILDING' ELSE segment IN ('BUILDING', 'AUTOMOBILE') OR segment IS NULL END",
    "flt_risk": fin._RISK + " SELECT company, year, gap, population FROM (SELECT * FROM risk QUALIFY row_number() OVER (PARTITION BY company ORDER BY year DESC) = 1) WHERE gap >= 1000",
    "jn_semi_comparable": fin._RISK + " SELECT company, name FROM companies WHERE company IN (SELECT company FROM risk WHERE population = 'comparable')",
    "jn_fallback_per_base": fin._BASE + " SELECT nation, count(*) FILTER (WHERE any_specific) AS specific, " + ", ".join(f"count(*) FILTER (WHERE ruling_base = '{k}') AS by_{k}" for k in ("income", "costs", "assets")) + " FROM base GROUP BY nation",
    "jn_activity_name": "WITH p AS (SELECT p_partkey, substr(p_type, 1, 1) || '0000.' || lpad(CAST(p_partkey % 50 AS VARCHAR), 2, '0') AS dotted FROM part), n AS (SELECT dotted, 'activity ' || min(p_partkey) AS activity FROM p WHERE p_partkey % 3 = 0 GROUP BY 1) SELECT p.dotted, p_partkey, activity FROM p LEFT JOIN n ON p.dotted = n.dotted",
    "jn_products_for_subject": f"{reg._PROFILE_SQL}, {reg._members_sql('m', 2000)}, prod(segment, product, priority) AS (VALUES ('large_assets', 'audit', 1), ('crossed_threshold', 'audit', 2), ('reachable', 'newsletter', 3), ('bookkeepers', 'software', 1)), j AS (SELECT DISTINCT kind, id, priority, product FROM m JOIN prod USING (segment)) SELECT kind, id, string_agg(product, ',' ORDER BY priority, product) AS products FROM j GROUP BY ALL",
    "ag_pivot_last_two": f"WITH {DETAIL_SQL}, y AS (SELECT company, year, max(CASE WHEN account = '1' THEN value END) AS assets, max(CASE WHEN account = '401' THEN value END) AS income, row_number() OVER (PARTITION BY company ORDER BY year DESC) AS k FROM detail WHERE form = 1 AND account IN ('1', '401') GROUP BY company, year) SELECT company, min(year) AS first_year, max(year) AS last_year, max(CASE WHEN k = 2 THEN year END) AS previous_year, " + ", ".join(f"max(CASE WHEN k = {k} THEN {v} END) AS {n}_{v}" for k, n in ((1, "last"), (2, "previous")) for v in ("assets", "income")) + " FROM y GROUP BY company",
    "ag_object_by_year": fin._MAG + " SELECT company, string_agg(year || '=' || vat_credit, ';' ORDER BY year) AS credits FROM mag WHERE vat_credit > 0 GROUP BY company",
    "ag_crawl_motives": "SELECT event_type, value > 50 AS confirmed, count(*) AS n, count(*) FILTER (WHERE contains(props, '\"k\": 1')) AS motive_one FROM events GROUP BY ALL",
    "mg_mark_missing": "SELECT o_orderkey AS id, 2 AS missing_since FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 11 = 0",
    "mg_two_fingerprints": "WITH l AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS line FROM lineitem) SELECT 0 AS inserted, 0 AS updated, 0 AS resurrected, count(*) AS unchanged, 0 AS missing, 0 AS kept, 'holder' AS of FROM orders UNION ALL SELECT 0, count(*) FILTER (WHERE id % 4 = 0), 0, count(*) FILTER (WHERE id % 4 <> 0), 0, 0, 'establishment' FROM l",
    "mg_reclassify": "WITH a AS (SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 13 THEN 'keeps' ELSE 'plain' END AS kind FROM events GROUP BY 1), b AS (SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 6 THEN 'keeps' ELSE 'plain' END AS kind FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT a.user_id, coalesce(b.kind, a.kind) AS kind FROM a LEFT JOIN b ON a.user_id = b.user_id",
    "mg_scope_province": _C + "SELECT company FROM companies WHERE upper(division) = 'NATION_1'",
    "mg_content_change": "SELECT page_id, 2 AS last_job FROM pages WHERE page_id % 6 = 0",
    "pl_company_sector_view": fin._WIDE + ", v AS (SELECT year, company, section, roa AS value FROM wide JOIN companies USING (company) WHERE roa IS NOT NULL) SELECT *, round(quantile_cont(value, 0.5) OVER (PARTITION BY year, section), 6) AS p50 FROM v",
    "pl_risk_sheet": fin._RISK + " SELECT company, name, year, population, gap, percentile FROM risk JOIN companies USING (company)",
    "pl_site_merge": "SELECT l_suppkey AS holder, CASE WHEN l_suppkey % 2 = 0 AND l_suppkey IN (SELECT c_custkey FROM customer) THEN 'company' WHEN l_suppkey IN (SELECT s_suppkey FROM supplier) THEN 'supplier' ELSE 'unknown' END AS kind, count(DISTINCT l_orderkey) AS sites, arg_min(l_returnflag, (l_orderkey, l_returnflag)) AS main FROM lineitem GROUP BY l_suppkey",
    "pl_presence_sheet": "WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY k) FILTER (WHERE k <= 5) AS last_five FROM r GROUP BY user_id",
    "pl_payload_status": f"{reg._PROFILE_SQL}, {reg._members_sql('m', 2000)} SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE user_id IN (SELECT id FROM m WHERE segment = 'bookkeepers') GROUP BY 1",
    "pl_quality_report": "SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)) AS n, 'unknown_codes' AS check UNION ALL SELECT (SELECT count(*) FROM (" + fin.ORACLE_SQL["ag_equation_check"] + ")), 'equation_breaks' UNION ALL SELECT (SELECT count(*) FROM (SELECT c_custkey % 1400 FROM customer GROUP BY 1 HAVING count(*) > 1)), 'ambiguous_ids'",
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
