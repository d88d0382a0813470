"""Registered queries over the register: filters, counts, pages, profile, segments, presence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from regspark.operators import peers, presence, segments
from regspark.plans.domain import COMPANIES_SQL, MONEY, companies, read


def ag_conditional_counts(spark, sf_dir):
    c = companies(spark, sf_dir)
    return c.groupBy("section").agg(F.count("*").alias("companies"), F.count_if(F.col("capital") < 0).alias("negative"), F.count_if(F.col("segment") == "BUILDING").alias("building"), F.count_if(F.col("capital") >= 5000).alias("large"))


def ag_filtered_median(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("price"))
    years = o.groupBy("year").agg(F.count("*").alias("n"))  # a year without a finished order has no median
    m = peers.median(o, ["year"], "price", "median").withColumnRenamed("year", "_year")
    return years.join(m, F.col("year").eqNullSafe(F.col("_year")), "left").select("year", "median")


def ag_facets(spark, sf_dir):
    """The 40 most frequent values of three attributes, from one pass."""
    c = companies(spark, sf_dir).select("section", "division", "segment")
    each = F.inline(F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).alias("value")) for n in ("section", "division", "segment"))))
    sets = c.select(each).where("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))
    w = W.partitionBy("facet").orderBy(F.desc("n"), "value")
    return sets.withColumn("r", F.row_number().over(w)).where("r <= 40").drop("r")


def ag_list_years(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return o.groupBy(F.col("o_custkey").alias("company")).agg(F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))), ",").alias("years"))


def ag_places_text(spark, sf_dir):
    return companies(spark, sf_dir).groupBy("tax_id").agg(F.array_join(F.array_sort(F.collect_set("division")), ", ").alias("places"))


def ag_tourism_rollup(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("kinds"), F.count_distinct(F.when(F.col("p_size") > 25, F.col("p_size"))).alias("sizes"), F.bool_or(F.col("p_size") > 49).alias("any_large"))


def ag_registry_stats(spark, sf_dir):
    e, c = read(spark, sf_dir, "events"), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).where("user_id % 2 = 0").withColumn("known", F.lit(True))
    j = e.join(c, "user_id", "left")
    return j.agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("ids"), F.expr("count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase')").alias("buyers"), F.expr("count(DISTINCT user_id) FILTER (WHERE known)").alias("known_ids"))


def ag_bounded_count(spark, sf_dir):
    n = 10_000
    rows = read(spark, sf_dir, "orders").select("o_orderkey").limit(n)
    return rows.agg(F.count("*").alias("n")).withColumn("exact", F.col("n") < n)


def ag_channel_pivot(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(*(F.max_by("event_id", F.when(F.col("event_type") == k, F.struct("ts", "event_id"))).alias(f"last_{k}") for k in ("click", "purchase", "view")), F.count("*").alias("n"), F.max("ts").alias("last"))


def ag_review_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.count_distinct("user_id").alias("users"))


def ag_having_filtered(spark, sf_dir):
    g = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.year("o_orderdate") == 1998, F.col("o_totalprice").cast(MONEY))).alias("last_year"))
    return g.where("last_year >= 200000")


def ag_catalog_tree(spark, sf_dir):
    """Regions with their nations and numbers of companies, nested, as JSON text."""
    n = companies(spark, sf_dir).groupBy("section", "division").agg(F.count("*").alias("n"))
    return n.groupBy("section").agg(F.to_json(F.array_sort(F.collect_list(F.struct("division", "n")))).alias("tree"))


def flt_directory(spark, sf_dir):
    return companies(spark, sf_dir).where(F.col("name").ilike("%00%") & F.col("tax_id").startswith("0000000000") & F.col("section").isin("ASIA", "EUROPE") & (F.col("capital") > 0)).select("company", "name", "tax_id")


def flt_registry(spark, sf_dir):
    """Customers not certainly of BUILDING with an urgent order somewhere."""
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("company"))
    seg = F.when(F.col("company") % 6 != 0, F.col("segment"))
    return companies(spark, sf_dir).where(~seg.eqNullSafe(F.lit("BUILDING"))).join(urgent, "company", "left_semi").select("company", seg.alias("segment"))


def flt_list_membership(spark, sf_dir):
    years = ag_list_years(spark, sf_dir)
    c = companies(spark, sf_dir).join(years, "company", "left")
    kind = F.when(F.col("years").isNull(), "none").when(F.array_contains(F.split("years", ","), "1998"), "in_1998").otherwise("other_years")
    return c.select("company", kind.alias("membership"))


def flt_codes(spark, sf_dir):
    return read(spark, sf_dir, "part").where(F.col("p_brand").startswith("Brand#1") | F.lower("p_name").contains("red")).select("p_partkey", "p_brand")


def pg_keyset(spark, sf_dir):
    """A page of 50 after company 700, with whether there is a next one."""
    rows = companies(spark, sf_dir).where("company > 700").orderBy("company").limit(51).select("company", "name")
    w = W.orderBy("company")
    return rows.withColumns({"r": F.row_number().over(w), "more": F.count("*").over(W.partitionBy()) > 50}).where("r <= 50").drop("r")


def pg_offset(spark, sf_dir):
    return companies(spark, sf_dir).orderBy(F.desc_nulls_last("capital"), "company").offset(100).limit(40).select("company", "capital")


def wn_distinct_on(spark, sf_dir):
    """Each customer's first order by date, then the cheaper, then the number."""
    o = read(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_totalprice", "o_orderkey")).alias("first_order"))


def tk_main_activity(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("main_part"), F.count("*").alias("lines"))


def jn_entity_sheet(spark, sf_dir):
    c = companies(spark, sf_dir).select("company", "name")
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("company")).agg(F.count("*").alias("orders"), F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate").cast("string"))), ",").alias("years"))
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("company")).agg(F.count("*").alias("events"))
    return c.join(o, "company", "left").join(e, "company", "left")


def ag_latest_by_type(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.max("ts").alias("last_run"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"), F.count_if(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).alias("recent"))


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast(MONEY).alias("assets"))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a subject over three populations, in one shape."""
    c = companies(spark, sf_dir).join(segments.last_two(_headers(spark, sf_dir), ["assets"]), "company", "left")
    one = c.select(
        F.lit("company").alias("kind"), F.col("company").alias("id"), "name", F.col("division").alias("place"), "first_year", "last_year", "last_assets", "previous_assets", (F.col("segment") != "FURNITURE").alias("in_force"),
        F.when(F.col("company") % 3 == 0, F.concat(F.lit("c"), F.col("company"), F.lit("@mail.example"))).alias("contact"),
    )
    s = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(True).alias("in_force"))
    p = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.bool_or(F.col("event_type") == "purchase").alias("keeps_books"), (F.count("*") % 2 == 0).alias("in_force")).withColumn("kind", F.lit("person"))
    return one.unionByName(s, allowMissingColumns=True).unionByName(p, allowMissingColumns=True)


def pl_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


def st_population_check(spark, sf_dir):
    return _profile(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def flt_rule_text(spark, sf_dir):
    return segments.evaluate(_profile(spark, sf_dir), 2000)


def pl_segment_run(spark, sf_dir):
    """Entries and exits between the evaluations as of 1996 and 2000."""
    p = _profile(spark, sf_dir)
    return segments.run(segments.evaluate(p, 1996), segments.evaluate(p.where("kind <> 'company' OR id % 10 <> 0"), 2000))


def pl_segment_members(spark, sf_dir):
    members = segments.evaluate(_profile(spark, sf_dir), 2000).where("segment = 'large_assets'")
    return members.join(_profile(spark, sf_dir), ["kind", "id"]).where("contact IS NOT NULL").select("id", "name", "place", "last_assets", "contact")


def pl_registry_summary(spark, sf_dir):
    return _profile(spark, sf_dir).agg(F.count("*").alias("subjects"), F.count_if(F.col("in_force")).alias("in_force"), F.count_if(F.col("keeps_books")).alias("keep_books"), F.count_if(F.col("contact").isNotNull()).alias("with_contact"), F.count_distinct("place").alias("places"))


def pl_provinces(spark, sf_dir):
    return companies(spark, sf_dir).groupBy("section", "division").agg(F.count("*").alias("n"))


def pl_domain_candidates(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", F.lit("Compañía"), "c_mktsegment", F.substring("c_name", 1, 8), F.lit("S.A.")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x@firm"), F.col("c_custkey"), F.lit(".ec"))).when(F.col("c_custkey") % 3 == 1, F.lit("y@gmail.com")).alias("email"))
    return presence.domain_candidates(c, "c_custkey", "name", "email")


def pl_page_reading(spark, sf_dir):
    return presence.page_reading(read(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "title", "parked")


def pl_social_links(spark, sf_dir):
    """Profiles that pages link to; a profile, a share button and a network's home page are appended by page number."""
    extra = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<a href="https://www.facebook.com/firm'), F.col("page_id"), F.lit('/">f</a>'))).when(F.col("page_id") % 3 == 1, F.lit('<a href="https://www.facebook.com/sharer/sharer.php?u=x">s</a><a href="https://linkedin.com/company/acme">l</a>')).otherwise(F.lit('<a href="https://twitter.com/">t</a>'))
    return presence.social_links(read(spark, sf_dir, "pages").select("page_id", F.concat("html", extra).alias("html")), "page_id", "html")


def src_nested_payload(spark, sf_dir):
    """The JSON properties of events, flattened and summed by type."""
    e = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k INT").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count("p.k").alias("n"), F.max("p.k").alias("top"))


def src_conversation_children(spark, sf_dir):
    t = read(spark, sf_dir, "conversations")
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("role", "turn").alias("last_role"), F.sum(F.char_length("text")).alias("chars"))


def snk_rejects(spark, sf_dir):
    """Rejected rows with their reasons; a row may have several."""
    c = companies(spark, sf_dir)
    errors = F.filter(F.array(F.when(F.col("capital") < 0, F.struct(F.lit("capital").alias("field"), F.lit("negative").alias("reason"))), F.when(F.col("company") % 97 == 0, F.struct(F.lit("tax_id").alias("field"), F.lit("province").alias("reason")))), lambda x: x.isNotNull())
    return c.select("company", F.explode(errors).alias("e")).select("company", "e.field", "e.reason")


_PROFILE_SQL = f"""WITH {COMPANIES_SQL}, h AS (SELECT o_custkey AS company, year(o_orderdate) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS assets FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY year DESC) AS k FROM h),
t AS (SELECT company, min(year) AS first_year, max(year) AS last_year, max(CASE WHEN k = 1 THEN assets END) AS last_assets, max(CASE WHEN k = 2 THEN assets END) AS previous_assets FROM r GROUP BY company),
profile AS (SELECT 'company' AS kind, c.company AS id, name, division AS place, first_year, last_year, last_assets, previous_assets, segment <> 'FURNITURE' AS in_force, CASE WHEN c.company % 3 = 0 THEN 'c' || c.company || '@mail.example' END AS contact, CAST(NULL AS BOOLEAN) AS keeps_books FROM companies c LEFT JOIN t ON c.company = t.company
UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL, NULL, NULL, NULL, NULL, true, NULL, NULL FROM supplier
UNION ALL SELECT 'person', user_id, NULL, NULL, NULL, NULL, NULL, NULL, count(*) % 2 = 0, NULL, bool_or(event_type = 'purchase') FROM events GROUP BY user_id)"""


def _members_sql(name: str, year: int, where: str = "true") -> str:
    parts = [f"SELECT '{code}' AS segment, kind, id FROM profile WHERE {where} AND ({rule.replace('as_of_year', str(year))})" + ("" if lax else " AND in_force") for code, rule, active, lax in segments.RULES if active]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


_YEARS_SQL = "SELECT o_custkey AS company, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1"
_C = f"WITH {COMPANIES_SQL} "
_WORDS = "list_filter(string_split(trim(regexp_replace(upper(translate(name, 'ÁáÉéÍíÓóÚúÑñ', 'AaEeIiOoUuNn')), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains([" + ", ".join(f"'{w}'" for w in presence.LEGAL_WORDS) + "], w))"

ORACLE_SQL = {
    "ag_conditional_counts": _C + "SELECT section, count(*) AS companies, count(*) FILTER (WHERE capital < 0) AS negative, count(*) FILTER (WHERE segment = 'BUILDING') AS building, count(*) FILTER (WHERE capital >= 5000) AS large FROM companies GROUP BY section",
    "ag_filtered_median": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, quantile_cont(o_totalprice, 0.5) FILTER (WHERE o_orderstatus = 'F') AS median FROM orders GROUP BY 1",
    "ag_facets": _C + "SELECT facet, value, n FROM (SELECT 'section' AS facet, section AS value, count(*) AS n FROM companies GROUP BY section UNION ALL SELECT 'division', division, count(*) FROM companies GROUP BY division UNION ALL SELECT 'segment', segment, count(*) FROM companies GROUP BY segment) QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 40",
    "ag_list_years": _YEARS_SQL,
    "ag_places_text": _C + "SELECT tax_id, string_agg(DISTINCT division, ', ' ORDER BY division) AS places FROM companies GROUP BY 1",
    "ag_tourism_rollup": "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS kinds, count(DISTINCT CASE WHEN p_size > 25 THEN p_size END) AS sizes, bool_or(p_size > 49) AS any_large FROM part GROUP BY 1",
    "ag_registry_stats": "SELECT count(*) AS rows, count(DISTINCT user_id) AS ids, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers, count(DISTINCT user_id) FILTER (WHERE user_id % 2 = 0 AND user_id IN (SELECT c_custkey FROM customer)) AS known_ids FROM events",
    "ag_bounded_count": "SELECT least(count(*), 10000) AS n, count(*) < 10000 AS exact FROM orders",
    "ag_channel_pivot": "SELECT user_id, " + ", ".join(f"arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type = '{k}') AS last_{k}" for k in ("click", "purchase", "view")) + ", count(*) AS n, max(ts) AS last FROM events GROUP BY 1",
    "ag_review_summary": "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "ag_having_filtered": "SELECT o_custkey, sum(CASE WHEN year(o_orderdate) = 1998 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS last_year FROM orders GROUP BY 1 HAVING sum(CASE WHEN year(o_orderdate) = 1998 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) >= 200000",
    "ag_catalog_tree": _C + """SELECT section, '[' || string_agg('{"division":"' || division || '","n":' || n || '}', ',' ORDER BY division) || ']' AS tree FROM (SELECT section, division, count(*) AS n FROM companies GROUP BY ALL) GROUP BY section""",
    "flt_directory": _C + "SELECT company, name, tax_id FROM companies WHERE name ILIKE '%00%' AND starts_with(tax_id, '0000000000') AND section IN ('ASIA', 'EUROPE') AND capital > 0",
    "flt_registry": _C + "SELECT company, CASE WHEN company % 6 <> 0 THEN segment END AS segment FROM companies WHERE (company % 6 = 0 OR segment <> 'BUILDING') AND company IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "flt_list_membership": _C + f", y AS ({_YEARS_SQL}) SELECT c.company, CASE WHEN years IS NULL THEN 'none' WHEN contains(years, '1998') THEN 'in_1998' ELSE 'other_years' END AS membership FROM companies c LEFT JOIN y ON c.company = y.company",
    "flt_codes": "SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1') OR contains(lower(p_name), 'red')",
    "pg_keyset": _C + "SELECT company, name, (SELECT count(*) FROM companies WHERE company > 700) > 50 AS more FROM companies WHERE company > 700 ORDER BY company LIMIT 50",
    "pg_offset": _C + "SELECT company, capital FROM companies ORDER BY capital DESC NULLS LAST, company LIMIT 40 OFFSET 100",
    "wn_distinct_on": "SELECT o_custkey, o_orderkey AS first_order FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_totalprice, o_orderkey) = 1",
    "tk_main_activity": "SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS main_part, count(*) AS lines FROM lineitem GROUP BY 1",
    "jn_entity_sheet": _C + ", o AS (SELECT o_custkey AS company, count(*) AS orders, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years FROM orders GROUP BY 1), e AS (SELECT user_id AS company, count(*) AS events FROM events GROUP BY 1) SELECT c.company, name, orders, years, events FROM companies c LEFT JOIN o ON c.company = o.company LEFT JOIN e ON c.company = e.company",
    "ag_latest_by_type": "SELECT event_type, max(ts) AS last_run, arg_max(event_id, (ts, event_id)) AS last_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS recent FROM events GROUP BY 1",
    "pl_profile": _PROFILE_SQL + " SELECT * FROM profile",
    "st_population_check": _PROFILE_SQL + " SELECT kind, count(*) AS n, count(DISTINCT id) AS ids FROM profile GROUP BY 1",
    "flt_rule_text": f"{_PROFILE_SQL}, {_members_sql('m', 2000)} SELECT * FROM m",
    "pl_segment_run": f"{_PROFILE_SQL}, {_members_sql('a', 1996)}, {_members_sql('b', 2000, chr(40) + 'kind <> ' + repr('company') + ' OR id % 10 <> 0)')} SELECT *, 'entry' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'exit' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
    "pl_segment_members": _PROFILE_SQL + " SELECT id, name, place, last_assets, contact FROM profile WHERE last_assets >= 1500000 AND in_force AND contact IS NOT NULL",
    "pl_registry_summary": _PROFILE_SQL + " SELECT count(*) AS subjects, count(*) FILTER (WHERE in_force) AS in_force, count(*) FILTER (WHERE keeps_books) AS keep_books, count(contact) AS with_contact, count(DISTINCT place) AS places FROM profile",
    "pl_provinces": _C + "SELECT section, division, count(*) AS n FROM companies GROUP BY ALL",
    "pl_domain_candidates": f"""WITH c AS (SELECT c_custkey, 'Compañía ' || c_mktsegment || ' ' || substr(c_name, 1, 8) || ' S.A.' AS name, CASE c_custkey % 3 WHEN 0 THEN 'firm' || c_custkey || '.ec' END AS own FROM customer),
w AS (SELECT c_custkey, own, {_WORDS} AS w FROM c),
l AS (SELECT c_custkey, own, list_filter(list_transform([array_to_string(w, ''), array_to_string(w[1:2], '')] || list_filter(w, lambda x: length(x) >= 5), lambda x: lower(x)), lambda x: length(x) BETWEEN 4 AND 30) AS l FROM w),
u AS (SELECT c_custkey, own, unnest(l) AS label, generate_subscripts(l, 1) AS k FROM l), d AS (SELECT c_custkey, own, label, min(k) AS k FROM u GROUP BY ALL),
f AS (SELECT c_custkey, label || '.com.ec' AS domain, k * 2 AS k, 'name' AS origin FROM d UNION ALL SELECT c_custkey, label || '.ec', k * 2 + 1, 'name' FROM d UNION ALL SELECT DISTINCT c_custkey, own, 0, 'email' FROM c WHERE own IS NOT NULL)
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY k) AS INTEGER) AS rank, domain, origin FROM f QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY k) <= 8""",
    "pl_page_reading": "SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '[ \\t\\n\\r]+', ' ', 'g')), '') AS title, " + " OR ".join(f"contains(lower(html), '{p}')" for p in presence.PARKED) + " AS parked FROM pages",
    "pl_social_links": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'facebook' ELSE 'linkedin' END AS network, CASE page_id % 3 WHEN 0 THEN 'firm' || page_id ELSE 'acme' END AS handle FROM pages WHERE page_id % 3 < 2",
    "src_nested_payload": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS total, count(json_extract_string(props, '$.k')) AS n, max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS top FROM events GROUP BY 1",
    "src_conversation_children": "SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1",
    "snk_rejects": _C + "SELECT company, 'capital' AS field, 'negative' AS reason FROM companies WHERE capital < 0 UNION ALL SELECT company, 'tax_id', 'province' FROM companies WHERE company % 97 = 0",
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
