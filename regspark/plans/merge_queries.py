"""Registered queries over merges and register joins, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.operators import joins, merge
from regspark.plans.domain import COMPANIES_SQL, MONEY, companies, read

_VALUES = ["customer", "price"]


def _version(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").cast(MONEY).alias("price"), F.year("o_orderdate").alias("year"))
    if number == 2:
        return o.where("id % 11 <> 0").withColumn("price", F.when(F.col("id") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")).cast(MONEY))
    return o.where("id % 3 = 0") if number == 0 else o.where("id % 10 <> 0")


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.target_of(_version(spark, sf_dir, 1).select("id", *_VALUES), _VALUES, 1)


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.snapshot(_first(spark, sf_dir), _version(spark, sf_dir, 2), ["id"], _VALUES, 2)


_SHOWN = ["id", *_VALUES, "first_job", "last_job", "missing_since", "status"]


def mg_snapshot(spark, sf_dir):
    return _second(spark, sf_dir).select(_SHOWN)


def mg_resurrect(spark, sf_dir):
    """The first version comes again: rows missing since the second are resurrected."""
    return merge.snapshot(_second(spark, sf_dir).drop("status"), _version(spark, sf_dir, 1), ["id"], _VALUES, 3).select(_SHOWN)


def mg_replay(spark, sf_dir):
    """The second version once more changes nothing."""
    again = merge.snapshot(_second(spark, sf_dir).drop("status"), _version(spark, sf_dir, 2), ["id"], _VALUES, 3)
    return merge.counters(again)


def mg_partial(spark, sf_dir):
    return merge.counters(merge.snapshot(_first(spark, sf_dir), _version(spark, sf_dir, 2), ["id"], _VALUES, 2, full=False))


def mg_scoped_missing(spark, sf_dir):
    """A file that covers the even customers only marks no others as missing."""
    return merge.counters(merge.snapshot(_first(spark, sf_dir), _version(spark, sf_dir, 2).where("customer % 2 = 0"), ["id"], _VALUES, 2, scope=F.col("customer") % 2 == 0))


def mg_guard_truncated(spark, sf_dir):
    return merge.missing_share(merge.snapshot(_first(spark, sf_dir), _version(spark, sf_dir, 0), ["id"], _VALUES, 2))


def snk_run_metrics(spark, sf_dir):
    return merge.counters(_second(spark, sf_dir))


def mg_dedup_last(spark, sf_dir):
    """The last line of each order and part, by line number and then supplier."""
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.max("l_quantity").alias("quantity"))
    return merge.dedup_last(rows, ["l_orderkey", "l_partkey"], "l_linenumber").select("l_orderkey", "l_partkey", "quantity")


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("account")).agg(F.sum(F.col("l_quantity").cast(MONEY)).cast(MONEY).alias("value"))


def mg_header_detail(spark, sf_dir):
    """Orders divisible by 5 come again without their parts divisible by 4 and with one more of the others."""
    old = _detail(spark, sf_dir)
    new = old.where("id % 5 <> 0 OR account % 4 <> 0").withColumn("value", F.when(F.col("id") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")).cast(MONEY))
    known = read(spark, sf_dir, "part").where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("account"))
    return merge.header_detail(old, new, ["id"], "account", "value", known)


def mg_replace_children(spark, sf_dir):
    old = _detail(spark, sf_dir)
    return merge.replace_children(old, old.where("id % 3 = 0 AND account % 2 = 0"), ["id"])


def mg_insert_if_absent(spark, sf_dir):
    o = _version(spark, sf_dir, 1).select("id", "price")
    return merge.insert_if_absent(o, _version(spark, sf_dir, 2).select("id", "price"), ["id"])


def st_members_delta(spark, sf_dir):
    return merge.members_delta(_version(spark, sf_dir, 1).select("customer").distinct(), _version(spark, sf_dir, 2).where("year >= 1999").select("customer").distinct(), ["customer"])


def mg_latest_status(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return merge.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")


def mg_decision_state(spark, sf_dir):
    """Events by user: the state that they leave, how many there were, and whether it ever was confirmed."""
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("decisions"), F.bool_or(F.col("event_type") == "purchase").alias("ever_purchase"))


def mg_propagate_and_clear(spark, sf_dir):
    """Years of urgent orders onto companies by tax id; ids that several companies share get nothing."""
    c = companies(spark, sf_dir).select("company", "tax_id", F.when(F.col("company") % 2 == 0, "old").alias("years"))
    o = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.lpad((F.col("o_custkey") % 1400).cast("string"), 13, "0").alias("tax_id"), F.year("o_orderdate").cast("string").alias("y"))
    rollup = o.groupBy("tax_id").agg(F.array_join(F.array_sort(F.collect_set("y")), ",").alias("years"))
    return merge.propagate_and_clear(c, rollup, "tax_id", ["years"]).select("company", "tax_id", "years", "changed")


def jn_unique_key_enrich(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 13, "0").alias("tax_id"), F.col("s_name").alias("registered_name"))
    return joins.enrich_unique(companies(spark, sf_dir).select("company", "tax_id"), s, "tax_id").select("company", "tax_id", "registered_name")


def ag_ambiguous(spark, sf_dir):
    return joins.ambiguous_keys(companies(spark, sf_dir), "tax_id").select("tax_id", "n")


def jn_holder_kind(spark, sf_dir):
    """Users as companies, suppliers or unknown, the first that fits."""
    users = read(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    c, s = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).where("id % 3 = 0"), read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return joins.first_population(users, "id", {"company": c, "supplier": s}).select("id", "kind")


def jn_anti_unsupervised(spark, sf_dir):
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer").where("c_custkey % 4 <> 0")
    return s.join(c, F.col("s_suppkey") == F.col("c_custkey"), "left_anti").select("s_suppkey", "s_name")


def jn_anti_missing(spark, sf_dir):
    return _version(spark, sf_dir, 1).join(_version(spark, sf_dir, 2), "id", "left_anti").select("id", "customer")


def jn_anti_unknown_codes(spark, sf_dir):
    """Part numbers of lines that a catalogue without every seventh part lacks."""
    known = read(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select("p_partkey")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return lines.join(known, F.col("l_partkey") == F.col("p_partkey"), "left_anti")


def ag_orphans(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").where("c_custkey % 9 <> 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return o.agg(F.count_distinct("o_custkey").alias("companies"), F.count("*").alias("orders"))


def jn_semi_year(spark, sf_dir):
    years = read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct().where("year <> 2001")
    return _version(spark, sf_dir, 1).join(years, "year", "left_semi").groupBy("year").agg(F.count("*").alias("n"))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.substring("p_type", 1, 1), F.regexp_replace("p_brand", "[^0-9]", ""), F.col("p_size").cast("string"))
    return read(spark, sf_dir, "part").select(F.explode(F.array(F.substring(code, 1, 1), F.substring(code, 1, 2), code)).alias("code")).distinct()


def jn_longest_prefix(spark, sf_dir):
    return joins.prefix_parents(_codes(spark, sf_dir))


def ag_companies_per_code(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.concat(F.substring("p_type", 1, 1), F.regexp_replace("p_brand", "[^0-9]", ""), F.col("p_size").cast("string")).alias("code"))
    return joins.rows_per_prefix(_codes(spark, sf_dir), rows)


def ag_code_summary(spark, sf_dir):
    p = joins.prefix_parents(_codes(spark, sf_dir))
    return p.agg(F.count("*").alias("codes"), F.count_if(F.col("parent").isNull()).alias("roots"), F.count_if("leaf").alias("leaves"), F.max("depth").alias("depth"))


# ---- oracle SQL ----------------------------------------------------------------------------

_O = "SELECT o_orderkey AS id, o_custkey AS customer, CAST(o_totalprice AS DECIMAL(18,2)) AS price, year(o_orderdate) AS year FROM orders"
_V = f"""WITH o AS ({_O}), v0 AS (SELECT * FROM o WHERE id % 3 = 0), v1 AS (SELECT * FROM o WHERE id % 10 <> 0),
v2 AS (SELECT id, customer, CAST(CASE WHEN id % 7 = 0 THEN price + 1 ELSE price END AS DECIMAL(18,2)) AS price, year FROM o WHERE id % 11 <> 0),
m2 AS (SELECT coalesce(a.id, b.id) AS id, coalesce(b.customer, a.customer) AS customer, coalesce(b.price, a.price) AS price, CASE WHEN a.id IS NULL THEN 2 ELSE 1 END AS first_job,
  CASE WHEN a.id IS NULL OR b.price <> a.price THEN 2 ELSE 1 END AS last_job, CASE WHEN b.id IS NULL THEN 2 END AS missing_since,
  CASE WHEN a.id IS NULL THEN 'inserted' WHEN b.id IS NULL THEN 'missing' WHEN a.price <> b.price THEN 'updated' ELSE 'unchanged' END AS status FROM v1 a FULL JOIN v2 b ON a.id = b.id)"""
_COUNTERS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("inserted", "updated", "resurrected", "unchanged", "missing", "kept"))
_D = "WITH old AS (SELECT l_orderkey AS id, l_partkey AS account, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value FROM lineitem GROUP BY ALL)"
_CODE = "substr(p_type, 1, 1) || regexp_replace(p_brand, '[^0-9]', '', 'g') || p_size"
_P = f"WITH codes AS (SELECT DISTINCT unnest([substr(c, 1, 1), substr(c, 1, 2), c]) AS code FROM (SELECT {_CODE} AS c FROM part)), above AS (SELECT a.code, b.code AS p FROM codes a JOIN codes b ON length(b.code) < length(a.code) AND starts_with(a.code, b.code)), tree AS (SELECT c.code, arg_max(p, length(p)) AS parent, CAST(count(p) + 1 AS INTEGER) AS depth FROM codes c LEFT JOIN above a ON a.code = c.code GROUP BY c.code), full_tree AS (SELECT code, parent, depth, code NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL) AS leaf FROM tree)"

ORACLE_SQL = {
    "mg_snapshot": _V + " SELECT * FROM m2",
    "mg_resurrect": _V + """ SELECT m.id, coalesce(n.customer, m.customer) AS customer, coalesce(n.price, m.price) AS price, first_job,
 CASE WHEN n.id IS NOT NULL AND (missing_since IS NOT NULL OR n.price <> m.price) THEN 3 ELSE last_job END AS last_job, CASE WHEN n.id IS NULL AND missing_since IS NULL THEN 3 WHEN n.id IS NULL THEN missing_since END AS missing_since,
 CASE WHEN n.id IS NOT NULL AND missing_since IS NOT NULL THEN 'resurrected' WHEN n.id IS NOT NULL AND n.price <> m.price THEN 'updated' WHEN n.id IS NOT NULL THEN 'unchanged' WHEN missing_since IS NULL THEN 'missing' ELSE 'kept' END AS status FROM m2 m LEFT JOIN v1 n ON m.id = n.id""",
    "mg_replay": _V + " SELECT 0 AS inserted, 0 AS updated, 0 AS resurrected, count(*) FILTER (WHERE status <> 'missing') AS unchanged, 0 AS missing, count(*) FILTER (WHERE status = 'missing') AS kept FROM m2",
    "mg_partial": _V + " SELECT count(*) FILTER (WHERE status = 'inserted') AS inserted, count(*) FILTER (WHERE status = 'updated') AS updated, 0 AS resurrected, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, 0 AS missing, count(*) FILTER (WHERE status = 'missing') AS kept FROM m2",
    "mg_scoped_missing": _V + " SELECT count(*) FILTER (WHERE status = 'inserted' AND customer % 2 = 0) AS inserted, count(*) FILTER (WHERE status = 'updated' AND customer % 2 = 0) AS updated, 0 AS resurrected, count(*) FILTER (WHERE status = 'unchanged' AND customer % 2 = 0) AS unchanged, count(*) FILTER (WHERE status = 'missing' AND customer % 2 = 0) AS missing, count(*) FILTER (WHERE status <> 'inserted' AND customer % 2 <> 0) AS kept FROM m2",
    "mg_guard_truncated": _V + " SELECT count(*) AS live, count(*) FILTER (WHERE b.id IS NULL) AS missing, count(*) FILTER (WHERE b.id IS NULL) <= 0.2 * count(*) AS accepted FROM v1 a LEFT JOIN v0 b ON a.id = b.id",
    "snk_run_metrics": _V + f" SELECT {_COUNTERS} FROM m2",
    "mg_dedup_last": "SELECT l_orderkey, l_partkey, quantity FROM (SELECT l_orderkey, l_partkey, l_linenumber, max(l_quantity) AS quantity FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber DESC) = 1",
    "mg_header_detail": _D + """, new AS (SELECT id, account, CAST(CASE WHEN id % 5 = 0 THEN value + 1 ELSE value END AS DECIMAL(18,2)) AS value FROM old WHERE (id % 5 <> 0 OR account % 4 <> 0) AND account % 50 <> 0 AND account IN (SELECT p_partkey FROM part)),
mark AS (SELECT id, string_agg(account || ':' || value, ',' ORDER BY account) AS m FROM new GROUP BY id), mark_old AS (SELECT id, string_agg(account || ':' || value, ',' ORDER BY account) AS m FROM old GROUP BY id),
changed AS (SELECT a.id FROM mark a LEFT JOIN mark_old b ON a.id = b.id WHERE a.m IS DISTINCT FROM b.m)
SELECT * FROM old WHERE id NOT IN (SELECT id FROM changed) UNION ALL SELECT * FROM new WHERE id IN (SELECT id FROM changed)""",
    "mg_replace_children": _D + ", new AS (SELECT * FROM old WHERE id % 3 = 0 AND account % 2 = 0) SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new",
    "mg_insert_if_absent": _V + " SELECT id, price FROM v1 UNION ALL SELECT id, price FROM v2 WHERE id NOT IN (SELECT id FROM v1)",
    "st_members_delta": _V + ", a AS (SELECT DISTINCT customer FROM v1), b AS (SELECT DISTINCT customer FROM v2 WHERE year >= 1999) SELECT customer, 'entry' AS change FROM b WHERE customer NOT IN (SELECT customer FROM a) UNION ALL SELECT customer, 'exit' FROM a WHERE customer NOT IN (SELECT customer FROM b)",
    "mg_latest_status": "SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "mg_decision_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS decisions, bool_or(event_type = 'purchase') AS ever_purchase FROM events GROUP BY user_id",
    "mg_propagate_and_clear": f"WITH {COMPANIES_SQL}, c AS (SELECT company, tax_id, CASE WHEN company % 2 = 0 THEN 'old' END AS before FROM companies), r AS (SELECT lpad(CAST(o_custkey % 1400 AS VARCHAR), 13, '0') AS tax_id, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), u AS (SELECT tax_id FROM c GROUP BY 1 HAVING count(*) = 1) SELECT c.company, c.tax_id, r.years, before IS DISTINCT FROM r.years AS changed FROM c LEFT JOIN (SELECT * FROM r WHERE tax_id IN (SELECT tax_id FROM u)) r ON c.tax_id = r.tax_id",
    "jn_unique_key_enrich": f"WITH {COMPANIES_SQL}, u AS (SELECT tax_id FROM companies GROUP BY 1 HAVING count(*) = 1) SELECT company, c.tax_id, s.s_name AS registered_name FROM companies c LEFT JOIN supplier s ON c.tax_id = lpad(CAST(s_suppkey AS VARCHAR), 13, '0') AND c.tax_id IN (SELECT tax_id FROM u)",
    "ag_ambiguous": f"WITH {COMPANIES_SQL} SELECT tax_id, count(*) AS n FROM companies GROUP BY 1 HAVING count(*) > 1",
    "jn_holder_kind": "SELECT id, CASE WHEN id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) THEN 'company' WHEN id IN (SELECT s_suppkey FROM supplier) THEN 'supplier' ELSE 'unknown' END AS kind FROM (SELECT DISTINCT user_id AS id FROM events)",
    "jn_anti_unsupervised": "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)",
    "jn_anti_missing": _V + " SELECT id, customer FROM v1 WHERE id NOT IN (SELECT id FROM v2)",
    "jn_anti_unknown_codes": "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0) GROUP BY 1",
    "ag_orphans": "SELECT count(DISTINCT o_custkey) AS companies, count(*) AS orders FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)",
    "jn_semi_year": _V + " SELECT year, count(*) AS n FROM v1 WHERE year <> 2001 GROUP BY 1",
    "jn_longest_prefix": _P + " SELECT * FROM full_tree",
    "ag_companies_per_code": _P + f", r AS (SELECT {_CODE} AS c FROM part) SELECT code, count(*) FILTER (WHERE r.c = code) AS exact, count(r.c) AS under FROM codes LEFT JOIN r ON starts_with(r.c, code) GROUP BY code",
    "ag_code_summary": _P + " SELECT count(*) AS codes, count(*) FILTER (WHERE parent IS NULL) AS roots, count(*) FILTER (WHERE leaf) AS leaves, max(depth) AS depth FROM full_tree",
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
