"""Registered queries over the cleaning functions. Dirty text is rendered from clean columns, by
key modulo, and the oracle is the clean value (or NULL where the text is beyond repair)."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.functions import cleaning as c
from regspark.plans.domain import MONEY, read


def _by(key: str, *variants):
    """The variant that the key's remainder picks."""
    n = len(variants)
    out = F.when(F.col(key) % n == 0, variants[0])
    for k, v in enumerate(variants[1:], 1):
        out = out.when(F.col(key) % n == k, v)
    return out


def fn_coerce_date(spark, sf_dir):
    d = F.to_date("o_orderdate")
    text = _by(
        "o_orderkey", F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "yyyy-MM-dd"), F.concat(F.lit(" "), F.date_format(d, "d-M-yy")), F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"),
        F.concat(F.lit("31/02/"), F.year(d)), F.lit("N/A"), F.concat(F.dayofmonth(d), F.lit(" "), F.element_at(F.array(*map(F.lit, "enero Feb marzo Abr mayo Jun julio Ago sept Oct nov Dic".split())), F.month(d)), F.lit(" "), F.year(d)),
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", c.date(text).alias("day"))


def fn_coerce_numeric(spark, sf_dir):
    v = F.col("o_totalprice").cast(MONEY)
    us = F.format_number(v, 2)
    text = _by("o_orderkey", F.translate(us, ",.", ".,"), v.cast("string"), us, F.concat(F.lit("USD "), F.replace(v.cast("string"), F.lit("."), F.lit(","))), F.lit(" sin dato "), F.regexp_replace(F.format_number(F.floor(v), 0), ",", "."))
    return read(spark, sf_dir, "orders").select("o_orderkey", c.number(text).alias("price"))


def fn_coerce_amount(spark, sf_dir):
    v = F.col("l_tax").cast(MONEY)
    text = _by("l_orderkey", F.replace(v.cast("string"), F.lit("."), F.lit(",")), F.regexp_replace(F.replace(v.cast("string"), F.lit("."), F.lit(",")), "^0,", ","), F.lit("x1"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c.amount(text).alias("tax")).groupBy("l_orderkey", "l_linenumber", "tax").agg(F.count("*").alias("n"))


def fn_coerce_taxid(spark, sf_dir):
    text = _by("c_custkey", F.col("c_custkey").cast("string"), F.concat(F.lit("RUC 17"), F.lpad("c_custkey", 11, "0")), F.lit("12345678901234"), F.lit("s/n"))
    return read(spark, sf_dir, "customer").select("c_custkey", c.tax_id(text).alias("tax_id"), c.tax_id_note(text).alias("note"))


def fn_coerce_bool(spark, sf_dir):
    text = _by("c_custkey", F.lit("Sí"), F.lit(" no "), F.lit("x"), F.lit("quizás"), F.lit("N/A"))
    return read(spark, sf_dir, "customer").select("c_custkey", c.boolean(text).alias("flag"), c.yes_no(F.when(F.col("c_custkey") % 2 == 0, "S").otherwise("s")).alias("strict"))


def fn_coerce_year(spark, sf_dir):
    y = F.year("o_orderdate").cast("string")
    return read(spark, sf_dir, "orders").select("o_orderkey", c.year(_by("o_orderkey", y, F.concat(F.lit("Año "), y), F.lit("999999"), F.lit("-"))).alias("year"))


def fn_nullify(spark, sf_dir):
    text = _by("c_custkey", F.concat(F.lit("\t"), F.col("c_name"), F.lit("   ")), F.lit("Sin Información"), F.lit(" -- "), F.concat(F.lit("a\u0000b  "), F.col("c_mktsegment")))
    return read(spark, sf_dir, "customer").select("c_custkey", c.nullify(text).alias("text"))


def fn_header_key(spark, sf_dir):
    text = F.concat(F.lit(" Situación "), F.col("n_name"), F.lit(" (Nº) "))
    return read(spark, sf_dir, "nation").select("n_nationkey", c.header_key(text).alias("key"))


def fn_deaccent(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(c.deaccent(F.col("text")).cast("binary")).alias("plain"))


def fn_repair_mojibake(spark, sf_dir):
    """Texts broken by reading their UTF-8 as Windows-1252, then repaired."""
    d = read(spark, sf_dir, "documents")
    latin = F.decode(F.col("text").cast("binary"), "ISO-8859-1")
    broken = F.translate(latin, "".join(chr(b) for b in c.CP1252.values()), "".join(c.CP1252))
    return d.select("doc_id", c.repair_mojibake(broken).alias("text"))


def fn_fingerprint(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", c.fingerprint("c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")), F.col("c_nationkey")).alias("row_hash"))


def fn_activity(spark, sf_dir):
    code = F.concat(F.substring("p_type", 1, 1), F.lpad(F.pmod(F.col("p_partkey"), F.lit(1000000)).cast("string"), 6, "0"))
    code = F.when(F.col("p_partkey") % 5 == 0, F.substring(code, 1, 4)).otherwise(code)
    levels = c.activity_levels(code)
    return read(spark, sf_dir, "part").select("p_partkey", c.activity_dotted(code).alias("dotted"), *(v.alias(k) for k, v in levels.items()))


def fn_address(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", c.address(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lit(" "), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))).alias("address"))


def fn_channel_value(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", c.channel_value(F.lit("site"), F.col("url")).alias("site"), c.channel_value(F.lit("phone"), F.concat(F.lit("+593 (9) "), F.lpad(F.col("page_id"), 7, "0"))).alias("phone"))


def fn_email_or_null(spark, sf_dir):
    text = _by("c_custkey", F.concat(F.lit(" Info@"), F.col("c_custkey"), F.lit(".com ")), F.lit("none"), F.concat(F.lit("a b@"), F.col("c_name")))
    return read(spark, sf_dir, "customer").select("c_custkey", c.email_or_null(text).alias("email"), c.contact_kind(text).alias("kind"))


def fn_estab_code(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", c.establishment_code(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" 00"), F.col("s_suppkey"))), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("17-0"), F.col("s_suppkey"), F.lit("-9"))).otherwise(F.lit("x"))).alias("code"))


def fn_clamped_int(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", c.clamped(F.concat(F.col("p_size").cast("string"), F.lit(" u")), 10, 40).alias("size"))


def fn_coerce_text(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", c.text(F.to_date("o_orderdate")).alias("day"), c.text(_by("o_orderkey", F.concat(F.lit(" \t"), F.col("o_orderpriority"), F.lit(" ")), F.lit("s/n"))).alias("text"))


def fn_date_prefix(spark, sf_dir):
    d = F.to_date("o_orderdate")
    text = _by("o_orderkey", F.concat(d, F.lit(" 13:45:10.5")), F.concat(F.date_format(d, "dd/MM/yyyy"), F.lit(" 00:00")), F.concat(d, F.lit("T00:00:00Z")), F.lit("2021-02-30 10:00"))
    return read(spark, sf_dir, "orders").select("o_orderkey", c.date_prefix(text).alias("day"))


def fn_payload_date(spark, sf_dir):
    d = F.to_date("o_orderdate")
    text = _by("o_orderkey", F.concat(d, F.lit("T10:00")), F.date_format(d, "d/M/yyyy"), F.date_format(d, "dd-MM-yyyy"), F.lit("31/02/2020"), F.lit("1/1/1890"), F.lit(None))
    return read(spark, sf_dir, "orders").select("o_orderkey", c.payload_date(text).alias("day"))


def fn_payload_number(spark, sf_dir):
    v = F.col("o_totalprice").cast(MONEY).cast("string")
    text = _by("o_orderkey", F.concat(F.lit("USD "), v), F.concat(v, F.lit(" %")), F.concat(F.lit("-"), v), F.lit("1.2.3"), F.lit("none given"), F.lit("N/A"))
    return read(spark, sf_dir, "orders").select("o_orderkey", c.payload_number(text).alias("value"))


def fn_category_norm(spark, sf_dir):
    text = F.concat(F.lit(" Categoría   "), F.lower("c_mktsegment"), F.lit(" única "))
    kind = _by("c_custkey", F.lit("Urbana"), F.lit(" RURAL "), F.lit("rural"), F.lit("urbana y rural"), F.lit(None))
    return read(spark, sf_dir, "customer").select("c_custkey", c.category(text).alias("category"), c.parish_kind(kind).alias("parish"))


def fn_display(spark, sf_dir):
    m = lambda n, k, x: F.when(F.col("c_custkey") % n == k, x)
    years = [F.when(F.col("c_custkey") % n == 0, F.array(F.lit(2000) + F.col("c_custkey") % (10 + n), F.lit(2001)).cast("array<int>")) for n in (2, 3, 5)]
    return read(spark, sf_dir, "customer").select(
        "c_custkey", c.display_status(m(3, 0, "ACTIVO"), m(2, 0, "PASIVO")).alias("status"),
        c.display_location(m(2, 0, F.col("c_mktsegment")), m(3, 0, F.lit("Quito")), m(5, 0, F.lit("Loja")), m(7, 0, F.lit("Zona 9"))).alias("location"), c.newest_year(*years).alias("newest"),
    )


def fn_cell_errors(spark, sf_dir):
    """Why cells gave no value: the error channels of the coercions."""
    text = _by("o_orderkey", F.lit("31/02/2020"), F.lit("n/a"), F.lit("12,5"), F.lit("x1"), F.lit("2020"), F.lit("sí"))
    return read(spark, sf_dir, "orders").select("o_orderkey", c.date_error(text).alias("day"), c.number_error(text).alias("number"), c.amount_error(text).alias("amount"), c.year_error(text).alias("year"), c.boolean_error(text).alias("flag"))


def fn_year_of_number(spark, sf_dir):
    y, d = F.year("o_orderdate"), F.datediff(F.to_date("o_orderdate"), F.lit("1899-12-30").cast("date"))
    return read(spark, sf_dir, "orders").select("o_orderkey", c.year_of_number(_by("o_orderkey", y.cast("double") + 0.5, d.cast("double"), F.lit(99999.0), F.lit(12.0))).alias("year"))


def fn_fingerprint_uuid(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", c.as_uuid(c.fingerprint("c_name", F.col("c_custkey") % 2 == 0, F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 2 == 1))).alias("row_hash"))


_PLAIN = f"translate(text, '{c._ACCENTED}', '{c._PLAIN}')"

ORACLE_SQL = {
    "fn_coerce_text": "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS text FROM orders",
    "fn_date_prefix": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "fn_payload_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "fn_payload_number": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN -v WHEN 3 THEN NULL WHEN 4 THEN 0 WHEN 5 THEN NULL ELSE v END AS value FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS v FROM orders)",
    "fn_category_norm": "SELECT c_custkey, 'CATEGORIA ' || c_mktsegment || ' UNICA' AS category, CASE c_custkey % 5 WHEN 0 THEN 'urbana' WHEN 1 THEN 'rural' WHEN 2 THEN 'rural' END AS parish FROM customer",
    "fn_display": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ACTIVO' WHEN c_custkey % 2 = 0 THEN 'PASIVO' ELSE 'Sin estado' END AS status, coalesce(nullif(concat_ws(' · ', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN 'Quito' WHEN c_custkey % 5 = 0 THEN 'Loja' END), ''), CASE WHEN c_custkey % 7 = 0 THEN 'Zona 9' END, 'Ubicación no disponible') AS location, CAST(greatest(CASE WHEN c_custkey % 2 = 0 THEN greatest(2000 + c_custkey % 12, 2001) END, CASE WHEN c_custkey % 3 = 0 THEN greatest(2000 + c_custkey % 13, 2001) END, CASE WHEN c_custkey % 5 = 0 THEN greatest(2000 + c_custkey % 15, 2001) END) AS INTEGER) AS newest FROM customer",
    "fn_cell_errors": "SELECT o_orderkey, CASE WHEN k NOT IN (1, 4) THEN 'invalid_date' END AS day, CASE WHEN k = 5 THEN 'invalid_number' END AS number, CASE WHEN k NOT IN (2, 4) THEN 'INVALID' END AS amount, CASE WHEN k IN (2, 3, 5) THEN 'invalid_year' END AS year, CASE WHEN k NOT IN (1, 5) THEN 'invalid_flag' END AS flag FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)",
    "fn_year_of_number": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders",
    "fn_fingerprint_uuid": "SELECT c_custkey, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS row_hash FROM (SELECT c_custkey, md5(c_name || chr(31) || CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0' END || chr(31) || CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 1 THEN '1' ELSE '0' END ELSE '' END) AS h FROM customer)",
    "fn_coerce_date": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 NOT IN (4, 5) THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "fn_coerce_numeric": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN NULL WHEN 5 THEN CAST(floor(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS price FROM orders",
    "fn_coerce_amount": "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 < 2 THEN nullif(CAST(l_tax AS DECIMAL(18,2)), 0) END AS tax, count(*) AS n FROM lineitem GROUP BY ALL",
    "fn_coerce_taxid": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey AS VARCHAR), 13, '0') WHEN 1 THEN '17' || lpad(CAST(c_custkey AS VARCHAR), 11, '0') END AS tax_id, CASE WHEN c_custkey % 4 = 2 THEN 'too_long' WHEN c_custkey % 4 = 0 AND substr(lpad(CAST(c_custkey AS VARCHAR), 13, '0'), 1, 2) NOT BETWEEN '01' AND '24' THEN 'province' END AS note FROM customer",
    "fn_coerce_bool": "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS flag, CASE WHEN c_custkey % 2 = 0 THEN true END AS strict FROM customer",
    "fn_coerce_year": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(year(o_orderdate) AS INTEGER) END AS year FROM orders",
    "fn_nullify": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 3 THEN 'a b ' || c_mktsegment END AS text FROM customer",
    "fn_header_key": "SELECT n_nationkey, 'SITUACION_' || regexp_replace(upper(n_name), '[^A-Z0-9]+', '_', 'g') || '_N' AS key FROM nation",
    "fn_deaccent": f"SELECT doc_id, md5({_PLAIN}) AS plain FROM documents",
    "fn_repair_mojibake": "SELECT doc_id, text FROM documents",
    "fn_fingerprint": "SELECT c_custkey, md5(c_name || chr(31) || CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE '' END || chr(31) || c_nationkey) AS row_hash FROM customer",
    "fn_activity": "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN substr(k, 1, 4) ELSE k END AS k FROM (SELECT p_partkey, substr(p_type, 1, 1) || lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0') AS k FROM part)) SELECT p_partkey, CASE WHEN length(k) = 7 THEN substr(k, 1, 5) || '.' || substr(k, 6, 2) END AS dotted, substr(k, 1, 4) AS grp, substr(k, 1, 3) AS division, substr(k, 1, 1) AS section FROM p",
    "fn_address": "SELECT c_custkey, nullif(concat_ws(', ', CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END), '') AS address FROM customer",
    "fn_channel_value": "SELECT page_id, 'https://' || regexp_replace(regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '[?#].*$', ''), '/+$', '') AS site, '5939' || lpad(CAST(page_id AS VARCHAR), 7, '0') AS phone FROM pages",
    "fn_email_or_null": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'info@' || c_custkey || '.com' END AS email, CASE c_custkey % 3 WHEN 1 THEN 'unknown' ELSE 'email' END AS kind FROM customer",
    "fn_estab_code": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 THEN CAST(s_suppkey AS VARCHAR) END AS code FROM supplier",
    "fn_clamped_int": "SELECT p_partkey, CASE WHEN p_size BETWEEN 10 AND 40 THEN p_size END AS size FROM part",
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
