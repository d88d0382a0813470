"""Registered queries over readers and sinks: files are written from the given tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.operators import merge
from regspark.plans.domain import MONEY, read
from regspark.sources import lists, loading, readers, scratch, tourism

#: Rows of the wide file that a task writes; each has hundreds of cells.
WIDE_ROWS = 5000


def _written(spark: SparkSession, name: str, lines: DataFrame, latin: Column, order: list[str]) -> str:
    """Write (file, line) as text below a new folder, one folder a file, where `latin` holds in Latin-1."""
    folder = scratch.new_folder(spark, name)
    raw = F.when(latin, F.encode("line", "ISO-8859-1").cast("string")).otherwise(F.col("line"))
    lines.select("file", *order, raw.alias("value")).repartition("file").sortWithinPartitions("file", *order).select("file", "value").write.partitionBy("file").text(folder)
    return folder


def src_encoding(spark, sf_dir):
    """Customers' lines with accents in 32 files, every second in Latin-1, read back and counted by file; among them ones
    that fit no encoding but their own."""
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey") % 32).alias("file"), F.col("c_custkey").alias("id"), F.concat(F.col("c_custkey").cast("string"), F.lit(" Compañía Ñandú é"), F.repeat(F.lit("áß"), (F.col("c_custkey") % 7).cast("int"))).alias("line"))
    folder = _written(spark, "encodings", c, F.substring("file", 2, 9).cast("int") % 2 == 1, ["id"])
    lines = readers.text_lines(spark, [folder])
    return lines.select(F.regexp_extract("file", "file=(f[0-9]+)", 1).alias("file"), "value")


def _list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of exporters from orders: one file for each of three years and eight groups of customers."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), F.year("o_orderdate").alias("y"), "o_orderstatus").where("y BETWEEN 1996 AND 1998")
    file = F.concat(F.lit("lista_"), F.col("y"), F.lit("_"), F.col("c") % 8)
    tax = F.when(F.col("c") % 50 == 0, F.lit("")).otherwise(F.lpad(F.col("c").cast("string"), 13, "0"))
    year = F.when(F.col("o") % 40 == 1, F.concat(F.lit("año "), F.col("y") + 1)).otherwise(F.lit(""))
    rows = o.select(file.alias("file"), F.lit(2).alias("part"), "o", F.concat_ws(";", F.col("o").cast("string"), tax, F.concat(F.lit("Ñandú "), F.col("o")), F.concat(F.lit('"Provincia '), F.col("o_orderstatus"), F.lit('"')), year).alias("line"))
    title = F.when(F.col("y") == 1996, "Exportadores habituales de bienes, con rebaja de tres puntos").when(F.col("y") == 1997, "Exportación de servicios").otherwise("Catastro de exportadores habituales de bienes")
    frame = F.inline(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(0).cast("long").alias("o"), t.alias("line")) for p, t in ((0, title), (1, F.lit("No.;Número de RUC;Razón social;Provincia;Año de aplicación")), (3, F.concat(F.lit(";;Actualizado en "), F.col("y")))))))
    return rows.unionByName(o.select(file.alias("file"), "y").distinct().select("file", frame))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, "lists", _list_lines(spark, sf_dir), F.col("file").endswith("3") | F.col("file").endswith("4"), ["part", "o"])
    return lists.yearly_lists(readers.text_lines(spark, [folder]))


def src_yearly_lists(spark, sf_dir):
    """The rows of all lists: the year column beats the file's name, and the last row of a tax id counts."""
    return lists.list_rows(_lists(spark, sf_dir))


def src_yearly_lists_notes(spark, sf_dir):
    """What is no row: titles and footers, and rows without a tax id."""
    return _lists(spark, sf_dir).where("outcome <> 'row'").select(F.replace("label", F.lit("file="), F.lit("")).alias("file"), "outcome", "reason", "text")


def _providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    file = F.concat(F.lit("p"), F.col("p_partkey") % 4)
    rows = p.select(file.alias("file"), F.lit(1).alias("part"), F.col("p_partkey").alias("o"), F.concat_ws(";", F.when(F.col("p_partkey") % 30 == 0, "").otherwise(F.concat(F.col("p_name"), F.col("p_size"))), F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, "SÍ").otherwise("NO"), F.lit("05/03/2021")).alias("line"))
    extra = p.select(file.alias("file")).distinct().select("file", F.inline(F.array(*(F.struct(F.lit(k).alias("part"), F.lit(0).cast("long").alias("o"), F.lit(t).alias("line")) for k, t in ((0, "Proveedor;Descripción;Registrado SRI;Fecha de registro"), (2, "Fecha de publicación:;01/02/2024"))))))
    return lists.digital_providers(readers.text_lines(spark, [_written(spark, "providers", rows.unionByName(extra), F.col("file") == "p1", ["part", "o"])]))


def src_digital_providers(spark, sf_dir):
    """Providers, the last row of each spelling, over all files."""
    return lists.provider_rows(_providers(spark, sf_dir)).select("provider", "description", "registered", F.col("since").cast("string").alias("since"))


def src_digital_providers_notes(spark, sf_dir):
    return _providers(spark, sf_dir).where("outcome = 'note'").select(F.replace("label", F.lit("file="), F.lit("")).alias("file"), "text")


def _loaded(spark: SparkSession, sf_dir: str) -> loading.Loaded:
    """Lines of orders loaded by order and part: the last line of each counts."""
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast(MONEY).alias("quantity"), F.col("l_discount").cast("decimal(4,2)").alias("discount"))  # noqa: E741
    rules = [loading.Rule("quantity", "too_large", F.col("quantity") > 48), loading.Rule("part", "unknown", F.col("part") % 97 == 0), loading.Rule("discount", "high", F.col("discount") >= F.lit("0.09").cast("decimal(4,2)"), reject=False)]
    one = merge.dealt(l, l.count(), ["id", "part"]).groupBy("id", "part", "line").agg(F.max("quantity").alias("quantity"), F.max("discount").alias("discount"))
    return loading.load(one, rules, ["id", "part"], "line", scratch.new_folder(spark, "load"), most_rejects=1 << 30)


def snk_load_rows(spark, sf_dir):
    return _loaded(spark, sf_dir).rows.select("id", "part", "line", "quantity")


def snk_load_rejects(spark, sf_dir):
    """The report: one row a defect, with the column, the reason and the row as JSON."""
    return _loaded(spark, sf_dir).rejects.select("id", "part", "column", "reason", F.get_json_object("raw", "$.line").cast("long").alias("line"))


def snk_load_warnings(spark, sf_dir):
    return _loaded(spark, sf_dir).warnings.groupBy("column", "reason").agg(F.count("*").alias("n"))


def snk_load_metrics(spark, sf_dir):
    """Rows read, rejected, warned, duplicates and copied, as counted while the rows were written."""
    m = _loaded(spark, sf_dir).metrics
    return spark.range(1).select(*(F.lit(m[k]).cast("long").alias(k) for k in ("read", "rejected", "warned", "duplicates", "copied")))


def _tourism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of the tourism register, under the file's headers; numbers repeat, and some rows lack something."""
    k, n = F.col("p_partkey"), F.col("p_partkey") % 900
    return tourism.entries(
        read(spark, sf_dir, "part").select(
            k.alias("line"), F.when(k % 53 != 0, F.concat(F.lit("R-"), n, F.lit("-07"))).alias("No. Registro"), F.when(k % 47 == 0, "S/N").when(k % 43 == 0, "9900000000001").otherwise(F.concat(F.lit("17"), F.lpad(n.cast("string"), 11, "0"))).alias("RUC"),
            F.when(k % 41 != 0, F.col("p_type")).alias("Actividad / Modalidad"), F.when(k % 3 == 0, "006").alias("Establecimiento"), F.when(k % 37 == 0, "6/07/2021; 28/07/2021").otherwise("05/03/2021").alias("Fecha de registro"), F.concat("p_name", F.when(k % 2 == 0, F.lit("")).otherwise(F.lit(" "))).alias("Nombre comercial"), F.lit("INFO@Mail.example ").alias("Correo"), F.lit("x").alias("Columna nueva"),
        ),
        "line",
    )


def src_tourism_register(spark, sf_dir):
    """Entries of the tourism register, the last of each number."""
    return tourism.rows(_tourism(spark, sf_dir), "line").select("register", "line", "tax_id", "establishment", "activity", "trade_name", "email", F.col("registered").cast("string").alias("registered"), "registered_raw")


def src_tourism_rejects(spark, sf_dir):
    return tourism.rejects(_tourism(spark, sf_dir), "line").select("line", "column", "reason")


def src_tourism_warnings(spark, sf_dir):
    return tourism.warnings(_tourism(spark, sf_dir), "line")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders of 1998 as a wide statement file of 622 accounts, a few of them filled."""
    c = read(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1998).groupBy(F.col("o_custkey").alias("EXPEDIENTE")).agg(F.max("o_orderkey").alias("o"))
    c = scratch.stored(c, "wide-keys")  # hundreds of cells come of each of these small rows, so they are counted and dealt out
    c = merge.dealt(c, c.count(), ["EXPEDIENTE"], WIDE_ROWS)
    cells = (f"CASE WHEN (o + {k}) % 89 = 0 THEN '12,5x' WHEN (o + {k}) % 97 = 0 THEN '0.00' WHEN (o + {k}) % 61 = 0 THEN o || ',5' END AS CUENTA_{k}" for k in range(1, 623))
    return scratch.stored(c.selectExpr("'1998' AS ANIO", "EXPEDIENTE", *cells), "wide")


def src_wide_statements(spark, sf_dir):
    return readers.wide_statements(_wide(spark, sf_dir), "ANIO", "EXPEDIENTE")


def src_wide_statement_errors(spark, sf_dir):
    """Cells that hold something but no amount."""
    return readers.wide_statement_errors(_wide(spark, sf_dir), "ANIO", "EXPEDIENTE").select("year", "company", "account", "raw")


def snk_csv_segment(spark, sf_dir):
    """The file of a segment, as read back: header, the 500 largest orders, and how many were left out."""
    at = scratch.new_folder(spark, "segment")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.col("o_orderpriority"), F.lit('; "'), F.col("o_orderstatus"), F.lit('"')).alias("what"), F.col("o_totalprice").cast(MONEY).alias("price"))
    readers.write_segment(o, at, [F.desc("price"), F.col("id")], 500)
    return spark.read.text(at).select(F.col("value").alias("line"))


_ORDERS = "WITH o AS (SELECT o_custkey AS c, o_orderkey AS o, year(o_orderdate) AS y, o_orderstatus AS s, 'lista_' || year(o_orderdate) || '_' || (o_custkey % 8) AS file FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998)"
_LINES = "WITH l AS (SELECT l_orderkey AS id, l_partkey AS part, l_linenumber AS line, max(CAST(l_quantity AS DECIMAL(18,2))) AS quantity, max(CAST(l_discount AS DECIMAL(4,2))) AS discount FROM lineitem GROUP BY ALL), good AS (SELECT * FROM l WHERE quantity <= 48 AND part % 97 <> 0), rows_ AS (SELECT id, part, line, quantity FROM good QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY line DESC) = 1)"
_PARTS = "WITH p AS (SELECT *, 'p' || (p_partkey % 4) AS file FROM part)"
_TOURISM = """WITH p AS (SELECT p_partkey AS line, CASE WHEN p_partkey % 53 <> 0 THEN 'R-' || (p_partkey % 900) || '-07' END AS register, CASE WHEN p_partkey % 47 = 0 THEN NULL WHEN p_partkey % 43 = 0 THEN '9900000000001' ELSE '17' || lpad(CAST(p_partkey % 900 AS VARCHAR), 11, '0') END AS tax_id,
CASE WHEN p_partkey % 41 <> 0 THEN p_type END AS activity, CASE WHEN p_partkey % 3 = 0 THEN '6' ELSE CAST(p_partkey % 900 AS VARCHAR) END AS establishment, p_name AS trade_name, 'info@mail.example' AS email, CASE WHEN p_partkey % 37 <> 0 THEN '2021-03-05' END AS registered, CASE WHEN p_partkey % 37 = 0 THEN '6/07/2021; 28/07/2021' END AS registered_raw FROM part),
bad AS (SELECT line, CASE WHEN register IS NULL THEN 'register' WHEN tax_id IS NULL THEN 'tax_id' WHEN activity IS NULL THEN 'activity' END AS "column" FROM p WHERE register IS NOT NULL OR tax_id IS NOT NULL OR activity IS NOT NULL), good AS (SELECT p.* FROM p JOIN bad USING (line) WHERE "column" IS NULL)"""
_WIDE = "WITH c AS (SELECT o_custkey AS company, max(o_orderkey) AS o FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1), x AS (SELECT company, o, unnest(range(1, 623)) AS k FROM c)"

ORACLE_SQL = {
    "src_tourism_register": _TOURISM + " SELECT register, line, tax_id, establishment, activity, trade_name, email, registered, registered_raw FROM good QUALIFY row_number() OVER (PARTITION BY register ORDER BY line DESC) = 1",
    "src_tourism_rejects": _TOURISM + " SELECT line, \"column\", 'missing' AS reason FROM bad WHERE \"column\" IS NOT NULL",
    "src_tourism_warnings": _TOURISM + " SELECT line, register, 'tax_id' AS \"column\", 'province' AS reason FROM good WHERE starts_with(tax_id, '99') UNION ALL SELECT line, register, 'registered', 'unreadable' FROM good WHERE registered IS NULL UNION ALL SELECT max(line), register, 'register', 'duplicate_with_other_data' FROM good GROUP BY register HAVING count(DISTINCT (tax_id, establishment, activity, trade_name, registered IS NULL)) > 1",
    "src_wide_statements": _WIDE + " SELECT 1998 AS year, 1 AS form, company, CAST(k AS VARCHAR) AS account, CAST(o || '.5' AS DECIMAL(18,2)) AS value FROM x WHERE (o + k) % 61 = 0 AND (o + k) % 89 <> 0 AND (o + k) % 97 <> 0",
    "src_wide_statement_errors": _WIDE + " SELECT 1998 AS year, company, CAST(k AS VARCHAR) AS account, '12,5x' AS raw FROM x WHERE (o + k) % 89 = 0",
    "snk_csv_segment": "WITH o AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_orderpriority || '; \"\"' || o_orderstatus || '\"\"' AS what FROM orders), top AS (SELECT * FROM o ORDER BY price DESC, id LIMIT 500) SELECT id || ';\"' || what || '\";' || price AS line FROM top UNION ALL SELECT 'id;what;price' UNION ALL SELECT '# ' || (count(*) - 500) || ' rows left out' FROM orders HAVING count(*) > 500",
    "src_encoding": "SELECT 'f' || (c_custkey % 32) AS file, c_custkey || ' Compañía Ñandú é' || repeat('áß', CAST(c_custkey % 7 AS INTEGER)) AS value FROM customer",
    "src_yearly_lists": _ORDERS + " SELECT list, CAST(year AS INTEGER) AS year, tax_id, 'Ñandú ' || arg_max(o, (file, o)) AS name, 'Provincia ' || arg_max(s, (file, o)) AS province FROM (SELECT *, CASE y WHEN 1996 THEN 'rebate' WHEN 1997 THEN 'services' ELSE 'goods' END AS list, CASE WHEN o % 40 = 1 THEN y + 1 ELSE y END AS year, lpad(CAST(c AS VARCHAR), 13, '0') AS tax_id FROM o WHERE c % 50 <> 0) GROUP BY 1, 2, 3",
    "src_yearly_lists_notes": _ORDERS + ", f AS (SELECT DISTINCT file, y FROM o) SELECT file, 'note' AS outcome, NULL AS reason, CASE y WHEN 1996 THEN 'Exportadores habituales de bienes, con rebaja de tres puntos' WHEN 1997 THEN 'Exportación de servicios' ELSE 'Catastro de exportadores habituales de bienes' END AS text FROM f UNION ALL SELECT file, 'note', NULL, ';;Actualizado en ' || y FROM f UNION ALL SELECT file, 'reject', 'no_tax_id', o || ';;Ñandú ' || o || ';\"Provincia ' || s || '\";' || CASE WHEN o % 40 = 1 THEN 'año ' || (y + 1) ELSE '' END FROM o WHERE c % 50 = 0",
    "src_digital_providers": _PARTS + " SELECT p_name || p_size AS provider, arg_max(p_type, (file, p_partkey)) AS description, arg_max(p_partkey, (file, p_partkey)) % 2 = 0 AS registered, '2021-03-05' AS since FROM p WHERE p_partkey % 30 <> 0 GROUP BY 1",
    "src_digital_providers_notes": _PARTS + " SELECT DISTINCT file, 'Fecha de publicación:;01/02/2024' AS text FROM p",
    "snk_load_rows": _LINES + " SELECT * FROM rows_",
    "snk_load_rejects": _LINES + " SELECT id, part, 'quantity' AS \"column\", 'too_large' AS reason, line FROM l WHERE quantity > 48 UNION ALL SELECT id, part, 'part', 'unknown', line FROM l WHERE part % 97 = 0",
    "snk_load_warnings": _LINES + " SELECT 'discount' AS \"column\", 'high' AS reason, count(*) AS n FROM good WHERE discount >= 0.09 HAVING count(*) > 0",
    "snk_load_metrics": _LINES + " SELECT (SELECT count(*) FROM l) AS read, (SELECT count(*) FROM l) - (SELECT count(*) FROM good) AS rejected, (SELECT count(*) FROM good WHERE discount >= 0.09) AS warned, (SELECT count(*) FROM good) - (SELECT count(*) FROM rows_) AS duplicates, (SELECT count(*) FROM rows_) AS copied",
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
