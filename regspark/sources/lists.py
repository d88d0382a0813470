"""Lists that a register publishes by year, and its list of digital providers, from lines of text files.

A file has title lines, a header, rows and footers, in `;`-separated cells. What is no row is a note
or a reject, never lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import cleaning

#: Kinds of lists by what their titles say; the more special rule comes first.
TITLES = {"rebate": "REBAJA DE TRES|REBAJA DE 3|3 PUNTOS|TRES \\(3\\) PUNTOS", "services": "EXPORTACION DE SERVICIOS|EXPORTADORES HABITUALES DE SERVICIOS", "goods": "EXPORTADORES HABITUALES DE BIENES"}
#: Keys of header cells.
LIST_COLUMNS = {"tax_id": ["RUC", "NUMERO_RUC", "NUMERO_DE_RUC"], "name": ["RAZON_SOCIAL", "CONTRIBUYENTE"], "province": ["PROVINCIA"], "year": ["ANIO_APLICACION", "ANO_DE_APLICACION", "ANO_APLICACION"]}
PROVIDER_COLUMNS = {"provider": ["PROVEEDOR"], "description": ["DESCRIPCION"], "reference": ["REFERENCIA"], "registered": ["REGISTRADO_SRI"], "since": ["FECHA_REGISTRO", "FECHA_DE_REGISTRO"]}
BANNER = "PUBLICACION|^CATASTRO PUBLICADO"


def file_label(file: Column) -> Column:
    """The name of a file; of a folder that Spark wrote, the folder's name."""
    parts = F.split(file, "/")
    last = F.element_at(parts, -1)
    return F.url_decode(F.when(last.startswith("part-"), F.element_at(parts, -2)).otherwise(last))


def year_in(text: Column) -> Column:
    return F.regexp_extract(text, r"(20\d{2}|19\d{2})", 1).try_cast("int")


def _cells(lines: DataFrame, columns: dict[str, list[str]], needed: str) -> DataFrame:
    """file, label, place, header (place of the header), filled and the named cells of every line after its file's header; lines before it have their text only."""
    split = lines.select("file", "place", "value", F.transform(F.split("value", ";"), lambda c: cleaning.nullify(F.trim(c, F.lit('"')))).alias("cells"))
    split = split.withColumn("keys", F.transform("cells", cleaning.header_key))
    heads = split.where(F.arrays_overlap("keys", F.array(*map(F.lit, columns[needed])))).groupBy("file").agg(F.min(F.struct("place", "keys")).alias("header"))
    at = {name: F.coalesce(*(F.nullif(F.array_position("header.keys", k), F.lit(0)) for k in keys)).cast("int") for name, keys in columns.items()}
    j = split.join(heads, "file", "left").withColumn("after", F.coalesce(F.col("place") > F.col("header.place"), F.lit(False)))
    return j.select("file", file_label(F.col("file")).alias("label"), "place", "value", "after", F.col("header").isNotNull().alias("has_header"), (F.col("place") == F.col("header.place")).alias("is_header"), F.size(F.filter("cells", lambda c: c.isNotNull())).alias("filled"), *(F.when(F.col("after"), F.get("cells", a - 1)).alias(f"c_{n}") for n, a in at.items()))


def yearly_lists(lines: DataFrame) -> DataFrame:
    """file, label, place, outcome (row, note or reject), reason, list, year, tax_id, name, province, text.

    `lines` is (file, place, value). The kind of list comes from the titles above a file's header,
    the year from its column and else from the file's name. Lines of at most two filled cells
    without a tax id, and those above the header, are notes; a row without tax id or year, or in a
    file without header or known title, is a reject. Blank lines give nothing.
    """
    c = _cells(lines, LIST_COLUMNS, "tax_id")
    title = F.upper(cleaning.deaccent(F.col("value")))
    above = c.where(~F.col("after") & F.col("has_header") & ~F.col("is_header"))
    kinds = above.groupBy("file").agg(*(F.bool_or(title.rlike(rule)).alias(k) for k, rule in TITLES.items()))
    pick = F.lit(None).cast("string")
    for k in reversed(TITLES):
        pick = F.when(F.col(k), F.lit(k)).otherwise(pick)
    j = c.where((F.col("filled") > 0) & ~F.coalesce("is_header", F.lit(False))).join(kinds.select("file", pick.alias("list")), "file", "left")
    tax, year = cleaning.tax_id(F.col("c_tax_id")), F.coalesce(year_in(F.col("c_year")), year_in(F.col("label")))
    note = (F.col("has_header") & ~F.col("after")) | ((F.col("filled") <= 2) & F.col("has_header") & tax.isNull())
    reason = F.when(~F.col("has_header"), "no_header").when(note, None).when(F.col("list").isNull(), "unknown_title").when(tax.isNull(), "no_tax_id").when(year.isNull(), "no_year")
    return j.select("file", "label", "place", F.when(reason.isNotNull(), "reject").when(note, "note").otherwise("row").alias("outcome"), reason.alias("reason"), "list", year.alias("year"), tax.alias("tax_id"), F.col("c_name").alias("name"), F.col("c_province").alias("province"), F.col("value").alias("text"))


def list_rows(parsed: DataFrame) -> DataFrame:
    """list, year, tax_id, name, province: one row each, the last by file name and place."""
    rows = parsed.where("outcome = 'row'")
    return rows.groupBy("list", "year", "tax_id").agg(F.max_by(F.struct("name", "province"), F.struct("label", "file", "place")).alias("s")).select("list", "year", "tax_id", "s.*")


def digital_providers(lines: DataFrame) -> DataFrame:
    """file, label, place, outcome (row or note), provider, description, reference, registered, since, text.

    Banners about the publication are notes, as is what stands above the header; rows without a
    provider are passed over.
    """
    c = _cells(lines, PROVIDER_COLUMNS, "provider").where(~F.coalesce("is_header", F.lit(False)) & (F.col("filled") > 0))
    banner = F.upper(cleaning.deaccent(F.col("c_provider"))).rlike(BANNER)
    kept = c.where(~F.col("after") | F.col("c_provider").isNotNull())
    return kept.select("file", "label", "place", F.when(F.col("after") & ~F.coalesce(banner, F.lit(False)), "row").otherwise("note").alias("outcome"), F.col("c_provider").alias("provider"), F.col("c_description").alias("description"), F.col("c_reference").alias("reference"), cleaning.boolean(F.col("c_registered")).alias("registered"), cleaning.date(F.col("c_since")).alias("since"), F.col("value").alias("text"))


def provider_rows(parsed: DataFrame) -> DataFrame:
    """provider, description, reference, registered, since: the last row of each exact spelling."""
    rows = parsed.where("outcome = 'row'")
    return rows.groupBy("provider").agg(F.max_by(F.struct("description", "reference", "registered", "since"), F.struct("label", "file", "place")).alias("s")).select("provider", "s.*")
