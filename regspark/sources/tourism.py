"""The register of tourism: one row an entry, kept wherever it can be, with what was wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import cleaning
from regspark.sources.readers import read_aliased
from regspark.sources.scratch import stored

#: Names of the columns in the published file, by field.
ALIASES = {
    "register": ["NUMERO DE REGISTRO", "No. REGISTRO", "REGISTRO"], "tax_id": ["RUC", "NUMERO RUC"], "establishment": ["ESTABLECIMIENTO", "NUMERO ESTABLECIMIENTO", "CODIGO ESTABLECIMIENTO"], "trade_name": ["NOMBRE COMERCIAL"],
    "registered": ["FECHA DE REGISTRO", "FECHA REGISTRO"], "activity": ["ACTIVIDAD", "ACTIVIDAD / MODALIDAD", "ACTIVIDAD MODALIDAD"], "classification": ["CLASIFICACION"], "category": ["CATEGORIA"], "owner": ["RAZON SOCIAL PROPIETARIO", "RAZON SOCIAL", "PROPIETARIO"],
    "representative": ["REPRESENTANTE LEGAL"], "province": ["PROVINCIA"], "canton": ["CANTON"], "parish": ["PARROQUIA"], "parish_kind": ["TIPO PARROQUIA", "TIPO DE PARROQUIA"], "address": ["DIRECCION"], "reference": ["REFERENCIA DIRECCION", "REFERENCIA"],
    "phone": ["TELEFONO", "TELEFONO PRINCIPAL"], "email": ["CORREO", "CORREO ELECTRONICO"], "website": ["SITIO WEB", "PAGINA WEB"], "state": ["ESTADO REGISTRO", "ESTADO"],
}
REQUIRED = ("register", "tax_id", "activity")
#: Fields that come out as text without more ado.
PLAIN = ("trade_name", "activity", "classification", "category", "owner", "representative", "province", "canton", "parish", "address", "reference", "phone", "website", "state")
_FIELDS = [*PLAIN, "establishment", "category_norm", "parish_kind", "email", "registered", "registered_raw"]


def _problem(column: str, reason: Column) -> Column:
    return F.struct(F.lit(column).alias("column"), reason.alias("reason"))


def entries(raw: DataFrame, order: str) -> DataFrame:
    """`order`, register, tax_id, the fields, row_hash, errors and warnings of every row that is not blank.

    Columns are found by their headers; a file without register, tax id or activity column is refused
    (UnusableFile), other missing columns are null. errors names the first of the three that a row
    lacks, and rejects it; a date that cannot be read is null with its text kept, and a tax id of no
    province is kept: both are warnings.
    """
    named, report = read_aliased(raw.drop(order), ALIASES, REQUIRED)
    found = [c for c in ALIASES if c not in report["missing"]]
    kept, _ = read_aliased(raw, {**ALIASES, order: [order]}, REQUIRED)
    # A file of few splits is dealt out first: reading a row costs much more than moving it.
    kept = kept.repartition(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = kept.select(*(cleaning.nullify(F.col(c).cast("string")).alias(c) if c in found else F.lit(None).cast("string").alias(c) for c in ALIASES), order)
    tax, date = cleaning.tax_id(F.col("tax_id")), cleaning.date(F.col("registered"))
    note = cleaning.tax_id_note(F.col("tax_id"))
    fields: dict[str, Column] = {
        **{c: F.col(c) for c in PLAIN}, "establishment": cleaning.establishment_code(F.col("establishment"), F.col("register")), "category_norm": cleaning.category(F.col("category")), "parish_kind": cleaning.parish_kind(F.col("parish_kind")),
        "email": cleaning.email_or_null(F.col("email")), "registered": date, "registered_raw": F.when(date.isNull(), F.substring("registered", 1, 100)),
    }
    error = F.when(F.col("register").isNull(), _problem("register", F.lit("missing"))).when(tax.isNull(), _problem("tax_id", F.coalesce(note, F.lit("missing")))).when(F.col("activity").isNull(), _problem("activity", F.lit("missing")))
    warnings = F.array(F.when(note == "province", _problem("tax_id", note)), F.when(date.isNull() & F.col("registered").isNotNull(), _problem("registered", F.lit("unreadable"))))
    blank = F.col("register").isNull() & tax.isNull() & F.col("activity").isNull()
    typed = rows.where(~blank).select(order, "register", tax.alias("tax_id"), *(c.alias(n) for n, c in fields.items()), error.alias("error"), F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"))
    return typed.withColumn("row_hash", cleaning.fingerprint("tax_id", *_FIELDS))


def rows(parsed: DataFrame, order: str) -> DataFrame:
    """The good rows, the last of each register number."""
    good = parsed.where("error IS NULL").drop("error", "warnings")
    other = [c for c in good.columns if c != "register"]
    return good.groupBy("register").agg(F.max_by(F.struct(*other), F.struct(order, "row_hash")).alias("s")).select("register", "s.*")


def rejects(parsed: DataFrame, order: str) -> DataFrame:
    return parsed.where("error IS NOT NULL").select(order, "register", "tax_id", "error.column", "error.reason")


def warnings(parsed: DataFrame, order: str) -> DataFrame:
    """`order`, register, column, reason; numbers that occur again with other data are named once, by the row that counts."""
    good = stored(parsed.where("error IS NULL").select(order, "register", "warnings", "row_hash"), "entries")  # warnings and numbers that occur again are read from it
    twice = good.groupBy("register").agg(F.max(order).alias(order), F.min("row_hash").alias("a"), F.max("row_hash").alias("b")).where("a <> b")
    single = good.select(order, "register", F.explode("warnings").alias("w")).select(order, "register", "w.column", "w.reason")
    return single.unionByName(twice.select(order, "register", F.lit("register").alias("column"), F.lit("duplicate_with_other_data").alias("reason")))
