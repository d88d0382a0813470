"""Raw JSON answers of a portal, each with a company and four lists, taken apart into tables.

A raw row is parsed once as VARIANT, and its items come out as one tagged table, which can be
written by kind; the tables of each kind are typed from it. Inside a document the first item of a
natural key counts. What is not JSON, or no object, is a reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import cleaning

#: Names of the parts and fields in the portal's answers.
LISTS = {"contact": ("$.contacto",), "staff": ("$.nomina",), "vehicle": ("$.carro.vehicle", "$.carro"), "property": ("$.propiedades.propiedades", "$.propiedades")}
COMPANY = {"name": "razonSocial", "trade_name": "nombreComercial", "status": "estadoContribuyente", "activity": "actividadEconomica", "province": "provincia", "address": "direccion", "phone": "telefono"}
NATURAL_KEY = {"contact": "contacto", "staff": "dni", "vehicle": "carRegistration"}


def items(raw: DataFrame, key: list[str], text: str = "raw") -> DataFrame:
    """`key`, kind, pos, item (VARIANT): the company of each document (kind company) and the items of its lists.

    Lists that are absent or no list give nothing. Text that is not JSON, or whose value is no
    object, gives one row of kind reject with the text as item. One scan and no shuffle.
    """
    parsed = raw.select(*key, F.col(text).alias("_raw"), F.try_parse_json(text).alias("_v"))
    v = F.col("_v")
    is_object = F.schema_of_variant(v).startswith("OBJECT")

    def tagged(kind: str, list_: Column) -> Column:
        return F.coalesce(F.transform(list_, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("pos"), x.alias("item"))), F.array().cast("array<struct<kind:string,pos:int,item:variant>>"))

    lists = [tagged(kind, F.coalesce(*(F.try_variant_get(v, p, "array<variant>") for p in paths))) for kind, paths in LISTS.items()]
    company = tagged("company", F.array(F.try_variant_get(v, "$.ruc", "variant")))
    reject = tagged("reject", F.array(F.to_variant_object(F.array(F.coalesce("_raw", F.lit(""))))))
    return parsed.select(*key, F.explode(F.when(F.coalesce(is_object, F.lit(False)), F.concat(company, *lists)).otherwise(reject)).alias("x")).select(*key, "x.*")


def _text(name: str) -> Column:
    return cleaning.nullify(F.try_variant_get("item", f"$.{name}", "string"))


def _number(name: str) -> Column:
    return cleaning.payload_number(F.try_variant_get("item", f"$.{name}", "string"))


def _date(name: str) -> Column:
    return cleaning.payload_date(F.try_variant_get("item", f"$.{name}", "string"))


def _whole(name: str, low: int, high: int) -> Column:
    n = F.try_variant_get("item", f"$.{name}", "string")
    whole = F.regexp_replace(n, r"[^\d.-]", "").try_cast("double").try_cast("int")  # cut off, not rounded
    return F.when(whole.between(low, high), whole)


def _first(rows: DataFrame, key: list[str], natural: str, fields: dict[str, Column]) -> DataFrame:
    """One row a natural key in a document, the first by place (ties of repeated documents: the least values)."""
    typed = rows.select(*key, natural, "pos", *(c.alias(n) for n, c in fields.items())).where(F.col(natural).isNotNull())
    return typed.groupBy(*key, natural).agg(F.min(F.struct("pos", *fields)).alias("s")).select(*key, natural, *(F.col(f"s.{n}").alias(n) for n in fields))


def contacts(tagged: DataFrame, key: list[str]) -> DataFrame:
    """`key`, value, kind (email, phone or unknown, by what it looks like), code."""
    value = F.col("value")
    kind = F.when(value.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email").when(value.rlike(r"^\+?[\d\s()-]{7,}$"), "phone").otherwise("unknown")
    return _first(tagged.where("kind = 'contact'").withColumn("value", _text("contacto")), key, "value", {"kind": kind, "code": _text("tipo")})


def staff(tagged: DataFrame, key: list[str]) -> DataFrame:
    """`key`, person, name, job, wage, since."""
    return _first(tagged.where("kind = 'staff'").withColumn("person", _text("dni")), key, "person", {"name": _text("nombre"), "job": _text("ocupacion"), "wage": _number("sueldo"), "since": _date("fechaIngreso")})


def vehicles(tagged: DataFrame, key: list[str]) -> DataFrame:
    """`key`, plate, type, brand, model, year, engine, value, city; years and engines out of range are null."""
    fields = {"type": _text("vehicleType"), "brand": _text("brand"), "model": _text("model"), "year": _whole("year", 1900, 2100), "engine": _whole("cylinderCapacity", 0, 100_000), "value": _number("appraisalValue"), "city": _text("city")}
    return _first(tagged.where("kind = 'vehicle'").withColumn("plate", _text("carRegistration")), key, "plate", fields)


def properties(tagged: DataFrame, key: list[str]) -> DataFrame:
    """`key`, pos, content: properties have no natural key and are kept as JSON text."""
    return tagged.where("kind = 'property'").select(*key, "pos", F.to_json("item").alias("content"))


def company_rows(tagged: DataFrame, key: list[str]) -> DataFrame:
    """`key`, the company's fields, started, employees and wages (of its staff list, each person once);
    documents whose company has no name have no row."""
    own = _first(tagged.where("kind = 'company'").withColumn("_one", F.lit(1)), key, "_one", {n: _text(c) for n, c in COMPANY.items()} | {"started": _date("fechaInicioActividades")}).drop("_one").where("name IS NOT NULL")
    sums = staff(tagged, key).groupBy(*key).agg(F.count("*").alias("employees"), F.sum("wage").alias("wages"))
    return own.join(sums, key, "left").withColumn("employees", F.coalesce("employees", F.lit(0).cast("long")))


def rejects(tagged: DataFrame, key: list[str]) -> DataFrame:
    """`key`, reason, raw: documents that could not be read."""
    raw = F.try_variant_get("item", "$[0]", "string")
    return tagged.where("kind = 'reject'").select(*key, F.when(raw == "", "empty").when(F.try_parse_json(raw).isNull(), "not_json").otherwise("no_object").alias("reason"), raw.alias("raw"))
