"""A tax registry with one row a site, taken apart into holders and establishments, in one pass.

Each row is tagged twice, for its holder and for its site, and one aggregation brings both together:
one scan, one shuffle, and a holder with a third of all sites is added up before it is moved. Holders
are then told apart: persons, societies that the register of companies has (enrichment of the one
company with that tax id), and other societies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.operators import joins, merge

HOLDER = ("name", "state", "province", "keeps_books")
SITE = ("site_state", "province", "activity")
#: Columns of each kind of output that its fingerprint covers.
VALUES = {
    "person": ["class", *HOLDER, "sites"],
    "unsupervised": [*HOLDER, "sites"],
    "company": ["company", "state", "keeps_books", "sites", "activity"],
    "establishment": list(SITE),
}
KEYS = {kind: ["tax_id", "site"] if kind == "establishment" else ["tax_id"] for kind in VALUES}


def staged(rows: DataFrame, companies: DataFrame, province: str | None = None) -> DataFrame:
    """kind, tax_id, site, class, the columns of HOLDER and SITE, sites, company.

    `rows` has tax_id, taxpayer (PERSONA NATURAL or SOCIEDAD), site and the columns of HOLDER and
    SITE; `companies` has company and tax_id. A holder's values are those of its first site (equal
    sites: the least values), `sites` counts its rows. With `province`, holders of other provinces
    are left out; establishments are not. Rows without tax id, and holders of another kind, have no
    output; a tax id that several companies share enriches none of them, nor is its society new.
    """
    columns = list(dict.fromkeys(["taxpayer", *HOLDER, *SITE]))
    both = F.explode(F.array(F.struct(F.lit("holder").alias("tag"), F.lit(None).cast("string").alias("own_site")), F.struct(F.lit("establishment").alias("tag"), F.col("site").alias("own_site"))))
    tagged = rows.where(F.col("tax_id").isNotNull()).select("tax_id", "site", *columns, both.alias("b")).select("tax_id", "b.*", F.struct("site", *columns).alias("v"))
    g = tagged.groupBy("tag", "tax_id", "own_site").agg(F.min("v").alias("v"), F.count("*").alias("sites"))
    known = companies.where(F.col("tax_id").isNotNull()).select("tax_id").distinct().withColumn("supervised", F.lit(True))
    single = companies.join(joins.unique_keys(companies, "tax_id"), "tax_id", "left_semi").select("tax_id", "company")
    j = g.join(known, "tax_id", "left").join(single, "tax_id", "left")
    person, society = F.col("v.taxpayer") == "PERSONA NATURAL", F.col("v.taxpayer") == "SOCIEDAD"
    kind = F.when(F.col("tag") == "establishment", "establishment").when(person, "person").when(society & F.col("supervised").isNull(), "unsupervised").when(society & F.col("company").isNotNull(), "company")
    here = F.lit(True) if province is None else (F.col("kind") == "establishment") | (F.upper(F.trim("v.province")) == province.strip().upper())
    out = j.withColumn("kind", kind).where(F.col("kind").isNotNull() & here)
    class_ = F.when(F.col("kind") == "person", F.when(F.col("v.keeps_books"), "natural_keeps_books").otherwise("natural"))
    return out.select("kind", "tax_id", F.col("own_site").alias("site"), class_.alias("class"), *(F.col(f"v.{c}").alias(c) for c in columns[1:]), "sites", "company")


def merged(targets: DataFrame | None, stage: DataFrame, kind: str, job: int, scope: Column | None = None) -> DataFrame:
    """The new target of one kind with `status`, merged under a fingerprint of its own columns."""
    key, values = KEYS[kind], VALUES[kind]
    rows = stage.where(F.col("kind") == kind).select(*key, *values)
    old = merge.target_of(rows.limit(0), values, job) if targets is None else targets
    return merge.snapshot(old, rows, key, values, job, scope=scope)
