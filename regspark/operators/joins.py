"""Joins of the register: unambiguous keys, first matching population, longest prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur once."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key)


def ambiguous_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def enrich_unique(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Left join that gives nothing to keys which several target rows share."""
    usable = source.join(unique_keys(target, key), key, "left_semi")
    return target.join(usable, key, "left")


def first_population(rows: DataFrame, key: str, populations: dict[str, DataFrame], unknown: str = "unknown") -> DataFrame:
    """Add `kind`: the first population that has the row's key, else `unknown`."""
    known = None
    for rank, (name, keys) in enumerate(populations.items()):
        some = keys.select(F.col(key), F.lit(rank).alias("_rank"), F.lit(name).alias("kind"))
        known = some if known is None else known.unionByName(some)
    best = known.groupBy(key).agg(F.min_by("kind", "_rank").alias("kind"))
    return rows.join(best, key, "left").withColumn("kind", F.coalesce("kind", F.lit(unknown)))


def prefix_parents(codes: DataFrame, code: str = "code", level: str | None = None) -> DataFrame:
    """code, parent, depth, leaf. The parent is the longest proper prefix that is a code
    itself (and, with `level`, has a lower level); roots keep a NULL parent."""
    extra = [F.col(level).alias("level")] if level else []
    own = codes.select(F.col(code).alias("code"), *extra)
    prefixes = own.select("*", F.explode_outer(F.expr("CASE WHEN length(code) > 1 THEN transform(sequence(1, length(code) - 1), n -> substring(code, 1, n)) END")).alias("prefix"))
    of = codes.select(F.col(code).alias("prefix"), *([F.col(level).alias("_of_level")] if level else []))
    found = prefixes.join(of, "prefix")
    if level:
        found = found.where("_of_level < level")
    best = found.groupBy("code").agg(F.max_by("prefix", F.length("prefix")).alias("parent"), F.count("*").alias("_above"))
    out = own.join(best, "code", "left")
    parents = best.select(F.col("parent").alias("code")).distinct().withColumn("_inner", F.lit(True))
    return out.join(parents, "code", "left").select("code", "parent", (F.coalesce("_above", F.lit(0)) + 1).cast("int").alias("depth"), F.col("_inner").isNull().alias("leaf"))


def rows_per_prefix(codes: DataFrame, rows: DataFrame, code: str = "code") -> DataFrame:
    """For each code the rows with exactly it, and those whose code begins with it; 0 if none."""
    exact = rows.groupBy(code).agg(F.count("*").alias("n"))
    spread = exact.select("n", F.explode(F.expr(f"transform(sequence(1, length({code})), k -> substring({code}, 1, k))")).alias(code))
    under = spread.groupBy(code).agg(F.sum("n").alias("under"))
    return codes.select(code).join(exact, code, "left").join(under, code, "left").select(code, F.coalesce("n", F.lit(0)).alias("exact"), F.coalesce("under", F.lit(0)).alias("under"))
