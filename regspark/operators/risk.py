"""Presumptive-tax exposure: bases by coefficient, peers, persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.operators.peers import median, midrank, peer_level
from regspark.sources import scratch

BASES = ("income", "costs", "assets")


def presumptive_base(magnitude: DataFrame, companies: DataFrame, specific: DataFrame, general: DataFrame, regulated: DataFrame) -> DataFrame:
    """Coefficient times amount for three bases, the largest, which one it is, and the gap to
    the declared profit.

    specific: year, grp, base, coefficient; general: year, base, coefficient. Each base falls
    back to its general coefficient by itself. Only regulated years count; amounts that are not
    positive give no base. On equal bases income comes first, then costs.
    """
    m = magnitude.join(regulated, "year", "left_semi").join(companies.select("company", "grp", "division", "section", "nation", "simplified"), "company")
    wide = lambda t, keys, name: t.groupBy(*keys).agg(*(F.max(F.when(F.col("base") == b, F.col("coefficient"))).alias(f"{name}_{b}") for b in BASES))
    m = m.join(wide(specific, ["year", "nation"], "s"), ["year", "nation"], "left").join(wide(general, ["year"], "g"), "year", "left")
    amount = {"income": F.col("income"), "costs": F.col("cost_of_sales") + F.col("expenses"), "assets": F.col("assets")}
    bases = {f"base_{b}": F.when(amount[b] > 0, (amount[b].cast("decimal(18,2)") * F.coalesce(f"s_{b}", f"g_{b}")).cast("decimal(24,6)")) for b in BASES}
    m = m.withColumns(bases).withColumn("presumed", F.greatest(*bases))
    ruling = F.when(F.col("presumed") == F.col("base_income"), "income").when(F.col("presumed") == F.col("base_costs"), "costs").when(F.col("presumed") == F.col("base_assets"), "assets")
    return m.select(
        "year", "company", "nation", "grp", "division", "section", "simplified", "income", "assets",
        F.col("profit_before_tax").alias("declared"), *bases, "presumed", ruling.alias("ruling_base"),
        F.expr("s_income IS NOT NULL OR s_costs IS NOT NULL OR s_assets IS NOT NULL").alias("any_specific"),
        (F.col("presumed") - F.coalesce(F.col("profit_before_tax"), F.lit(0))).cast("decimal(24,6)").alias("gap"),
    )


def populations(base: DataFrame) -> DataFrame:
    """The rows of presumptive_base() under the ordinary regime, with the population that each belongs to.

    Companies under the simplified regime, and those of which it is not known, are left out.
    """
    population = F.expr("CASE WHEN income IS NULL OR income <= 0 OR income < 0.01 * coalesce(assets, 0) THEN 'no_income' WHEN declared IS NULL OR declared <= 0 THEN 'no_profit' ELSE 'comparable' END")
    return base.where("NOT simplified").withColumn("population", population)


def risk_year(base: DataFrame, least: int = 30) -> DataFrame:
    """Population, intensity and peer percentile of each company and year.

    Companies are those of populations(). Peers are the comparable companies of the first of group,
    division and section that has `least` of them in the year (the section whatever it has).
    """
    r = populations(base).withColumn("intensity", F.try_divide(F.col("gap").cast("double"), F.when(F.col("income") > 0, F.col("income").cast("double"))))
    r = r.select("year", "company", "population", "grp", "division", "section", "presumed", "ruling_base", "gap", "intensity")
    r = scratch.stored(r, "bases")  # sizes of peer groups, ties, their sums and the rows themselves are read from it
    r = peer_level(r, ["grp", "division"], "section", counts=F.col("population") == "comparable", least=least)
    r = r.withColumn("measured", F.when(F.col("population") == "comparable", F.col("intensity")))
    ranked = midrank(r, ["year", "peer_key"], "measured").drop("n")
    peers = r.groupBy("year", "peer_key").agg(F.count_if(F.col("population") == "comparable").alias("n_peers"))
    return ranked.join(peers, ["year", "peer_key"]).select(
        "year", "company", "population", "peer_level", "peer_key", "n_peers", "presumed", "ruling_base", "gap", "intensity", F.col("midrank").alias("percentile")
    )


def risk_profile(yearly: DataFrame) -> DataFrame:
    """Each company's last year and how its risk lasts over its years with data."""
    last = ["population", "peer_level", "presumed", "ruling_base", "gap", "intensity", "percentile"]
    return yearly.groupBy("company").agg(
        F.max("year").alias("last_year"),
        *(F.max_by(c, "year").alias(f"{c}_last") for c in last),
        F.count("*").alias("years"),
        F.count_if(F.col("percentile") >= 0.9).alias("years_high"),
        F.count_if(F.col("population") == "no_profit").alias("years_without_profit"),
        F.sum(F.greatest("gap", F.lit(0))).cast("decimal(24,6)").alias("gap_total"),
        F.max("percentile").alias("percentile_max"),
    )


def risk_summary(yearly: DataFrame) -> DataFrame:
    """Counts of each population, positive gaps and the median intensity of comparables by year."""
    yearly = scratch.stored(yearly.select("year", "population", "gap", "intensity"), "risk")  # counts, ties and their sums read it
    counts = yearly.groupBy("year").agg(
        F.count("*").alias("companies"),
        *(F.count_if(F.col("population") == p).alias(f"n_{p}") for p in ("no_income", "no_profit", "comparable")),
        F.count_if(F.col("gap") > 0).alias("n_gap"),
    )
    return counts.join(median(yearly.where("population = 'comparable'"), ["year"], "intensity", "median_intensity"), "year", "left")


def credit_summary(magnitude: DataFrame, kinds: tuple[str, ...] = ("vat_credit", "income_tax_credit")) -> DataFrame:
    """Of each year: the statements, and for each kind of credit how many have a positive balance and its sum (0 if none)."""
    positive = {k: F.when(F.col(k) > 0, F.col(k)) for k in kinds}
    return magnitude.groupBy("year").agg(
        F.count("*").alias("statements"),
        *(F.count(c).alias(f"n_{k}") for k, c in positive.items()),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("decimal(24,2)").alias(f"sum_{k}") for k, c in positive.items()),
    )


def persistence(profile: DataFrame) -> DataFrame:
    """How many companies were of high risk in how many of their years, and their summed gaps."""
    return profile.groupBy("years_high", "years").agg(F.count("*").alias("companies"), F.sum("gap_total").cast("decimal(30,6)").alias("gap_total"))


def risk_ranking(profile: DataFrame, companies: DataFrame, min_years_high: int = 1, min_gap: int = 0) -> DataFrame:
    """Companies of persistent risk, the largest gap first, then the id."""
    p = profile.where((F.col("years_high") >= min_years_high) & (F.col("gap_last") >= min_gap))
    return p.join(companies.select("company", "name", "division"), "company").orderBy(F.desc_nulls_last("gap_last"), "company")
