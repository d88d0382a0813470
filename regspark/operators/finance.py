"""Financial statements: magnitudes from accounts, ratios from formulas kept as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from regspark.plans.domain import CONCEPTS, MONEY


@dataclass(frozen=True)
class Formula:
    """(sum of plus - sum of minus) / sum of over; without `over` an amount. `better` is 1 if
    high values are good, -1 if low ones are, 0 if neither."""

    plus: tuple[str, ...]
    minus: tuple[str, ...] = ()
    over: tuple[str, ...] = ()
    better: int = 1


#: The register's indicators.
INDICATORS = {
    "current_ratio": Formula(("current_assets",), over=("current_liabilities",)),
    "acid_test": Formula(("current_assets",), ("inventories",), ("current_liabilities",)),
    "working_capital": Formula(("current_assets",), ("current_liabilities",)),
    "asset_debt": Formula(("liabilities",), over=("assets",), better=-1),
    "equity_debt": Formula(("liabilities",), over=("equity",), better=-1),
    "leverage": Formula(("assets",), over=("equity",), better=0),
    "solvency": Formula(("assets",), over=("liabilities",)),
    "interest_cover": Formula(("profit_before_tax",), over=("financial_expenses",)),
    "asset_turnover": Formula(("income",), over=("assets",)),
    "cost_share": Formula(("cost_of_sales",), over=("income",), better=-1),
    "expense_share": Formula(("expenses",), over=("income",), better=-1),
    "financial_load": Formula(("financial_expenses",), over=("income",), better=-1),
    "gross_margin": Formula(("gross_profit",), over=("income",)),
    "net_margin": Formula(("net_profit",), over=("income",)),
    "roa": Formula(("net_profit",), over=("assets",)),
    "roe": Formula(("net_profit",), over=("equity",)),
}

#: The concepts that the indicators are made of.
OPERANDS = [c for c in CONCEPTS if any(c in (*f.plus, *f.minus, *f.over) for f in INDICATORS.values())]


def magnitudes(detail: DataFrame) -> DataFrame:
    """One row per (year, company) with a column for each concept, from its preferred form.

    Form 1 wins over others. A concept that the form has but the company left out is 0; one
    that the form lacks is NULL, never 0.
    """
    one_form = detail.groupBy("year", "company", "form").agg(
        *(F.max(F.when(F.col("account") == F.when(F.col("form") == 1, F.lit(one)).otherwise(F.lit(three)), F.col("value"))).alias(c) for c, (one, three) in CONCEPTS.items())
    )
    # Column by column: a struct could only be aggregated by sorting.
    preference = F.when(F.col("form") == 1, 0).otherwise(F.col("form"))
    kept = one_form.groupBy("year", "company").agg(*(F.min_by(c, preference).alias(c) for c in ("form", *CONCEPTS)))
    zero = F.lit(0).cast(MONEY)
    return kept.select("year", "company", "form", *(F.when(F.lit(True) if three else F.col("form") == 1, F.coalesce(c, zero)).alias(c) for c, (_, three) in CONCEPTS.items()))


def ratio(f: Formula) -> Column:
    """The formula over magnitude columns: NULL if one is missing or the denominator is 0."""

    def total(names: tuple[str, ...]) -> Column:
        out = F.col(names[0]).cast("double")
        for n in names[1:]:
            out = out + F.col(n).cast("double")
        return out

    top = total(f.plus) - total(f.minus) if f.minus else total(f.plus)
    return F.try_divide(top, F.nullif(total(f.over), F.lit(0.0))) if f.over else top


def indicators(magnitude: DataFrame, *also: str) -> DataFrame:
    """year, company, the columns of `also`, and all ratios, one column each."""
    return magnitude.select("year", "company", *also, *(ratio(f).alias(name) for name, f in INDICATORS.items()))


def unpivoted(wide: DataFrame) -> DataFrame:
    """The other columns, indicator, value; no row where the value is NULL."""
    return wide.unpivot([c for c in wide.columns if c not in INDICATORS], list(INDICATORS), "indicator", "value").where("value IS NOT NULL")


def indicators_long(magnitude: DataFrame) -> DataFrame:
    """year, company, indicator, value; no row where the value is NULL."""
    return unpivoted(indicators(magnitude))


def comparative(magnitude: DataFrame, years: list[int]) -> DataFrame:
    """company, concept and one column a year; 0 where the year or the concept is missing."""
    long = magnitude.unpivot(["year", "company"], list(CONCEPTS), "concept", "value")
    return long.groupBy("company", "concept").agg(*(F.coalesce(F.max(F.when(F.col("year") == y, F.col("value"))), F.lit(0).cast(MONEY)).alias(f"y{y}") for y in years))


def statement_matrix(detail: DataFrame, form: int, years: list[int]) -> DataFrame:
    """company, account and the amounts of each year in one form; NULL where absent. Codes sort as bytes."""
    d = detail.where((F.col("form") == form) & F.col("year").isin(years))
    return d.groupBy("company", "account").agg(*(F.max(F.when(F.col("year") == y, F.col("value"))).alias(f"y{y}") for y in years))


def variation(magnitude: DataFrame, concept: str) -> DataFrame:
    """Change in percent against the previous year with data; NULL on a missing or zero base and when the sign flips."""
    before, now = F.col("before").cast("double"), F.col("now").cast("double")
    w = W.partitionBy("company").orderBy("year")
    steps = magnitude.select("year", "company", F.col(concept).alias("now"), F.lag(concept).over(w).alias("before"))
    return steps.withColumn("change_pct", F.when((before != 0) & (before * now >= 0), (now - before) / F.abs(before) * 100))


def percentile_band(percentile: Column, better: Column) -> Column:
    """good / bad / neutral at 75 and 25, by the indicator's direction."""
    p = F.when(better < 0, 100 - percentile).otherwise(percentile)
    return F.when(percentile.isNull(), F.lit(None)).when(better == 0, "neutral").when(p >= 75, "good").when(p <= 25, "bad").otherwise("neutral")


def equation_breaks(detail: DataFrame, tolerance: str = "0.05") -> DataFrame:
    """Statements whose assets are not liabilities plus equity, within a tolerance."""

    def of(concept: str) -> Column:
        one, three = CONCEPTS[concept]
        return F.coalesce(F.sum(F.when(F.col("account") == F.when(F.col("form") == 1, F.lit(one)).otherwise(F.lit(three)), F.col("value"))), F.lit(0)).cast(MONEY)

    g = detail.groupBy("year", "form", "company").agg(of("assets").alias("assets"), of("liabilities").alias("liabilities"), of("equity").alias("equity"))
    return g.withColumn("gap", (F.col("assets") - F.col("liabilities") - F.col("equity")).cast(MONEY)).where(F.abs("gap") > F.lit(tolerance).cast(MONEY))


def statement_summary(detail: DataFrame) -> DataFrame:
    """Statements and cells per year and form, with the year's totals."""
    per = detail.groupBy("year", "form", "company").agg(F.count("*").alias("n")).groupBy("year", "form").agg(F.count("*").alias("statements"), F.sum("n").alias("cells"))
    w = W.partitionBy("year")
    return per.withColumns({"year_statements": F.sum("statements").over(w), "year_cells": F.sum("cells").over(w)})


def undistributed_profit(magnitude: DataFrame, finance_companies: DataFrame, rate: str = "0.0125") -> DataFrame:
    """Retained profit, advance base and provisional advance by company and year."""
    net = F.coalesce(F.col("retained_total"), F.col("retained_gains") + F.coalesce("retained_losses", F.lit(0)))
    m = magnitude.join(finance_companies, "company").select(
        "year", "company", "financial", net.cast(MONEY).alias("net"), F.when(F.col("retained_total").isNotNull(), "total").otherwise("sum").alias("origin"), "retained_ifrs", "net_profit", "equity"
    )
    base = (F.coalesce("net", F.lit(0)) + F.coalesce("net_profit", F.lit(0))).cast(MONEY)
    w = W.partitionBy("company").orderBy("year")
    return m.select(
        "year",
        "company",
        "financial",
        "net",
        "origin",
        (F.col("net") - F.coalesce("retained_ifrs", F.lit(0))).cast(MONEY).alias("net_without_ifrs"),
        base.alias("advance_base"),
        F.when(base > 0, F.round(base * F.lit(rate).cast("decimal(6,5)"), 2)).cast(MONEY).alias("advance"),
        F.lag("net").over(w).alias("previous"),
        (F.col("net") - F.lag("net").over(w)).cast(MONEY).alias("change"),
        F.when(F.col("equity") > 0, F.col("net").cast("double") / F.col("equity").cast("double")).alias("equity_weight"),
    )


def credit_diagnosis(magnitude: DataFrame) -> DataFrame:
    """How each company's two tax credits move over its years with data."""
    w = W.partitionBy("company").orderBy("year")
    names = {"vat": "vat_credit", "rent": "income_tax_credit"}
    zero = F.lit(0).cast(MONEY)
    s = magnitude.select("company", "year", *(F.coalesce(c, zero).alias(k) for k, c in names.items()))
    s = s.withColumns({f"{k}_before": F.lag(k).over(w) for k in names})
    parts = [F.count("*").alias("years"), F.max("year").alias("last_year")]
    for k in names:
        parts += [F.max_by(k, "year").alias(f"{k}_last"), F.min_by(k, "year").alias(f"{k}_first"), F.max(k).alias(f"{k}_max"), F.count_if(F.col(k) > F.col(f"{k}_before")).alias(f"{k}_up"), F.count_if(F.col(k) < F.col(f"{k}_before")).alias(f"{k}_down")]
    g = s.groupBy("company").agg(*parts)
    for k in names:
        last, top, up, down = (F.col(f"{k}_{x}") for x in ("last", "max", "up", "down"))
        g = g.withColumn(
            f"{k}_diagnosis",
            F.when(last <= 0, "no_balance").when(F.col("years") < 3, "short_series").when((last >= top) & (up > down), "accumulates").when((last < top) & (down >= up), "consumes").otherwise("irregular"),
        )
    return g
