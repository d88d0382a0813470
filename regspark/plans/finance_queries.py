"""Registered queries over statements: magnitudes, ratios, peers, tax risk; with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.operators import finance, peers, risk
from regspark.plans.domain import COMPANIES_SQL, CONCEPTS, DETAIL_SQL, companies, read, statements
from regspark.sources import scratch

YEARS = [1995, 1996, 1997, 1998, 1999, 2000, 2001]
SECTOR = ["year", "level", "sector", "indicator"]
REGULATED = [1995, 1996, 1997, 1998, 1999, 2000]


def _magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.magnitudes(statements(spark, sf_dir))


def _with_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators by row, with sectors; those of a company and year are stored in one row, since the rows are read twice."""
    wide = finance.indicators(_magnitudes(spark, sf_dir)).join(companies(spark, sf_dir).select("company", "division", "section"), "company")
    return finance.unpivoted(scratch.stored(wide, "indicators"))


def _company_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes with sectors. Orders are dealt out by company, which serves the sums and the join alike."""
    return finance.magnitudes(statements(spark, sf_dir, by_company=True)).join(companies(spark, sf_dir).select("company", "division", "section"), "company")


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies(spark, sf_dir).withColumn("simplified", F.col("segment") == "HOUSEHOLD")


def _coefficients(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(specific, general, regulated) presumptive coefficients, from the nation's number."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.array(*map(F.lit, REGULATED))).alias("year"))
    money = "AS decimal(6,4)) AS coefficient"
    per = F.inline(F.expr(f"array(struct('income' AS base, CAST(0.05 + nation * 0.001 {money}), struct('costs' AS base, CAST(0.04 + nation * 0.002 {money}), struct('assets' AS base, CAST(IF(nation % 3 = 0, NULL, 0.02 + nation * 0.0005) {money}))"))
    years = nations.select("year").distinct()
    general = F.inline(F.expr(f"array(struct('income' AS base, CAST(0.05 {money}), struct('costs' AS base, CAST(0.06 {money}), struct('assets' AS base, CAST(0.03 {money}))"))
    return nations.where("nation % 4 <> 0").select("year", "nation", per), years.select("year", general), years


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.presumptive_base(_magnitudes(spark, sf_dir), _companies(spark, sf_dir), *_coefficients(spark, sf_dir))


def _risk_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.risk_year(_base(spark, sf_dir))


def pl_magnitudes(spark, sf_dir):
    return _magnitudes(spark, sf_dir)


def pl_indicators(spark, sf_dir):
    return finance.indicators(_magnitudes(spark, sf_dir))


def pl_indicator_history(spark, sf_dir):
    long = finance.indicators_long(_magnitudes(spark, sf_dir))
    return long.groupBy("company", "indicator").agg(*(F.max(F.when(F.col("year") == y, F.col("value"))).alias(f"y{y}") for y in YEARS))


def pl_company_percentiles(spark, sf_dir):
    """Each company's indicators with their percentile among the chosen peers: the division
    if 30 companies filed in it that year, else the section."""
    kept = scratch.stored(_company_magnitudes(spark, sf_dir).select("year", "company", "division", "section", *finance.OPERANDS), "magnitudes")  # amounts take less room than ratios
    chosen = peers.peer_level(finance.indicators(kept, "division", "section"), ["division"], "section").drop("division", "section")
    long = finance.unpivoted(chosen)
    return peers.percentile(long, ["year", "peer_level", "peer_key", "indicator"], "value").select("year", "company", "peer_level", "peer_key", "indicator", "value", "percentile")


def fn_percentile_band(spark, sf_dir):
    better = F.element_at(F.create_map(*(x for k, f in finance.INDICATORS.items() for x in (F.lit(k), F.lit(f.better)))), F.col("indicator"))
    return pl_company_percentiles(spark, sf_dir).select("year", "company", "indicator", "percentile", finance.percentile_band(F.col("percentile"), better).alias("band"))


def ag_sector_cuts(spark, sf_dir):
    return peers.cuts(peers.sector_axes(_with_sector(spark, sf_dir)), SECTOR, "value")


def pl_sector_view(spark, sf_dir):
    """The cuts of every section in its last year."""
    cuts = peers.cuts(peers.sector_axes(_with_sector(spark, sf_dir)).where("level = 'section'"), SECTOR, "value")
    last = cuts.groupBy("sector").agg(F.max("year").alias("year"))
    return cuts.join(last, ["sector", "year"]).select("sector", "year", "indicator", "n", "p50", "mean")


def pl_comparative(spark, sf_dir):
    return finance.comparative(_magnitudes(spark, sf_dir), YEARS)


def pl_statement_matrix(spark, sf_dir):
    return finance.statement_matrix(statements(spark, sf_dir), 1, YEARS)


def pl_statement_detail(spark, sf_dir):
    concept = F.explode(F.array(*(F.struct(F.lit(code).alias("account"), F.lit(c).alias("concept")) for c, (code, _) in CONCEPTS.items())))
    names = spark.range(1).select(concept.alias("x")).select("x.*")
    d = statements(spark, sf_dir).where("form = 1 AND year = 1997")
    return d.join(names, "account", "left").select("company", "account", "concept", "value")


def fn_variation_pct(spark, sf_dir):
    return finance.variation(_magnitudes(spark, sf_dir), "net_profit")


def ag_equation_check(spark, sf_dir):
    """Statements that do not balance once liabilities of every seventh company are raised by 1."""
    d = statements(spark, sf_dir)
    bumped = F.when((F.col("company") % 7 == 0) & F.col("account").isin("2", "599"), F.col("value") + 1).otherwise(F.col("value")).cast("decimal(18,2)")
    return finance.equation_breaks(d.withColumn("value", bumped))


def ag_statement_summary(spark, sf_dir):
    return finance.statement_summary(statements(spark, sf_dir))


def pl_undistributed_profit(spark, sf_dir):
    finance_companies = _companies(spark, sf_dir).select("company", (F.col("segment") == "MACHINERY").alias("financial"))
    return finance.undistributed_profit(_magnitudes(spark, sf_dir), finance_companies)


def pl_credit_diagnosis(spark, sf_dir):
    return finance.credit_diagnosis(_magnitudes(spark, sf_dir))


def pl_credit_page(spark, sf_dir):
    """Companies whose last credits sum to 1000 or more, with the credit of each year."""
    m = _magnitudes(spark, sf_dir).withColumn("credit", F.coalesce("vat_credit", F.lit(0)) + F.coalesce("income_tax_credit", F.lit(0)))
    g = m.groupBy("company").agg(F.max("year").alias("last_year"), F.max_by("credit", "year").cast("decimal(18,2)").alias("last_credit"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", "credit"))), lambda x: F.concat_ws(":", x["year"].cast("string"), x["credit"].cast("decimal(18,2)").cast("string"))), " ").alias("by_year"))
    return g.where("last_credit >= 1000")


def pl_presumptive_base(spark, sf_dir):
    return _base(spark, sf_dir)


def pl_risk_year(spark, sf_dir):
    return _risk_year(spark, sf_dir)


def pl_risk_profile(spark, sf_dir):
    return risk.risk_profile(_risk_year(spark, sf_dir))


def pl_risk_summary(spark, sf_dir):
    return risk.risk_summary(_risk_year(spark, sf_dir))


def pl_risk_ranking(spark, sf_dir):
    return risk.risk_ranking(risk.risk_profile(_risk_year(spark, sf_dir)), companies(spark, sf_dir)).select("company", "name", "division", "last_year", "gap_last", "years_high")


# ---- oracle SQL ----------------------------------------------------------------------------

_PIVOT = ", ".join(f"max(CASE WHEN account = (CASE WHEN form = 1 THEN '{one}' ELSE {repr(three) if three else 'NULL'} END) THEN value END) AS {c}" for c, (one, three) in CONCEPTS.items())
_FILLED = ", ".join(f"CASE WHEN {'true' if three else 'form = 1'} THEN coalesce({c}, CAST(0 AS DECIMAL(18,2))) END AS {c}" for c, (_, three) in CONCEPTS.items())


def _sql_ratio(f: finance.Formula) -> str:
    add = lambda names: " + ".join(f"CAST({n} AS DOUBLE)" for n in names)
    top = f"({add(f.plus)})" + (f" - ({add(f.minus)})" if f.minus else "")
    return f"({top}) / nullif({add(f.over)}, 0)" if f.over else top


_MAG = f"""WITH {COMPANIES_SQL}, {DETAIL_SQL},
one_form AS (SELECT year, company, form, {_PIVOT} FROM detail GROUP BY ALL),
mag AS (SELECT year, company, form, {_FILLED} FROM (SELECT * FROM one_form QUALIFY row_number() OVER (PARTITION BY year, company ORDER BY form) = 1))"""
_WIDE = _MAG + ", wide AS (SELECT year, company, " + ", ".join(f"{_sql_ratio(f)} AS {k}" for k, f in finance.INDICATORS.items()) + " FROM mag)"
_LONG = _WIDE + ", long AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT year, company, '{k}' AS indicator, {k} AS value FROM wide" for k in finance.INDICATORS) + ") WHERE value IS NOT NULL)"
_PCT = _LONG + """,
size AS (SELECT year, division, count(*) AS n FROM mag JOIN companies USING (company) GROUP BY ALL),
chosen AS (SELECT m.year, m.company, CASE WHEN n >= 30 THEN 'division' ELSE 'section' END AS peer_level, CASE WHEN n >= 30 THEN c.division ELSE c.section END AS peer_key FROM mag m JOIN companies c USING (company) JOIN size s ON s.year = m.year AND s.division = c.division),
ranked AS (SELECT year, company, peer_level, peer_key, indicator, value,
  CAST(round(100 * ((rank() OVER g - 1) + CAST(count(*) OVER (PARTITION BY year, peer_level, peer_key, indicator, value) AS DOUBLE) / 2) / count(*) OVER (PARTITION BY year, peer_level, peer_key, indicator)) AS INTEGER) AS percentile
  FROM long JOIN chosen USING (year, company) WINDOW g AS (PARTITION BY year, peer_level, peer_key, indicator ORDER BY value))"""
_CUTS = _LONG + """,
axes AS (SELECT year, indicator, value, unnest(['division', 'section', 'total']) AS level, unnest([division, section, '*']) AS sector FROM long JOIN companies USING (company)),
cut AS (SELECT year, level, sector, indicator, CAST(count(*) AS BIGINT) AS n, """ + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(100 * p)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9)) + """, round(avg(value), 6) AS mean FROM axes WHERE sector IS NOT NULL GROUP BY ALL)"""
_YEAR_COLUMNS = ", ".join(f"max(CASE WHEN year = {y} THEN value END) AS y{y}" for y in YEARS)
_BASE = _MAG + """,
coef AS (SELECT n_nationkey AS nation, CAST(0.05 + n_nationkey * 0.001 AS DECIMAL(6,4)) AS s_income, CAST(0.04 + n_nationkey * 0.002 AS DECIMAL(6,4)) AS s_costs, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(0.02 + n_nationkey * 0.0005 AS DECIMAL(6,4)) END AS s_assets FROM nation WHERE n_nationkey % 4 <> 0),
amount AS (SELECT m.*, c.nation, c.grp, c.division, c.section, c.segment = 'HOUSEHOLD' AS simplified, cost_of_sales + expenses AS costs, s_income, s_costs, s_assets
  FROM mag m JOIN companies c USING (company) LEFT JOIN coef USING (nation) WHERE year <= 2000),
bases AS (SELECT *, CASE WHEN income > 0 THEN CAST(CAST(income AS DECIMAL(18,2)) * CAST(coalesce(s_income, 0.05) AS DECIMAL(6,4)) AS DECIMAL(24,6)) END AS base_income,
  CASE WHEN costs > 0 THEN CAST(CAST(costs AS DECIMAL(18,2)) * CAST(coalesce(s_costs, 0.06) AS DECIMAL(6,4)) AS DECIMAL(24,6)) END AS base_costs,
  CASE WHEN assets > 0 THEN CAST(CAST(assets AS DECIMAL(18,2)) * CAST(coalesce(s_assets, 0.03) AS DECIMAL(6,4)) AS DECIMAL(24,6)) END AS base_assets FROM amount),
base AS (SELECT year, company, nation, grp, division, section, simplified, income, assets, profit_before_tax AS declared, base_income, base_costs, base_assets, greatest(base_income, base_costs, base_assets) AS presumed,
  CASE greatest(base_income, base_costs, base_assets) WHEN base_income THEN 'income' WHEN base_costs THEN 'costs' WHEN base_assets THEN 'assets' END AS ruling_base,
  s_income IS NOT NULL OR s_costs IS NOT NULL OR s_assets IS NOT NULL AS any_specific, CAST(greatest(base_income, base_costs, base_assets) - coalesce(profit_before_tax, 0) AS DECIMAL(24,6)) AS gap FROM bases)"""
_RISK = _BASE + """,
pop AS (SELECT *, CASE WHEN income IS NULL OR income <= 0 OR income < 0.01 * coalesce(assets, 0) THEN 'no_income' WHEN declared IS NULL OR declared <= 0 THEN 'no_profit' ELSE 'comparable' END AS population,
  CASE WHEN income > 0 THEN CAST(gap AS DOUBLE) / CAST(income AS DOUBLE) END AS intensity FROM base WHERE NOT simplified),
sized AS (SELECT *, count(*) FILTER (WHERE population = 'comparable') OVER (PARTITION BY year, grp) AS ng, count(*) FILTER (WHERE population = 'comparable') OVER (PARTITION BY year, division) AS nd FROM pop),
leveled AS (SELECT *, CASE WHEN ng >= 30 THEN 'grp' WHEN nd >= 30 THEN 'division' ELSE 'section' END AS peer_level, CASE WHEN ng >= 30 THEN grp WHEN nd >= 30 THEN division ELSE section END AS peer_key FROM sized),
risk AS (SELECT year, company, population, peer_level, peer_key, CAST(count(*) FILTER (WHERE population = 'comparable') OVER (PARTITION BY year, peer_key) AS BIGINT) AS n_peers, presumed, ruling_base, gap, intensity,
  CASE WHEN population = 'comparable' THEN (rank() OVER (PARTITION BY year, peer_key, population ORDER BY intensity) - 1 + CAST(count(*) OVER (PARTITION BY year, peer_key, population, intensity) AS DOUBLE) / 2) / count(*) OVER (PARTITION BY year, peer_key, population) END AS percentile FROM leveled),
profile AS (SELECT company, max(year) AS last_year, """ + ", ".join(f"arg_max_null({c}, year) AS {c}_last" for c in ("population", "peer_level", "presumed", "ruling_base", "gap", "intensity", "percentile")) + """,
  count(*) AS years, count(*) FILTER (WHERE percentile >= 0.9) AS years_high, count(*) FILTER (WHERE population = 'no_profit') AS years_without_profit, CAST(sum(greatest(gap, 0)) AS DECIMAL(24,6)) AS gap_total, max(percentile) AS percentile_max FROM risk GROUP BY company)"""


def _credit_sql() -> str:
    parts, verdicts = [], []
    for k in ("vat", "rent"):
        parts.append(f"arg_max({k}, year) AS {k}_last, arg_min({k}, year) AS {k}_first, max({k}) AS {k}_max, count(*) FILTER (WHERE {k} > {k}_before) AS {k}_up, count(*) FILTER (WHERE {k} < {k}_before) AS {k}_down")
        verdicts.append(f"CASE WHEN {k}_last <= 0 THEN 'no_balance' WHEN years < 3 THEN 'short_series' WHEN {k}_last >= {k}_max AND {k}_up > {k}_down THEN 'accumulates' WHEN {k}_last < {k}_max AND {k}_down >= {k}_up THEN 'consumes' ELSE 'irregular' END AS {k}_diagnosis")
    return f"""{_MAG}, s AS (SELECT company, year, coalesce(vat_credit, 0) AS vat, coalesce(income_tax_credit, 0) AS rent FROM mag),
l AS (SELECT *, lag(vat) OVER w AS vat_before, lag(rent) OVER w AS rent_before FROM s WINDOW w AS (PARTITION BY company ORDER BY year)),
g AS (SELECT company, count(*) AS years, max(year) AS last_year, {', '.join(parts)} FROM l GROUP BY company) SELECT *, {', '.join(verdicts)} FROM g"""


_BETTER = "CASE indicator " + " ".join(f"WHEN '{k}' THEN {f.better}" for k, f in finance.INDICATORS.items()) + " END"

ORACLE_SQL = {
    "pl_magnitudes": _MAG + " SELECT * FROM mag",
    "pl_indicators": _WIDE + " SELECT * FROM wide",
    "pl_indicator_history": _LONG + f" SELECT company, indicator, {_YEAR_COLUMNS} FROM long GROUP BY ALL",
    "pl_company_percentiles": _PCT + " SELECT * FROM ranked",
    "fn_percentile_band": _PCT + f", b AS (SELECT *, {_BETTER} AS better FROM ranked) SELECT year, company, indicator, percentile, CASE WHEN better = 0 THEN 'neutral' WHEN (CASE WHEN better < 0 THEN 100 - percentile ELSE percentile END) >= 75 THEN 'good' WHEN (CASE WHEN better < 0 THEN 100 - percentile ELSE percentile END) <= 25 THEN 'bad' ELSE 'neutral' END AS band FROM b",
    "ag_sector_cuts": _CUTS + " SELECT * FROM cut",
    "pl_sector_view": _CUTS + " SELECT sector, year, indicator, n, p50, mean FROM cut WHERE level = 'section' QUALIFY year = max(year) OVER (PARTITION BY sector)",
    "pl_comparative": _MAG + " SELECT company, concept, " + ", ".join(f"coalesce(max(CASE WHEN year = {y} THEN value END), CAST(0 AS DECIMAL(18,2))) AS y{y}" for y in YEARS) + " FROM (" + " UNION ALL ".join(f"SELECT year, company, '{c}' AS concept, {c} AS value FROM mag" for c in CONCEPTS) + ") GROUP BY ALL",
    "pl_statement_matrix": f"WITH {DETAIL_SQL} SELECT company, account, {_YEAR_COLUMNS} FROM detail WHERE form = 1 GROUP BY ALL",
    "pl_statement_detail": f"WITH {DETAIL_SQL} SELECT company, account, CASE account " + " ".join(f"WHEN '{one}' THEN '{c}'" for c, (one, _) in CONCEPTS.items()) + " END AS concept, value FROM detail WHERE form = 1 AND year = 1997",
    "fn_variation_pct": _MAG + ", s AS (SELECT year, company, net_profit AS now, lag(net_profit) OVER (PARTITION BY company ORDER BY year) AS before FROM mag) SELECT *, CASE WHEN before <> 0 AND CAST(before AS DOUBLE) * CAST(now AS DOUBLE) >= 0 THEN (CAST(now AS DOUBLE) - CAST(before AS DOUBLE)) / abs(CAST(before AS DOUBLE)) * 100 END AS change_pct FROM s",
    "ag_equation_check": f"""WITH {DETAIL_SQL}, b AS (SELECT year, form, company, account, CASE WHEN company % 7 = 0 AND account IN ('2', '599') THEN value + 1 ELSE value END AS value FROM detail),
g AS (SELECT year, form, company, CAST(coalesce(sum(CASE WHEN account = CASE WHEN form = 1 THEN '1' ELSE '499' END THEN value END), 0) AS DECIMAL(18,2)) AS assets, CAST(coalesce(sum(CASE WHEN account = CASE WHEN form = 1 THEN '2' ELSE '599' END THEN value END), 0) AS DECIMAL(18,2)) AS liabilities, CAST(coalesce(sum(CASE WHEN account = CASE WHEN form = 1 THEN '3' ELSE '698' END THEN value END), 0) AS DECIMAL(18,2)) AS equity FROM b GROUP BY ALL)
SELECT *, CAST(assets - liabilities - equity AS DECIMAL(18,2)) AS gap FROM g WHERE abs(assets - liabilities - equity) > 0.05""",
    "ag_statement_summary": f"WITH {DETAIL_SQL}, p AS (SELECT year, form, count(DISTINCT company) AS statements, count(*) AS cells FROM detail GROUP BY ALL) SELECT *, CAST(sum(statements) OVER (PARTITION BY year) AS BIGINT) AS year_statements, CAST(sum(cells) OVER (PARTITION BY year) AS BIGINT) AS year_cells FROM p",
    "pl_undistributed_profit": _MAG + """, n AS (SELECT year, company, segment = 'MACHINERY' AS financial, CAST(coalesce(retained_total, retained_gains + coalesce(retained_losses, 0)) AS DECIMAL(18,2)) AS net, CASE WHEN retained_total IS NOT NULL THEN 'total' ELSE 'sum' END AS origin, retained_ifrs, net_profit, equity FROM mag JOIN companies USING (company)),
b AS (SELECT *, CAST(coalesce(net, 0) + coalesce(net_profit, 0) AS DECIMAL(18,2)) AS advance_base, lag(net) OVER (PARTITION BY company ORDER BY year) AS previous FROM n)
SELECT year, company, financial, net, origin, CAST(net - coalesce(retained_ifrs, 0) AS DECIMAL(18,2)) AS net_without_ifrs, advance_base, CASE WHEN advance_base > 0 THEN CAST(round(advance_base * CAST(0.0125 AS DECIMAL(6,5)), 2) AS DECIMAL(18,2)) END AS advance, previous, CAST(net - previous AS DECIMAL(18,2)) AS change, CASE WHEN equity > 0 THEN CAST(net AS DOUBLE) / CAST(equity AS DOUBLE) END AS equity_weight FROM b""",
    "pl_credit_diagnosis": _credit_sql(),
    "pl_credit_page": _MAG + ", s AS (SELECT company, year, CAST(coalesce(vat_credit, 0) + coalesce(income_tax_credit, 0) AS DECIMAL(18,2)) AS credit FROM mag) SELECT company, max(year) AS last_year, arg_max(credit, year) AS last_credit, string_agg(year || ':' || credit, ' ' ORDER BY year) AS by_year FROM s GROUP BY company HAVING arg_max(credit, year) >= 1000",
    "pl_presumptive_base": _BASE + " SELECT * FROM base",
    "pl_risk_year": _RISK + " SELECT * FROM risk",
    "pl_risk_profile": _RISK + " SELECT * FROM profile",
    "pl_risk_summary": _RISK + " SELECT year, count(*) AS companies, " + ", ".join(f"count(*) FILTER (WHERE population = '{p}') AS n_{p}" for p in ("no_income", "no_profit", "comparable")) + ", count(*) FILTER (WHERE gap > 0) AS n_gap, quantile_cont(intensity, 0.5) FILTER (WHERE population = 'comparable') AS median_intensity FROM risk GROUP BY year",
    "pl_risk_ranking": _RISK + " SELECT company, name, division, last_year, gap_last, years_high FROM profile JOIN companies USING (company) WHERE years_high >= 1 AND gap_last >= 0",
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
