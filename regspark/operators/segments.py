"""Subject profile over several populations, and segments as rules over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

class InactiveSegment(ValueError):
    """A segment that is switched off was asked for."""


#: A rule is SQL text over the profile; NULL means not a member. (code, rule, active, include_inactive)
RULES = (
    ("new_companies", "kind = 'company' AND first_year >= as_of_year - 1", True, False),
    ("large_assets", "last_assets >= 1500000", True, False),
    ("crossed_threshold", "last_assets >= 1000000 AND previous_assets < 1000000", True, False),
    ("bookkeepers", "kind = 'person' AND keeps_books", True, False),
    ("reachable", "contact IS NOT NULL", True, True),
    ("retired", "kind = 'supplier'", False, False),
)
#: Companies must be in force themselves; others too, unless a segment takes inactive ones.
IN_FORCE = "in_force"


def last_two(headers: DataFrame, values: list[str]) -> DataFrame:
    """company with the values of its last and previous year with data, one row each."""
    top = headers.groupBy("company").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.slice(F.sort_array(F.collect_set(F.struct("year", *values)), False), 1, 2).alias("s"))
    picks = [F.get("s", F.lit(k))[v].alias(f"{name}_{v}") for k, name in enumerate(("last", "previous")) for v in values]
    return top.select("company", "first_year", "last_year", F.get("s", F.lit(1))["year"].alias("previous_year"), *picks)


def evaluate(profile: DataFrame, as_of_year: int, rules=RULES, only: list[str] | None = None) -> DataFrame:
    """(segment, kind, id) of every member of every active segment, in one scan of the profile.

    With `only`, of those named; an inactive or unknown one among them raises InactiveSegment.
    """
    if only is not None:
        if refused := sorted(set(only) - {code for code, _, active, _ in rules if active}):
            raise InactiveSegment(f"inactive or unknown: {', '.join(refused)}")
        rules = [r for r in rules if r[0] in only]
    p = profile.withColumn("as_of_year", F.lit(as_of_year))
    codes = F.array(*(F.when(F.expr(f"({rule})" + ("" if lax else f" AND {IN_FORCE}")), F.lit(code)) for code, rule, active, lax in rules if active))
    return p.select(F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("segment"), "kind", "id")


def run(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(segment, kind, id, change) between two evaluations; the first run has entries only."""
    key = ["segment", "kind", "id"]
    if old is None:
        return new.select(*key, F.lit("entry").alias("change"))
    j = new.withColumn("_n", F.lit(1)).join(old.withColumn("_o", F.lit(1)), key, "full_outer")
    return j.where("_n IS NULL OR _o IS NULL").select(*key, F.when(F.col("_o").isNull(), "entry").otherwise("exit").alias("change"))


# ---- history over many runs ------------------------------------------------------------------


def intervals(members: DataFrame, dates: list[str]) -> DataFrame:
    """segment, kind, id, first_run, last_run, entered, left: how long each was a member without a gap.

    `members` is (segment, kind, id, run) with runs numbered from 1, held on `dates`. `left` is the
    date of the first run without the member, null while it still is one. A member has at most as
    many rows as there were runs, so its runs fit in an array, and one shuffle does.
    """
    runs = F.array(*(F.lit(d).cast("date") for d in dates))
    m = members.groupBy("segment", "kind", "id").agg(F.collect_set("run").alias("runs"))
    begun = F.array_sort(F.filter("runs", lambda r: ~F.array_contains("runs", r - 1)))
    ended = F.array_sort(F.filter("runs", lambda r: ~F.array_contains("runs", r + 1)))
    spans = F.arrays_zip(begun.alias("first_run"), ended.alias("last_run"))
    x = m.select("segment", "kind", "id", F.inline(spans).alias("first_run", "last_run"))
    return x.withColumns({"entered": F.get(runs, F.col("first_run") - 1), "left": F.get(runs, F.col("last_run"))})


def run_rows(spans: DataFrame, segments: list[str], dates: list[str]) -> DataFrame:
    """segment, run, held_on, total, entries, exits, events for every segment and run, from intervals().

    A run whose members are all new and that nobody leaves is a first run: it has no events, since
    none of its entries is news; else there is one for each entry and exit.
    """
    spark = spans.sparkSession
    change = spans.select("segment", F.inline(F.array(F.struct(F.col("first_run").alias("run"), F.lit(1).alias("n")), F.struct((F.col("last_run") + 1).alias("run"), F.lit(-1).alias("n")))))
    counted = change.groupBy("segment", "run").agg(F.count_if(F.col("n") > 0).alias("entries"), F.count_if(F.col("n") < 0).alias("exits"))
    runs = F.explode(F.array(*(F.struct(F.lit(k).alias("run"), F.lit(d).cast("date").alias("held_on")) for k, d in enumerate(dates, 1))))
    grid = spark.createDataFrame([(s,) for s in segments], "segment string").select("segment", runs.alias("r")).select("segment", "r.*")
    all_ = grid.join(counted, ["segment", "run"], "left").na.fill(0, ["entries", "exits"])
    total = F.sum(F.col("entries") - F.col("exits")).over(Window.partitionBy("segment").orderBy("run"))  # one row a run
    first = (F.col("exits") == 0) & (F.col("entries") == F.col("total"))
    return all_.withColumn("total", total).withColumn("events", F.when(first, F.lit(0)).otherwise(F.col("entries") + F.col("exits")).cast("long")).select("segment", "run", "held_on", "total", "entries", "exits", "events")


def events(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """segment, kind, id, run, change of every entry and exit in runs that have events."""
    change = spans.select("segment", "kind", "id", F.inline(F.array(F.struct(F.col("first_run").alias("run"), F.lit("entry").alias("change")), F.struct((F.col("last_run") + 1).alias("run"), F.lit("exit").alias("change")))))
    return change.join(runs.where("events > 0").select("segment", "run"), ["segment", "run"], "left_semi").select("segment", "kind", "id", "run", "change")


def members_at(spans: DataFrame, date: str, within_days: int | None = None) -> DataFrame:
    """The members on a date, with the date they entered; with `within_days` only those that entered so lately."""
    d = F.lit(date).cast("date")
    there = (F.col("entered") <= d) & (F.col("left").isNull() | (F.col("left") > d))
    recent = F.lit(True) if within_days is None else F.col("entered") > F.date_sub(d, within_days)
    return spans.where(there & recent).select("segment", "kind", "id", "entered")


def overview(spans: DataFrame, runs: DataFrame, products: DataFrame, within_days: int = 30) -> DataFrame:
    """segment, last_run, held_on, members, entries (of the last days before the last run), products (by priority)."""
    last = runs.groupBy("segment").agg(F.max(F.struct("run", "held_on", "total")).alias("r")).select("segment", F.col("r.run").alias("last_run"), F.col("r.held_on").alias("held_on"), F.col("r.total").alias("members"))
    lately = runs.alias("a").join(last.select("segment", F.col("held_on").alias("_end")), "segment").where(F.col("held_on") > F.date_sub("_end", within_days)).groupBy("segment").agg(F.sum("entries").alias("entries"))
    sold = products.groupBy("segment").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("priority", "product"))), lambda x: x["product"]), ",").alias("products"))
    return last.join(lately, "segment", "left").join(sold, "segment", "left")
