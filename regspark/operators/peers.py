"""Peer groups: fallback when a group is too small, midrank percentiles, sector cuts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from regspark.operators.merge import dealt
from regspark.sources.scratch import stored

MIN_PEERS = 30


def peer_level(rows: DataFrame, levels: list[str], last: str, period: str = "year", counts: Column | None = None, least: int = MIN_PEERS) -> DataFrame:
    """Add peer_level and peer_key: the first of `levels` whose group has `least` counted rows
    in the period, else `last`. `counts` says which rows count (all by default).

    Group sizes are aggregated and joined back, so that no window gathers a large group. They are
    stored first: Spark then knows that they are few and broadcasts them, and `rows` stays where it is.
    """
    counted = F.lit(True) if counts is None else counts
    out = rows
    level, key = F.lit(last), F.col(last)
    for name in reversed(levels):
        n = f"_n_{name}"
        size = rows.where(F.col(name).isNotNull()).groupBy(period, name).agg(F.count_if(counted).alias(n))
        out = out.join(stored(size, "sizes"), [period, name], "left")
        enough = F.coalesce(F.col(n), F.lit(0)) >= least
        level, key = F.when(enough, F.lit(name)).otherwise(level), F.when(enough, F.col(name)).otherwise(key)
    return out.withColumns({"peer_level": level, "peer_key": key}).drop(*(f"_n_{n}" for n in levels))


def value_range(value: Column) -> Column:
    """A whole number that never falls as the value rises, one for each 1/256 of a doubling; NaN counts as largest, as in Spark's order."""
    v = value.cast("double")
    size = F.floor(F.least(F.log2(F.abs(v)) * 256, F.lit(400_000.0))) + 500_000
    return F.when(F.isnan(v), F.lit(2_000_000)).when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("int")


def distribution(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Of each distinct value in a group: ties, rows below, and rows of the group.

    Rows are counted by value first. Then values are ordered within narrow ranges only, and the
    rows of lower ranges are added from sums by range: no task holds all values of a group,
    however large it is.
    """
    at = "_range"
    ties = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("ties")).withColumn(at, value_range(F.col(value)))
    w = W.partitionBy(*group)
    sums = ties.groupBy(*group, at).agg(F.sum("ties").alias("s"))
    sums = sums.select(*(F.col(c).alias(f"_{c}_of") for c in (*group, at)), F.coalesce(F.sum("s").over(w.orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("s").over(w).alias("n"))
    within = F.coalesce(F.sum("ties").over(W.partitionBy(*group, at).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in (*group, at)]
    return ties.withColumn("_within", within).join(sums, same).select(*group, value, "ties", (F.col("_before") + F.col("_within")).alias("below"), "n")


def midrank(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Add n (rows of the group with a value) and midrank, the share of them below plus half of
    the ties, from 0 to 1; midrank_100 is the same from 0 to 100."""
    d = distribution(rows, group, value)
    rank = F.col("below") + F.col("ties") / 2
    return rows.join(d.withColumns({"midrank": rank / F.col("n"), "midrank_100": 100 * rank / F.col("n")}).drop("ties", "below"), [*group, value], "left")


def percentile(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Add percentile: midrank_100 rounded to a whole number, NULL without a value.

    A percentile never falls as the value rises, so a group needs only the lowest value of each one it
    has, 101 at most. Rows are counted by narrow value range, which needs no shuffle of rows. Only in
    ranges where the percentile changes are values then counted one by one. `rows` is read three times.
    """
    some = rows.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("_low"), value_range(F.col(value)).alias("_range"))
    same = lambda other, by: reduce(Column.__and__, [F.col(c).eqNullSafe(other[f"_{c}_of"]) for c in by])
    named = lambda by: [F.col(c).alias(f"_{c}_of") for c in by]
    of = lambda below, ties: F.round(100 * (below + ties / 2) / F.col("_n")).cast("int")
    w = W.partitionBy(*group)
    sums = some.groupBy(*group, "_range").agg(F.count("*").alias("_s"), F.min("_low").alias("_low"), F.max("_low").alias("_high"))
    before = F.coalesce(F.sum("_s").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = stored(sums.select("*", before.alias("_before"), F.sum("_s").over(w).alias("_n")), "ranges")
    first, last = of(F.col("_before"), F.lit(1)), of(F.col("_before") + F.col("_s") - 1, F.lit(1))
    sums = sums.withColumn("_at", F.when(F.col("_low") == F.col("_high"), of(F.col("_before"), F.col("_s"))).when(first == last, first))
    held = stored(sums.where("_at IS NULL").select(*named([*group, "_range"]), "_before", "_n", "_s", F.monotonically_increasing_id().alias("_cell")), "held")
    count = held.agg(F.coalesce(F.sum("_s"), F.lit(0))).first()[0]
    ties = dealt(some.join(held, same(held, [*group, "_range"])).select("_cell", "_low"), count, ["_cell"])  # rows are moved with no more than that
    ties = ties.groupBy("_cell", "_low").agg(F.count("*").alias("_ties"))
    within = F.coalesce(F.sum("_ties").over(W.partitionBy("_cell").orderBy("_low").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = ties.withColumn("_within", within).join(held, "_cell")
    counted = counted.select(*(F.col(f"_{c}_of").alias(c) for c in group), "_low", of(F.col("_before") + F.col("_within"), F.col("_ties")).alias("_at"))
    lows = sums.where("_at IS NOT NULL").select(*group, "_low", "_at").unionAll(counted).groupBy(*group, "_at").agg(F.min("_low").alias("_low"))
    lows = lows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_low", "_at"))).alias("_s"))
    lows = stored(lows.select(*named(group), F.col("_s._low").alias("_lows"), F.col("_s._at").alias("_ats")), "lows")
    out = rows.join(lows, same(lows, group), "left").withColumn("_at", F.lit(0))
    for step in (64, 32, 16, 8, 4, 2, 1):  # the number of lows that the value reaches
        out = out.withColumn("_at", F.col("_at") + F.when(F.get("_lows", F.col("_at") + (step - 1)) <= F.col(value), step).otherwise(0))
    return out.select(*rows.columns, F.get("_ats", F.col("_at") - 1).alias("percentile"))


def cuts(rows: DataFrame, group: list[str], value: str, at: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """n, the exact interpolated percentiles (p10 ...) and the mean of each group.

    Rows are counted by narrow value range, which needs no shuffle of rows. Only the values of ranges
    that hold one of the order statistics are then counted one by one. `rows` is read twice.
    """
    some = rows.where(F.col(value).isNotNull()).select(*group, value, value_range(F.col(value)).alias("_range"))
    w = W.partitionBy(*group)
    sums = some.groupBy(*group, "_range").agg(F.count("*").alias("_s"), F.sum(value).alias("_total"))
    before = F.coalesce(F.sum("_s").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = stored(sums.select("*", before.alias("_before"), F.sum("_s").over(w).alias("n")), "ranges")
    places = [F.lit(p) * (F.col("n") - 1) for p in at]
    holds = [(F.col("_before") <= k) & (k < F.col("_before") + F.col("_s")) for place in places for k in (F.floor(place), F.ceil(place))]
    held = stored(sums.where(reduce(Column.__or__, holds)).select(*(F.col(c).alias(f"_{c}_of") for c in (*group, "_range")), "_before", "n"), "held")
    ties = some.join(held, [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in (*group, "_range")]).groupBy(*group, value, "_range", "_before", "n").agg(F.count("*").alias("ties"))
    within = F.coalesce(F.sum("ties").over(W.partitionBy(*group, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = ties.withColumn("below", F.col("_before") + within)
    picks = []
    for p, place in zip(at, places):
        low = F.floor(place)
        here = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("ties")), F.col(value)))
        a, b = here(low), here(F.ceil(place))
        picks.append(F.round(a + (b - a) * F.max(place - low), 6).alias(f"p{round(100 * p)}"))
    picked = d.groupBy(*group).agg(F.max("n").alias("n"), *picks)
    means = sums.groupBy(*(F.col(c).alias(f"_{c}_of") for c in group)).agg(F.round(F.sum("_total") / F.sum("_s"), 6).alias("mean"))
    return picked.join(means, [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in group]).select(*picked.columns, "mean")


def median(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """The exact interpolated median of each group that has a value, from running counts: no task holds a group's values."""
    d = distribution(rows, group, value)
    place = (F.col("n") - 1) / 2
    here = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("ties")), F.col(value)))
    low, high = here(F.floor(place)), here(F.ceil(place))
    return d.groupBy(*group).agg((low + (high - low) * F.max(place - F.floor(place))).alias(name))


def sector_axes(rows: DataFrame) -> DataFrame:
    """Each row once for its division, its section and the total ('*'); missing sectors are left out."""
    axis = F.inline(F.array(*(F.struct(F.lit(n).alias("level"), s.alias("sector")) for n, s in (("division", F.col("division")), ("section", F.col("section")), ("total", F.lit("*"))))))
    return rows.select("*", axis).where("sector IS NOT NULL")
