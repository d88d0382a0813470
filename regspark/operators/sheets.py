"""Pages and sheets of the register: a page of holders with their sites, a subject with its children,
nested catalogues, checks with samples, and the guard of populations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regspark.sources import scratch

#: Events that a presence sheet shows, ids that a check shows.
HISTORY, SAMPLE = 50, 5


class PopulationChanged(ValueError):
    """A step that may only reshape rows has lost or gained some."""


def page(holders: DataFrame, sites: DataFrame, key: str = "id", size: int = 50, after: object | None = None) -> DataFrame:
    """The `size` holders that follow `after` in the order of `key`, each with the places of its sites and the
    activity and code of its first site (by number); `next` is the key to go on from, null on the last page.

    `sites` is (key, number, province, activity, code). Holders without a key are on no page. Only the sites
    of the page's holders are aggregated; one row more than the page tells whether there is another.
    """
    start = holders.where(F.col(key).isNotNull() if after is None else F.col(key) > after)
    taken = start.orderBy(key).limit(size + 1)  # so few rows that one task may hold them, and a broadcast too
    every = Window.partitionBy()
    shown = taken.withColumns({"_k": F.row_number().over(Window.orderBy(key)), "_n": F.count("*").over(every)})
    shown = shown.withColumn("next", F.when(F.col("_n") > size, F.max(F.when(F.col("_k") == size, F.col(key))).over(every))).where(F.col("_k") <= size).drop("_k", "_n")
    first = F.min_by(F.struct("activity", "code"), F.struct("number", "activity", "code"))
    theirs = sites.join(F.broadcast(shown.select(key)), key, "left_semi").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("province")), ", ").alias("places"), first.alias("_first"))
    return shown.join(theirs, key, "left").select(*holders.columns, "places", F.col("_first.activity").alias("main_activity"), F.col("_first.code").alias("main_code"), "next")


def with_children(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Each parent with its children of every kind as an array of structs, in the order of their columns; none is an empty array.

    A kind must have been summed to a bounded number of rows a parent (its years, lists, places), as the arrays hold all.
    """
    out = parents
    for name, (rows, columns) in children.items():
        each = rows.groupBy(F.col(key).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        kept = [F.col(c) for c in out.columns]
        out = out.join(each, F.col(key) == F.col("_parent"), "left").select(*kept, F.coalesce(name, F.array().cast(each.schema[name].dataType)).alias(name))
    return out


def tree(rows: DataFrame, levels: list[str]) -> DataFrame:
    """`levels[0]`, n and `children`: the next level's names in order with n and their own children, down to the last.

    Rows are counted on the last level first, so only the catalogue itself is nested.
    """
    counted = rows.groupBy(*levels).agg(F.count("*").alias("n"))
    inner = ["n"]
    for depth in range(len(levels) - 1, 0, -1):
        node = F.struct(F.col(levels[depth]).alias("name"), *inner)
        counted = counted.groupBy(*levels[:depth]).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(node)).alias("children"))
        inner = ["n", "children"]
    return counted


def check_report(checks: dict[str, tuple[DataFrame, Column]], sample: int = SAMPLE) -> DataFrame:
    """check, n, and the `sample` least ids as one text, null where nothing was found; one row a check.

    All findings are written once as (check, id). The ids are ranked inside tasks before they are shuffled, so a
    check that finds most rows sends few.
    """
    found = reduce(DataFrame.unionByName, (rows.select(F.lit(name).alias("check"), at.cast("string").alias("id")) for name, (rows, at) in checks.items()))
    found = scratch.stored(found, "checks")
    n = found.groupBy("check").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("check").orderBy("id"))
    least = found.withColumn("_k", rank).where(F.col("_k") <= sample).groupBy("check").agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("sample"))
    names = found.sparkSession.createDataFrame([(name,) for name in checks], "check string")
    return names.join(n, "check", "left").join(least, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"), "sample")


def population_guard(before: DataFrame, after: DataFrame, kind: str = "kind") -> DataFrame:
    """Rows of each kind (kind, before, after); raises PopulationChanged if any kind has not as many as before."""
    count = lambda rows, name: rows.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias(name))
    b, a = count(before, "before").withColumnRenamed("kind", "_kind"), count(after, "after")
    both = b.join(a, F.col("_kind").eqNullSafe(F.col("kind")), "full")
    sizes = both.select(F.coalesce("kind", "_kind").alias("kind"), F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    sizes = scratch.stored(sizes, "populations")
    changed = sizes.where("before <> after").orderBy("kind").limit(20).collect()  # named in the message
    if changed:
        raise PopulationChanged("; ".join(f"{r['kind']}: {r['before']} before, {r['after']} after" for r in changed))
    return sizes


def presence(channels: DataFrame, history: DataFrame, key: str, shown: int = HISTORY) -> DataFrame:
    """Each subject with its channels, confirmed ones first, and its `shown` latest audit events, newest first.

    `channels` is (key, channel, value, state), one row a channel; `history` is (key, ts, event_id, action). Either
    may lack a subject. Older events are left out inside tasks, before the shuffle.
    """
    c = channels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((F.col("state") != "confirmed").alias("later"), "channel", "value", "state"))).alias("channels"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")))
    h = history.withColumn("_k", rank).where(F.col("_k") <= shown).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_k", "event_id", "action"))).alias("history"))
    return c.join(h, key, "full")
