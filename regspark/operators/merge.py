"""Merging snapshots: pure functions from a target and an input to a new target with a change log.

Absent is not deleted: rows that a full snapshot lacks are marked, never dropped. Every merge is
one full outer join on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions.cleaning import fingerprint

#: A full snapshot that lacks more than this share of the live rows is refused.
MAX_MISSING = 0.20

#: Rows of a task where a table is dealt out by its key.
ROWS_A_TASK = 500_000


class TruncatedSnapshot(ValueError):
    """The input lacks so many rows that it is taken for a truncated file."""


def dealt(rows: DataFrame, count: int, key: list[str], most: int | None = None) -> DataFrame:
    """`rows`, of which there are `count`, dealt out by key into parts of about `most` (ROWS_A_TASK) rows: what is
    grouped or joined by the key after that takes no more memory in a task when the table grows."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // (most or ROWS_A_TASK))), *key)


def dedup_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`."""
    other = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*other), order).alias("_s")).select(*key, "_s.*")


def target_of(rows: DataFrame, values: list[str], job: int) -> DataFrame:
    """A first target: fingerprint, first_job, last_job, missing_since."""
    return rows.withColumns({"row_hash": fingerprint(*values), "first_job": F.lit(job), "last_job": F.lit(job), "missing_since": F.lit(None).cast("int")})


def snapshot(target: DataFrame, rows: DataFrame, key: list[str], values: list[str], job: int, full: bool = True, scope: Column | None = None) -> DataFrame:
    """The new target with `status`: inserted, updated, resurrected, unchanged, missing or kept.

    Rows whose fingerprint is unchanged keep their last_job; those missing before come back as
    resurrected. In full mode live rows that the input lacks are marked with the job, within
    `scope` (a condition on the target) only; in partial mode they are kept as they are. `rows`
    has one row a key (see dedup_last).
    """
    new = rows.select(*(F.col(k).alias(f"n_{k}") for k in key), *(F.col(v).alias(f"n_{v}") for v in values), fingerprint(*values).alias("n_hash"))
    on = [F.col(k) == F.col(f"n_{k}") for k in key]
    j = target.join(new, on, "full_outer")
    here, there = F.col("n_hash").isNotNull(), F.col("row_hash").isNotNull()
    in_scope = F.lit(full) if scope is None else F.lit(full) & scope
    status = (
        F.when(here & ~there, "inserted")
        .when(here & F.col("missing_since").isNotNull(), "resurrected")
        .when(here & ~F.col("n_hash").eqNullSafe(F.col("row_hash")), "updated")
        .when(here, "unchanged")
        .when(in_scope & F.col("missing_since").isNull(), "missing")
        .otherwise("kept")
    )
    j = j.withColumn("status", status)
    take = here
    return j.select(
        *(F.coalesce(k, f"n_{k}").alias(k) for k in key),
        *(F.when(take, F.col(f"n_{v}")).otherwise(F.col(v)).alias(v) for v in values),
        F.coalesce("n_hash", "row_hash").alias("row_hash"),
        F.coalesce("first_job", F.lit(job)).alias("first_job"),
        F.when(F.col("status").isin("inserted", "updated", "resurrected"), job).otherwise(F.col("last_job")).alias("last_job"),
        F.when(F.col("status") == "missing", job).when(here, F.lit(None)).otherwise(F.col("missing_since")).cast("int").alias("missing_since"),
        "status",
    )


def counters(merged: DataFrame) -> DataFrame:
    """One row: how many rows had each status."""
    return merged.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("inserted", "updated", "resurrected", "unchanged", "missing", "kept")))


def guard(merged: DataFrame, most: float = MAX_MISSING) -> DataFrame:
    """`merged`, unless too many live rows would become missing: then TruncatedSnapshot."""
    if not (row := missing_share(merged).first())["accepted"]:
        raise TruncatedSnapshot(f"{row['missing']} of {row['live']} live rows are missing; at most {most:.0%} may be")
    return merged


def missing_share(merged: DataFrame, most: float = MAX_MISSING) -> DataFrame:
    live = F.count_if(F.col("status").isin("updated", "unchanged", "missing"))
    missing = F.count_if(F.col("status") == "missing")
    return merged.agg(live.alias("live"), missing.alias("missing"), (missing <= most * live).alias("accepted"))


def header_detail(old_detail: DataFrame, new_detail: DataFrame, header: list[str], account: str, value: str, known: DataFrame | None = None) -> DataFrame:
    """The new detail: headers whose amounts changed are replaced whole, others stay.

    A header's fingerprint covers its amounts, so an account that went to zero disappears with
    the old rows. Unknown accounts are not inserted.
    """
    if known is not None:
        new_detail = new_detail.join(known.select(account), account, "left_semi")
    cells = F.array_sort(F.collect_list(F.struct(F.col(account), F.col(value).cast("string"))))
    marks = lambda d, name: d.groupBy(*header).agg(F.md5(F.to_json(cells).cast("binary")).alias(name))
    changed = marks(new_detail, "new").join(marks(old_detail, "old"), header, "left").where("NOT new <=> old").select(*header)
    kept = old_detail.join(changed, header, "left_anti")
    return kept.unionByName(new_detail.join(changed, header, "left_semi"))


def replace_children(old: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """Children of the parents in `new` are replaced whole; others stay."""
    return old.join(new.select(*parent).distinct(), parent, "left_anti").unionByName(new)


def insert_if_absent(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """`target` with the rows whose key it does not have."""
    return target.unionByName(rows.join(target.select(*key), key, "left_anti"), allowMissingColumns=True)


def members_delta(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key and change: entry (only in new) or exit (only in old)."""
    return new.join(old, key, "left_anti").select(*key, F.lit("entry").alias("change")).unionByName(old.join(new, key, "left_anti").select(*key, F.lit("exit").alias("change")))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by several columns in order."""
    other = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*other), F.struct(*order)).alias("_s")).select(*key, "_s.*")


def propagate_and_clear(holders: DataFrame, rollup: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rolled-up values onto holders; holders without one are cleared; keys that several
    holders share get none. `changed` says whether a holder's values differ from before."""
    single = holders.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key)
    usable = rollup.join(single, key, "left_semi").select(key, *(F.col(v).alias(f"_new_{v}") for v in values))
    j = holders.join(usable, key, "left")
    differs = None
    for v in values:
        d = ~F.col(v).eqNullSafe(F.col(f"_new_{v}"))
        differs = d if differs is None else differs | d
    return j.withColumn("changed", differs).withColumns({v: F.col(f"_new_{v}") for v in values}).drop(*(f"_new_{v}" for v in values))
