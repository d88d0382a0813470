"""Loading rows under rules: what is good, what is rejected and why, and the figures of the run, in one scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from regspark.operators import merge

#: Rejects that are kept for a report; their number is exact all the same.
MOST_REJECTS = 10_000


@dataclass(frozen=True)
class Rule:
    """A defect of a column: rows where `broken` is true are rejected, or only warned about."""

    column: str
    reason: str
    broken: Column
    reject: bool = True


@dataclass(frozen=True)
class Loaded:
    """The rows that passed, the last of each key; rejects and warnings with their reasons; counts."""

    rows: DataFrame
    rejects: DataFrame
    warnings: DataFrame
    metrics: dict[str, int]


def load(rows: DataFrame, rules: list[Rule], key: list[str], order: str, path: str, most_rejects: int = MOST_REJECTS) -> Loaded:
    """Judge `rows` by `rules`, write them by outcome below `path`, and count while they are written.

    A row with several defects is one rejected row and several rows of the report, each with column,
    reason and the row as JSON. A condition that is null breaks no rule. Rows are dealt out by key
    into as many parts as their number takes, so no task's share grows with the table. The report has the first
    `most_rejects` rows by the order column. metrics: read, rejected, warned, duplicates, copied.
    """
    spark = rows.sparkSession

    def found(reject: bool) -> Column:
        some = [F.when(F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.column).alias("column"), F.lit(r.reason).alias("reason"))) for r in rules if r.reject is reject]
        return F.filter(F.array(*some), lambda x: x.isNotNull()) if some else F.array().cast("array<struct<column:string,reason:string>>")

    marked = rows.withColumns({"_errors": found(True), "_warnings": found(False)}).withColumn("_outcome", F.when(F.size("_errors") > 0, "reject").otherwise("good"))
    seen, kept = Observation(), Observation()
    watched = marked.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(F.size("_errors") > 0).alias("rejected"), F.count_if((F.size("_errors") == 0) & (F.size("_warnings") > 0)).alias("warned"))
    watched.write.mode("overwrite").partitionBy("_outcome").parquet(f"{path}/judged")
    judged = spark.read.schema(marked.schema).parquet(f"{path}/judged")
    good = judged.where("_outcome = 'good'")
    dealt = merge.dealt(good.select(*rows.columns), seen.get["read"], key)
    last = merge.dedup_last(dealt, key, order).select(*rows.columns).observe(kept, F.count(F.lit(1)).alias("copied"))
    last.write.mode("overwrite").parquet(f"{path}/rows")
    counts = {k: int(v) for k, v in (seen.get | kept.get).items()}
    metrics = counts | {"duplicates": counts["read"] - counts["rejected"] - counts["copied"]}

    def report(of: DataFrame, defects: str) -> DataFrame:
        return of.select(*key, F.to_json(F.struct(*rows.columns)).alias("raw"), F.explode(defects).alias("e")).select(*key, "e.column", "e.reason", "raw")

    first = judged.where("_outcome = 'reject'").orderBy(order, *key).limit(most_rejects)
    return Loaded(spark.read.schema(last.schema).parquet(f"{path}/rows"), report(first, "_errors"), report(good.where(F.size("_warnings") > 0), "_warnings"), metrics)
