"""Streams over batch code: register files merged as they land, and a log of decisions kept by key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from regspark.operators import decisions as review
from regspark.operators import merge
from regspark.sources import scratch

#: Buckets of a target; a batch rewrites those in which something changed.
BUCKETS = 64
#: Shards of the keys of a log of decisions, each with one state.
SHARDS = 1024


# ---- files into a bucketed target -------------------------------------------------------------


def read_target(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a target with their `bucket`, or None before its first batch."""
    return spark.read.parquet(f"{path}/rows") if scratch.exists(spark, f"{path}/rows/bucket=*") else None


def publish(rows: DataFrame, path: str, key: list[str], values: list[str], order: str, batch: int, source: str = "stream", job: int | None = None, buckets: int = BUCKETS) -> list[int]:
    """Merge one batch into the target at `path` in partial mode; the buckets that were rewritten.

    The batch reads only the buckets of its own keys, and overwrites only those in which a row was
    inserted, updated or resurrected. A marker, written last, makes a replay return at once; a
    batch that broke off before its marker is merged again, and finds in the buckets that it had
    written that nothing changed. The merged rows are staged, so the target is no longer read when
    its buckets are replaced.
    """
    spark = rows.sparkSession
    marker, staged_at = f"{path}/_committed/{source}-{batch}", f"{path}/_staged/{source}-{batch}"
    if scratch.exists(spark, f"{marker}/_SUCCESS"):
        return []
    job = batch + 1 if job is None else job
    place = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    latest = merge.dedup_last(rows.select(*key, *values, order), key, order).select(*key, *values)
    target = read_target(spark, path)
    if target is None:
        target = merge.target_of(latest.limit(0), values, job)
    else:
        touched = [r[0] for r in rows.select(place.alias("bucket")).distinct().collect()]  # at most `buckets` numbers
        target = target.where(F.col("bucket").isin(touched)).drop("bucket")
    merged = merge.snapshot(target, latest, key, values, job, full=False).withColumn("bucket", place)
    merged.write.mode("overwrite").parquet(staged_at)
    staged = spark.read.schema(merged.schema).parquet(staged_at)
    changed = [r[0] for r in staged.where("status NOT IN ('unchanged', 'kept')").select("bucket").distinct().orderBy("bucket").collect()]
    if changed:
        out = staged.where(F.col("bucket").isin(changed)).drop("status").repartition("bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    spark.range(1).write.mode("overwrite").parquet(marker)
    scratch.remove(spark, staged_at)
    return changed


def ingest(stream: DataFrame, path: str, key: list[str], values: list[str], order: str, checkpoint: str, source: str = "stream", first_job: int = 1, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge each micro-batch of new files into the bucketed target at `path`."""

    def step(rows: DataFrame, batch: int) -> None:
        publish(rows, path, key, values, order, batch, source, first_job + batch, buckets)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- decisions by key ---------------------------------------------------------------------------


def deduplicated(stream: DataFrame, event_id: str, time: str, late: str = "1 hour") -> DataFrame:
    """The stream without repeated event ids inside the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([event_id])


_STATE = "settled string, pending string"


def decision_states(stream: DataFrame, key: list[str], time: str, event_id: str, late: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """`key`, live, value, state, note, source, applied: the row of each key that a batch has decisions on.

    `stream` has action, value and note too. Keys fall into shards by hash, and a shard has one
    state, since a call a key costs far more than its few decisions. It has the row of each of its
    keys that the decisions up to the watermark leave, and the later ones by themselves: those are
    applied in order on top of it whenever something comes, so a decision that comes out of order by
    less than `late` counts where it belongs, and repeated ids count once. A timer settles what the
    watermark has passed. Decisions behind the watermark are dropped. `shards` stays the same for as
    long as a checkpoint is used.
    """
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    names = T.StructType([T.StructField(k, kinds[k]) for k in key])
    row_columns = "live boolean, value string, state string, note string, source string, applied long"
    columns = ["_name", "live", "value", "state", "note", "source", "applied"]

    def update(_: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        before, pending = map(json.loads, kept.get) if kept.exists else ({}, {})
        settled = {name: (tuple(row) if row else None, applied) for name, (row, applied) in before.items()}
        waiting = {name: {(t, i): rest for t, i, *rest in some} for name, some in pending.items()}
        arrived, rows = set(), []
        for part in parts:
            for name, t, i, *rest in part[["_name", "_at", event_id, "action", "value", "note"]].itertuples(index=False):
                waiting.setdefault(name, {})[int(t), int(i)] = [x if isinstance(x, str) else None for x in rest]
                arrived.add(name)
        passed = kept.getCurrentWatermarkMs() * 1000
        for name, some in list(waiting.items()):
            now = settled.get(name, (None, 0))
            for at in sorted(some):
                after, outcome = review.apply_one(now[0], *some[at])
                now = after, now[1] + (outcome == "applied")
                if at[0] <= passed:
                    settled[name] = now
                    del some[at]
            if name in arrived:
                rows.append((name, now[0] is not None, *(now[0] or (None,) * 4), now[1]))
            if not some:
                del waiting[name]
        kept.update((json.dumps(settled), json.dumps({name: [[*at, *rest] for at, rest in some.items()] for name, some in waiting.items()})))
        if waiting:
            kept.setTimeoutTimestamp(max(max(some)[0] for some in waiting.values()) // 1000 + 1)
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    timed = timed.select(F.pmod(F.xxhash64(*key), F.lit(shards)).alias("_shard"), F.to_json(F.struct(*key)).alias("_name"), time, F.unix_micros(time).alias("_at"), event_id, "action", "value", "note")
    found = timed.groupBy("_shard").applyInPandasWithState(update, f"_name string, {row_columns}", _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("_key", F.from_json("_name", names)).select("_key.*", *columns[1:])


def keep_decisions(stream: DataFrame, path: str, key: list[str], time: str, event_id: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Run decision_states and add the rows of each batch to the table at `path`, under the batch's
    number: a batch writes only keys that it has decisions on, and a replay overwrites its own part."""

    def step(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    states = decision_states(stream, key, time, event_id, late)
    return states.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_decisions(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The rows that are there after the last batch of each key."""
    last = merge.latest(spark.read.parquet(path), key, ["batch"])
    return last.where("live").select(*key, "value", "state", "note", "source", "applied")


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by window and kind, late ones within the watermark included."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
