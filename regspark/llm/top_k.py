"""Exact search for the largest inner products, in buckets of vectors of like length.

Candidates are ordered by length and packed into buckets. The longest ones give each query a
first threshold: a k-th score that its result reaches at least. Divided by the query's length it
is the length that a candidate needs, so whole buckets of shorter ones are never met, and divided
by a bucket's longest length too it is the cosine that a candidate of the bucket needs. From these
local cosines each bucket chooses, for a block of queries, how to prune: by length (the leading
part of the bucket, ordered by length), or by coordinates (candidates whose unit vectors lie in
the range that the cosine leaves to one coordinate, the narrowest of a few). Products of all that
is left are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regspark.llm.common import dropped, stored
from regspark.llm.vectors import BLOCK_ENTRIES, matrix, scaled, usable

K, SCALE = 5, 256
#: Most rows of a bucket and of a block of queries; wide vectors have fewer, by BLOCK_ENTRIES.
BUCKET_ROWS, QUERY_ROWS = 4_096, 512
#: A bucket ends where the length falls below this share of its longest, from a number of rows on.
LENGTH_SHARE, LEAST_ROWS = 0.9, 256
#: Coordinates that a query looks at, its largest; a product after a look-up costs so many in a row.
FOCUS, LOOKUP_COST = 4, 4
#: Buckets that share one copy of the queries, where there are more buckets than tasks at once.
BUCKETS_PER_PART = 32
#: Whole numbers below it are exact in floating point; the rounding of lengths and cosines.
EXACT, SLACK = 2**53, 1e-9

_BUCKET = "longest double, shortest double, rows int, ids binary, content binary"
_BLOCK = "need double, rows int, ids binary, content binary, floors binary"


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products of rows, exact; those beyond a long are the nearest long."""
    bound = np.linalg.norm(queries.astype(float), axis=1).max(initial=0) * np.linalg.norm(candidates.astype(float), axis=1).max(initial=0)
    if bound * (1 + SLACK) < EXACT:
        return (queries.astype(float) @ candidates.astype(float).T).astype(np.int64)
    exact = queries.astype(object) @ candidates.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _rows(most: int, dims: int) -> int:
    return max(1, min(most, BLOCK_ENTRIES // max(1, dims)))


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(float) ** 2).sum(axis=1))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k first by score, then by id."""
    among = np.arange(len(score))
    if len(score) > 4 * k:
        among = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    by_id = among[np.argsort(ids[among], kind="stable")]
    return by_id[np.argsort(~score[by_id], kind="stable")][:k]  # ~score falls as score rises, and no long overflows


def ranges(q: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a coordinate of a unit vector is if its cosine to a unit vector with the coordinate
    `q` is `cosine` at least: the ends of the range."""
    c = np.clip(cosine, -1, 1)
    wide = np.sqrt(np.maximum(0, (1 - c * c) * (1 - q * q)))
    low, high = q * c - wide, q * c + wide
    return np.where(q <= -c, -1.0, low) - SLACK, np.where(q >= c, 1.0, high) + SLACK


class Bucket:
    """Candidates in falling order of length, with sorted coordinates made when first looked at."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x, self.lengths = ids, x, _lengths(x)
        self.unit = x.astype(float) / np.maximum(self.lengths, 1e-300)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = order, self.unit[order, f]
        return self.sorted[f]

    def search(self, ids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int = K) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its number, candidates and scores: the k first of the bucket whose score is its floor at least."""
        lengths = _lengths(q)
        need = np.maximum(floors, 0) / np.maximum(lengths, 1e-300)  # of a candidate's length
        open_ = np.flatnonzero(need <= self.lengths[0] * (1 + SLACK))
        if not len(open_):
            return
        # Length pruning leaves a leading part of the bucket; coordinate pruning the narrowest range of a few coordinates.
        leading = np.searchsorted(-self.lengths, -need[open_] * (1 - SLACK), side="right")
        cosine = np.where(floors[open_] > 0, need[open_] / self.lengths[0] * (1 - SLACK), -1.0) if self.lengths[0] else np.full(len(open_), -1.0)
        unit = q[open_].astype(float) / np.maximum(lengths[open_], 1e-300)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        begin, end, coordinate = np.zeros(len(open_), dtype=int), np.full(len(open_), len(self.ids)), np.full(len(open_), -1)
        usable_ = cosine > 0
        for f in np.unique(focus[usable_]).tolist():
            rows = np.flatnonzero(usable_ & (focus == f).any(axis=1))
            low, high = ranges(unit[rows, f], cosine[rows])
            values = self.by_coordinate(f)[1]
            a, b = np.searchsorted(values, low, side="left"), np.searchsorted(values, high, side="right")
            better = b - a < end[rows] - begin[rows]
            begin[rows[better]], end[rows[better]], coordinate[rows[better]] = a[better], b[better], f
        if LOOKUP_COST * (end - begin).sum() < leading.sum():  # the bucket's choice
            for i, row in enumerate(open_.tolist()):
                among = np.arange(leading[i]) if coordinate[i] < 0 else self.by_coordinate(int(coordinate[i]))[0][begin[i] : end[i]]
                yield from self._kept(row, ids, products(q[row : row + 1], self.x[among])[0], among, floors, k)
        else:
            longest = int(leading.max())
            scores = products(q[open_], self.x[:longest])
            for i, row in enumerate(open_.tolist()):
                yield from self._kept(row, ids, scores[i, : leading[i]], np.arange(leading[i]), floors, k)

    def _kept(self, row: int, ids: np.ndarray, score: np.ndarray, among: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        keep = np.flatnonzero((score >= floors[row]) & (self.ids[among] != ids[row]))
        if len(keep):
            keep = keep[_best(score[keep], self.ids[among[keep]], k)]
            yield row, self.ids[among[keep]], score[keep]


def _pack_buckets(dims: int):
    """Rows (id, x), longest first in each task, as rows of whole buckets."""
    most = _rows(BUCKET_ROWS, dims)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.zeros(0, dtype=np.int64), np.zeros((0, dims), dtype=np.int64)

        def out(n: int) -> pa.RecordBatch:
            length = _lengths(x[:n])
            return pa.RecordBatch.from_arrays([pa.array([length[0]]), pa.array([length[-1]]), pa.array([n], pa.int32()), pa.array([ids[:n].tobytes()], pa.binary()), pa.array([x[:n].tobytes()], pa.binary())], names=["longest", "shortest", "rows", "ids", "content"])

        for batch in batches:
            ids, x = np.concatenate([ids, batch.column(0).to_numpy()]), np.vstack([x, matrix(batch.column(1), dims)])
            while len(ids) > most:
                length = _lengths(x[:most])
                n = max(min(most, LEAST_ROWS), int((length >= LENGTH_SHARE * length[0]).sum()))
                yield out(n)
                ids, x = ids[n:], x[n:]
        while len(ids):
            length = _lengths(x[:most])
            n = min(len(ids), max(min(most, LEAST_ROWS), int((length >= LENGTH_SHARE * length[0]).sum())))
            yield out(n)
            ids, x = ids[n:], x[n:]

    return packed


def _floors(dims: int, head: Bucket | None, k: int):
    """Rows (id, x) with the k-th score among the longest candidates, or the least long where there are fewer, and the length that a candidate needs."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), matrix(batch.column(1), dims)
            floors = np.full(len(ids), -(2**63), dtype=np.int64)
            for at in range(0, len(ids) if head else 0, QUERY_ROWS):
                part = slice(at, at + QUERY_ROWS)
                for i, score in enumerate(products(q[part], head.x)):
                    others = score[head.ids != ids[at + i]]
                    if len(others) >= k:
                        floors[at + i] = np.partition(others, len(others) - k)[len(others) - k]
            need = np.maximum(floors, 0) / np.maximum(_lengths(q), 1e-300)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floors), pa.array(need)], names=["id", "x", "floor", "need"])

    return judged


def _pack_queries(dims: int):
    most = _rows(QUERY_ROWS, dims)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, q, floors, need = batch.column(0).to_numpy(), matrix(batch.column(1), dims), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for at in range(0, len(ids), most):
                p = slice(at, at + most)
                yield pa.RecordBatch.from_arrays([pa.array([need[p].min()]), pa.array([len(ids[p])], pa.int32()), pa.array([ids[p].tobytes()], pa.binary()), pa.array([q[p].tobytes()], pa.binary()), pa.array([floors[p].tobytes()], pa.binary())], names=["need", "rows", "ids", "content", "floors"])

    return packed


def _search(dims: int, k: int):
    """Pairs of a bucket and a block of queries to (query_id, vec_id, score)."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bucket = None, None
        for batch in batches:
            for ids, content, q_ids, q_content, floors in zip(*(batch.column(c) for c in range(5))):
                raw = ids.as_buffer()
                if key is None or not key.equals(raw):  # pairs of one bucket come one after the other
                    key, own = raw, np.frombuffer(raw, dtype=np.int64)
                    bucket = Bucket(own, np.frombuffer(content.as_buffer(), dtype=np.int64).reshape(len(own), dims))
                asked = np.frombuffer(q_ids.as_buffer(), dtype=np.int64)
                q = np.frombuffer(q_content.as_buffer(), dtype=np.int64).reshape(len(asked), dims)
                found = list(bucket.search(asked, q, np.frombuffer(floors.as_buffer(), dtype=np.int64), k))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(v), asked[r]) for r, v, _ in found])), pa.array(np.concatenate([v for _, v, _ in found])), pa.array(np.concatenate([s for *_, s in found]))], names=["query_id", "vec_id", "score"])

    return searched


def search(queries: DataFrame, candidates: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of largest inner product.

    Components are multiplied by SCALE and rounded down; scores are whole numbers, ties go to the
    smaller id, and rank counts from 1. A candidate of the query's own id is left out. Rows whose
    id is null, or whose vector is null or holds null, NaN or infinite components, take no part;
    rows equal in id and vector are one. Shorter vectors end in zeros, so an empty one scores 0.
    Queries with fewer than k candidates get all of them, those without any have no row. Further
    columns are not looked at.

    A query's work is a pass over the buckets that its threshold leaves, in blocks; nothing but the
    longest few thousand candidates, a fixed number, reaches the driver.
    """
    spark = candidates.sparkSession
    x = scaled(F.col(vector_col), SCALE)

    def made(rows: DataFrame) -> DataFrame:
        used = rows.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
        return used.distinct().withColumn("length", F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"), F.sqrt))

    all_, asked = stored(made(candidates)), stored(made(queries))
    dims = max(t.agg(F.max(F.size("x"))).first()[0] or 0 for t in (all_, asked))
    longest = all_.orderBy(F.desc("length"), "id").limit(_rows(BUCKET_ROWS, dims)).select("id", "x").toArrow()
    head = Bucket(longest.column("id").combine_chunks().to_numpy(), matrix(longest.column("x").combine_chunks(), dims)) if longest.num_rows else None

    # By id within a length too, so that equal lengths are spread over tasks.
    buckets = stored(all_.repartitionByRange(F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id").select("id", "x").mapInArrow(_pack_buckets(dims), _BUCKET))
    judged = asked.select("id", "x").mapInArrow(_floors(dims, head, k), "id long, x array<long>, floor long, need double")
    blocks = stored(judged.repartitionByRange("need", "id").sortWithinPartitions("need", "id").mapInArrow(_pack_queries(dims), _BLOCK))

    n = buckets.count()
    parts = max(1, min(n, spark.sparkContext.defaultParallelism), n // BUCKETS_PER_PART)
    placed = buckets.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    sent = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "need", F.col("ids").alias("q_ids"), F.col("content").alias("q_content"), "floors")
    pairs = placed.join(sent, "part").where(F.col("need") <= F.col("longest") * (1 + SLACK))
    found = pairs.select("ids", "content", "q_ids", "q_content", "floors").mapInArrow(_search(dims, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = stored(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    dropped(all_, asked, buckets, blocks)
    return best


def oracle_sql(query_every: int, k: int = K) -> str:
    """DuckDB SQL: every query against every other row."""
    return f"""WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor({SCALE} * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id) AS INTEGER) AS rank, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {query_every} = 0 QUALIFY rank <= {k}"""
