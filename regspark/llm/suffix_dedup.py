"""Removal of byte strings that occur more than once, by suffix and longest-previous-factor arrays.

Every string of LENGTH bytes holds an anchor: the byte string of KGRAM bytes in it whose hash is
least. All windows of LENGTH bytes with one anchor form a run, and equal windows have equal
anchors, so runs are compared only with runs of the same anchor:

1. Runs that are equal as a whole are found by counting their hashes, which needs no text.
2. Runs that share an anchor but differ are compared by content: the bytes of one copy of each
   go to the anchor's task, which sorts their suffixes and takes longest previous factors. A
   position whose factor has LENGTH bytes is a repeat, and so is the earlier position it names.
3. Where an anchor has more different runs than a task should hold, the windows themselves are
   counted by hash in Spark, blocks of windows first, so that no task gathers the anchor.

Texts equal as a whole are looked at once. They are told apart by two 64-bit hashes; a run is
named by its own hash and its anchor's, and windows are compared within one anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import durable, stored

LENGTH, KGRAM = 400, 128
#: An anchor with more different runs than this is resolved by counting instead of in one task.
TASK_RUNS = 256
#: Bytes of which suffixes are sorted together, and windows of a block when counting.
SORT_BYTES, BLOCK = 400_000, 16

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, dtype=np.uint64))])


class Hashed:
    """Hashes of any part of a byte string, from one pass over it."""

    def __init__(self, raw: bytes):
        self.n = len(raw)
        top = max(1 << 14, 1 << self.n.bit_length())
        self.inverse = _powers(_BASE_INVERSE, top)
        with np.errstate(over="ignore"):
            values = _BYTE_VALUES[np.frombuffer(raw, dtype=np.uint8)] * _powers(_BASE, top)[: self.n]
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])

    def parts(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return x ^ (x >> np.uint64(32))


def runs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, run hash, first window, windows) of each run of windows with one anchor."""
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none
    h = Hashed(raw)
    at = np.arange(len(raw) - KGRAM + 1)
    grams = h.parts(at, at + KGRAM)
    key = (grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    w = LENGTH - KGRAM + 1
    blocks = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(raw) - LENGTH + 1
    anchor = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    width = np.diff(np.append(first, n))
    with np.errstate(over="ignore"):
        run = h.parts(first, first + width - 1 + LENGTH) + (anchor[first] - first).astype(np.uint64) * np.uint64(_BASE)
    return grams[anchor[first]].view(np.int64), run.view(np.int64), first, width


def suffix_order(data: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of `data` (integers from 1) in order of their first 512 values, by prefix
    doubling, and their ranks by the first 8, 16, ... 256 values."""
    n = len(data)
    rank, size, ranks = np.unique(data, return_inverse=True)[1].astype(np.int64) + 1, 1, []
    while True:
        key = rank << 32
        key[:-size] |= rank[size:] if size < n else 0
        order = np.argsort(key, kind="stable")
        size *= 2
        if size >= 512 or size >= 2 * n:
            return order, ranks
        k = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (k[1:] != k[:-1]).astype(np.int64)]))
        if size >= 8:
            ranks.append(rank)


def common_prefix(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many values the suffixes at i and j have in common at least, to a multiple of 8 below 512."""
    total = np.zeros(len(i), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        n, size = len(ranks[k]), 8 << k
        x, y = i + total, j + total
        inside = (x < n) & (y < n)
        equal = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        total += equal * size
    return total


def previous_factors(data: np.ndarray, least: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(position, source): each position whose longest previous factor has `least` values or
    more, with the earlier position of that factor.

    The previous and the next smaller position in suffix order are the candidates; runs of the
    order within which neighbours share `least` values are looked at, as no factor of that
    length leaves its run. `least` is a multiple of 8 up to 504.
    """
    order, ranks = suffix_order(data)
    near = common_prefix(ranks, order[:-1], order[1:])
    inside = np.flatnonzero(near >= least)
    found, source = [], []
    stack: list[tuple[int, int]] = []  # positions in suffix order, with the least common prefix since the one below
    positions, shared = order.tolist(), near.tolist()
    for run in np.split(inside, np.flatnonzero(np.diff(inside) > 1) + 1) if len(inside) else []:
        stack = []
        for k in range(int(run[0]), int(run[-1]) + 2):
            here = positions[k]
            common = shared[k - 1] if stack else 0
            while stack and stack[-1][0] > here:  # `here` is the next smaller position
                later, before = stack.pop()
                if before < least:
                    found.append(later)
                    source.append(here)
                common = min(common, before) if stack else 0
            if stack:  # the top of the stack is the previous smaller position
                found.append(here)
                source.append(stack[-1][0])
            stack.append((here, common if stack else 0))
    return np.array(found, dtype=np.int64), np.array(source, dtype=np.int64)


def repeated_windows(parts: list[bytes]) -> list[np.ndarray]:
    """For each byte string, which of its windows of LENGTH bytes occur anywhere else in them."""
    stop = np.array([256 + 1 + k for k in range(len(parts))])  # separators, all different
    data = np.concatenate([x for k, p in enumerate(parts) for x in (np.frombuffer(p, dtype=np.uint8).astype(np.int64) + 1, stop[k : k + 1])])
    marks = np.zeros(len(data), dtype=bool)
    for at in previous_factors(data):
        marks[at] = True
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return [marks[starts[k] : starts[k] + max(0, len(p) - LENGTH + 1)] for k, p in enumerate(parts)]


def spans(marks: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of set marks."""
    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def _all_runs(rows: DataFrame) -> DataFrame:
    """(anchor, run, node, starts, width) of the texts of rows (node, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies give the same rows, so those met lately are passed over
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                out: list[tuple] = []
                for node, raw in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    if node in seen:
                        continue
                    seen.add(node)
                    found: dict[tuple, list[int]] = {}
                    for a, r, first, width in zip(*(x.tolist() for x in runs(raw))):
                        found.setdefault((a, r, width), []).append(first)
                    out += [(a, r, node, starts, width) for (a, r, width), starts in found.items()]
                columns = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32()))], names=["anchor", "run", "node", "starts", "width"])
            if len(seen) > 200_000:
                seen.clear()

    return rows.select("node", "raw").mapInArrow(run, "anchor long, run long, node long, starts array<int>, width int")


def _sorted_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, run, first, last): repeated windows of (anchor, run, content), sorted by anchor."""
    held: list[tuple[int, int, bytes]] = []
    size, seen = 0, set()

    def resolve() -> pa.RecordBatch:
        out = [(a, r, first, last) for (a, r, _), marks in zip(held, repeated_windows([c for _, _, c in held])) for first, last in spans(marks)] if held else []
        columns = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["anchor", "run", "first", "last"])

    for batch in batches:
        for a, r, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if held and a != held[-1][0] and size >= SORT_BYTES:
                yield resolve()
                held, size, seen = [], 0, set()
            if (a, r) not in seen:
                seen.add((a, r))
                held.append((a, r, content))
                size += len(content)
    yield resolve()


def _counted(contents: DataFrame) -> DataFrame:
    """(anchor, run, first, last) for anchors with many runs, without gathering an anchor.

    Windows are told apart by how far before the anchor they start, and their hash. All windows
    of a block (BLOCK neighbouring distances) hold the same middle part; only blocks whose
    middle part two runs share can hold a repeat. Of blocks that are equal as a whole one
    stands for all; its windows, and those of the blocks that are like no other, are counted.
    """

    def middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, r, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                h = Hashed(content)
                lead = _lead(h, a)
                block = np.arange((lead - (h.n - LENGTH)) // BLOCK, lead // BLOCK + 1)
                first, last = lead - BLOCK * block - BLOCK + 1, lead - BLOCK * block
                inside = (first >= 0) & (last + LENGTH <= h.n)
                whole = np.zeros(len(block), dtype=np.int64)
                whole[inside] = h.parts(first[inside], last[inside] + LENGTH).view(np.int64)
                out += zip([a] * len(block), [r] * len(block), block.tolist(), first.tolist(), h.parts(last, first + LENGTH).view(np.int64).tolist(), whole.tolist(), inside.tolist())
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()))], names=["anchor", "run", "block", "first", "middle", "whole", "inside"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, r, content, wanted in zip(*(batch.column(k).to_pylist() for k in range(4))):
                h = Hashed(content)
                lead, start = _lead(h, a), np.arange(h.n - LENGTH + 1)
                start = start[np.isin((lead - start) // BLOCK, wanted)]
                out += zip([a] * len(start), [r] * len(start), start.tolist(), (lead - start).tolist(), h.parts(start, start + LENGTH).view(np.int64).tolist())
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["anchor", "run", "first", "lead", "hash"])

    blocks = durable(contents.mapInArrow(middles, "anchor long, run long, block int, first int, middle long, whole long, inside boolean"))
    shared = blocks.groupBy("anchor", "block", "middle").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    open_ = blocks.join(shared, ["anchor", "block", "middle"], "left_semi")
    equal = open_.where("inside").groupBy("anchor", "block", "whole").agg(F.count("*").alias("n"), F.min("run").alias("stands")).where("n > 1").drop("n")
    judged = durable(open_.join(equal.withColumn("inside", F.lit(True)), ["anchor", "block", "whole", "inside"], "left"))
    full = judged.where("stands IS NOT NULL").select("anchor", "run", "first", (F.col("first") + BLOCK - 1).alias("last"))
    wanted = judged.where("stands IS NULL OR stands = run").groupBy("anchor", "run").agg(F.collect_list("block").alias("wanted"))
    single = contents.join(wanted, ["anchor", "run"]).select("anchor", "run", "content", "wanted").mapInArrow(windows, "anchor long, run long, first int, lead int, hash long")
    again = single.groupBy("anchor", "lead", "hash").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return full.unionByName(single.join(again, ["anchor", "lead", "hash"], "left_semi").select("anchor", "run", "first", F.col("first").alias("last")))


def _lead(h: Hashed, anchor: int) -> int:
    """Where the first occurrence of the anchor is in a run's content."""
    at = np.arange(h.n - KGRAM + 1)
    return int(np.flatnonzero(h.parts(at, at + KGRAM).view(np.int64) == anchor)[0])


def _repeats(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, first, last): repeated windows in the distinct texts of rows (id, node, raw).

    `heads` (node, id) names one row of each text, whose contents stand for all of its copies.
    """
    every = durable(_all_runs(rows.where(F.octet_length("raw") >= LENGTH)).groupBy("anchor", "run", "node").agg(F.max("starts").alias("starts"), F.max("width").alias("width")))
    by_run = every.groupBy("anchor", "run").agg(F.sum(F.size("starts")).alias("n"), F.min(F.struct("node", F.col("starts")[0].alias("start"), "width")).alias("one"))
    by_anchor = by_run.groupBy("anchor").agg(F.count("*").alias("n_runs"))
    chosen = durable(by_run.join(by_anchor, "anchor").where("n > 1 OR n_runs > 1"))
    whole = every.join(chosen.where("n > 1").select("anchor", "run"), ["anchor", "run"], "left_semi").select("node", F.explode("starts").alias("first"), F.col("width"))
    whole = whole.select("node", "first", (F.col("first") + F.col("width") - 1).alias("last"))

    compared = chosen.where("n_runs > 1").select("anchor", "run", "n", "n_runs", F.col("one.node").alias("node"), F.col("one.start").alias("start"), F.col("one.width").alias("width"))
    by_node = compared.groupBy("node").agg(F.collect_list(F.struct("anchor", "run", "n_runs", "start", "width")).alias("asked"))
    cut = F.substring("raw", F.col("r.start") + 1, F.col("r.width") + LENGTH - 1)
    asked = by_node.join(heads, "node").select(F.col("node").alias("_node"), F.col("id").alias("_id"), "asked")
    # By id too, so that the copies of one text go to many tasks and all but one row meet nothing.
    contents = rows.join(asked, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id"))).select(F.col("raw"), F.explode("asked").alias("r")).select("r.anchor", "r.run", "r.n_runs", cut.alias("content"))
    contents = durable(contents)
    few = contents.where(F.col("n_runs") <= TASK_RUNS).select("anchor", "run", "content").repartition("anchor").sortWithinPartitions("anchor", "run")
    found = few.mapInArrow(_sorted_task, "anchor long, run long, first int, last int")
    many = contents.where(F.col("n_runs") > TASK_RUNS).select("anchor", "run", "content")
    if not many.isEmpty():
        found = found.unionByName(_counted(many.dropDuplicates(["anchor", "run"])))
    parts = compared.where("n = 1").join(found, ["anchor", "run"]).select("node", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    return whole.unionByName(parts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept") -> DataFrame:
    """The id, n_bytes, n_removed, n_spans (long) and the bytes that are left, for every row.

    A byte goes if a string of LENGTH bytes over it also starts anywhere else in the table, in
    the same text or another; overlaps count, all copies go, and strings are judged on the
    input. Null texts are empty; texts shorter than LENGTH stay whole. Rows with one text are
    copies of each other, whatever their ids, which may be null or repeat. What is left is
    binary, since a cut may fall inside a character. An empty table gives no rows; columns
    besides the id and the text, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    rows = rows.withColumns({"node": F.xxhash64("raw"), "second": F.xxhash64(F.lit(1), "raw")})
    clash = rows.groupBy("node").agg(F.min("second").alias("least"), F.max("second").alias("most")).where("least < most").select("node", "least")
    clash = stored(clash)
    if not clash.isEmpty():  # different texts with one hash: a few in a trillion; all but one get another
        rows = rows.join(clash, "node", "left").withColumn("node", F.when(F.col("second") > F.col("least"), F.xxhash64("node", "second")).otherwise(F.col("node"))).drop("least")
    rows = rows.drop("second")
    folded = stored(rows.where(F.octet_length("raw") >= LENGTH).groupBy("node").agg(F.count("*").alias("n"), F.max(F.octet_length("raw")).alias("size"), F.min("id").alias("id")))
    copies = folded.where("n > 1")
    marked = _repeats(rows, folded.select("node", "id")).unionByName(copies.select("node", F.lit(0).alias("first"), (F.col("size") - LENGTH).alias("last")))
    marks = marked.groupBy("node").agg(F.collect_set(F.struct("first", "last")).alias("marks"))
    joined = rows.join(marks, "node", "left").select("id", "raw", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, count, left = [], [], [], []
            for raw, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                gone: list[list[int]] = []
                for first, last in sorted((x["first"], x["last"] + LENGTH) for x in found or ()):
                    if gone and first <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], last)
                    else:
                        gone.append([first, last])
                edges = [0, *(x for g in gone for x in g), len(raw)]
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in gone))
                count.append(len(gone))
                left.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, count)), pa.array(left, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "left"])

    out = joined.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, left binary")
    return out.withColumnsRenamed({"id": id_col, "left": kept_col})
