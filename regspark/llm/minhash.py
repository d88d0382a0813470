"""Near-duplicate detection by order MinHash.

A text is the sequence of its five-word k-mers, each labelled with its occurrence number. A
sketch takes the two k-mers that come first under a seeded hash and keeps them in the order of
the text, so that two texts agree on it only if they share those k-mers in that order, which
follows edit similarity. Texts that agree on one of several sketches are candidates; a banded
alignment of their words decides. Short texts have sketches of single words besides, since one
edit may change all of their k-mers.

Exact copies are folded into one representative first. In a group of candidates everybody is
aligned with the group's leader, so that most families are known and a group of thousands of
near copies gives thousands of pairs and not millions. Then every two texts of a group that are
not known to be of one family are candidates, whatever the group's size; of these only pairs
whose words rule a link out are left out. Links become classes by label propagation in
DataFrame joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import dropped, fresh, stored

KMER = 5
#: Sketches of a text, and the k-mers in each.
SKETCHES, SKETCH_KMERS = 60, 2
#: Texts of at most so many words have further sketches, of so many single words each.
SHORT_WORDS, SHORT_SKETCHES, SHORT_KMERS = 128, 8, 3
#: Least similarity: one less the edits over the words of the longer text.
MIN_SIMILARITY = 0.8
#: One group in so many is looked at first, so that most families are known before the rest.
FIRST_SHARE = 15
#: Words, each with its occurrence number, are put into so many classes by hash, which stand for them where open pairs are looked for.
WORD_CLASSES = 1 << 20
#: So many word classes, those that most texts look by, each have a bit; a pair with some of them in common is made at one.
MARKED, MASK_BITS = 1512, 63
#: Masks of a text's groups.
GROUP_MASKS = 6
#: Texts that meet at least so many rows at marked classes carry all their classes as bits: one each for so many most frequent ones, and so many by hash for the rest.
BUSY, FREQUENT_BITS, OTHER_BITS = 50, 1024, 2048
#: Tables are broadcast to pairs only if they come to at most so many bytes (a character counts as one), since the driver holds what is broadcast several times over.
BROADCAST_SIZE = 6_000_000
#: Rows by which the band of an alignment moves on.
STEP = 64
#: Characters of texts that are hashed at once, unless one text is longer.
CHUNK_CHARS = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_CHAIN = np.uint64(0x100000001B3)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(first: int, n: int) -> np.ndarray:
    return np.arange(first, first + n, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of the texts, in order: a 64-bit hash of its bytes, and the number of its text."""
    encoded = [t.encode() for t in texts]
    raw = np.frombuffer(b" ".join([*encoded, b""]), dtype=np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(raw)]])))
    factors = _mix(_numbers(1, int((ends - starts).max())) * _ODD) | np.uint64(1)
    value = np.where(gap, np.uint8(0), raw).astype(np.uint64)
    value *= factors[np.minimum(place, len(factors) - 1)]
    hashes = _mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * _ODD)
    return hashes, np.searchsorted(np.cumsum([len(e) + 1 for e in encoded]), starts, side="right")


def _occurrences(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The values with the number of earlier equal ones in the same text mixed in."""
    key = _mix(values + of.astype(np.uint64) * _ODD)
    order = np.argsort(key, kind="stable")
    place = np.arange(len(key))
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])[: len(key)]
    nth = np.empty(len(key), dtype=np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return _mix(values + nth * _ODD)


def kmers(words: np.ndarray, of: np.ndarray, k: int = KMER) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the occurrence-labelled k-mers of texts, of which `words` and `of` are word_hashes()."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = _mix(h * _CHAIN + words[i : i + n])
    inside = of[:n] == of[k - 1 :]
    return _occurrences(h[inside], of[:n][inside]), of[:n][inside]


def sketches(labelled: np.ndarray, of: np.ndarray, count: int = SKETCHES, take: int = SKETCH_KMERS, first: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(text, sketches): the texts that have k-mers, and `count` rows of hashes, one column a text.

    Each sketch has a number, from `first`, that seeds its hash. The least k-mers of a text are
    taken one by one; a value's last bits are its place, so equal hashes are settled by order.
    """
    if not len(labelled):
        return np.zeros(0, dtype=np.int64), np.zeros((count, 0), dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    n = len(labelled)
    mask = np.uint64((1 << n.bit_length()) - 1)
    place, padded = _numbers(0, n), np.append(labelled, np.uint64(0))
    numbers = _numbers(first, count)
    seeds, factors = _mix(numbers * _ODD), _ODD + np.uint64(2) * numbers
    out = np.empty((count, len(starts)), dtype=np.uint64)
    for s in range(count):
        value = (labelled ^ seeds[s]) * factors[s]
        value ^= value >> np.uint64(32)
        value = (value & ~mask) | place
        chosen = np.empty((take, len(starts)), dtype=np.int64)
        for k in range(take):
            least = np.minimum.reduceat(value, starts)
            chosen[k] = np.where(least == _LAST, n, least & mask)
            value[chosen[k][least != _LAST]] = _LAST
        h = np.full(len(starts), numbers[s])
        for at in np.sort(chosen, axis=0):
            h = _mix(h * _CHAIN + padded[at])
        out[s] = h
    return of[starts], out.view(np.int64)


def sketch_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, sketch) pairs of the texts as two arrays, and the number of words of every text."""
    words, of = word_hashes(texts)
    sizes = np.bincount(of, minlength=len(texts))
    short = sizes[of] <= SHORT_WORDS if len(of) else np.zeros(0, dtype=bool)
    parts = [sketches(*kmers(words, of)), sketches(*kmers(words[short], of[short], 1), SHORT_SKETCHES, SHORT_KMERS, SKETCHES + 1)]
    return np.concatenate([np.repeat(ids, len(rows)) for ids, rows in parts]), np.concatenate([rows.T.ravel() for _, rows in parts]), sizes


def _chunks(texts: list[str]) -> Iterator[slice]:
    """Consecutive parts of a list of texts, each of about CHUNK_CHARS characters."""
    first = chars = 0
    for k, text in enumerate(texts):
        if chars and chars + len(text) > CHUNK_CHARS:
            yield slice(first, k)
            first, chars = k, 0
        chars += len(text)
    if first < len(texts):
        yield slice(first, len(texts))


def most_edits(n: int, m: int, least: float = MIN_SIMILARITY) -> int:
    """Edits at which texts of n and m words are still similar."""
    return int((1 - least) * max(n, m) + 1e-9)


def similar(a: str, b: str, least: float = MIN_SIMILARITY) -> bool:
    """Whether the words of two texts can be aligned with at most (1 - least) edits a word."""
    words, of = word_hashes([a, b])
    return aligned(words[of == 0], words[of == 1], least)


def aligned(x: np.ndarray, y: np.ndarray, least: float = MIN_SIMILARITY) -> bool:
    """similar() for texts given by their words' hashes.

    The columns of the distance table are held as the bits of its row differences, within a band
    of as many diagonals either side as edits are allowed. Word bags are compared first, and
    common words at both ends are passed over.
    """
    most = most_edits(len(x), len(y), least)
    if abs(len(x) - len(y)) > most:
        return False
    names, number = np.unique(np.concatenate([x, y]), return_inverse=True)
    p, q = number[: len(x)], number[len(x) :]
    bags = np.bincount(p, minlength=len(names)) - np.bincount(q, minlength=len(names))
    if len(bags) and max(bags[bags > 0].sum(), -bags[bags < 0].sum()) > most:
        return False
    n = min(len(p), len(q))
    differ = np.flatnonzero(p[:n] != q[:n])
    head = int(differ[0]) if len(differ) else n
    p, q = p[head:], q[head:]
    n = min(len(p), len(q))
    differ = np.flatnonzero(p[len(p) - n :][::-1] != q[len(q) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    return _edits_within(p[: len(p) - tail], q[: len(q) - tail], most)


def _edits_within(p: np.ndarray, q: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two sequences, whose lengths differ by at most `most`, is at most `most`."""
    n, m = len(p), len(q)
    if not n or not m:
        return max(n, m) <= most
    places: dict[int, int] = {}
    for i, w in enumerate(p.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    # Rows low + 1 to high of a column of the distance table: bits of up where a row is one more than the one before, of down where one less; `top` is row low.
    low = high = top = up = down = inside = 0
    for j, w in enumerate(q.tolist()):
        if j % STEP == 0:  # the band goes down the table, some rows at a time
            gone = max(0, j - most) - low
            rows = (1 << gone) - 1
            top += (up & rows).bit_count() - (down & rows).bit_count()
            up, down, low = up >> gone, down >> gone, low + gone
            more = min(n, j + STEP + most) - high
            up |= ((1 << more) - 1) << (high - low)
            high += more
            inside = (1 << (high - low)) - 1
        equal = (places.get(w, 0) >> low) & inside
        level = (((equal & up) + up) ^ up) | equal
        right_up, right_down = down | (~(level | up) & inside), up & level
        right_up, right_down = right_up << 1 | 1, right_down << 1
        kept = equal | down
        up, down = (right_down | ~(kept | right_up)) & inside, right_up & kept & inside
        top += 1
    return top + up.bit_count() - down.bit_count() <= most


def _sketched(rows: DataFrame) -> DataFrame:
    """(sketch, node, n) for rows (node, text): the sketches of each text and its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies give the same rows, so those met lately are passed over
        for batch in batches:
            nodes, texts = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    texts.append(text)
            if len(seen) > 200_000:
                seen.clear()
            for part in _chunks(texts):
                of, found, sizes = sketch_texts(texts[part])
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.array(nodes[part], dtype=np.int64)[of]), pa.array(sizes[of], pa.int32())], names=["sketch", "node", "n"])

    return rows.select("node", "text").mapInArrow(run, "sketch long, node long, n int")


def _most(n: str, m: str) -> Column:
    """Edits at which texts of n and m words are still similar."""
    return F.expr(f"CAST({1 - MIN_SIMILARITY:.6f}D * greatest({n}, {m}) + 1e-6D AS INT)")


def _close(n: str, m: str) -> Column:
    """Whether texts of so many words may be similar."""
    return F.abs(F.col(n) - F.col(m)) <= _most(n, m)


def _paired(pairs: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """`pairs` (a, b) with the columns of `table` (node, ...) for either side; `size` tells how many bytes the table has."""
    near = F.broadcast if size <= BROADCAST_SIZE else (lambda df: df)
    for side in "ab":
        pairs = pairs.join(near(table.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in table.columns if c != "node"))), side)
    return pairs


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of `pairs` (a, b) with `ok`: whether the texts can be aligned."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return _paired(pairs, texts.select("node", "text"), chars).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, ok boolean")


def _with_labels(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (sketch, node, n) with the family that each is known to belong to."""
    if labels is None:
        return members.withColumn("label", F.col("node"))
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _led_pairs(known: DataFrame) -> DataFrame:
    """(a, b): the members of each group with its leader, where they are not known to be of one family.

    The leader is the least node, which is a hash: mostly the same one in all groups of a family.
    """
    led = known.groupBy("sketch").agg((F.min("label") != F.max("label")).alias("mixed"), F.min(F.struct("node", "n", "label")).alias("lead")).where("mixed")
    met = known.join(led.select("sketch", "lead"), "sketch").where((F.col("label") != F.col("lead.label")) & _close("n", "lead.n"))
    return met.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def _word_classes(words: np.ndarray) -> np.ndarray:
    """The distinct classes of a text's words, each with the number of its earlier occurrences."""
    return np.unique(_occurrences(words, np.zeros(len(words), dtype=np.int64)) % np.uint64(WORD_CLASSES)).astype(np.int64)


def _first_classes(words: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The rarest word classes of a text, one more than the words it may lose to a similar one."""
    classes = _word_classes(words)
    return classes[np.lexsort((classes, often[classes]))][: most_edits(len(words), 0) + 1]


def _class_bits(classes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """A text's classes as bits in 64-bit integers. `frequent`: sorted classes that have a bit each; others share one by hash."""
    at = np.minimum(np.searchsorted(frequent, classes), max(0, len(frequent) - 1))
    own = frequent[at] == classes if len(frequent) else np.zeros(len(classes), dtype=bool)
    bits = np.zeros(FREQUENT_BITS + OTHER_BITS, dtype=np.uint8)
    bits[at[own]] = 1
    bits[FREQUENT_BITS + classes[~own] % OTHER_BITS] = 1
    return np.packbits(bits).view(np.int64)


def _lost_bits(x: str, y: str) -> str:
    """How many bits of one array of integers are not set in another: no more than the classes that the other text lacks."""
    return f"aggregate(zip_with({x}, {y}, (i, j) -> bit_count(i & ~j)), 0, (s, v) -> s + v)"


def _without_lost(pairs: DataFrame) -> DataFrame:
    """`pairs` (n, n_b, and the word classes of either side) without those where one text has more classes that the other lacks than words may be edited.

    Texts of which one line makes nearly all words have most classes in common; only the rest tells them apart.
    """
    for x, y in (("classes_a", "classes_b"), ("classes_b", "classes_a")):
        pairs = pairs.where(F.size(F.array_except(x, y)) <= _most("n", "n_b"))
    return pairs


def _masks(numbers: list[int], n: int) -> list[int]:
    """`n` integers of MASK_BITS bits, of which the bits with the given numbers are set."""
    masks = [0] * n
    for k in numbers:
        masks[k // MASK_BITS] |= 1 << k % MASK_BITS
    return masks


def _open_pairs(known: DataFrame, texts: DataFrame, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(a, b): pairs of different families within the groups of members (sketch, node, n, label).

    Every pair of one group that aligned() accepts is among them. Words, each with the number
    of its earlier occurrences, fall into classes that are put in one order for all texts, rare
    ones first. Of two similar texts each loses at most a fifth of the longer one's words, so
    they share one of their first classes, as many as that and one more: pairs are joined by
    these, in groups of any size alike, and no group is gathered. Texts that many others meet
    carry their classes as bits, so that the join itself leaves out those that lack too many; of
    what it makes, pairs whose classes differ too much go. `keep` stores what is read twice.
    """
    mixed = known.groupBy("sketch").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed").select("sketch")
    nodes = known.join(mixed, "sketch", "left_semi").groupBy("node").agg(F.first("label").alias("label"), F.collect_set("sketch").alias("groups"))
    theirs = keep(nodes.join(texts, "node").select("node", "label", "groups", "text"))
    spark = theirs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORD_CLASSES, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in _chunks(texts):
                classes = _occurrences(*word_hashes(texts[part])) % np.uint64(WORD_CLASSES)
                total += np.bincount(classes.astype(np.int64), minlength=WORD_CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["class", "n"])

    counted = theirs.select("text").mapInArrow(count, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(WORD_CLASSES, dtype=np.int64)
    often[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    frequent = np.sort(np.argsort(-often, kind="stable")[:FREQUENT_BITS])
    sent = spark.sparkContext.broadcast(often)  # WORD_CLASSES numbers

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                some = batch.slice(k, 200)
                sizes, firsts, classes = [], [], []
                for text in some.column(3).to_pylist():
                    words, _ = word_hashes([text])
                    sizes.append(len(words))
                    firsts.append(_first_classes(words, sent.value).tolist())
                    classes.append(_word_classes(words).tolist())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(sizes, pa.int32()), *(pa.array(x, pa.list_(pa.int32())) for x in (firsts, classes))], names=["node", "label", "groups", "n", "firsts", "classes"])

    found = keep(theirs.mapInArrow(first, "node long, label long, groups array<long>, n int, firsts array<int>, classes array<int>"))
    by_class = keep(found.select("label", F.explode("firsts").alias("class")).groupBy("class").agg(F.count("*").alias("n"), (F.min("label") != F.max("label")).alias("mixed")).where("mixed"))
    looked = by_class.orderBy(F.desc("n"), "class").limit(MARKED).collect()
    marked, met_by = {r["class"]: k for k, r in enumerate(looked)}, np.array([r["n"] for r in looked], dtype=np.int64)
    n_masks = MARKED // MASK_BITS

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                node, label, groups, n, firsts = (batch.column(c).slice(k, 200).to_pylist() for c in range(5))
                classes = np.array([c for f in firsts for c in f], dtype=np.int32)
                bits = [[marked.get(c, -1) for c in f] for f in firsts]
                same = np.array([[x, y, z, *_masks([i % (GROUP_MASKS * MASK_BITS) for i in g], GROUP_MASKS), *_masks([i for i in b if i >= 0], n_masks)] for x, y, z, b, g in zip(node, label, n, bits, groups)], dtype=np.int64)
                times = [len(f) for f in firsts]
                same = np.repeat(same, times, axis=0)
                bit = np.array([i for b in bits for i in b], dtype=np.int64)
                part, own = bit // MASK_BITS, same[:, -n_masks:]
                rows = np.flatnonzero(bit >= 0)
                own[rows, part[rows]] &= (np.int64(1) << (bit[rows] % MASK_BITS)) - 1
                own[(bit >= 0)[:, None] & (np.arange(n_masks) > part[:, None])] = 0
                busy = [sum(met_by[i] for i in b if i >= 0) >= BUSY for b in bits]
                held = pa.array([_class_bits(c, frequent) if x else None for x, c in zip(busy, map(np.array, batch.column(5).slice(k, 200).to_pylist()))], pa.list_(pa.int64()))
                columns = [pa.array(c, pa.int32() if t == "int" else pa.int64()) for c, t in zip([classes, *same.T], kinds)]
                yield pa.RecordBatch.from_arrays([*columns, held.take(pa.array(np.repeat(np.arange(len(node)), times)))], names=[*names, "held"])

    masks = [f"g{k}" for k in range(GROUP_MASKS)] + [f"m{k}" for k in range(n_masks)]
    names = ["class", "node", "label", "n", *masks]
    kinds = ["int", "long", "long", "int", *["long"] * len(masks)]
    schema = ", ".join(f"{x} {t}" for x, t in zip([*names, "held"], [*kinds, "array<long>"]))
    words = found.mapInArrow(spread, schema).join(by_class.select("class"), "class", "left_semi")
    other = words.select(*(F.col(c).alias(f"{c}_b") for c in [*names, "held"]))
    maybe_grouped = F.expr(" OR ".join(f"(g{k} & g{k}_b) <> 0L" for k in range(GROUP_MASKS)))  # bits of their groups, which others may share
    # m0, m1, ...: the text's marked classes that come before the row's own; without a mark all of them.
    once = F.expr(f"({' | '.join(f'(m{k} & m{k}_b)' for k in range(n_masks))}) = 0L")
    lacking = F.greatest(F.expr(_lost_bits("held", "held_b")), F.expr(_lost_bits("held_b", "held")))
    on = [F.col("class") == F.col("class_b"), F.col("node") < F.col("node_b"), F.col("label") != F.col("label_b"), _close("n", "n_b"), maybe_grouped, once]
    on.append(F.col("held").isNull() | F.col("held_b").isNull() | (lacking <= _most("n", "n_b")))
    met = words.join(other, on).select(F.col("node").alias("a"), F.col("node_b").alias("b"), "n", "n_b").distinct()
    words_of = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return _without_lost(_paired(met, found.select("node", "classes"), 4 * words_of)).select("a", "b")


def families(rows: DataFrame) -> DataFrame:
    """(node, second, label): the family of every text of rows (node, second, text) that is linked to another.

    Members of a group are aligned with its leader, first in some groups, then in all, so that
    most families are known; then all pairs of different families that may be similar follow.
    A family of thousands of near copies costs a few alignments for each of them.
    """
    spare: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        spare.append(stored(df))
        return spare[-1]

    drawn = keep(_sketched(rows))
    shared = drawn.groupBy("sketch").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("sketch")
    members = keep(drawn.join(shared, "sketch", "left_semi").distinct())
    texts = keep(rows.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("second", "text")).alias("t")).select("node", "t.second", "t.text"))
    tried = keep(_verified(_led_pairs(members.where(F.pmod("sketch", F.lit(FIRST_SHARE)) == 0).withColumn("label", F.col("node"))), texts))
    for step in (_led_pairs, lambda known: _open_pairs(known, texts, keep)):
        labels = keep(components(tried.where("ok").select("a", "b")))
        known = _with_labels(members, labels)
        possible = keep(step(known))  # before those tried are taken off, which Spark would else do ahead of what narrows the pairs
        tried = tried.unionByName(keep(_verified(possible.join(tried, ["a", "b"], "left_anti"), texts)))
    found = components(tried.where("ok").select("a", "b"))
    out = stored(found.join(texts.select("node", "second"), "node"))
    dropped(*spare)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that links (a, b) lead to, for every node in a link.

    Alternating star contractions: each node's neighbours are tied to the least of them, until
    the links are stars; every round is one aggregation and one join, written to the shared
    folder, where the links of the round before are removed.
    """

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = large.where("u <> v").distinct()
        down = kept.groupBy("u").agg(F.min("v").alias("m"))
        small = kept.join(down, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small)
        after = state(new)
        if after == before:
            dropped(edges)
            break
        dropped(edges)
        edges, before = new, after
    return new.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (id, text, node, second), and (node, second, copy_of, class_id) of every distinct text among those with an id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"node": F.xxhash64("text"), "second": F.xxhash64(F.lit(1), "text")})
    whole = rows.where("text IS NOT NULL AND id IS NOT NULL")
    labels = families(whole.select("node", "second", "text"))
    firsts = whole.groupBy("node", "second").agg(F.min("id").alias("copy_of"))
    linked = firsts.join(labels, ["node", "second"])
    least = linked.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    classed = linked.join(least, "label").select("node", "second", "class_id")
    return rows, firsts.join(classed, ["node", "second"], "left").withColumn("class_id", F.coalesce("class_id", "copy_of"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, copy_of (the least id with the same text) and class_id (the
    least id among all texts linked to it, directly or by way of others).

    Two texts are linked if a banded alignment finds at most one edit for five words of the
    longer one. Words are what white space (space, U+0009 to U+000D) separates. Texts are told
    apart by two 64-bit hashes. Ids may be of any type that has an order; rows with a null id or
    a null text are classes by themselves, with their id as class_id. Texts without words are
    alike only to exact copies. Repeated rows come out as often as they went in; of other
    columns, whatever their names, none is read. An empty table gives no rows.
    """
    rows, classed = _classes(docs, id_col, text_col)
    out = rows.where("text IS NOT NULL AND id IS NOT NULL").select("id", "node", "second").join(classed, ["node", "second"]).select(F.col("id").alias(id_col), "copy_of", "class_id")
    alone = rows.where("text IS NULL OR id IS NULL").select(F.col("id").alias(id_col), F.col("id").alias("copy_of"), F.col("id").alias("class_id"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each class, one with the class's least id; columns unchanged.

    Rows with a null id or text stay; of repeated rows one stays. Columns of any name pass
    through, however clashing.
    """
    _, classed = _classes(docs, id_col, text_col)
    node, second, of = fresh(docs, "_node"), fresh(docs, "_second"), fresh(docs, "_class")
    chosen = classed.where("copy_of = class_id").groupBy("class_id").agg(F.min(F.struct("node", "second")).alias("t"))
    chosen = chosen.select(F.col("t.node").alias(node), F.col("t.second").alias(second), F.col("class_id").alias(of))
    has_both = F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    kept = docs.where(has_both).withColumns({node: F.xxhash64(text_col), second: F.xxhash64(F.lit(1), text_col), of: F.col(id_col)})
    kept = kept.join(chosen, [of, node, second], "left_semi").dropDuplicates([of, node, second]).drop(of, node, second)
    return kept.unionByName(docs.where(~has_both))
