"""Grouping of spelling variants: words that differ by one code point, found on bit-sliced positions.

The words of all texts are counted; two words are near if one inserted, deleted or replaced
code point turns one into the other. Words that are near share a half: one error leaves either
the first or the last half of the shorter word alone. So words meet in cells by a half, and a
cell is searched word-parallel: for each position and letter a bitset tells which words of the
cell have that letter there, and four bitsets a query follow the words that agree so far: with
no error, with one letter replaced, with one letter more (read one position ahead) and with one
letter fewer (one position behind). Cells of a frequent half are split in pairs of chunks, so no
task holds more than a few thousand words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import dropped, stored

#: Runs of letters: A-Z, a-z and U+00C0 to U+00FF, here in Latin-1 bytes whose A-Z are in lower case.
RUN = re.compile(rb"[a-z\xc0-\xff]+")
MIN_CHARS, MIN_COUNT = 6, 5
#: A form has so many times the occurrences of the word at least.
RATIO = 5
#: Words of a cell, about; a half with more words is split into chunks that meet in pairs.
CELL_WORDS = 4_096
#: Distinct words that a task counts before it hands them on.
TASK_COUNTS = 200_000


def runs(text: str | None) -> Counter[bytes]:
    """The runs of letters of a text with their numbers, in Latin-1, only A-Z lower-cased."""
    return Counter(RUN.findall((text or "").encode("latin-1", "replace").lower()))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, misspell_every: int | None = None) -> DataFrame:
    """(word, n): runs of at least `min_chars` code points that occur `min_count` times in all texts.

    With `misspell_every`, the run of a document whose crc32 of `<id>:<run>` it divides loses its
    code point crc32 % length (a null id is written as nothing). Each task adds up what it reads
    before anything is shuffled.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return found

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for run, n in runs(text.as_py()).items():
                    if len(run) < min_chars:
                        continue
                    if misspell_every:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                        if h % misspell_every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < min_chars:
                                continue
                    total[run] += n
                if len(total) >= TASK_COUNTS:
                    yield flush()
        yield flush()

    parts = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Positions:
    """The bitsets of words by position and letter, made position by position.

    Each bitset has one bit a word, in rows of 64-bit numbers; the words are given as matrices of
    code points, one for each length.
    """

    def __init__(self, groups: list[np.ndarray]) -> None:
        self.groups, self.n = groups, sum(len(g) for g in groups)
        self.width = -(-self.n // 64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bits(self, marks: np.ndarray) -> np.ndarray:
        """Rows of booleans, one for each word, as rows of 64-bit numbers."""
        packed = np.zeros((len(marks), self.width * 8), dtype=np.uint8)
        raw = np.packbits(marks, axis=1, bitorder="little")
        packed[:, : raw.shape[1]] = raw
        return packed.view(np.uint64)

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each of `letters`, the words that have it at `position`."""
        if position not in self.tables:
            self.tables.pop(position - 3, None)
            column = np.concatenate([g[:, position] if 0 <= position < g.shape[1] else np.zeros(len(g), dtype=np.uint32) for g in self.groups])
            known = np.unique(column[column > 0])
            self.tables[position] = known, np.vstack([self.bits(known[:, None] == column[None, :]), np.zeros((1, self.width), dtype=np.uint64)])
        known, rows = self.tables[position]
        if not len(known):
            return np.repeat(rows, len(letters), axis=0)
        slot = np.minimum(np.searchsorted(known, letters), len(known) - 1)
        return rows[np.where(known[slot] == letters, slot, len(known))]


def one_error(queries: np.ndarray, groups: list[np.ndarray], own: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) numbers of all pairs with exactly one error.

    `queries` are the code points of words of one length m; `groups` are those of the distinct
    words of m - 1, m and m + 1, numbered in this order; the queries stand from number `own`.
    """
    table, (count, m) = Positions(groups), queries.shape
    everything = table.bits(np.ones((1, table.n), dtype=bool))
    itself = np.zeros((count, table.width), dtype=np.uint64)
    self_at = own + np.arange(count)
    itself[np.arange(count), self_at // 64] = np.uint64(1) << (self_at % 64).astype(np.uint64)
    exact = everything & ~itself
    replaced, longer, shorter = (np.zeros_like(exact) for _ in range(3))
    for k in range(m):
        letters = queries[:, k]
        here = table.at(k, letters)
        longer = (longer | exact) & table.at(k + 1, letters)
        shorter = (shorter & table.at(k - 1, letters)) | exact
        replaced = (replaced & here) | (exact & ~here)
        exact = exact & here
        if k % 4 == 3 and not (exact.any() or replaced.any() or longer.any() or shorter.any()):
            return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    longer = longer | exact
    sizes = np.concatenate([np.full(len(g), g.shape[1]) for g in groups])
    of_length = table.bits(sizes[None, :] == np.array([[m], [m + 1], [m - 1]]))
    found = (replaced & of_length[0]) | (longer & of_length[1]) | (shorter & of_length[2])
    rows = np.flatnonzero(found.any(axis=1))
    hits = np.unpackbits(found[rows].view(np.uint8), axis=1, bitorder="little")[:, : table.n]
    q, w = np.nonzero(hits)
    return rows[q], w


def near_in(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all ordered pairs of near words among distinct `words`."""
    lengths = np.array([len(w) for w in words], dtype=int)
    numbers = {m: np.flatnonzero(lengths == m) for m in np.unique(lengths).tolist()}
    codes = {m: np.frombuffer("".join(words[k] for k in ks).encode("utf-32-le"), dtype="<u4").reshape(len(ks), m) for m, ks in numbers.items()}
    left, right = [np.zeros(0, dtype=int)], [np.zeros(0, dtype=int)]
    for m, queries in codes.items():
        beside = [x for x in (m - 1, m, m + 1) if x in codes]
        if len(beside) == 1 and len(queries) == 1:
            continue
        q, w = one_error(queries, [codes[x] for x in beside], len(codes[m - 1]) if m - 1 in codes else 0)
        left.append(numbers[m][q])
        right.append(np.concatenate([numbers[x] for x in beside])[w])
    return np.concatenate(left), np.concatenate(right)


def _cell(table: pa.Table) -> pa.Table:
    """All near pairs of the words of a bin."""
    words, n = table.column("word").to_pylist(), table.column("n").to_pylist()
    counts = dict(zip(words, n))
    distinct = list(counts)
    left, right = near_in(distinct)
    numbers = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    take = pa.array(distinct, pa.string())
    return pa.Table.from_arrays([take.take(pa.array(left)), pa.array(numbers[left]), take.take(pa.array(right)), pa.array(numbers[right])], names=["word", "n", "other", "other_n"])


def near_words(counts: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """(word, n, other, other_n): every ordered pair of near words of a stored table (word, n).

    A word of m code points goes to the cells of its first and last m // 2 and (m - 1) // 2 code
    points. Halves with more than `cell_words` words are split into chunks, and each pair of
    chunks is a cell; cells share bins of about `cell_words` rows.
    """
    m = F.char_length("word")
    halves = F.array_distinct(F.array(F.floor(m / 2), F.floor((m - 1) / 2)))
    keys = F.flatten(F.transform(halves, lambda h: F.array(F.xxhash64(F.lit("first"), h, F.expr("word").substr(F.lit(1), h.cast("int"))), F.xxhash64(F.lit("last"), h, F.expr("word").substr((m - h + 1).cast("int"), h.cast("int"))))))
    keyed = counts.select("word", "n", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("rows"))
    split = sizes.where(F.col("rows") > cell_words).select(F.col("key").alias("_key"), F.ceil(F.col("rows") / cell_words).cast("int").alias("chunks"))
    j = keyed.join(split, F.col("key") == F.col("_key"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("word", F.lit("chunk")), F.col("chunks")).cast("int")
    j = j.withColumn("own", own).withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    bins = max(1, -(-4 * counts.count() // cell_words))
    placed = j.select("word", "n", F.pmod(F.xxhash64("key", F.least("own", "meets"), F.greatest("own", "meets")), F.lit(bins)).alias("bin"))
    return placed.groupBy("bin").applyInArrow(_cell, "word string, n long, other string, other_n long").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each word's last form, by joins that double the steps.

    Forms have ever more occurrences, so there is no circle, and a chain of n steps takes about
    log2(n) rounds. Each round is a stored table.
    """
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        further = stored(at.join(ahead, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        ended = further.where("moved").isEmpty()
        dropped(at)
        at = further
        if ended:
            return at.select("word", "root")


def spelling_groups(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of a table (word, n) of distinct words.

    A word's form is its near word of largest n (ties: the least in code-point order), if that n
    is at least `ratio` times its own, else null; its root is the last word that forms lead to,
    itself if there is none. Words without near words have n_near 0. Words are compared by code
    points, whatever their length; an empty table gives none.
    """
    counts = stored(counts.select("word", "n"))
    best = near_words(counts).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("b"))
    reached = -F.col("b.n") >= ratio * F.col("n")
    best = stored(best.select(F.col("word").alias("_word"), "n_near", F.when(reached, F.col("b.word")).alias("form"), F.when(reached, -F.col("b.n")).alias("form_n")))
    roots = last_forms(best.where("form IS NOT NULL").select(F.col("_word").alias("word"), "form")).withColumnRenamed("word", "_from")
    j = counts.join(best, F.col("word") == F.col("_word"), "left").join(roots, F.col("word") == F.col("_from"), "left")
    return j.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def _nibble(k: int) -> int:
    """The crc32 of four bits, from its reversed polynomial."""
    for _ in range(4):
        k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
    return k


def oracle_sql(misspell_every: int, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> str:
    """DuckDB SQL: crc32 four bits at a time, near words by equal texts with one code point left out."""
    byte = "list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c) & 15, unicode(c) >> 4] ELSE [3, 12, unicode(c) & 15, (unicode(c) - 64) >> 4] END)"
    step = "lambda c, b: xor(list_extract(" + str([_nibble(k) for k in range(16)]) + "::BIGINT[], CAST((xor(c, b) & 15) + 1 AS BIGINT)), c >> 4)"
    return f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= {min_chars} GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten({byte})::BIGINT[]), {step}), 4294967295::BIGINT) AS h FROM d),
e AS (SELECT CASE WHEN h % {misspell_every} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= {min_chars} GROUP BY 1 HAVING sum(n) >= {min_count}),
x AS (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM x a JOIN x b ON a.less = b.less AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM x a JOIN v b ON a.less = b.word UNION SELECT b.word, b.n, a.word, a.n FROM x a JOIN v b ON a.less = b.word),
best AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY ALL),
f AS (SELECT word, n_near, CASE WHEN form_n >= {ratio} * n THEN form END AS form, CASE WHEN form_n >= {ratio} * n THEN form_n END AS form_n FROM best),
walk AS (SELECT word, form AS target, 1 AS steps FROM f WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form, steps + 1 FROM walk w JOIN f ON w.target = f.word WHERE f.form IS NOT NULL),
ended AS (SELECT word, arg_max(target, steps) AS root FROM walk GROUP BY word)
SELECT v.word, form, coalesce(root, v.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n FROM v LEFT JOIN f ON v.word = f.word LEFT JOIN ended ON v.word = ended.word"""
