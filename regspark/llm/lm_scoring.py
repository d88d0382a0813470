"""Scoring by a log-bilinear neural language model trained with noise-contrastive estimation.

The model predicts the class of the next token from two context classes: the frequent words
have classes of their own, all others share one. The predicted vector is the sum of the context
vectors times position weights; its products with the class vectors, plus biases, are the
scores. The texts are dealt into shards of about SHARD_TOKENS tokens by a hash of their rows,
whatever the partitions of the table. One shard's worth of rows sets out the vectors; then every
shard trains a copy of these by minibatches on its own texts and Spark averages the copies, so
training sees all of the corpus. Normalised log-probabilities come from batched matrix products
over all contexts at once. A rare word takes its class's probability
times its smoothed share among rare words, for which counts of all words are joined in.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from regspark.llm.common import durable

#: Frequent words with a class of their own; length of the vectors.
CLASSES, WIDTH = 1022, 32
#: Words at most whose counts every scoring task holds; the counts of all others are joined in.
HELD_WORDS = 200_000
#: Passes over the corpus, tokens of a minibatch, noise samples of a minibatch, learning rate, seed.
PASSES, BATCH, NOISE, RATE, SEED = 1, 1024, 32, 0.1, 7
#: Tokens of a shard: a task trains on about so many, however large the corpus is.
SHARD_TOKENS = 2_000_000
#: Distinct words that a task counts before it hands on what it has; tokens that it gathers before training on them.
COUNT_WORDS, TRAIN_TOKENS = 400_000, 1_000_000
#: The end of a text as a token: no word is empty.
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, then the end; only the end for a null text."""
    return [*(text or "").encode().lower().split(), END]


@dataclass
class Model:
    """Class numbers of the words with a class, their counts, the counts of other frequent words, and what the scores need.

    `pair` holds for each context place the products of all context classes with all classes;
    `norm` the logarithm of the normaliser of every pair of contexts.
    """

    classes: dict[bytes, int]
    counts: np.ndarray
    held: dict[bytes, int]
    pair: tuple[np.ndarray, np.ndarray]
    bias: np.ndarray
    norm: np.ndarray
    total: int
    distinct: int

    @property
    def rare(self) -> int:
        return len(self.counts)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c): how often each token occurs in all texts, counted in tasks before the shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(at).to_pylist():
                held.update(tokens(text))
                if len(held) >= COUNT_WORDS:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    return durable(docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])


def _start(n: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return {"context": rng.normal(0, 0.1, (n, WIDTH)), "place": np.ones((2, WIDTH)) * 0.5, "target": rng.normal(0, 0.1, (n, WIDTH))}


def _descend(into: np.ndarray, past: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Move the given rows against the sums of their gradients, by AdaGrad with one rate a row."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    sums, at = np.add.reduceat(values[order], starts, axis=0), rows[starts]
    past[at] += (sums * sums).mean(axis=1)
    into[at] -= RATE * sums / np.sqrt(past[at])[:, None]


def train_batch(p: dict[str, np.ndarray], past: dict[str, np.ndarray], bias: np.ndarray, log_noise: np.ndarray, noise: np.ndarray, before: np.ndarray, last: np.ndarray, word: np.ndarray) -> None:
    """One step of noise-contrastive estimation, the same noise words serving the whole minibatch.

    The bias of a class stays at its log-frequency, so the vectors learn what the contexts add.
    """
    a, b = p["context"][before], p["context"][last]
    h = a * p["place"][0] + b * p["place"][1]
    q, r = p["target"][word], p["target"][noise]
    log_k = np.float32(np.log(len(noise)))
    true = np.einsum("ij,ij->i", h, q) + bias[word] - log_k - log_noise[word]
    false = h @ r.T + (bias[noise] - log_k - log_noise[noise])
    g_true = -1 / (1 + np.exp(np.clip(true, -30, 30)))
    g_false = 1 / (1 + np.exp(-np.clip(false, -30, 30)))
    dh = g_true[:, None] * q + g_false @ r
    place = np.stack([(dh * a).sum(axis=0), (dh * b).sum(axis=0)])
    _descend(p["target"], past["target"], np.concatenate([word, noise]), np.concatenate([g_true[:, None] * h, g_false.T @ h]))
    _descend(p["context"], past["context"], np.concatenate([before, last]), np.concatenate([dh * p["place"][0], dh * p["place"][1]]))
    _descend(p["place"], past["place"], np.arange(2), place)


def class_ids(texts: list[str | None], classes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(before, last, word, sizes): classes of each token and of the two before it; texts start after two ends."""
    get, rare, end = classes.get, len(classes), classes[END]
    before, last, word, sizes = [], [], [], []
    for text in texts:
        ids = np.fromiter((get(w, rare) for w in tokens(text)), dtype=np.int32)
        line = np.concatenate([[end, end], ids])
        before.append(line[:-2])
        last.append(line[1:-1])
        word.append(ids)
        sizes.append(len(ids))
    return np.concatenate(before), np.concatenate(last), np.concatenate(word), np.array(sizes)


def hashed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, h): h is a hash of all plain columns of the row, so copies of a text under different ids part."""
    plain = [docs[f.name] for f in docs.schema.fields if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
    return docs.select(docs[text_col].alias("text"), F.xxhash64(*plain).alias("h"))


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """(text, h) in `shards` partitions by h, in its order in each: neither depends on how the table is laid out,
    and a task that is run again sees the same order."""
    return rows.repartition(shards, "h").sortWithinPartitions("h", "text")


def train_pass(texts: DataFrame, classes: dict[bytes, int], counts: np.ndarray, start: dict[str, np.ndarray], past: dict[str, np.ndarray], number: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """One pass over dealt texts: each partition trains from `start` on its own; the means of the copies and
    of their AdaGrad sums, weighted by tokens.

    Spark adds the copies up row by row, so the driver gets one model whatever the number of shards.
    """
    at = texts.columns.index("text")
    freq = counts / counts.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = {k: v.astype(np.float32) for k, v in start.items()}
        sums = {k: v.astype(np.float32) for k, v in past.items()}
        rng = np.random.default_rng(SEED + number)
        share = freq**0.75 / (freq**0.75).sum()
        log_noise, bias = np.log(share).astype(np.float32), np.log(freq).astype(np.float32)
        ladder = np.cumsum(share)[:-1]
        done = 0

        def learn(held: list) -> int:
            before, last, word, _ = class_ids(held, classes)
            order = rng.permutation(len(word))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                train_batch(p, sums, bias, log_noise, np.searchsorted(ladder, rng.random(NOISE)), before[some], last[some], word[some])
            return len(word)

        held: list = []
        chars = 0
        for batch in batches:
            for text in batch.column(at).to_pylist():
                held.append(text)
                chars += len(text or "")
                if chars >= 6 * TRAIN_TOKENS:
                    done += learn(held)
                    held, chars = [], 0
        if held:
            done += learn(held)
        if done:
            flat = [(name, k, np.append(row, sums[name][k])) for name, m in p.items() for k, row in enumerate(m)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in flat]), pa.array([x[1] for x in flat], pa.int32()), pa.array([(x[2] * float(done)).tolist() for x in flat], pa.list_(pa.float64())), pa.array([done] * len(flat), pa.int64())],
                names=["part", "row", "v", "n"],
            )

    copies = texts.mapInArrow(run, "part string, row int, v array<double>, n long")
    mean = copies.groupBy("part", "row").agg(*(F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(WIDTH + 1)), F.sum("n").alias("n"))
    out, seen = {k: v.copy() for k, v in start.items()}, {k: v.copy() for k, v in past.items()}
    for r in mean.collect():  # one model: (2 x classes + 2) rows
        out[r["part"]][r["row"]] = np.array([r[f"v{k}"] for k in range(WIDTH)]) / r["n"]
        seen[r["part"]][r["row"]] = r[f"v{WIDTH}"] / r["n"]
    return out, seen


def train(docs: DataFrame, counts: DataFrame, text_col: str = "text", passes: int = PASSES) -> Model:
    """Learn from every text of `docs`, of which `counts` are the token counts."""
    least, sums = _threshold(counts)
    top = sorted(((-r["c"], bytes(r["word"])) for r in counts.where(F.col("c") >= least).collect() if r["word"]))  # at most HELD_WORDS
    end = counts.where(F.col("word") == END).first()
    words = [END, *(w for _, w in top[:CLASSES])]
    c = np.array([end["c"] if end else 0, *(-n for n, _ in top[:CLASSES])], dtype=np.int64)
    total, distinct = sums
    classes = {w: k for k, w in enumerate(words)}
    with_rare = np.maximum(np.append(c, total - c.sum()), 1).astype(float)
    p = _start(len(with_rare))
    past = {k: np.full(len(v), 1e-3) for k, v in p.items()}
    shards = max(1, -(-total // SHARD_TOKENS))
    rows = hashed(docs, text_col)
    if shards > 1 and passes:  # copies that set out from vectors that mean something can be averaged
        first = rows.where(F.pmod(F.xxhash64("h"), F.lit(shards)) == 0)
        p, past = train_pass(dealt(first, 1), classes, with_rare, p, past, passes)
    for number in range(passes if total else 0):
        p, past = train_pass(dealt(rows, shards), classes, with_rare, p, past, number)
    return Model(classes, c, {w: -n for n, w in top[CLASSES:]}, *normalise(p, np.log(with_rare / with_rare.sum())), total, distinct)


def _threshold(counts: DataFrame) -> tuple[int, tuple[int, int]]:
    """The least count that at most HELD_WORDS words reach; the sum and the number of counts."""
    by_count = F.least("c", F.lit(1 << 20))
    levels = sorted((r["level"], r["words"], r["n"]) for r in counts.groupBy(by_count.alias("level")).agg(F.count("*").alias("words"), F.sum("c").alias("n")).collect())
    least, held = (1 << 20) + 1, 0
    for level, words, _ in reversed(levels):
        if held + words > HELD_WORDS:
            break
        least, held = level, held + words
    return least, (sum(n for _, _, n in levels), sum(words for _, words, _ in levels))


def normalise(p: dict[str, np.ndarray], bias: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Products of contexts and classes, biases, and all log-normalisers by one matrix product."""
    first, second = ((p["context"] * p["place"][k]) @ p["target"].T for k in (0, 1))
    high = first.max(axis=1), second.max(axis=1)
    z = np.exp(first - high[0][:, None]) @ (np.exp(second - high[1][:, None]) * np.exp(bias)).T
    norm = np.log(np.maximum(z, 1e-300)) + high[0][:, None] + high[1][None, :]
    return (first.astype(np.float32), second.astype(np.float32)), bias.astype(np.float32), norm.astype(np.float32)


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_tokens, n_known, train_tokens (long), base_score and score (double) of every row.

    base_score: the sum of log10((c + 1) / (N + V + 1)); score: the log10 probability of the
    whole text under the model. A null text is empty: one token, the end. Null and repeated
    ids are allowed, one row coming out for each row; other columns are left behind.

    Only words outside the HELD_WORDS most frequent leave a task, so no frequent word can make
    one task of the join large.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a bounded size: CLASSES, HELD_WORDS
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known_class, held, rare = m.classes.get, m.held.get, m.rare
        logc, seen = np.log10(np.append(m.counts, 0) + 1.0), np.append(m.counts > 0, False)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(1).to_pylist()
                before, last, word, sizes = class_ids(texts, m.classes)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                logp = (m.pair[0][before, word] + m.pair[1][last, word] + m.bias[word] - m.norm[before, last]).astype(np.float64) / np.log(10)
                logp, log_c, known, n_rare = (np.add.reduceat(x, starts) for x in (logp, np.where(word < rare, logc[word], 0.0), seen[word].astype(np.int64), (word == rare).astype(np.int64)))
                other: list[tuple[int, bytes, int]] = []
                rare_c = np.zeros(len(texts))
                for j, text in enumerate(texts):
                    row += 1
                    counted, asked = [], []
                    for w in tokens(text):
                        if known_class(w) is None:
                            if c := held(w):
                                counted.append(c)
                            else:
                                asked.append(w)
                    known[j] += len(counted)
                    rare_c[j] = np.log10(np.array(counted, dtype=float) + 1).sum()
                    # No token has a space in it: this row meets no count, and carries what is known already.
                    other.append((row, b" %d" % row, 0))
                    other += [(row, w, n) for w, n in Counter(asked).items()]
                rows, words, times = zip(*other)
                first = np.array(times) == 0
                spread = lambda values, kind: pa.array(np.repeat(values, np.diff(np.append(np.flatnonzero(first), len(first)))), kind, mask=~first)
                ids = part.column(0).take(pa.array(np.where(first, np.cumsum(first) - 1, 0), mask=~first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int64()), ids, spread(sizes, pa.int64()), spread(known, pa.int64()), spread(n_rare, pa.int64()), spread(log_c + rare_c, pa.float64()), spread(logp + rare_c, pa.float64())],
                    names=["row", "word", "times", "id", "n_tokens", "known", "n_rare", "logc", "logp"],
                )

    kinds = "word binary, times long", f"id {given.schema['id'].dataType.simpleString()}, n_tokens long, known long, n_rare long, logc double, logp double"
    asked = given.mapInArrow(run, f"row long, {kinds[0]}, {kinds[1]}")
    met = asked.join(counts.where(F.col("c") < (min(model.held.values(), default=1 << 62) if model.held else 1 << 62)), "word", "left")
    n, v = model.total, model.distinct
    rare_n, rare_v = n - int(model.counts.sum()), v - int((model.counts > 0).sum())
    more = F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0))
    summed = met.groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("id", "n_tokens", "known", "n_rare", "logc", "logp")), more.alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("met")
    )
    return summed.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.col("met")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logc") + F.col("more") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("logp") + F.col("more") - F.col("n_rare") * F.lit(float(np.log10(rare_n + rare_v + 1)))).alias("score"),
    )
