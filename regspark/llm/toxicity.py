"""Toxicity by compression distance: windows compressed with a toxic and an ordinary dictionary.

Two zstandard dictionaries are trained, one on toxic passages and one on ordinary text. A
window (a word with the spaces around it) that the toxic dictionary compresses to fewer bytes
than the ordinary one resembles toxic text; a document is scored by how many of its windows
reach each of several differences, under weights calibrated on labelled documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.llm.common import fresh, least_by_hash
from regspark.llm.quality_classifier import fit_logistic, logit, sigmoid

#: Bound of the labelled sample, for each of the two classes.
MAX_PER_CLASS = 2_000
#: Bytes of the trained dictionaries.
TOXIC_BYTES, ORDINARY_BYTES = 4_096, 65_536
#: Toxic passages for the dictionary are words with a byte string of one of these lengths that at
#: least so many toxic documents hold, so many times their share among ordinary ones at least, and
#: so many deviations more than is to be expected.
GRAMS, MIN_TOXIC_DOCS, MIN_RATIO, MIN_DEVIATIONS = (5, 7, 9), 4, 20.0, 8.0
#: Both dictionaries end with these bytes, and so does each window: zstandard looks for no match in the last few bytes of its input.
TAIL = b"0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Byte differences at which windows are counted.
STEPS = (2, 3, 4, 5, 6, 7)
#: Samples that passages are dealt out to for training a dictionary.
STRIDES = 64
#: Longer words are cut into windows of so many bytes; windows that a worker remembers.
WINDOW_BYTES, CACHE_ENTRIES = 64, 500_000
#: A document is called toxic from this score.
TOXIC_FROM = 0.7


def windows(text: str | None) -> list[bytes]:
    """The windows of a text: its words in lower case, words over WINDOW_BYTES in parts."""
    found = (text or "").lower().encode().split()
    if any(len(w) > WINDOW_BYTES for w in found):
        found = [w[k : k + WINDOW_BYTES] for w in found for k in range(0, len(w), WINDOW_BYTES)]
    return found


@dataclass
class Model:
    """Both dictionaries and the weights of the calibrated score; compressors are made in each worker."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = ()
    memo: dict[bytes, int] = field(default_factory=dict, repr=False)
    tools: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return (self.toxic, self.ordinary, self.weights)

    def __setstate__(self, state):
        self.__init__(*state)

    def difference(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves over the ordinary one."""
        if not self.tools:
            self.tools = [_compressor(self.ordinary), _compressor(self.toxic)]
        if len(self.memo) >= CACHE_ENTRIES:
            self.memo.clear()
        padded = b" " + window + b" " + TAIL
        d = self.memo[window] = len(self.tools[0].compress(padded)) - len(self.tools[1].compress(padded))
        return d

    def features(self, text: str | None) -> np.ndarray:
        found = windows(text)
        known = self.memo.get
        d = np.fromiter((x if (x := known(w)) is not None else self.difference(w) for w in found), dtype=np.int16, count=len(found))
        counts = np.array([(d >= k).sum() for k in STEPS], dtype=float)
        return np.concatenate([np.log1p(counts), np.minimum(1.0, 20 * counts / max(1, len(d)))])

    def score(self, text: str | None) -> float:
        return float(sigmoid(logit(self.features(text)[None, :], np.array(self.weights)))[0])


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters(
        compression_level=5, min_match=4, strategy=zstandard.STRATEGY_LAZY, window_log=17, chain_log=16, hash_log=16, search_log=6,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    data.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=settings)


def _dictionary(size: int, passages: list[bytes]) -> bytes:
    """A trained dictionary; of passages that come to no more than twice `size` all different ones, as zstandard trains on much text only."""
    samples = [b"".join(passages[k::STRIDES]) for k in range(min(STRIDES, len(passages)))]
    if sum(map(len, samples)) > 2 * size:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    return b"".join(dict.fromkeys(passages))


def _grams(word: bytes) -> set[bytes]:
    word = b" " + word + b" "
    return {word[k : k + n] for n in GRAMS for k in range(len(word) - n + 1)}


def _typical(toxic: int, ordinary: int, per_ordinary: float) -> bool:
    """Whether a string in so many documents of either class is typical of toxic ones: by the ratio of its shares, and by deviations from what one ordinary document more would lead to expect."""
    expected = (ordinary + 1) * per_ordinary
    return toxic >= max(MIN_RATIO * ordinary * per_ordinary, expected + MIN_DEVIATIONS * expected**0.5)


def fit(texts: list[str | None], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Train both dictionaries and calibrate the score; `weight` undoes unequal sampling.

    Dictionaries are trained on two documents of three, the score is calibrated on the rest.
    Without documents of both classes the model gives every document the smoothed share.
    """
    n = len(STEPS) * 2
    hold = np.arange(len(texts)) % 3 == 2
    if any(len(np.unique(toxic[part])) < 2 for part in (hold, ~hold)):
        prior = (float((weight * toxic).sum()) + 1) / (float(weight.sum()) + 2)
        return Model(TAIL, TAIL, (*[0.0] * n, float(np.log(prior / (1 - prior)))))
    docs = [(windows(texts[k]), int(toxic[k])) for k in np.flatnonzero(~hold)]
    held: tuple[Counter, Counter] = (Counter(), Counter())
    size = [sum(1 for _, y in docs if y == c) for c in (0, 1)]
    for found, y in docs:
        held[y].update(set().union(*map(_grams, set(found))) if found else ())
    typical = {g for g, c in held[1].items() if c >= MIN_TOXIC_DOCS and _typical(c, held[0][g], size[1] / size[0])}
    toxic_words = [b" " + w + b" " for found, y in docs if y for w in found if _grams(w) & typical]
    ordinary_words = [b" " + w + b" " for found, y in docs if not y for w in found]
    del held
    model = Model(_dictionary(TOXIC_BYTES, toxic_words) or TAIL, _dictionary(ORDINARY_BYTES, ordinary_words) or TAIL)
    rows = np.flatnonzero(hold)
    x = np.array([model.features(texts[k]) for k in rows])
    model.weights = tuple(map(float, fit_logistic(x, toxic[rows].astype(float), weight[rows], l2=0.05)))
    return Model(model.toxic, model.ordinary, model.weights)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = MAX_PER_CLASS) -> Model:
    """Fit on at most `max_per_class` labelled documents of each class, the least by a hash of
    the id. Rows with a null id, text or label, and ids with both labels, are left out."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high")).where("low = high AND low IN (0, 1)").select("id", F.col("low").cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [least_by_hash(known.where(F.col("y") == c), "id", max_per_class, total.get(c, 0)) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # bounded by twice the limit
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Of several texts with one id the same one is taken each time.
    got = texts.join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text")).orderBy(F.xxhash64("id"), "id").toPandas()
    y = got["y"].to_numpy(dtype=int) if len(got) else np.zeros(0, dtype=int)
    weight = np.array([total[c] / max(1, (y == c).sum()) for c in y]) if len(y) else np.zeros(0)
    return fit(got["text"].tolist(), y, weight / max(weight.mean(), 1e-9) if len(y) else weight)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Add the toxicity of every whole text (0 to 1) and 1 where it reaches TOXIC_FROM, else 0.

    Null and empty texts have no windows and get the score of a text without toxic ones. Each
    partition is scored where it lies, in Arrow batches; columns of `docs` pass through.
    """
    score_col, predicted_col = fresh(docs, score_col), fresh(docs, predicted_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= TOXIC_FROM) for s in scores], pa.int32())], names=[*batch.schema.names, score_col, predicted_col])

    return docs.mapInArrow(run, schema)
