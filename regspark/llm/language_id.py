"""Language identification by unigram pieces, summed over all segmentations of each word.

Every language has a probability for each piece of one fixed public vocabulary, learned by
expectation-maximisation. A forward pass over a word's characters adds up the probabilities of
all ways to cut it into pieces; a text's score is the product over its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from regspark.llm.common import fresh

#: Bound of the fit: labelled documents for each language. Longer words are scored, but not learned from.
MAX_PER_LANG, FIT_WORD_CHARS = 400, 64
#: Rounds of expectation-maximisation, smoothing counts for each piece.
ROUNDS, SMOOTH = 3, 0.05
#: Probability of a character that is no piece, shared by all languages.
UNKNOWN = 1e-7
#: Ends of a word after which its forward sums are scaled; words that a worker remembers, if they are not longer than this.
SCALE_STEP, CACHE_ENTRIES, CACHE_CHARS = 16, 700_000, 64
#: A word's evidence counts for this share in the posterior probability, since words depend on each other.
TEMPER = 0.1
START = "▁"
UNDETERMINED = "und"

_LETTERS = regex.compile(r"\p{L}+")


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """Numbers of the vocabulary's pieces of lower-case letters, by piece; words start with START."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = dict.fromkeys(p.lower() for p in map(model.id_to_piece, range(model.get_piece_size())) if _LETTERS.fullmatch(p.removeprefix(START)) or p == START)
    return {p: k for k, p in enumerate(found)}


def text_words(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L) in lower case."""
    return _LETTERS.findall((text or "").lower())


@dataclass
class Model:
    """Piece log-probability tables of each language, over the vocabulary at `path`."""

    path: str
    langs: tuple[str, ...]
    table: np.ndarray  # pieces + 1 (unknown, last) x languages
    prior: np.ndarray
    rows: dict[str, int] = field(default_factory=dict, repr=False)  # of the words in `logs`
    logs: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return (self.path, self.langs, self.table, self.prior)

    def __setstate__(self, state):
        self.__init__(*state)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Of each word by language; new words are worked out by length and remembered."""
        if self.logs is None:
            self.logs = np.empty((0, len(self.langs)), dtype=np.float32)
        if new := [w for w in dict.fromkeys(words) if w not in self.rows]:
            if len(self.rows) + len(new) > CACHE_ENTRIES:
                self.rows.clear()
                self.logs = self.logs[:0]
                new = list(dict.fromkeys(words))
            more = [self.logs]
            for some, logs in forward(new, pieces(self.path), self.table):
                self.rows.update(zip(some, range(len(self.rows), len(self.rows) + len(some))))
                more.append(logs.astype(np.float32))
            self.logs = np.vstack(more)
        return self.logs[np.fromiter(map(self.rows.__getitem__, words), dtype=np.int64, count=len(words))]

    def posteriors(self, texts: list[list[str]]) -> np.ndarray:
        """Probabilities of the languages for each text, given as its words; 0 without words."""
        sizes = np.array([len(t) for t in texts])
        out = np.zeros((len(texts), len(self.langs)))
        if full := np.flatnonzero(sizes).tolist():
            logs = self.log_probabilities([w for t in texts for w in t]).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
            total = np.log(self.prior) + TEMPER * np.add.reduceat(logs, starts, axis=0)
            p = np.exp(total - total.max(axis=1, keepdims=True))
            out[full] = p / p.sum(axis=1, keepdims=True)
        return out


def longest(vocabulary: dict[str, int]) -> int:
    return max(map(len, vocabulary), default=1)


def lattice(words: list[str], vocabulary: dict[str, int], most: int) -> np.ndarray:
    """Piece numbers of equally long words: [word, end, length], lengths up to `most`; -1 where there is no piece, the last number for an unknown character."""
    n, unknown = len(words[0]) + 1, len(vocabulary)
    out = np.full((len(words), n, most), -1, dtype=np.int32)
    get = vocabulary.get
    for length in range(1, min(most, n) + 1):
        none = unknown if length == 1 else -1
        for end in range(length, n + 1):
            start = end - length
            out[:, end - 1, length - 1] = [get(START + w[: end - 1] if not start else w[start - 1 : end - 1], none) for w in words]
    return out


def forward(words: list[str], vocabulary: dict[str, int], table: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """(words of one length, their log-probabilities by language), over all segmentations.

    The sums of the last few ends are divided by their largest now and then, so that words of
    any length keep their probability.
    """
    padded, most = np.vstack([table, np.zeros((1, table.shape[1]))]), longest(vocabulary)  # number -1: no piece
    for some in by_length(words):
        number = lattice(some, vocabulary, most)
        n = number.shape[1]
        alpha = np.zeros((n + 1, len(some), table.shape[1]))
        scale = np.zeros(alpha.shape[1:])
        alpha[0] = 1.0
        for end in range(1, n + 1):
            for length in range(1, min(most, end) + 1):
                alpha[end] += alpha[end - length] * padded[number[:, end - 1, length - 1]]
            if end % SCALE_STEP == 0:
                last = alpha[max(0, end - most + 1) : end + 1]
                largest = np.maximum(last.max(axis=0), 1e-250)
                last /= largest
                scale += np.log(largest)
        yield some, np.log(np.maximum(alpha[n], 1e-290)) + scale


def by_length(words: list[str], most: int = 4096) -> Iterator[list[str]]:
    """Words of one length, as many as `most` of 16 characters would take room for."""
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for n, group in sorted(groups.items()):
        step = max(1, min(most, 16 * most // n))
        for k in range(0, len(group), step):
            yield group[k : k + step]


def fit_language(counts: Counter, vocabulary: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (unknown last) of one language by expectation-maximisation.

    Expected piece counts come from a forward and a backward pass over each word's lattice.
    """
    k, most = len(vocabulary), longest(vocabulary)
    p = np.full(k + 2, 1.0 / k)
    p[k], p[k + 1] = UNKNOWN, 0.0  # unknown character; no piece
    for _ in range(rounds):
        expected = np.zeros(k + 2)
        for some in by_length([w for w in counts if len(w) <= FIT_WORD_CHARS]):
            number = lattice(some, vocabulary, most)
            n = number.shape[1]
            f, b = np.zeros((n + 1, len(some))), np.zeros((n + 1, len(some)))
            f[0] = b[n] = 1.0
            for end in range(1, n + 1):
                for length in range(1, min(most, end) + 1):
                    f[end] += f[end - length] * p[number[:, end - 1, length - 1]]
            for end in range(n, 0, -1):
                for length in range(1, min(most, end) + 1):
                    b[end - length] += b[end] * p[number[:, end - 1, length - 1]]
            # Square roots, so that a few very frequent words do not take all of the probability.
            weight = np.sqrt([counts[w] for w in some]) / np.maximum(f[n], 1e-290)
            for end in range(1, n + 1):
                for length in range(1, min(most, end) + 1):
                    piece = number[:, end - 1, length - 1]
                    np.add.at(expected, piece, weight * f[end - length] * p[piece] * b[end])
        expected = expected[:k] + SMOOTH
        p[:k] = expected / expected.sum()
    return p[: k + 1]


def train(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_lang: int = MAX_PER_LANG) -> Model:
    """Fit on at most `max_per_lang` documents of each language, the least by a hash of the id
    (ties: of the text). Every non-null language is learned; rows with a null id or language are
    not learned from. Equal rows count once."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    share = known.groupBy("lang").agg(F.count("*").alias("n"))
    counted = {r["lang"]: r["n"] for r in share.collect()}  # one row a language
    if not counted:
        return Model(path, (), np.zeros((0, 0)), np.zeros(0))
    # A threshold for the hash leaves a few times as many as are wanted, so that little is ranked and no language is gathered.
    drawn = known.join(share, "lang").where((F.pmod("h", F.lit(1 << 30)) < F.lit(float(1 << 30)) * 4 * max_per_lang / F.col("n")) | (F.col("n") <= 4 * max_per_lang))
    turn = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h", F.xxhash64("text")))
    sample = drawn.distinct().withColumn("turn", turn).where(F.col("turn") <= max_per_lang).select("lang", "text")
    counts: dict[str, Counter] = {lang: Counter() for lang in counted}
    for row in sample.toLocalIterator():
        counts[row["lang"]].update(text_words(row["text"]))
    vocabulary = pieces(path)
    langs = tuple(sorted(counts))
    table = np.column_stack([fit_language(counts[lang], vocabulary) for lang in langs])
    n = np.array([counted[lang] for lang in langs], dtype=float)
    return Model(path, langs, table, (n + 1) / (n + 1).sum())


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the likeliest language of every whole text and its probability (0 to 1).

    Texts that are null or without a letter are `und` with score 0, as is everything under a
    model that learned no language. Ties take the first language by name. Each partition is
    read where it lies, in Arrow batches; columns of `docs` pass through.
    """
    lang_col, score_col = fresh(docs, lang_col), fresh(docs, score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            texts = batch.column(at)
            for k in range(0, batch.num_rows, 512):
                found = [text_words(t) for t in texts.slice(k, 512).to_pylist()]
                p = model.posteriors(found) if model.langs else np.zeros((len(found), 1))
                langs += [model.langs[row.argmax()] if row.any() else UNDETERMINED for row in p]
                scores += p.max(axis=1).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_col, score_col])

    return docs.mapInArrow(run, schema)
