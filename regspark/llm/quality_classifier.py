"""Quality classification by co-training a text view and a metadata view.

Two logistic classifiers see separate views of a document: figures of its text, and its
metadata (source, language, stated length). Over some rounds each labels the unlabelled
documents that it is sure of for the other. Both are then calibrated on labelled documents
that neither learned from, and the calibrated views are combined into one score.

Features and scores are column expressions over all documents; only the fit itself runs on the
driver, on samples whose bounds are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.llm.common import WORD_BREAKS, fresh, words

#: Bounds of the samples that the fit uses: labelled rows, and rows without a label.
MAX_LABELLED, MAX_UNLABELLED = 20_000, 20_000
ROUNDS = 4
#: Pseudo-labels need this probability; in each round a view gives at most this share of the pool, both classes alike.
SURE, SHARE = 0.97, 0.05
#: The decision threshold rejects at most this share of the good calibration rows, and is never above 0.5.
MAX_GOOD_LOST = 0.002
META_BUCKETS, LENGTH_BUCKETS = 32, 20


def text_view(text: Column) -> list[Column]:
    """Figures of a text between 0 and about 1; all 0 for a null or empty text."""
    t = F.coalesce(text, F.lit(""))
    w = words(text)
    n_words, n_chars = F.greatest(F.size(w), F.lit(1)), F.greatest(F.char_length(t), F.lit(1))
    lines = F.split(t, "\n")

    def share(characters: str) -> Column:
        return (n_chars - F.greatest(F.char_length(F.translate(t, characters, "")), F.lit(0))) / n_chars * (t != "").cast("int")

    return [
        F.least(F.lit(1.0), F.size(F.array_distinct(w)) / n_words),
        F.least(F.lit(1.0), F.char_length(F.translate(t, WORD_BREAKS, "")) / n_words / 20),
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        F.sqrt(share("#*$%&|<>")),
        F.sqrt(share("!?")),
        F.sqrt(share("0123456789")),
        F.sqrt(share(".,;:")),
        1 - F.size(F.array_distinct(lines)) / F.size(lines),
        F.log1p(F.size(w)) / 12,
    ]


def meta_view(docs: DataFrame, source_col: str, lang_col: str, length_col: str) -> list[Column]:
    """0/1 figures of the metadata; a null value or missing column is a value of its own."""

    def value(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in docs.columns else F.lit("")

    source = F.pmod(F.xxhash64(value(source_col)), F.lit(META_BUCKETS))
    lang = F.pmod(F.xxhash64(value(lang_col)), F.lit(META_BUCKETS // 4))
    size = F.least(F.coalesce(F.log2(F.greatest(F.try_to_number(value(length_col), F.lit("999999999999999")).cast("double"), F.lit(1.0))).cast("int") + 1, F.lit(0)), F.lit(LENGTH_BUCKETS - 1))
    return [
        *((source == k).cast("double") for k in range(META_BUCKETS)),
        *((lang == k).cast("double") for k in range(META_BUCKETS // 4)),
        *((size == k).cast("double") for k in range(LENGTH_BUCKETS)),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + l2 * b
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + (l2 + 1e-9) * np.eye(len(b))
        step = np.linalg.solve(hessian, gradient)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def logit(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return x @ b[:-1] + b[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Model:
    """Weights of both views, of the calibrated combination, and the decision threshold."""

    text: tuple[float, ...]
    meta: tuple[float, ...]
    combine: tuple[float, float, float]
    threshold: float


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, ut: np.ndarray, um: np.ndarray, hold: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit both views on labelled rows outside `hold` and pool rows that the other view is sure of.

    With a single class among the labels nothing can be learned: the model then gives every
    document that class's share, smoothed, and a threshold that keeps everything.
    """
    if len(y) == 0 or len(np.unique(y[~hold])) < 2 or len(np.unique(y[hold])) < 2:
        prior = (y.sum() + 1) / (len(y) + 2)
        return Model((0.0,) * (xt.shape[1] + 1), (0.0,) * (xm.shape[1] + 1), (float(np.log(prior / (1 - prior))), 0.0, 0.0), 0.0)
    learn = ~hold
    given = {"text": {}, "meta": {}}  # pool rows and labels that a view got from the other
    views = {"text": (xt[learn], ut), "meta": (xm[learn], um)}
    b: dict[str, np.ndarray] = {}
    for _ in range(rounds + 1):
        for view, (x, u) in views.items():
            rows = np.array(sorted(given[view]), dtype=int)
            labels = np.array([given[view][k] for k in rows])
            b[view] = fit_logistic(np.vstack([x, u[rows]]) if len(rows) else x, np.concatenate([y[learn], labels]))
        for view, other in (("text", "meta"), ("meta", "text")):
            p = sigmoid(logit(views[view][1], b[view]))
            most = int(SHARE * len(p))
            for label, order in ((1, np.argsort(-p, kind="stable")), (0, np.argsort(p, kind="stable"))):
                sure = [k for k in order[:most] if (p[k] if label else 1 - p[k]) >= SURE]
                given[other] |= {k: label for k in sure if k not in given[other]}
    calibrated = [fit_logistic(logit(x[hold], b[v])[:, None], y[hold]) for v, x in (("text", xt), ("meta", xm))]
    z = np.column_stack([c[0] * logit(x[hold], b[v]) + c[1] for c, (v, x) in zip(calibrated, (("text", xt), ("meta", xm)))])
    mix = fit_logistic(z, y[hold])
    p = sigmoid(logit(z, mix))
    threshold = min(0.5, float(np.quantile(p[y[hold] == 1], MAX_GOOD_LOST)))
    at = mix[2] + mix[0] * calibrated[0][1] + mix[1] * calibrated[1][1]
    return Model(tuple(map(float, b["text"])), tuple(map(float, b["meta"])), (float(at), float(mix[0] * calibrated[0][0]), float(mix[1] * calibrated[1][0])), threshold)


def _dot(columns: list[Column], weights: tuple[float, ...]) -> Column:
    total = F.lit(weights[-1])
    for c, w in zip(columns, weights):
        total = total + c * F.lit(w)
    return total


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars", max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on at most `max_labelled` labelled and `max_unlabelled` other documents.

    Both samples take the least by a hash of the id, so they do not depend on the layout of the
    tables. Rows with a null id or label, and ids whose labels disagree, are not learned from; of
    an id's repeated rows one is. Columns of any other name may stand beside those named here.
    """
    key, y_col = fresh(docs, "_id"), fresh(docs, "_y")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(key)).agg(F.min(label_col).alias("_lo"), F.max(label_col).alias("_hi")).where("_lo = _hi").select(key, F.col("_lo").cast("double").alias(y_col))
    known = known.orderBy(F.xxhash64(key), key).limit(max_labelled)
    pool = docs.select(F.col(id_col).alias(key)).where(F.col(key).isNotNull()).join(known, key, "left_anti")
    pool = pool.orderBy(F.xxhash64(key), key).limit(max_unlabelled).withColumn(y_col, F.lit(None).cast("double"))
    chosen = F.broadcast(known.unionByName(pool))  # bounded by the two limits
    rows = docs.join(chosen, docs[id_col] == chosen[key]).dropDuplicates([key])
    views = text_view(F.col(text_col)), meta_view(docs, source_col, lang_col, length_col)
    got = rows.select(F.col(key).alias("id"), F.col(y_col).alias("y"), *(F.array(*v).alias(name) for name, v in zip("tm", views))).orderBy("id").toArrow()  # as numbers, which take a tenth of the room of Python's lists
    t, m = (got[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(got.num_rows, len(v)) for name, v in zip("tm", views))
    y = got["y"].to_numpy().astype(float)
    has = ~np.isnan(y)
    hold = np.arange(int(has.sum())) % 4 == 0
    return co_train(t[has], m[has], y[has], t[~has], m[~has], hold)


def score(docs: DataFrame, model: Model, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars", score_col: str = "score", keep_col: str = "keep") -> DataFrame:
    """Add the probability of good quality and whether it reaches the model's threshold.

    Every row gets both, null and empty texts too, in place of columns of those names; no shuffle
    and no Python takes place.
    """
    t = fresh(docs, "_text_view")
    with_view = docs.withColumn(t, F.array(*text_view(F.col(text_col))))
    n = len(model.text) - 1
    z_text = _dot([F.get(F.col(t), F.lit(k)) for k in range(n)], model.text)
    z_meta = _dot(meta_view(docs, source_col, lang_col, length_col), model.meta)
    c0, ct, cm = model.combine
    z = F.lit(c0) + F.lit(ct) * z_text + F.lit(cm) * z_meta
    scored = with_view.withColumn(score_col, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))
    return scored.withColumn(keep_col, F.col(score_col) >= model.threshold).drop(t)


def keep_good(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """`docs` without the rows that the classifier rejects; columns unchanged."""
    scored_col, keep_col = fresh(docs, "_score"), fresh(docs, "_keep")
    return score(docs, train(docs, labels, **columns), score_col=scored_col, keep_col=keep_col).where(keep_col).drop(scored_col, keep_col)
