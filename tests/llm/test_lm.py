"""The language model whatever the layout of the table, and its score against a plain sum over tokens."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspark.llm import lm_scoring

PAIRS = [("red", "house"), ("blue", "Sea"), ("old", "tree"), ("tall", "mast")]


def corpus(n):
    r = random.Random(3)
    text = lambda k: " ".join(w for _ in range(40) for w in (*r.choice(PAIRS), r.choice(["and", "or", f"rare{k % 17}", f"once{k}"])))
    return [(k, text(k)) for k in range(n)]


def per_token(spark, docs, parts):
    learned = docs.repartition(parts)
    counts = lm_scoring.count_words(learned)
    out = lm_scoring.score(docs, lm_scoring.train(learned, counts), counts).agg(F.sum("score"), F.sum("n_tokens"), F.sum("base_score")).first()
    return out[0] / out[1], out[2] / out[1]


@pytest.mark.parametrize("shard", [2_000_000, 4_000])
def test_score_does_not_depend_on_partitions(spark, monkeypatch, shard):
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", shard)  # all in one shard, and some seven averaged copies
    docs = spark.createDataFrame([*corpus(240), (900, None), (901, ""), (None, "red house"), (None, "red house")], "doc_id long, text string").withColumns({"h": F.lit("mine"), "v": F.array(F.lit(1))})
    got = [per_token(spark, docs, parts) for parts in (1, 8, 64)]
    assert max(s for s, _ in got) - min(s for s, _ in got) < 1e-6
    assert all(s > base + 0.05 for s, base in got)


def test_copies_under_other_ids_part(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same' ELSE concat('text ', id) END AS text")
    sizes = [r["n"] for r in lm_scoring.dealt(lm_scoring.hashed(docs), 8).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 650


def test_score_against_a_sum_over_tokens(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CLASSES", 6)
    monkeypatch.setattr(lm_scoring, "HELD_WORDS", 14)
    rows = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm_scoring.count_words(docs)
    m = lm_scoring.train(docs, counts)
    assert len(m.classes) == 7 and m.held and m.distinct > len(m.classes) + len(m.held)
    c = collections.Counter(w for _, t in rows for w in lm_scoring.tokens(t))
    rare_n = sum(n for w, n in c.items() if w not in m.classes)
    rare_v = sum(w not in m.classes for w in c)
    asked = [*rows[:5], (100, None), (101, ""), (102, "RED zzz house zzz once3"), (103, "rare1 " * 700), (102, "RED zzz house zzz once3")]
    out = collections.defaultdict(list)
    for r in lm_scoring.score(spark.createDataFrame(asked, "doc_id long, text string"), m, counts).collect():
        out[r["doc_id"]].append(r["score"])
    for k, text in asked:
        before = last = m.classes[lm_scoring.END]
        expected = 0.0
        for w in lm_scoring.tokens(text):
            at = m.classes.get(w, m.rare)
            weights = np.exp((m.pair[0][before] + m.pair[1][last] + m.bias).astype(float))
            expected += math.log10(weights[at] / weights.sum())
            if at == m.rare:
                expected += math.log10((c[w] + 1) / (rare_n + rare_v + 1))
            before, last = last, at
        assert len(out[k]) == (2 if k == 102 else 1) and all(math.isclose(s, expected, rel_tol=1e-4) for s in out[k])
