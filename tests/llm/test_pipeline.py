"""The pipeline on a small corpus against a brute-force version of every stage."""

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from regspark.llm.queries import tokenizer_file
from tests.llm.test_operators import brute_lines, distance, words

BOILERPLATE = "Read our terms before use\nAll content is provided as is\nWrite to us with questions"
ITEM = "How many litres does a tank of 40 metres hold if Maria fills it with 12 pumps for 3 hours today"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = [], []
    for k in range(80):
        w = words(70, 500 + k)
        bad = k % 4 == 0
        text = " ".join(x + "###" for x in w) if bad else "\n".join(" ".join(w[j : j + 14]) for j in range(0, 70, 14))
        if not bad and k % 5 == 1:
            text = BOILERPLATE + "\n" + text
        docs.append((k, text, "en", f"s{k % 3}", len(text)))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, 0 if bad else 1, 0))
    base = docs[1][1].split("\n")
    docs.append((200, docs[2][1], "en", "s1", 1))  # an exact copy
    docs.append((201, docs[3][1].replace(docs[3][1].split()[20], "altered", 1), "en", "s1", 1))  # a near copy
    docs.append((202, "\n".join(base[3:]) + "\n" + ITEM.replace("40", "70").replace("Maria", "Pedro").replace("12", "9"), "en", "s2", 1))  # asks the item again
    docs += [(203, " ".join(words(60, 999)) + " " + ITEM, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, "another question that no document repeats anywhere at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs


def brute(docs):
    kept = [(d, t) for d, t, *_ in docs if "###" not in t]
    kept = brute_lines(kept)
    label = {d: d for d, _ in kept}
    for i, (a, s) in enumerate(kept):
        for b, t in kept[:i]:
            x, y = s.split(), t.split()
            if min(len(x), len(y)) >= 5 and abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9):
                low, high = sorted((label[a], label[b]))
                label = {d: low if v == high else v for d, v in label.items()}
    kept = [(d, t) for d, t in kept if label[d] == d]
    return {d: t for d, t in kept if "litres does a tank" not in t}


def test_pipeline_against_brute_force(spark, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    d, docs = corpus
    rows = corpus_pipeline.run(spark, d).collect()
    expected = brute(docs)
    assert {r["doc_id"]: r["text"] for r in rows} == expected and len(rows) == len(expected)
    for r in rows:
        assert np.frombuffer(bytes(r["token_ids"]), dtype="<u4").tolist() == reference.encode(r["text"], add_special_tokens=False).ids and r["decoded"] == r["text"]


def test_stages_keep_the_columns(spark, corpus):
    d, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
        assert stage(spark, docs.limit(0), d).count() == 0


def test_registered():
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {k.split("_")[0] for k in entry.queries()}
