"""Operators on tables whose own columns have the names that a helper would take."""

from pyspark.sql import functions as F

from regspark.llm import line_dedup, quality_classifier

TAKEN = ["_doc", "_body", "_gone", "_lines", "_text_md5", "_id", "_y", "_lo", "_hi", "_text_view", "_score", "_keep", "doc", "body", "gone", "hash", "t", "m", "y"]


def crowded(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"mine {c}") for c in TAKEN})


def untouched(df):
    return all(r[c] == f"mine {c}" for r in df.collect() for c in TAKEN)


def test_lines(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, None), (4, ""), (2, "x\na\nb\nc"), (None, "a\nb\nc")]
    plain = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), removed_col="n")
    out = line_dedup.dedup_lines(crowded(spark, rows), removed_col="n")
    assert out.columns == ["doc_id", "text", *TAKEN, "n"] and untouched(out)
    key = lambda r: (str(r["doc_id"]), str(r["text"]), r["n"])
    assert sorted(map(key, out.collect())) == sorted(map(key, plain.collect()))


def test_quality(spark):
    rows = [(k, "good words in a plain sentence, quite long. " * 3 if k % 3 else "#$%& !!! BUY BUY BUY $$$ ### " * 3) for k in range(80)] + [(90, None), (91, ""), (1, "good words in a plain sentence, quite long. " * 3), (None, "no id")]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(60)], "doc_id long, quality int, _y int")
    docs = crowded(spark, rows)
    out = quality_classifier.keep_good(docs, labels)
    assert out.columns == docs.columns and untouched(out)
    kept = {r["doc_id"] for r in out.collect()}
    assert {k for k in range(80) if k % 3} <= kept and not {k for k in range(80) if k % 3 == 0} & kept
