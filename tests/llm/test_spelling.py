"""Spelling variants against brute force: edit distances over all pairs, and counts one by one."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from regspark.llm import spelling

LETTERS = "abcdeé"


def apart(a, b):
    """The edit distance by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def vocabulary(n, seed, least=6, most=9, letters=LETTERS):
    """Random words with many near ones."""
    r = random.Random(seed)
    found = set()
    while len(found) < n:
        w = "".join(r.choice(letters) for _ in range(r.randint(least, most)))
        found.add(w)
        for _ in range(3):
            at = r.randrange(len(w))
            found.add(r.choice((w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1 :])))
    return sorted(w for w in found if len(w) >= least)


def brute(counts, ratio=5):
    near = {w: [o for o in counts if o != w and abs(len(o) - len(w)) < 2 and apart(w, o) == 1] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("least, most, letters", [(1, 4, "ab"), (6, 9, LETTERS), (63, 66, "ab"), (6, 8, "a😀日")])
def test_bitsets_against_the_full_table(least, most, letters):
    words = vocabulary(20 if most == 4 else 150, least, least, most, letters)
    left, right = spelling.near_in(words)
    found = list(zip(left.tolist(), right.tolist()))
    assert len(found) == len(set(found))
    assert set(found) == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and abs(len(a) - len(b)) < 2 and apart(a, b) == 1}


@pytest.mark.parametrize("cell_words", [7, 4_096])
def test_groups_against_brute_force(spark, cell_words, monkeypatch):
    """Also with halves that are split into many chunks: a third of the words begin alike."""
    monkeypatch.setattr(spelling.near_words, "__defaults__", (cell_words,))
    r = random.Random(3)
    words = vocabulary(220, 3) + ["prefix" + w for w in vocabulary(110, 4, 2, 4)]
    counts = {w: int(5 * 6 ** r.randint(0, 4)) + r.randint(0, 3) for w in words}
    got = as_dict(spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts)
    assert sum(v[1] not in (w, v[0]) for w, v in got.items()) > 0  # chains of two steps


EDGE = [(1, None), (2, ""), (3, "!!! 12 \n"), (4, "Ärger ÄRGER ärger Straße STRASSE łódź"), (5, "wordswords " * 7), (5, "wordswords " * 7), (None, "wordswerds " * 2), (6, "q" * 70_000 + " " + "wordswords"), (7, "日本" * 9)]


@pytest.mark.parametrize("every", [None, 2])
def test_counts_against_brute_force(spark, every):
    docs = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("word", F.lit("mine")).withColumn("n", F.lit(0))
    expected = collections.Counter()
    for name, text in EDGE:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({k: k + 32 for k in range(65, 91)})
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            expected[run] += 1
    got = {r["word"]: r["n"] for r in spelling.count_words(docs, min_count=2, misspell_every=every).collect()}
    assert got == {w: n for w, n in expected.items() if len(w) >= 6 and n >= 2}


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TASK_COUNTS", 1)
    docs = spark.createDataFrame([(k, "letters letters others") for k in range(9)], "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.count_words(docs).collect()} == {"letters": 18, "others": 9}


def test_empty_and_ties(spark):
    assert spelling.spelling_groups(spelling.count_words(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    counts = {"abcdef": 1, "abcdeg": 9, "abcdeh": 9, "zzzzzzzz": 4}
    got = as_dict(spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got["abcdef"] == ("abcdeg", "abcdeg", 1, 2, 9) and got["zzzzzzzz"] == (None, "zzzzzzzz", 4, 0, None)
