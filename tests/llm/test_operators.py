"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing
names, and against brute force on small fixtures."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspark.llm import bpe, decontamination, language_id, line_dedup, lm_scoring, minhash, quality_classifier, quality_rules, suffix_dedup, toxicity
from regspark.llm.queries import tokenizer_file

random.seed(5)
VOCABULARY = [f"w{k}{'aeiou'[k % 5]}" for k in range(400)]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


LONG = " ".join(words(30_000, 1))
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "same text twice"), (6, "same text twice"), (None, "no id here at all"), (7, "<|endoftext|> é 日本 😀")]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(spark, name):
    return frame(spark, EDGE).withColumn(name, F.lit("mine"))


# ---- BPE -----------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_file("byte_bpe_50k.json")
    reference = tokenizers.Tokenizer.from_file(path)
    texts = [t for _, t in EDGE] + ["x" * 3000, "don't  stop\n\n\nnow 12345 ...", "ab" * 999, "tail   "]
    rows = bpe.encode_decode(frame(spark, list(enumerate(texts))), path).collect()
    for r in rows:
        expected = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["token_ids"]), dtype="<u4").tolist() == expected
        assert r["decoded"] == reference.decode(expected, skip_special_tokens=False)


def test_bpe_empty_table_and_clash(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    assert bpe.encode_decode(frame(spark, []), path).count() == 0
    out = bpe.encode_decode(clashing(spark, "decoded"), path)
    assert out.columns == ["doc_id", "text", "decoded", "token_ids", "decoded_"] and out.count() == len(EDGE)


def test_bpe_cuts_lie_inside_no_token():
    c = bpe.codec(tokenizer_file("byte_bpe_50k.json"))
    raw = bytes(random.Random(2).randrange(256) for _ in range(2000))
    assert b"".join(c.fragments(raw)) == raw
    for token in c.token_bytes[:5000]:
        assert len(c.fragments(token)) <= 1 or token == b"<|endoftext|>"


# ---- quality rules -------------------------------------------------------------------------


def rule_figures(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_against_brute_force(spark):
    loop = " ".join(words(12, 3) * 5 + words(30, 4))
    texts = [t for _, t in EDGE] + [loop, "a b c\n" * 20, "# $ x" * 30, "SHOUT!! " * 40, " ".join(words(60, 9))]
    rows = quality_rules.apply_rules(frame(spark, list(enumerate(texts)))).collect()
    for r in rows:
        figures = rule_figures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == figures
        assert r["base_failed"] == (figures[0] < 20 or 100 * figures[4] > 30 * figures[0])
        assert not (r["base_failed"] and r["kept"])
    assert [r["kept"] for r in rows][-4:] == [False, False, False, True]


def test_quality_rules_empty_and_clash(spark):
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0
    assert quality_rules.apply_rules(clashing(spark, "n_words")).select("n_words").first()[0] == 0
    assert quality_rules.cascade(quality_rules.measure(frame(spark, EDGE)), ()).where("failed_rule IS NOT NULL").count() == 0


# ---- quality classifier --------------------------------------------------------------------


def quality_fixture(spark):
    rows, labels = [], []
    for k in range(240):
        bad = k % 3 == 0
        text = " ".join(w + ("***" if bad else "") for w in words(60, k))
        rows.append((k, text, "en", "spam" if bad and k % 2 else f"s{k % 4}", len(text)))
        if k % 2 == 0:
            labels.append((k, 0 if bad else 1, 0))
    return frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long"), frame(spark, labels, "doc_id long, quality int, toxic int")


def test_quality_classifier_separates_held_out_rows(spark):
    docs, labels = quality_fixture(spark)
    out = quality_classifier.score(docs, quality_classifier.train(docs, labels)).where("doc_id % 2 = 1").collect()
    assert all(r["keep"] == (r["doc_id"] % 3 != 0) for r in out)
    assert quality_classifier.keep_good(docs, labels).columns == docs.columns


def test_quality_classifier_edges(spark):
    docs, labels = quality_fixture(spark)
    odd = frame(spark, [(None, None, None, None, None), (1, "", None, "x", -5)], docs.schema)
    model = quality_classifier.train(docs, labels)
    assert quality_classifier.score(odd, model).where("score BETWEEN 0 AND 1").count() == 2
    assert quality_classifier.keep_good(odd, labels.limit(0)).count() == 2  # nothing learned: everything stays
    assert quality_classifier.keep_good(docs.limit(0), labels).count() == 0


# ---- language ------------------------------------------------------------------------------


def language_fixture(spark):
    sets = {"aa": "the and of house water going under mother".split(), "bb": "der und von haus wasser gehen unter mutter".split()}
    rows = [(k, " ".join(random.Random(k).choices(sets[lang], k=25)), lang) for k, lang in ((k, "aabb"[2 * (k % 2) : 2 * (k % 2) + 2]) for k in range(60))]
    return frame(spark, rows, "doc_id long, text string, lang string")


def test_language_id(spark):
    docs = language_fixture(spark)
    model = language_id.train(docs.where("doc_id < 40"), tokenizer_file("piece_bpe_32k.model"))
    out = language_id.predict(docs.where("doc_id >= 40").select("doc_id", "text", F.col("lang").alias("true")), model).collect()
    assert all(r["lang_pred"] == r["true"] and 0.5 < r["score"] <= 1 for r in out)


def test_language_id_edges(spark):
    docs = language_fixture(spark)
    path = tokenizer_file("piece_bpe_32k.model")
    model = language_id.train(docs, path)
    out = {(r["doc_id"], r["lang_pred"]) for r in language_id.predict(frame(spark, [(1, None), (2, ""), (3, "12 34 !"), (4, "x" * 100_000)]), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= out and len(out) == 4
    numerals = language_id.predict(frame(spark, [(1, "½ ² ① Ⅷ 12"), (2, "½ water")]), model).collect()
    assert [(r["lang_pred"], r["score"] > 0) for r in sorted(numerals)] == [("und", False), ("aa", True)]
    assert language_id.predict(docs.limit(0), model).count() == 0
    nothing = language_id.train(docs.limit(0), path)
    assert {r["lang_pred"] for r in language_id.predict(docs.select("doc_id", "text"), nothing).collect()} == {"und"}
    assert "score_" in language_id.predict(clashing(spark, "score"), model).columns


def test_language_of_every_row_is_learned_once(spark):
    rows = [(k % 3, f"only this text {'abc'[k % 3]}", f"l{k % 3}") for k in range(30)]  # repeated rows, and ids that tie with themselves
    docs = frame(spark, rows, "doc_id long, text string, lang string").withColumn("_id", F.lit(1)).withColumn("_lang", F.lit("x"))
    model = language_id.train(docs, tokenizer_file("piece_bpe_32k.model"))
    assert model.langs == ("l0", "l1", "l2") and np.allclose(model.table[:, 0].sum(), 1, atol=1e-3)
    many = frame(spark, [(k, f"word{chr(97 + k % 26)}", f"lang{k:03d}") for k in range(70)], "doc_id long, text string, lang string")
    assert len(language_id.train(many, tokenizer_file("piece_bpe_32k.model")).langs) == 70


def test_long_words_against_logarithms():
    vocabulary = {"▁": 0, "a": 1, "▁a": 2, "aa": 3}
    table = np.array([[0.2], [0.3], [0.1], [0.05], [1e-7]])
    n = 3000
    logs = np.full(n + 2, -np.inf)  # forward sums in logarithms, position 1 being the word's start mark
    logs[0], logs[1] = 0.0, math.log(0.2)
    logs[2] = np.logaddexp(math.log(0.1), logs[1] + math.log(0.3))
    for k in range(3, n + 2):
        logs[k] = np.logaddexp(logs[k - 1] + math.log(0.3), logs[k - 2] + math.log(0.05) if k - 2 >= 1 else -np.inf)
    ((_, found),) = language_id.forward(["a" * n], vocabulary, table)
    assert math.isclose(found[0, 0], logs[n + 1], rel_tol=1e-9)


def test_forward_sums_all_segmentations():
    vocabulary, table = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}, np.array([[0.1], [0.2], [0.3], [0.15], [0.25], [1e-7]])
    ((_, logs),) = language_id.forward(["ab"], vocabulary, table)
    expected = 0.1 * 0.2 * 0.3 + 0.1 * 0.15 + 0.25 * 0.3
    assert math.isclose(math.exp(logs[0, 0]), expected, rel_tol=1e-9)


# ---- language model ------------------------------------------------------------------------


def test_lm_base_figures_and_gain(spark):
    rows = [(k, " ".join(w for pair in [random.Random(k).choice((("red", "house"), ("blue", "Sea"), ("old", "tree"))) for _ in range(40)] for w in pair)) for k in range(120)] + [(900, None), (901, ""), (901, "zzz unseen")]
    docs = frame(spark, rows)
    learned = docs.where("doc_id < 100")
    counts = lm_scoring.count_words(learned)
    out = {(r["doc_id"], r["n_tokens"]): r for r in lm_scoring.score(docs, lm_scoring.train(learned, counts, passes=2), counts).collect()}
    c = collections.Counter(w for k, t in rows if k < 100 for w in lm_scoring.tokens(t))
    n, v = sum(c.values()), len(c)
    for k, t in rows:
        w = lm_scoring.tokens(t)
        r = out[k, len(w)]
        assert r["n_known"] == sum(c[x] > 0 for x in w) and r["train_tokens"] == n
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), abs_tol=1e-6)
    assert all(out[k, 81]["score"] > out[k, 81]["base_score"] for k in range(100, 120))


def test_lm_probabilities_sum_to_one():
    p = lm_scoring._start(6)
    pair, bias, norm = lm_scoring.normalise(p, np.log(np.full(6, 1 / 6)))
    for a in range(6):
        for b in range(6):
            assert math.isclose(np.exp(pair[0][a] + pair[1][b] + bias - norm[a, b]).sum(), 1, rel_tol=1e-4)


def test_lm_empty_corpus(spark):
    docs = frame(spark, EDGE)
    counts = lm_scoring.count_words(docs.limit(0))
    assert lm_scoring.score(docs, lm_scoring.train(docs.limit(0), counts), counts).where("n_known = 0").count() == len(EDGE)


# ---- decontamination -----------------------------------------------------------------------


def test_decontamination(spark):
    item = "If Anna buys 12 apples for 30 dollars in Quito how much does every apple cost her today"
    again = "If Peter buys 45 apples for 90 dollars in Lima how much does every apple cost her today"
    mixed = "If Peter buys 45 apples for 90 dollars in Lima how much does every apple cost her"
    twice = "Say Anna met Anna and Anna said that 5 plus 5 is more than 5 every single day"
    broken = "Say Bob met Carl and Dora said that 1 plus 2 is more than 3 every single day"
    docs = [(1, "Intro text. " + item + " and more"), (2, again), (3, "nothing of the kind is in this text at all"), (4, None), (5, ""), (None, item), (6, broken), (7, mixed), (8, item), (8, item)]
    bench = frame(spark, [(10, item), (11, None), (12, ""), (13, "too short"), (14, twice)], "item_id long, text string")
    got = {(r["id"], r["item"]) for r in decontamination.contaminated(frame(spark, docs), bench).collect()}
    assert got == {(1, 10), (2, 10), (None, 10), (7, 10), (8, 10)}
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(frame(spark, docs), bench).collect()) == [3, 4, 5, 6]
    assert decontamination.decontaminate(clashing(spark, "hash"), bench.limit(0)).columns == ["doc_id", "text", "hash"]


def test_an_item_that_leaks_twice_is_found(spark):
    item = "If Anna buys 12 apples for 30 dollars in Quito how much does every apple cost her today"
    again = "If Peter buys 45 apples for 90 dollars in Lima how much does every apple cost her today"
    third = again.replace("Peter", "Olga").replace("Lima", "Oslo").replace("45", "7")
    broken = "Say Bob met Carl and Dora said that 1 plus 2 is more than 3 every single day"
    twice = "Say Anna met Anna and Anna said that 5 plus 5 is more than 5 every single day"
    other = "Say Ed met Fay and Gus said that 4 plus 6 is more than 8 every single day"
    long = "much else is said " * 300
    docs = [(1, f"{long}. {item} {long}. {again} {long}"), (2, f"{again} {third}"), (None, f"{again} {item} {third}"), (3, f"{broken} {long} {other}"), (4, f"{broken} {twice}"), (5, f"{item[:44]} {long} {again[44:]}")]
    bench = frame(spark, [(10, item), (14, twice)], "item_id long, text string")
    got = {(r["id"], r["item"]): r["consistent"] for r in decontamination.contaminated(frame(spark, docs), bench).collect()}
    assert got == {(1, 10): 1.0, (2, 10): 1.0, (None, 10): 1.0, (4, 14): 1.0}


# ---- MinHash -------------------------------------------------------------------------------


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_alignment_against_full_table():
    r = random.Random(3)
    for _ in range(500):
        a = [r.choice("abcd") for _ in range(r.randint(0, 12))]
        b = [x for x in a if r.random() > 0.1]
        if b and r.random() < 0.5:
            b[r.randrange(len(b))] = "z"
        assert minhash.similar(" ".join(a), " ".join(b), 0.7) == (distance(a, b) <= int(0.3 * max(len(a), len(b)) + 1e-9))


def test_alignment_of_longer_texts():
    r = random.Random(4)
    for k in range(60):
        a = [r.choice("abcdefgh") for _ in range(r.randint(60, 320))]
        b = [r.choice("abcdefgh") if r.random() < k % 10 / 40 else x for x in a if r.random() > 0.03]
        b = b[r.randint(0, 20) :]
        d = distance(a, b)
        for most in (d - 1, d, d + 1, d + 40):
            if abs(len(a) - len(b)) <= most:
                p, q = (np.array([ord(x) for x in t]) for t in (a, b))
                assert minhash._edits_within(p, q, most) == (d <= most)


def test_near_duplicates(spark):
    base, other = words(200, 11), words(200, 12)
    near = list(base)
    near[50], near[120] = "changed", "also"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(other)), (5, None), (6, ""), (7, ""), (8, "a few words"), (None, " ".join(base)), (9, LONG)]
    rows += [(100 + k, " ".join(w if j != k else "x" for j, w in enumerate(other))) for k in range(150)]  # more than are paired
    out = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, rows)).collect() if r["doc_id"] is not None}
    assert [out[k]["class_id"] for k in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [1, 1, 1, 4, 5, 6, 6, 8, 9]
    assert all(out[100 + k]["class_id"] == 4 for k in range(150)) and out[3]["copy_of"] == 1
    left = [r["doc_id"] for r in minhash.keep_one(frame(spark, rows)).collect()]
    assert sorted(x for x in left if x is not None) == [1, 4, 5, 6, 8, 9] and None in left
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def classes_by_brute_force(texts):
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            x, y = texts[a].split(), texts[b].split()
            most = int(0.2 * max(len(x), len(y)) + 1e-9)
            if label[a] != label[b] and abs(len(x) - len(y)) <= most and (x == y or distance(x, y) <= most):
                low, high = sorted((label[a], label[b]))
                label = [low if v == high else v for v in label]
    return label


def edited(text, share, seed):
    r = random.Random(seed)
    at = set(r.sample(range(len(text)), int(share * len(text) + 1e-9)))
    return [f"new{seed}x{k}" if k in at else w for k, w in enumerate(text)]


def test_no_link_of_a_large_group_is_left_out(spark, monkeypatch):
    texts = []
    for k in range(45):  # chains of four: each resembles the next one and no other
        text = words(60, 1000 + k)
        for step in range(4):
            text = text[: 12 * step] + words(12, 5000 + 4 * k + step) + text[12 * step + 12 :]
            texts.append(" ".join(text))
    common = words(36, 4)  # one passage in all of these, which links few of them
    texts += [" ".join(common + words(14 + k % 5, 9000 + k)) for k in range(60)]
    texts += [" ".join(edited((common + words(14 + k % 5, 9000 + k)), 0.1, k)) for k in range(0, 60, 3)]
    everything_in_one_group = lambda rows: rows.selectExpr("30L AS sketch", "node", "size(split(text, ' ')) AS n")
    monkeypatch.setattr(minhash, "_sketched", everything_in_one_group)
    out = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert [out[k] for k in range(len(texts))] == classes_by_brute_force(texts)


@pytest.mark.parametrize("n", [20, 50, 120, 200, 1000])
def test_candidates_at_the_threshold(n):
    met = 0
    for k in range(200):
        a = [f"w{x}" for x in np.random.default_rng(k).integers(0, 20_000, n)]
        b = edited(a, 0.2, k)
        assert minhash.similar(" ".join(a), " ".join(b))
        of, found, _ = minhash.sketch_texts([" ".join(a), " ".join(b)])
        met += bool(set(found[of == 0].tolist()) & set(found[of == 1].tolist()))
    assert met >= 0.87 * 200


def test_short_texts(spark):
    texts = ["one two three", "one  two\tthree", "one two four", "five six seven eight nine", "five six seven eight ten", "a", "b", "a ", "k l m n o p q r s t", "k l m n o X q r s t"]
    out = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert [out[k] for k in range(len(texts))] == [0, 0, 2, 3, 3, 5, 6, 5, 8, 8]


def test_near_duplicates_with_text_ids_and_clashing_columns(spark):
    a, b = " ".join(words(40, 1)), " ".join(words(40, 2))
    rows = frame(spark, [("p", a, 1, 2, 3), ("q", a, 4, 5, 6), ("q", a, 4, 5, 6), ("r", b, 7, 8, 9), (None, b, 0, 0, 0)], "doc_id string, text string, _node long, node long, _class long")
    assert {(r["doc_id"], r["class_id"]) for r in minhash.near_duplicates(rows).collect()} == {("p", "p"), ("q", "p"), ("r", "r"), (None, None)}
    left = minhash.keep_one(rows)
    assert left.columns == rows.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["None", "p", "r"]


def test_sketches_do_not_depend_on_the_batch():
    texts = [" ".join(words(n, n)) for n in (1, 3, 5, 6, 40, 300)] + [LONG, "", "same"]
    of, found, sizes = minhash.sketch_texts(texts)
    for k, text in enumerate(texts):
        _, alone, size = minhash.sketch_texts([text])
        assert found[of == k].tolist() == alone.tolist() and sizes[k] == size[0] == len(text.split())


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["label"]) for r in minhash.components(edges).collect()} == {(k, 0) for k in range(31)} | {(100, 100), (101, 100)}


# ---- line dedup ----------------------------------------------------------------------------


def brute_lines(rows):
    seen, out = set(), []
    for doc, text in sorted(((d, t) for d, t in rows), key=lambda x: x[0]):
        parts = text.split("\n")
        real = [k for k, x in enumerate(parts) if x.strip()]
        gone, own = set(), []
        for k in range(len(real) - 2):
            g = tuple(parts[j].strip() for j in real[k : k + 3])
            if g in seen:
                gone |= set(real[k : k + 3])
            seen.add(g)
        out.append((doc, "\n".join(x for k, x in enumerate(parts) if k not in gone)))
    return out


def test_line_dedup_against_brute_force(spark):
    r = random.Random(8)
    rows = [(k, "\n".join(r.choice("abcd ") for _ in range(r.randint(0, 14)))) for k in range(60)]
    assert sorted((x["doc_id"], x["text"]) for x in line_dedup.dedup_lines(frame(spark, rows)).collect()) == brute_lines(rows)


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    out = line_dedup.dedup_lines(clashing(spark, "n_removed_"))
    assert out.columns == ["doc_id", "text", "n_removed_"] and out.count() == len(EDGE)
    assert out.where("doc_id = 1").first()["text"] is None


# ---- suffix dedup --------------------------------------------------------------------------


def brute_repeats(rows):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    out = []
    for (doc, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("runs", [256, 1])
def test_suffix_dedup_against_brute_force(spark, runs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TASK_RUNS", runs)
    passage = " ".join(words(130, 21))
    rows = [(k, " ".join(words(30 + k, 100 + k)) + " " + passage[k : 700 + k] + " " + " ".join(words(20, 200 + k))) for k in range(12)]
    rows += [(50, passage), (51, passage), (52, "é" * 900), (53, None), (54, ""), (55, "short"), (56, "x" * 399), (None, " ".join(words(200, 77)))]
    out = suffix_dedup.remove_repeats(frame(spark, rows)).withColumn("sha", F.sha2("kept", 256)).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in out), key=str) == brute_repeats(rows)


def test_previous_factors_against_brute_force():
    r = np.random.default_rng(4)
    data = r.integers(1, 3, 300)
    found = dict(zip(*suffix_dedup.previous_factors(data, 8)))
    for i in range(300):
        best = max((next((k for k in range(300 - i) if data[j + k] != data[i + k]), 300 - i) for j in range(i)), default=0)
        assert (i in found) == (best >= 8)
        if i in found:
            j = found[i]
            assert j < i and (data[j : j + 8] == data[i : i + 8]).all()


def test_suffix_dedup_empty(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


# ---- toxicity ------------------------------------------------------------------------------


def test_toxicity(spark):
    bad = ["grumblefoot", "snarkwart", "blightnose"]
    rows, labels = [], []
    for k in range(300):
        w = words(50, 1000 + k)
        if k % 3 == 0:
            w[random.Random(k).randrange(50)] = bad[k % 9 // 3]
            w[random.Random(k + 1).randrange(50)] = bad[(k + 1) % 3]
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(k % 3 == 0)))
    docs, lab = frame(spark, rows), frame(spark, labels, "doc_id long, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    out = toxicity.score(docs, toxicity.train(docs, lab.where(~held))).where(held).collect()
    right = [(r["predicted"] == 1) == (r["doc_id"] % 3 == 0) for r in out]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in out) and np.mean(right) > 0.95


def test_toxicity_score_against_brute_force(spark):
    rows = [(k, " ".join(words(30, 3000 + k) + (["grumblefoot"] if k % 2 else []))) for k in range(120)]
    docs = frame(spark, rows).withColumn("_id", F.lit(7)).withColumn("y", F.lit(0))
    model = toxicity.train(docs, frame(spark, [(k, 1, k % 2) for k in range(100)] + [(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int"))
    import zstandard

    settings = zstandard.ZstdCompressionParameters(compression_level=5, min_match=4, strategy=zstandard.STRATEGY_LAZY, window_log=17, chain_log=16, hash_log=16, search_log=6, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

    def length(window, dictionary):  # compressed from nothing but the dictionary, each time anew
        data = zstandard.ZstdCompressionDict(dictionary + toxicity.TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=data, compression_params=settings).compress(b" " + window + b" " + toxicity.TAIL))

    for r in toxicity.score(docs.where("doc_id >= 100"), model).collect():
        d = [length(w, model.ordinary) - length(w, model.toxic) for w in r["text"].lower().encode().split()]
        counts = [sum(x >= k for x in d) for k in toxicity.STEPS]
        x = [math.log1p(c) for c in counts] + [min(1.0, 20 * c / len(d)) for c in counts]
        z = sum(a * b for a, b in zip(x, model.weights)) + model.weights[-1]
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
        assert (r["predicted"] == 1) == (r["doc_id"] % 2 == 1)


def test_toxicity_edges(spark):
    model = toxicity.train(frame(spark, EDGE), frame(spark, [], "doc_id long, quality int, toxic int"))
    out = toxicity.score(clashing(spark, "score"), model)
    assert out.columns == ["doc_id", "text", "score", "score_", "predicted"] and out.where("score_ BETWEEN 0 AND 1").count() == len(EDGE)
    assert toxicity.score(frame(spark, []), model).count() == 0


def joined_rows(df):
    """Rows that the joins on word classes made for a table, once it is collected."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif kind in ("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage"):
            todo.append(node.plan())
        else:
            if "Join" in kind and "class_b" in node.simpleString(100):
                found += node.metrics().apply("numOutputRows").value()
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_minhash_join_leaves_out_texts_that_share_a_line_and_some_words(spark):
    # 60 texts of which one line makes 75 %, and which share a few of their other words: every pair meets, two copies with few edits are similar.
    rng = random.Random(7)
    line = [f"line{k}" for k in range(15)] * 10
    texts = [line + [f"own{t}_{k}" for k in range(44)] + [f"shared{k}" for k in rng.sample(range(12), 6)] for t in range(60)]
    texts += [t[:150] + [f"new{k}_{i}" for k in range(20)] + t[170:] for i, t in enumerate(texts[:2])]
    rows = [(node, node, " ".join(t)) for node, t in enumerate(texts)]
    members = [(1, node, len(t), node) for node, t in enumerate(texts)]
    found = minhash._open_pairs(frame(spark, members, "sketch long, node long, n int, label long"), frame(spark, rows, "node long, second long, text string"))
    assert {(r["a"], r["b"]) for r in found.collect()} == {(0, 60), (1, 61)}
    assert 0 < joined_rows(found) < 100  # of 1,891 pairs


def test_minhash_bits_never_tell_more_lost_than_there_are(spark):
    rng = np.random.default_rng(3)
    frequent = np.sort(rng.choice(minhash.WORD_CLASSES, minhash.FREQUENT_BITS, replace=False)).astype(np.int64)
    sets = [np.unique(np.concatenate([rng.choice(frequent, k), rng.integers(0, minhash.WORD_CLASSES, 3 * k)])) for k in (0, 5, 100, 2000)]
    rows = [(i, j, minhash._class_bits(x, frequent).tolist(), minhash._class_bits(y, frequent).tolist(), len(np.setdiff1d(x, y))) for i, x in enumerate(sets) for j, y in enumerate(sets)]
    df = spark.createDataFrame(rows, "i int, j int, x array<long>, y array<long>, lost int")
    assert df.where(f"{minhash._lost_bits('x', 'y')} > lost").count() == 0
    assert df.where(f"i = 2 AND j = 1 AND {minhash._lost_bits('x', 'y')} > 0.9 * lost").count() == 1
    assert len(minhash._class_bits(sets[1], frequent[:0])) * 64 == minhash.FREQUENT_BITS + minhash.OTHER_BITS


def test_minhash_pairs_that_share_one_repeated_line_are_ruled_out_by_their_words(spark):
    # 75 % of each text is one line; the rest differs, in words that fall into a bin each of the other text's.
    line, n = [f"line{k}" for k in range(15)] * 10, 50
    texts = [" ".join(line + [f"w{t}_{k}" for k in range(n)]) for t in range(2)]
    near = " ".join(line + [f"w0_{k}" for k in range(n - 20)] + [f"z{k}" for k in range(20)])
    rows = []
    for node, text in enumerate([*texts, near]):
        words, _ = minhash.word_hashes([text])
        rows.append((node, len(words), minhash._word_classes(words).tolist()))
    a = spark.createDataFrame(rows, "a long, n int, classes_a array<int>")
    b = spark.createDataFrame(rows, "b long, n_b int, classes_b array<int>")
    kept = {(r["a"], r["b"]) for r in minhash._without_lost(a.crossJoin(b).where("a < b")).collect()}
    assert kept == {(0, 2)}
    assert [(i, j) for i, x in enumerate([*texts, near]) for j, y in enumerate([*texts, near]) if i < j and minhash.similar(x, y)] == [(0, 2)]
