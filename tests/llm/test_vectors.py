"""Whitening against numpy's eigenvalues and whole-number covariance; top-k search against all products."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspark.llm import top_k, whitening

NAN, INF = float("nan"), float("inf")


def table(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def random_rows(n, d, seed, spread=None):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d)) * (spread if spread is not None else np.linspace(1, 3, d))
    return [(k, v) for k, v in enumerate(x.tolist())]


# ---- whitening -----------------------------------------------------------------------------


def test_inertia_counts_eigenvalues():
    r = np.random.default_rng(2)
    for d in (1, 2, 7, 40):
        a = r.standard_normal((d, d))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in (*((values[1:] + values[:-1]) / 2), values[0] - 1, values[-1] + 1):
            assert whitening.inertia(a, shift) == (values > shift).sum()
    assert whitening.inertia(np.array([[0, 1.0], [1, 0]]), 0.0) == 1  # both diagonal pivots are zero


@pytest.mark.parametrize("values", [np.linspace(1, 9, 30), np.array([5.0] * 6 + [2.0] * 8 + [0.0] * 6), np.array([3.0, 3 + 1e-13, 1, 0, 0]), 10.0 ** -np.arange(12), np.array([4.0])])
def test_leading_eigenvalues(values):
    q = np.linalg.qr(np.random.default_rng(4).standard_normal((len(values),) * 2))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    got, v = whitening.leading(a)
    expected = np.sort(values)[::-1][:16]
    assert np.allclose(got, expected[: len(got)], rtol=1e-12, atol=1e-13) and len(got) == min(16, (values > 1e-12).sum())
    assert np.abs(v.T @ v - np.eye(len(got))).max() < 1e-13 and np.abs(a @ v - v * got).max() < 1e-13 * a.trace()


def brute_whiten(rows, most=16):
    used = [(k, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for k, v in rows]
    fit = sorted({tuple(v) for _, v in used})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    centred = [[v[j] - Fraction(sums[j], n) for j in range(d)] for v in fit]
    cov = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    whitened = np.array([[float(v[j] - Fraction(sums[j], n)) for j in range(d)] for _, v in used]) @ u / np.sqrt(e)
    return n, [sum((n * v[j] - sums[j]) ** 2 for j in range(d)) for _, v in used], whitened, e / cov.trace()


@pytest.mark.parametrize("d", [3, 20])
def test_whitening_against_brute_force(spark, d):
    rows = random_rows(60, d, d)
    rows += [(100 + k, rows[0][1]) for k in range(40)] + [(7, rows[7][1])]  # one vector holds a third of all rows
    odd = [(200, None), (201, [1.0] * (d - 1) + [None]), (202, [NAN] * d), (203, [INF] + [0.0] * (d - 1)), (204, []), (205, [1.0] * (d + 1))]
    n, deviation, whitened, explained = brute_whiten(rows)
    got = whitening.whiten(table(spark, rows + odd).repartition(5)).collect()
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    k = min(16, d)
    assert set(by_row) == {i for i, _ in rows} and all(set(c) == set(range(1, k + 1)) for c in by_row.values())
    assert len(by_row[7][1]) == 2 and len(got) == len(rows) * k
    sign = [1 if by_row[0][c + 1][0]["whitened"] * whitened[0][c] > 0 else -1 for c in range(k)]
    for at, (i, _) in enumerate(rows):
        for c in range(k):
            r = by_row[i][c + 1][0]
            assert (r["n"], r["deviation"]) == (n, deviation[at])
            assert r["whitened"] == pytest.approx(sign[c] * whitened[at][c], rel=1e-9, abs=1e-11)
            assert r["explained"] == pytest.approx(explained[c], rel=1e-10) and 0 <= r["identity_error"] < 1e-10


def test_whitening_edges(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one vector: no variance
    flat = whitening.whiten(table(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [4.0, 0.0])])).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1)  # no second direction
    named = table(spark, random_rows(9, 2, 1), "float").withColumns({"n": F.lit("mine"), "_x": F.lit("x"), "_whitened": F.lit("w"), "component": F.lit(0)})
    out = whitening.whiten(named)
    assert out.columns == ["vec_id", "embedding", "_x", "_whitened", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert {(r["_x"], r["_whitened"], r["n"]) for r in out.collect()} == {("x", "w", 9)}
    huge = whitening.whiten(table(spark, [(1, [3e9, 1.0]), (2, [-3e9, 2.0]), (3, [0.0, 9.0])])).collect()
    assert huge[0]["deviation"] is None and huge[0]["identity_error"] < 1e-4  # the sum of squares is no long


# ---- top-k ---------------------------------------------------------------------------------


def brute_top(queries, rows, k=5):
    def whole(v):
        return [int(np.floor(256 * c)) for c in v]

    good = {(i, tuple(whole(v))) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and i is not None}
    out = {}
    for i, v in queries:
        q = whole(v)
        ranked = sorted((-min(2**63 - 1, sum(a * b for a, b in zip(q, c))), j) for j, c in good if j != i)[:k]
        out[i] = [(r, j, -s) for r, (s, j) in enumerate(ranked, 1)]
    return out


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


ODD = [(900, None), (901, [None] * 6), (902, [NAN] * 6), (903, [INF] * 6), (None, [9.0] * 6)]


@pytest.mark.parametrize("spread", ["equal", "lengths", "clusters"])
def test_search_against_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(top_k, "BUCKET_ROWS", 40)
    monkeypatch.setattr(top_k, "LEAST_ROWS", 10)
    r = np.random.default_rng(1)
    x = r.standard_normal((400, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if spread == "lengths":
        x *= (10.0 ** r.uniform(-2, 2, 400))[:, None]
    if spread == "clusters":
        x = np.repeat(x[:8], 50, axis=0) + 0.02 * r.standard_normal((400, 6))
    x[100:230] = x[100]  # one vector holds a third of all rows: ties
    rows = [(k, v) for k, v in enumerate(x.tolist())]
    queries = [(k, v) for k, v in rows if k % 7 == 0]
    got = as_lists(top_k.search(table(spark, queries + ODD[:4]), table(spark, rows + rows[:9] + ODD).withColumn("score", F.lit("mine")).withColumn("x", F.lit(0)).repartition(6)))
    assert got == brute_top(queries, rows)


def test_both_ways_of_pruning_are_taken(monkeypatch):
    r = np.random.default_rng(5)
    for noise, coordinate in ((0.01, True), (3.0, False)):
        x = np.eye(8)[r.integers(0, 8, 3000)] + noise * r.standard_normal((3000, 8))
        x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
        x = x[np.argsort(-(x**2).sum(axis=1), kind="stable")]
        bucket, q = top_k.Bucket(np.arange(3000), x), x[::100]
        scores = q @ x.T
        floors = np.sort(scores, axis=1)[:, -6]
        sizes = []
        monkeypatch.setattr(top_k, "products", lambda a, b, f=top_k.products, sizes=sizes: sizes.append(len(b)) or f(a, b))
        got = {i: list(zip(ids.tolist(), s.tolist())) for i, ids, s in bucket.search(np.arange(3000)[::100], q, floors)}
        monkeypatch.undo()
        for i in range(len(q)):
            assert got[i] == [(j, int(scores[i][j])) for j in sorted((j for j in range(3000) if j != 100 * i), key=lambda j: (-scores[i][j], j))[:5]]
        assert (max(sizes) < 1500) is coordinate and (len(sizes) == len(q)) is coordinate


def test_search_edges(spark):
    empty = table(spark, [])
    assert top_k.search(empty, empty).count() == 0 and top_k.search(empty, table(spark, [(1, [1.0])])).count() == 0
    few = [(0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, [-1.0, -5.0])]
    assert as_lists(top_k.search(table(spark, few), table(spark, few)))[0] == [(1, 1, 65536), (2, 2, 0), (3, 3, -720896)]
    huge = [(0, [1e12, 1.0]), (1, [1e12, 3.0]), (2, [1e12, 2.0]), (3, [1e300, 0.0])]
    got = as_lists(top_k.search(table(spark, huge), table(spark, huge)))
    assert [v for _, v, _ in got[0]] == [1, 2, 3] and got[0][0][2] == 2**63 - 1  # beyond a long all are equal
    wide = [(0, [2.0**40, 1.0]), (1, [1.0, 2.0**38]), (2, [1.0, 2.0**38 + 1]), (3, [1.0, 1.0])]
    assert as_lists(top_k.search(table(spark, wide), table(spark, wide))) == brute_top(wide, wide)
