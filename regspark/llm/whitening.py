"""Whitening of vectors along the leading components of their covariance, by slicing its spectrum.

Spark sums the vectors and then their centred products, in whole numbers, so the covariance is
exact before it is rounded once. Its leading eigenvalues are isolated by inertia: the signs of D
in an LDL' factorisation of the covariance less a shift say how many eigenvalues lie above the
shift. From inside its interval each vector converges by Rayleigh quotient iteration (cubically),
and two more counts certify its number. Only matrices of dims x dims reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.llm.common import dropped, fresh, stored
from regspark.llm.vectors import BLOCK_ENTRIES, commonest_size, matrix, scaled, usable

#: Vectors are multiplied by SCALE, rounded down and moved by OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Sums below this are whole in 64-bit floating point, and below the other in 64-bit integers.
EXACT_FLOAT, EXACT_LONG = 2**53, 2**63


# ---- the spectrum ---------------------------------------------------------------------------


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric `a` lie above `shift`.

    LDL' with symmetric pivoting: a pivot is one entry of the diagonal, or two by two entries
    where the largest entry of what is left stands off the diagonal; by Sylvester's law D has as
    many positive eigenvalues as `a` less the shift.
    """
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        size = np.abs(m)
        diagonal = int(np.argmax(size.diagonal()))
        row, column = divmod(int(np.argmax(size)), len(m))
        if size[row, column] == 0:
            break  # what is left is zero: eigenvalues at the shift itself
        if size[diagonal, diagonal] >= 0.6404 * size[row, column]:  # (1 + sqrt(17)) / 8 bounds the growth of entries
            pivots = [diagonal]
            above += m[diagonal, diagonal] > 0
        else:
            pivots = [row, column]
            above += 1 + (m[row, row] * m[column, column] > m[row, column] ** 2) * (1 if m[row, row] > 0 else -1)
        rest = np.setdiff1d(np.arange(len(m)), pivots)
        side = m[np.ix_(rest, pivots)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(m[np.ix_(pivots, pivots)], side.T)
        m = (m + m.T) / 2
    return int(above)


def isolate(a: np.ndarray, k: int, counts: dict[float, int], tiny: float) -> tuple[float, float]:
    """An interval that holds the k-th eigenvalue alone, as does one twice as wide about its middle.

    It is halved until the counts at its ends say so, or until it is `tiny` (equal eigenvalues).
    """

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(a, shift)
        return counts[shift]

    low = max(s for s, n in counts.items() if n >= k)
    high = min(s for s, n in counts.items() if n < k)
    while high - low > tiny:
        if above(low) - above(high) == 1 and above(1.5 * low - 0.5 * high) - above(1.5 * high - 0.5 * low) == 1:
            break
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) >= k else (low, middle)
    return low, high


def rayleigh(a: np.ndarray, low: float, high: float, found: np.ndarray, tiny: float) -> tuple[float, np.ndarray]:
    """The eigenvalue within (low, high) and its unit vector, orthogonal to the columns `found`.

    Inverse iteration about the interval's middle, to which all others are twice as far, until
    the residual shows that the eigenvalue next to the quotient is in the interval; from there the
    quotient is the shift.
    """
    unit = np.eye(len(a))
    v = np.random.default_rng(0).standard_normal(len(a))
    shift, inside = (low + high) / 2, 0
    for _ in range(100):
        v = v - found @ (found.T @ v)
        v /= np.linalg.norm(v)
        try:
            w = np.linalg.solve(a - shift * unit, v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last digit
            w = np.linalg.solve(a - (shift + tiny) * unit, v)
        w = w - found @ (found.T @ w)
        v = w / np.linalg.norm(w)
        quotient = float(v @ a @ v)
        residual = float(np.linalg.norm(a @ v - quotient * v))
        if residual <= tiny and low - tiny / 16 <= quotient <= high + tiny / 16:
            inside += 1
            if inside == 2:  # one more step after the residual has gone down to rounding
                return quotient, v
        shift = quotient if residual < min(quotient - low, high - quotient) else (low + high) / 2
    return quotient, v


def leading(a: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues of a covariance, falling, and their unit vectors in columns.

    Eigenvalues that rounding cannot tell from zero are left out. Of equal eigenvalues the vectors
    are any orthonormal ones. Each number is certified by the counts on both sides of its value;
    where they disagree, ArithmeticError.
    """
    d, scale = len(a), float(np.trace(a))
    if d == 0 or scale <= 0:
        return np.zeros(0), np.zeros((d, 0))
    tiny = 64 * d * np.finfo(float).eps * scale
    counts = {-tiny: d, scale + tiny: 0, tiny: inertia(a, tiny)}
    values: list[float] = []
    vectors = np.zeros((d, 0))
    for k in range(1, min(most, counts[tiny]) + 1):
        low, high = isolate(a, k, counts, 4 * tiny)
        value, v = rayleigh(a, low, high, vectors, tiny)
        if not inertia(a, value + 4 * tiny) < k <= inertia(a, value - 4 * tiny):
            raise ArithmeticError(f"eigenvalue {k} is not certified")
        values.append(value)
        vectors = np.column_stack([vectors, v])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[:, order]


# ---- sums over the table --------------------------------------------------------------------


@dataclass(frozen=True)
class Fit:
    """Number and sums of the distinct vectors, eigenvalues, unit vectors and shares of the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _add_up(rows: DataFrame, vector: str, dims: int, centre: list[int] | None) -> DataFrame:
    """(entry, total): without a centre the sums of each dimension, with one the upper triangle
    of the products about it. Each task sends one row an entry."""
    upper = np.triu_indices(dims)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims if centre is None else len(upper[0]), dtype=object)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for at in range(0, len(x), step := max(1, BLOCK_ENTRIES // max(dims, 1))):
                part = x[at : at + step]
                most = max(abs(int(part.max())), abs(int(part.min())))
                if centre is None:
                    total = total + (part.sum(axis=0) if most * len(part) < EXACT_LONG else part.astype(object).sum(axis=0))
                    continue
                most += max(map(abs, centre))
                y = part - np.array(centre) if most < EXACT_LONG else part.astype(object) - np.array(centre, dtype=object)
                most = max(abs(int(y.max())), abs(int(y.min())))
                y = y.astype(float) if most * most * len(part) < EXACT_FLOAT else y.astype(object)
                total = total + np.array([int(v) for v in (y.T @ y)[upper]], dtype=object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([str(int(v)) for v in total], pa.string())], names=["entry", "total"])

    sent = rows.select(vector).mapInArrow(parts, "entry int, total string")
    return sent.groupBy("entry").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def covariance(distinct: DataFrame, vector: str, dims: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of each dimension, and the covariance (divisor n), exact before its last rounding."""
    n = distinct.count()
    if n == 0:
        return 0, [0] * dims, np.zeros((dims, dims))
    sums = [int(r["total"]) for r in _add_up(distinct, vector, dims, None).orderBy("entry").collect()]
    centre = [round(Fraction(s, n)) for s in sums]
    products = [int(r["total"]) for r in _add_up(distinct, vector, dims, centre).orderBy("entry").collect()]
    off = [s - n * c for s, c in zip(sums, centre)]  # what the rounded centre leaves of the sums
    v = np.zeros((dims, dims))
    for i, j, p in zip(*np.triu_indices(dims), products):
        v[i, j] = v[j, i] = (n * p - off[i] * off[j]) / (n * n)
    return n, sums, v


def fit(distinct: DataFrame, vector: str, dims: int, most: int = COMPONENTS) -> Fit:
    """Fit on each row of `distinct` (whole numbers, `dims` in each) once."""
    n, sums, v = covariance(distinct, vector, dims)
    values, vectors = leading(v, most)
    return Fit(n, tuple(sums), values, vectors, float(np.trace(v)))


def _centred(x: np.ndarray, model: Fit) -> np.ndarray:
    """n * x - S in whole numbers."""
    most = model.n * (max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0) + max(map(abs, model.sums), default=0)
    kind = np.int64 if most < EXACT_LONG else object
    return x.astype(kind) * model.n - np.array(model.sums, dtype=kind)


def project(x: np.ndarray, model: Fit) -> tuple[list[int | None], np.ndarray]:
    """Exact sums of (n * x - S)^2 (None beyond a long) and the whitened rows."""
    y = _centred(x, model)
    most = max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0
    squares = (y * y if most * most * max(1, y.shape[1]) < EXACT_LONG else y.astype(object) ** 2).sum(axis=1).tolist()
    return [int(s) if s < EXACT_LONG else None for s in squares], (y.astype(float) / model.n) @ (model.vectors / np.sqrt(model.values))


def identity_error(distinct: DataFrame, vector: str, dims: int, model: Fit) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity."""
    k = len(model.values)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = project(matrix(batch.column(0), dims), model)[1]
            one, two = one + w.sum(axis=0), two + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array(np.concatenate([one, two.ravel()]))], names=["entry", "total"])

    got = np.array([r["total"] for r in distinct.select(vector).mapInArrow(parts, "entry int, total double").groupBy("entry").agg(F.sum("total").alias("total")).orderBy("entry").collect()])
    mean = got[:k] / model.n
    return float(np.abs(got[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """`rows` with component (from 1), n, deviation, whitened, explained and identity_error: one
    row for each usable vector and component; columns of these names are replaced.

    Rows whose vector is null, holds null, NaN or infinite components, or has another number of
    components than most rows (ties: the larger number) are dropped. Equal vectors count once in
    the fit; every row gets its figures. `deviation` is null where it does not fit a long.
    Components whose eigenvalue is zero but for rounding are left out, so equal vectors only, or
    an empty table, give no rows. Signs of components are any, the same for all rows.
    """
    x = fresh(rows, "_x")
    used = rows.where(usable(F.col(vector_col)))
    dims = commonest_size(used, vector_col)
    used = used.where(F.size(vector_col) == dims).withColumn(x, F.transform(scaled(F.col(vector_col), SCALE), lambda c: F.coalesce(F.try_add(c, F.lit(OFFSET)), c)))
    distinct = stored(used.select(x).distinct())
    model = fit(distinct, x, dims, most)
    k = len(model.values)
    error = identity_error(distinct, x, dims, model) if k else 0.0
    dropped(distinct)
    out = fresh(rows, "_whitened")
    keep = [c for c in rows.columns if c.lower() not in ("component", "n", "deviation", "whitened", "explained", "identity_error")]
    schema = T.StructType([*used.select(*keep).schema.fields, T.StructField("deviation", T.LongType()), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deviation, w = project(matrix(batch.column(len(keep)), dims), model)
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, max(k, 1), dtype=np.int32) if k else np.zeros(len(w) + 1, dtype=np.int32), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(deviation, pa.int64()), lists], names=[*keep, "deviation", out])

    found = used.select(*keep, x).mapInArrow(projected, schema)
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.values)).cast("array<double>")
    each = found.select(*keep, "deviation", F.posexplode(out).alias("component", "whitened"))
    return each.select(*keep, (F.col("component") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))
