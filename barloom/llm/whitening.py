"""Whitening of embeddings by their leading principal components.

Vectors become whole numbers, each distinct one counts once, and its covariance is summed over the parts of the data, centred before it is multiplied. The matrix
alone (as many rows as a vector has entries) is decomposed on the driver: Householder reflections make it tridiagonal, Sturm counts and bisection find the leading
eigenvalues, inverse iteration their vectors, with those of close eigenvalues held orthogonal. The components are broadcast and every row is projected on them."""

from __future__ import annotations

import decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import cut_lineage

SCALE, SHIFT, TOP = 64, 1_000_000, 16
LEAST = 1e-11                          # eigenvalues below this share of the largest count as zero: their direction does not vary
CLOSE = 1e-3                           # eigenvalues nearer than this share of the norm are one cluster
GROUPS = 32                            # partial matrices are added up in so many tasks before the driver adds the rest
_EPS = np.finfo(float).eps


# --- a symmetric matrix's leading eigenvectors ------------------------------------------------------------------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and Householder vectors that turn a symmetric matrix into tridiagonal form."""
    a, n, mirrors = np.array(matrix, dtype=float), len(matrix), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        if not x[1:].any():
            mirrors.append(None)
            continue
        x /= np.abs(x).max()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        v = x / np.linalg.norm(x)
        p = a[k + 1:, k + 1:] @ v
        q = p - (v @ p) * v
        a[k + 1:, k + 1:] -= 2 * (np.outer(v, q) + np.outer(q, v))
        column = a[k + 1:, k] - 2 * (v @ a[k + 1:, k]) * v
        a[k + 1:, k] = a[k, k + 1:] = column
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(d: np.ndarray, e: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each shift: the negative terms of its Sturm sequence."""
    least = max(float(np.abs(e).max()) ** 2 if len(e) else 0.0, 1.0) * np.finfo(float).tiny
    q = d[0] - shifts
    count = (q < 0).astype(int)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < least, -least, q)
        q = d[i] - shifts - e[i - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, top: int) -> np.ndarray:
    """The `top` largest eigenvalues, falling, by bisection to the last bit."""
    n = len(d)
    around = np.append(0, np.abs(e)) + np.append(np.abs(e), 0)
    place = n - 1 - np.arange(min(top, n))
    low, high = np.full(len(place), (d - around).min() - 1), np.full(len(place), (d + around).max() + 1)
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high) & (high - low > _EPS * np.maximum(np.abs(low), np.abs(high)) / 4)
        if not open_.any():
            return middle
        more = below(d, e, middle) > place
        low, high = np.where(open_ & ~more, middle, low), np.where(open_ & more, middle, high)


def _solver(d: np.ndarray, e: np.ndarray, shift: float, tiny: float):
    """Solve (T - shift) x = b by elimination with row exchanges, factored once."""
    n = len(d)
    main, up, up2 = (d - shift).tolist(), [*e.tolist(), 0.0], [0.0] * n
    factor, swapped = [0.0] * n, [False] * n
    for i in range(n - 1):
        under = float(e[i])
        if abs(under) > abs(main[i]):
            swapped[i] = True
            factor[i] = main[i] / under
            main[i], up[i], up2[i], main[i + 1], up[i + 1] = under, main[i + 1], up[i + 1], up[i] - factor[i] * main[i + 1], -factor[i] * up[i + 1]
        else:
            factor[i] = under / main[i] if main[i] else 0.0
            main[i + 1] -= factor[i] * up[i]
    main = [m if abs(m) > tiny else (tiny if m >= 0 else -tiny) for m in main]

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i in range(n - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - factor[i] * x[i + 1]
            else:
                x[i + 1] -= factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            rest = x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (up2[i] * x[i + 2] if i + 2 < n else 0.0)
            x[i] = rest / main[i]
            if abs(x[i]) > 1e150:                                  # only the direction counts
                x = [y * 1e-150 for y in x]
        return np.array(x)
    return solve


def leading(matrix: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns; the entry of largest size of each is positive."""
    d, e, mirrors = tridiagonal(matrix)
    values = leading_values(d, e, top)
    norm = max(float(np.abs(d).max()), float(np.abs(e).max()) if len(e) else 0.0, 1e-280)
    vectors, cluster, rng = np.zeros((len(d), len(values))), 0, np.random.default_rng(0)
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * norm:
            cluster = j
        solve = _solver(d, e, value - (j - cluster) * 4 * _EPS * norm, _EPS * norm * 1e-3)      # equal eigenvalues get different shifts
        x = rng.standard_normal(len(d))
        for _ in range(4):
            x = solve(x)
            x /= np.abs(x).max()
            for _twice in range(2):
                x -= vectors[:, cluster:j] @ (vectors[:, cluster:j].T @ x)
            x /= np.linalg.norm(x)
        vectors[:, j] = x
    for k in range(len(mirrors) - 1, -1, -1):
        if mirrors[k] is not None:
            vectors[k + 1:] -= 2 * np.outer(mirrors[k], mirrors[k] @ vectors[k + 1:])
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors


# --- sums over the data -----------------------------------------------------------------------------------------------------------------------------------------

def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, q) with q = floor(64 c) of each entry, for the vectors that take part."""
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine &= F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < float(1 << 53)))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE)).alias("q"))


def _rows(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(batches):
    """Exact sums of a part: the high and the low bits apart, so that none overflows."""
    n, high, low = 0, 0, 0
    for batch in batches:
        if batch.num_rows:
            q = _rows(batch.column(0))
            n, high, low = n + len(q), high + (q >> 26).sum(axis=0), low + (q & ((1 << 26) - 1)).sum(axis=0)
    if n:
        total = [decimal.Decimal((int(a) << 26) + int(b)) for a, b in zip(high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(total, pa.decimal128(38, 0))], names=["dim", "n", "total"])


def _merge(a, b):
    """Rows, mean and centred products of two parts as of one."""
    if a is None or b is None:
        return a or b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _pack(state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([state[0]], pa.int64()), pa.array([state[1].tobytes()], pa.binary()), pa.array([state[2].tobytes()], pa.binary())], names=["n", "mean", "products"])


def _unpack(n: int, mean: bytes, products: bytes):
    mean = np.frombuffer(mean)
    return n, mean, np.frombuffer(products).reshape(len(mean), -1)


def _moments(frame: DataFrame, of) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (divisor n) of `of(q)` over all rows: each part centres its batches, GROUPS tasks add up the parts, the driver the rest."""
    def part(batches):
        state = None
        for batch in batches:
            if batch.num_rows:
                x = of(_rows(batch.column(0)))
                mean = x.mean(axis=0)
                state = _merge(state, (len(x), mean, (x - mean).T @ (x - mean)))
        if state:
            yield _pack(state)

    def add(batches):
        state = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = _merge(state, _unpack(*row))
        if state:
            yield _pack(state)
    schema, total = "n bigint, mean binary, products binary", None
    for row in frame.select("q").mapInArrow(part, schema).repartition(GROUPS).mapInArrow(add, schema).collect():          # at most GROUPS rows
        total = _merge(total, _unpack(*row))
    return total[1], total[2] / total[0]


def _project(q: np.ndarray, n: int, sums: np.ndarray, exact: bool, axes: np.ndarray) -> np.ndarray:
    """Entries less their mean, on each axis. Whole numbers n q - S are used while they fit."""
    return ((q * n - sums) / n if exact else q - np.array([float(Fraction(int(s), n)) for s in sums])) @ axes


def whiten(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector that takes part and each of the `top` leading components.

    Vectors that are null, empty or hold a null, NaN, infinity or an entry of 2**47 and more take no part, nor those of another length than most (of lengths equally
    frequent the longest). Repeated rows each get their own result and count once in the fit; ids may be null, repeated or of any order. Directions without variance
    are no components: fewer distinct vectors than `top` + 1 give fewer, a single one or an empty table gives no rows. Equal eigenvalues give any orthonormal
    vectors of their space. A deviation beyond a long is null. Other columns are left out, whatever their names. A d x d matrix of doubles passes through each task."""
    spark = vectors.sparkSession
    rows = whole(vectors)
    lengths = rows.groupBy(F.size("q").alias("size")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("size")).limit(1).collect()
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("q") == lengths[0].size)
    fit = cut_lineage(rows.select("q").distinct(), "fit")                          # equal vectors meet in their own task before the exchange
    sums = fit.mapInArrow(_sums, "dim int, n bigint, total decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()   # a row a dimension
    n, total = sums[0].n, [int(r.total) for r in sums]
    _, covariance = _moments(fit, lambda q: q.astype(float))
    values, axes = leading(covariance, top)
    kept = values > LEAST * max(values[0], 0)
    if not kept.any():
        return spark.createDataFrame([], schema)
    values, axes = values[kept], axes[:, kept] / np.sqrt(values[kept])
    edge = fit.agg(F.max(F.array_max("q")).alias("high"), F.min(F.array_min("q")).alias("low")).first()
    reach = max(abs(n * edge.high - min(total)), abs(n * edge.low - max(total)), abs(n * edge.high), abs(n * edge.low), *map(abs, total))
    exact = reach * reach * len(total) < 1 << 63
    sent = spark.sparkContext.broadcast((n, np.array(total, dtype=np.int64 if exact else object), exact, axes))
    identity = float(np.abs(_moments(fit, lambda q: _project(q, *sent.value))[1] - np.eye(len(values))).max())
    explained = values / np.trace(covariance)

    def run(batches):
        n, total, exact, axes = sent.value
        k = axes.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _rows(batch.column(1))
            away = (((q if exact else q.astype(object)) * n - total) ** 2).sum(axis=1).tolist()
            scores = _project(q, n, total, exact, axes)
            at = pa.array(np.repeat(np.arange(len(q)), k))
            away = pa.array([a if a < 1 << 63 else None for a in away], pa.int64())
            full = lambda v, t: pa.array(np.full(len(q) * k, v), t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), len(q)), pa.int32()), full(n, pa.int64()), away.take(at), pa.array(scores.ravel()),
                                              pa.array(np.tile(explained, len(q))), full(identity, pa.float64())],
                                             names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.select("vec_id", "q").mapInArrow(run, schema)
