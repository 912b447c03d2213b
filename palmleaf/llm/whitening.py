"""Whitening of embeddings by the leading eigenvectors of their covariance.

Every entry c is taken as the integer ``floor(64 c) + 1000000``, so that counts and sums are exact and do not depend on the
order in which partitions come. The covariance is summed over partitions around the mean, a block of d numbers a row; only
d x d numbers reach the driver, whatever the number of vectors. The eigenproblem of that matrix is solved there by
Householder tridiagonalisation, Sturm counts with bisection, and inverse iteration with reorthogonalisation of clusters.
Mean and components (d and COMPONENTS x d doubles) go out with the projecting function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.vectors import as_rows, dimension
from palmleaf.llm.workers import slices

#: Components returned at most, and the scale and offset of the integers.
COMPONENTS, SCALE, OFFSET = 32, 64.0, 1_000_000
#: Integers are held to this distance from the offset, so that sums over 2,000 vectors of the largest ones fit a long.
LARGEST = 1 << 52
#: Most components of a vector: the matrix on the driver then takes 128 MB.
DIM_MOST = 4096
#: Eigenvalues closer than this share of the matrix's norm have their vectors made orthogonal to one another.
CLUSTER = 1e-3


def usable(rows: DataFrame, column: str, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` finite components; zero vectors stay."""
    finite = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.coalesce((F.size(column) == dim) & finite, F.lit(False)))


def whole(vectors: np.ndarray) -> np.ndarray:
    """The vectors as integers."""
    return np.clip(np.floor(SCALE * vectors), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _by_place(parts: list[np.ndarray], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts[0])), pa.int32()), *(pa.array(list(p), k) for p, k in zip(parts, kinds))], names=["place", *names])


def exact_sums(rows: DataFrame, column: str, dim: int) -> tuple[int, list[int], list[int], list[int]]:
    """Number of vectors, and sum, least and largest integer of each component; sums are decimals, so they hold whatever the size."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, 2000):
            if b.num_rows:
                x = whole(as_rows(b.column(0), dim))
                yield _by_place([np.full(dim, len(x)), x.sum(axis=0), x.min(axis=0), x.max(axis=0)], ["n", "s", "lo", "hi"], [pa.int64()] * 4)

    parts = rows.select(column).mapInArrow(run, "place int, n long, s long, lo long, hi long")
    found = parts.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # dim rows
    found.sort(key=lambda r: r["place"])
    if not found:
        return 0, [], [], []
    return found[0]["n"], [int(r["s"]) for r in found], [r["lo"] for r in found], [r["hi"] for r in found]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n`` in doubles, the whole part of the mean taken off in integers first."""
    base = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - base) - rest


def _summed(rows: DataFrame, column: str, dim: int, transform, size: int) -> np.ndarray:
    """Sum over all vectors of the outer product of ``transform`` of a vector with itself."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in slices(it, 2000):
            if b.num_rows:
                y = transform(whole(as_rows(b.column(0), dim)))
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["place", "line"])

    parts = rows.select(column).mapInArrow(run, "place int, line array<double>")
    # a line of each partition: lines of one place are summed entry by entry, then at most size rows reach the driver
    whole_lines = parts.groupBy("place").agg(*(F.sum(F.get("line", F.lit(i))).alias(f"c{i}") for i in range(size))) if size <= 128 else parts.select("place", F.posexplode("line").alias("at", "v")).groupBy("place", "at").agg(F.sum("v").alias("v")).groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("line"))
    out = np.zeros((size, size))
    for r in whole_lines.collect():
        out[r["place"]] = list(r)[1:] if size <= 128 else r["line"]
    return (out + out.T) / 2


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix, and the unit vectors of the Householder reflections."""
    a, d, mirrors = matrix.astype(np.float64).copy(), len(matrix), []
    for k in range(d - 2):
        x = a[k + 1 :, k]
        v, norm = x.copy(), np.linalg.norm(x)
        v[0] += np.copysign(norm, x[0])
        length = np.linalg.norm(v)
        v = v / length if length > 0 else v
        mirrors.append(v)
        if length > 0:
            block = a[k + 1 :, k + 1 :]
            p = block @ v
            w = p - (v @ p) * v
            block -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, x[0])
            a[k + 2 :, k] = a[k, k + 2 :] = 0
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues are smaller than each of ``at``."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q, count = diagonal[0] - at, np.zeros(len(at), dtype=int)
    for i in range(len(diagonal)):
        if i:
            q = diagonal[i] - at - off[i - 1] ** 2 / np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bracketed by bisection until no double lies between."""
    d, reach = len(diagonal), np.zeros(len(diagonal))
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    lo, hi = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    hi = hi + np.abs(hi) * 1e-15 + np.finfo(float).tiny
    wanted = d - np.arange(k)  # the i-th largest has d - i eigenvalues not above it
    for _ in range(200):
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            break
        over = below(diagonal, off, mid) >= wanted
        lo, hi = np.where(over, lo, mid), np.where(over, mid, hi)
    return lo + (hi - lo) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, value: float, b: np.ndarray) -> np.ndarray:
    """``(T - value) x = b`` by elimination with row exchanges; zero pivots count as the rounding of the norm."""
    d, norm = len(diagonal), np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)
    tiny = max(norm, np.finfo(float).tiny / np.finfo(float).eps) * np.finfo(float).eps
    u, u1, u2, x = diagonal - value, np.append(off, 0.0), np.zeros(d), b.copy()
    low = off.copy()
    for i in range(d - 1):
        if abs(low[i]) > abs(u[i]):  # exchange lines i and i + 1
            u[i], low[i] = low[i], u[i]
            u1[i], u[i + 1] = u[i + 1], u1[i]
            u2[i], u1[i + 1] = u1[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        u[i] = u[i] if abs(u[i]) > tiny else tiny
        f = low[i] / u[i]
        u[i + 1] -= f * u1[i]
        u1[i + 1] -= f * u2[i]
        x[i + 1] -= f * x[i]
    for i in range(d - 1, -1, -1):
        pivot = u[i] if abs(u[i]) > tiny else tiny
        x[i] = (x[i] - (u1[i] * x[i + 1] if i + 1 < d else 0.0) - (u2[i] * x[i + 2] if i + 2 < d else 0.0)) / pivot
    return x


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, a row each, by inverse iteration; those of a cluster of values are orthogonal to one another."""
    d, norm = len(diagonal), np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0)
    rnd, out, first = np.random.default_rng(0), np.zeros((len(values), d)), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # values that are equal in rounding are set apart a little, or all iterations would go to one vector
        shift, x = value - (k - first) * 4 * np.finfo(float).eps * norm, rnd.standard_normal(d)
        for step in range(8):
            for y in out[first:k]:
                x = x - (y @ x) * y
            x = x / np.linalg.norm(x)
            if step > 3:
                break
            x = _solved(diagonal, off, shift, x)
            x = x / np.abs(x).max()
        for _ in range(2):
            for y in out[first:k]:
                x = x - (y @ x) * y
            x = x / np.linalg.norm(x)
        out[k] = x
    return out


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors, a row each."""
    diagonal, off, mirrors = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    vectors = leading_vectors(diagonal, off, values)
    for i in range(len(mirrors) - 1, -1, -1):
        v = mirrors[i]
        vectors[:, i + 1 :] -= 2 * np.outer(vectors[:, i + 1 :] @ v, v)
    return values, vectors


def whiten(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``, one row for each usable vector and component.

    A vector that is null, or holds a null or non-finite component, takes no part, nor does one whose number of components is
    not the most frequent one. Null and repeated ids are rows like any other; extra columns change nothing. Components whose
    eigenvalue is zero in rounding (fewer different vectors than components, or components that never vary) are not
    returned; an empty table, or one of equal vectors, gives no rows. Entries beyond 2^46 in size count as that. ``deviation``
    is a decimal, exact at any size. ``identity_error`` is measured on the projected rows in a pass of their own.
    """
    kind = dict(rows.dtypes)[id_column]
    schema = f"`{id_column}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    dim = dimension(rows, column)
    if dim > DIM_MOST:
        raise ValueError(f"vectors of {dim} components; at most {DIM_MOST} are whitened")
    kept = usable(rows, column, dim).select(F.col(id_column).alias(id_column), F.transform(column, lambda x: x.cast("double")).alias("_vector"))
    n, sums, lo, hi = exact_sums(kept, "_vector", dim) if dim else (0, [], [], [])
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    covariance = _summed(kept, "_vector", dim, lambda x: centred(x, n, sums), dim) / n
    values, vectors = leading_pairs(covariance, min(components, dim))
    trace = float(np.trace(covariance))
    real = values > max(trace, 0.0) * dim * np.finfo(float).eps
    values, vectors = values[real], vectors[real]
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    project = (vectors / np.sqrt(values)[:, None]).T

    def scores(x: np.ndarray) -> np.ndarray:
        return centred(x, n, sums) @ project

    k = len(values)
    with_one = _summed(kept, "_vector", dim, lambda x: np.hstack([scores(x), np.ones((len(x), 1))]), k + 1)  # last line: sums, to centre by
    mean = with_one[k, :k] / n
    error = float(np.abs(with_one[:k, :k] / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = values / trace
    fits = sum(max(n * h - s, s - n * low) ** 2 for s, low, h in zip(sums, lo, hi)) < 1 << 63 and max(map(abs, sums)) < 1 << 63

    def deviations(x: np.ndarray) -> list[int]:
        if fits:
            y = n * x - np.array(sums, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        return [sum((n * int(a) - s) ** 2 for a, s in zip(line, sums)) for line in x.tolist()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it, 1000):
            x = whole(as_rows(b.column(1), dim))
            m = len(x)
            each = np.repeat(np.arange(m), k)
            dev = pa.array(deviations(x), pa.decimal128(38, 0) if not fits else pa.int64()).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), dev.take(pa.array(each)), pa.array(scores(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.mapInArrow(run, schema)


def whitening_report(rows: DataFrame) -> DataFrame:
    """``whiten`` with production parameters; a deviation beyond a long is an error, never a wrong number."""
    return whiten(rows).withColumn("deviation", F.col("deviation").cast("long"))
