"""Whitening of vectors by a pivoted Cholesky factor and one-sided Jacobi rotations.

Vectors become long integers, and everything about all rows is a sum of integers: counts, sums, and the scatter of rows centred
on the rounded mean, corrected by the exact rest. Such sums are the same in any order and after any lost executor. The scatter
(dimensions squared, whatever the rows) is factored on the driver: Cholesky with diagonal pivots, then Jacobi rotations of the
columns of the triangular factor until they are orthogonal. Their squared norms are the eigenvalues, the normalised columns the
components. Rows are then projected where they lie; nothing is shuffled but the partial sums.

A vector that is null, empty or holds null or non-finite entries is left out, as is one of another length than most (of equally
frequent lengths the greatest counts). Components without variance are not returned, so a single row, or equal rows, give no
rows. Null ids and repeated rows are rows like any other. Empty tables give no rows. Columns beyond id and vector are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Products of doubles below this are exact integers.
_EXACT = 1 << 53
#: Rows of one block of projected values.
_ROWS = 2048

# --- linear algebra on the scatter --------------------------------------------------------------------------------


def pivoted_cholesky(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): ``factor @ factor.T`` is the scatter with rows and columns in ``order``.

    Each step takes the largest diagonal entry left; it ends where what is left is rounding, so the factor has as many columns
    as the scatter has rank.
    """
    a = scatter.copy()
    d = len(a)
    order = np.arange(d)
    factor = np.zeros((d, d))
    floor = d * np.finfo(float).eps * max(float(a.diagonal().max(initial=0.0)), 0.0)
    for k in range(d):
        at = k + int(np.argmax(a.diagonal()[k:]))
        if not a[at, at] > floor:
            return factor[:, :k], order
        if at != k:
            a[[k, at]], factor[[k, at]], order[[k, at]] = a[[at, k]], factor[[at, k]], order[[at, k]]
            a[:, [k, at]] = a[:, [at, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor times rotations that make its columns orthogonal.

    A sweep rotates each pair of columns once, in rounds of disjoint pairs.
    """
    x = factor.T.copy()  # a column of the factor is a row here
    r = len(x)
    if r < 2:
        return x.T
    seats = list(range(r)) + [-1] * (r % 2)
    half = len(seats) // 2
    small = np.finfo(float).eps
    for _ in range(sweeps):
        largest = 0.0
        for _ in range(len(seats) - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], reversed(seats[half:])) if p >= 0 and q >= 0]
            i, j = np.array(pairs).T
            a, b = x[i], x[j]
            aa, bb, ab = (np.einsum("ij,ij->i", u, v) for u, v in ((a, a), (b, b), (a, b)))
            with np.errstate(divide="ignore", invalid="ignore"):
                off = np.where(ab == 0, 0.0, np.abs(ab) / np.sqrt(aa * bb))
                zeta = (bb - aa) / (2 * ab)
                t = np.where(ab == 0, 0.0, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)))
            largest = max(largest, float(off.max()))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            x[i], x[j] = c[:, None] * a - s[:, None] * b, s[:, None] * a + c[:, None] * b
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if largest <= 4 * small:
            break
    return x.T


def components_of(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): eigenvalues by falling size and unit eigenvectors as columns, as many as the rank."""
    factor, order = pivoted_cholesky(scatter)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt(np.einsum("ij,ij->j", turned, turned))
    by = np.argsort(-norms, kind="stable")
    by = by[norms[by] > 0]
    vectors = np.empty((len(scatter), len(by)))
    vectors[order] = turned[:, by] / norms[by]
    return norms[by] ** 2, vectors


# --- sums over all rows --------------------------------------------------------------------------------------------


def _integers(values: pa.Array) -> np.ndarray:
    """Rows of long integers from vectors of one length."""
    width = len(values[0])
    flat = np.asarray(values.flatten().cast(pa.float64()), np.float64).reshape(-1, width)
    if np.abs(flat).max(initial=0.0) >= 1 << 56:
        raise OverflowError("an entry is too large for a long integer")
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def _squares(z: np.ndarray) -> np.ndarray:
    """``z.T @ z`` of integers, exactly, as integers of any size."""
    top = int(np.abs(z).max(initial=0))
    if top * top >= _EXACT:
        big = z.astype(object)
        return big.T.dot(big)
    step = max(1, (_EXACT - 1) // max(1, top * top))
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for at in range(0, len(z), step):
        part = z[at : at + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64)
    return total


def _partial_scatter(centre: np.ndarray):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row (row of the matrix, its entries as decimal texts) per dimension of a task's own sum."""
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + _squares(_integers(batch.column(0)) - centre)
        if not isinstance(total, int):
            rows = [[str(v) for v in row] for row in total.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], names=["i", "entries"])

    return add


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: exact sums, components by falling eigenvalue, and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector, width) of the rows without null or non-finite entries."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.withColumn("width", F.size("vector")).filter((F.col("width") > 0) & finite)


def _of_width(rows: DataFrame) -> tuple[DataFrame, int]:
    widths = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    return (rows.filter(F.col("width") == widths["width"]), widths["n"]) if widths else (rows, 0)


def fit(rows: DataFrame, n: int) -> Whitening:
    """The whitening of ``n`` rows (id, vector) of one width. One row per dimension, and one per pair, reach the driver."""
    exact = "decimal(38,0)"
    x = F.posexplode("vector").alias("i", "c")
    sums = rows.select(x).groupBy("i").agg(F.sum((F.floor(F.lit(SCALE) * F.col("c")) + SHIFT).cast(exact)).alias("s")).collect()
    sums = tuple(int(r.s) for r in sorted(sums))
    centre = np.array([s // n for s in sums], np.int64)
    parts = rows.select("vector").mapInArrow(_partial_scatter(centre), "i int, entries array<string>")
    entries = parts.select("i", F.posexplode("entries").alias("j", "v")).groupBy("i", "j").agg(F.sum(F.col("v").cast(exact)).alias("v"))
    scatter = np.zeros((len(sums), len(sums)), object)
    for i, j, v in entries.collect():
        scatter[i, j] = int(v)
    # centred on the rounded mean; the exact rest of each sum takes it to the mean itself
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], object)
    covariance = np.array([[(n * scatter[i, j] - rest[i] * rest[j]) / (n * n) for j in range(len(sums))] for i in range(len(sums))], np.float64)
    values, vectors = components_of(covariance)
    return Whitening(n, sums, values, vectors, float(covariance.trace()))


# --- projection ----------------------------------------------------------------------------------------------------


def _deviations(z: np.ndarray, n: int, rest: np.ndarray) -> list[int]:
    """The sum over dimensions of ``(n * x - S) ** 2`` per row, exactly."""
    top = n * int(np.abs(z).max(initial=0)) + max(abs(int(r)) for r in rest)
    if top * top * z.shape[1] < 1 << 63:
        y = n * z - rest.astype(np.int64)
        return np.einsum("ij,ij->i", y, y).tolist()
    y = n * z.astype(object) - rest
    return [int(v) for v in (y * y).sum(axis=1)]


def _project(found: Whitening, k: int):
    centre, n = found.centre, found.n
    rest = np.array([s - n * int(c) for s, c in zip(found.sums, centre)], object)
    shift = rest.astype(np.float64) / n
    into = found.vectors[:, :k] / np.sqrt(found.values[:k])

    def project(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        z = _integers(values) - centre
        return z, (z - shift) @ into

    return project, rest


def whiten(rows: DataFrame, found: Whitening, k: int = COMPONENTS) -> DataFrame:
    """(id, deviation, whitened) per row: the exact deviation from the mean as decimal, and its first ``k`` whitened values."""
    k = min(k, len(found.values))
    project, rest = _project(found, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                z, values = project(part.column(1))
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, k), pa.int32()), pa.array(values.ravel()))
                deviation = pa.array([str(v) for v in _deviations(z, found.n, rest)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), deviation, whitened], names=["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    done = rows.select("id", "vector").mapInArrow(run, f"id {kind}, deviation string, whitened array<double>")
    return done.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(rows: DataFrame, found: Whitening, k: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the whitened rows themselves."""
    k = min(k, len(found.values))
    project, _ = _project(found, k)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                _, values = project(batch.slice(at, _ROWS).column(0))
                total += values.T @ values
                sums += values.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k + 1), pa.int32()), pa.array([*total.tolist(), sums.tolist()], pa.list_(pa.float64()))], names=["i", "entries"]
        )

    parts = rows.select("vector").mapInArrow(add, "i int, entries array<double>")
    entries = parts.select("i", F.posexplode("entries").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    table = np.zeros((k + 1, k))
    for i, j, v in entries:
        table[i, j] = v
    # the rows are centred, so their mean is rounding
    mean = table[k] / found.n
    return float(np.abs(table[:k] / found.n - np.outer(mean, mean) - np.eye(k)).max())


_FIELDS = "vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def digest(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """The columns of the query. A deviation that no long holds is an error, as is an entry whose integer is none."""
    rows = usable(vectors)
    kind = _FIELDS.format(kind=rows.schema["id"].dataType.simpleString())
    rows, n = _of_width(rows)
    found = fit(rows, n) if n else None
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], kind)
    error = identity_error(rows, found, k)
    explained = F.array(*[F.lit(float(v / found.trace)) for v in found.values[:k]])
    done = whiten(rows, found, k)
    return done.select(
        F.col("id").alias("vec_id"), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        F.posexplode("whitened").alias("at", "whitened"),
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
