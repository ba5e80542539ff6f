"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Entries become whole numbers, so that counts, sums and the scatter are exact whatever the
order of the tasks.  Tasks sum the scatter of their distinct vectors, each less the rounded
mean before it is multiplied, in blocks small enough for doubles to be exact; Spark adds the
blocks up, entry by entry.  What reaches the driver is the count, the sums and the scatter:
as many numbers as two dimensions allow, however many vectors there are.

There the scatter is factored as L L' with the largest remaining diagonal entry as the next
pivot, in decimals of ``DIGITS`` digits, so small directions keep their digits beside large
ones.  One-sided Jacobi rotates the columns of L until they are orthogonal: their squared
norms are the eigenvalues, the columns over their norms are the components.

Defined cases: a null vector, and one with a null, infinite or NaN entry, is dropped; so is a
vector whose number of entries is not the one that most vectors have (of equally frequent ones
the larger), and an empty one; repeated rows and null ids each give rows, equal vectors count
once in the fit; entries whose whole number is over 2^63 are held at that bound, as Spark's
floor does; a direction without variance is no component, so one vector, or a table of copies,
gives no rows; a deviation that a long can't hold is null; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy, to_batch

SCALE = 256
COMPONENTS = 4
DIGITS = 100
#: A pivot this much smaller than the largest diagonal entry is no direction of its own.
NO_PIVOT = Decimal("1e-60")
SWEEPS = 60
#: Vectors that a task multiplies at once.
BLOCK = 4096

#: A sum's part is sent as two numbers, value = high * 2^60 + low, so that adding can't overflow.
LOW = 1 << 60
_PARTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", pa.decimal128(38)), ("low", pa.decimal128(38))])
_PARTS_DDL = "i int, j int, high decimal(38,0), low decimal(38,0)"


def sound_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors as doubles, without those that are null, empty or hold what is no finite number."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.select("vec_id", F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)


def whole_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the whole numbers of the vectors that are not dropped."""
    rows = sound_vectors(embeddings, vector)
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    width = widths.agg(F.max_by("width", F.struct("n", "width"))).first()[0]
    kept = rows.where(F.size("v") == F.lit(width)) if width else rows.where("false")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """The vectors of a column as rows of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def largest(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def less(x: np.ndarray, by: list[int]) -> np.ndarray:
    """x - by, exactly: as int64, or as Python's numbers where those are needed."""
    kind = np.int64 if largest(x) + max(map(abs, by), default=0) < 1 << 63 else object
    return x.astype(kind) - np.array(by, kind)


def product(y: np.ndarray) -> np.ndarray:
    """y' y, exactly: by doubles or int64 where they hold every sum, else by Python's numbers."""
    most = largest(y) ** 2 * len(y)
    for bound, kind in ((1 << 53, np.float64), (1 << 63, np.int64)):
        if most < bound:
            z = y.astype(kind)
            return (z.T @ z).astype(np.int64)
    return y.astype(object).T @ y.astype(object)


def totals(x: np.ndarray) -> np.ndarray:
    """One row: how many vectors, then the sum of each dimension."""
    kind = np.int64 if largest(x) * len(x) < 1 << 63 else object
    return np.array([[len(x), *x.astype(kind).sum(axis=0).tolist()]], object)


def added(distinct: DataFrame, measure) -> dict[tuple[int, int], int]:
    """Sums of the matrices that ``measure`` makes of blocks of vectors, by place (the upper triangle)."""

    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = measure(matrix(batch.column(0).slice(at, BLOCK))).astype(object)
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(total.shape[0], 0, total.shape[1])
            pairs = [divmod(v, LOW) for v in total[i, j].tolist()]
            yield to_batch(_PARTS, (i.tolist(), j.tolist(), [Decimal(high) for high, _ in pairs], [Decimal(low) for _, low in pairs]))

    summed = distinct.mapInArrow(tidy(run), _PARTS_DDL).groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {(r["i"], r["j"]): int(r["high"]) * LOW + int(r["low"]) for r in summed.collect()}


@dataclass
class Whitening:
    """n vectors and their sums; eigenvalues, falling, and their components as rows."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def offset(self) -> list[int]:
        """The mean, rounded."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """n times what the rounding took from the mean."""
        return [s - self.n * c for s, c in zip(self.sums, self.offset, strict=True)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        centred = less(x, self.offset).astype(np.float64) - np.array([r / self.n for r in self.rest])
        return centred @ self.components.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y = less(x, self.offset)
        most = (largest(y) + 1) * self.n
        kind = np.int64 if most * most * y.shape[1] < 1 << 63 else object
        apart = y.astype(kind) * self.n - np.array(self.rest, kind)
        return [v if v < 1 << 63 else None for v in (apart * apart).sum(axis=1).tolist()]


def pivoted_cholesky(scatter: np.ndarray) -> np.ndarray:
    """L with L L' equal to a matrix of whole numbers: a column a pivot, rows in the matrix's order."""
    size = len(scatter)
    columns = []
    with localcontext(prec=DIGITS):
        rest, left = np.array([[Decimal(v) for v in row] for row in scatter.tolist()], object).reshape(size, size), np.arange(size)
        least = max(rest.diagonal(), default=Decimal(0)) * NO_PIVOT
        while len(left):
            pivot = int(np.argmax(rest.diagonal()))
            if rest[pivot, pivot] <= least:
                break
            column = rest[:, pivot] / rest[pivot, pivot].sqrt()
            placed = np.zeros(size)
            placed[left] = column.astype(float)
            columns.append(placed)
            others = np.delete(np.arange(len(left)), pivot)
            rest = rest[np.ix_(others, others)] - np.multiply.outer(column[others], column[others])
            left = left[others]
    return np.array(columns).reshape(-1, size).T


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The columns of a matrix rotated until all are orthogonal: disjoint pairs at a time, all pairs a sweep."""
    g = np.array(factor, float)
    many = g.shape[1]
    enough = np.finfo(float).eps * len(g) ** 0.5
    for _ in range(SWEEPS if many > 1 else 0):
        seats, turned = list(range(many + many % 2)), False  # with an odd number one sits out
        for _ in range(len(seats) - 1):
            facing = zip(seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1], strict=True)
            p, q = np.array([pair for pair in facing if max(pair) < many]).T
            seats = [seats[0], seats[-1], *seats[1:-1]]
            left, right = g[:, p], g[:, q]
            a, b, c = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            turn = np.abs(c) > enough * np.sqrt(a * b)
            zeta = (b - a) / np.where(turn, 2 * c, 1)
            tangent = np.where(turn, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            cosine = 1 / np.hypot(1, tangent)
            g[:, p], g[:, q] = cosine * (left - tangent * right), cosine * (tangent * left + right)
            turned |= bool(turn.any())
        if not turned:
            break
    return g


def fitted(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of distinct vectors ``x``; None without vectors."""
    counted = added(distinct, totals)
    if not counted:
        return None
    width = len(counted) - 1
    white = Whitening(counted[0, 0], [counted[0, 1 + j] for j in range(width)], np.empty(0), np.empty((0, width)), 0.0)
    n, offset, rest = white.n, white.offset, white.rest
    parts = added(distinct, lambda x: product(less(x, offset)))
    # n^2 times the covariance, in whole numbers
    scatter = np.array([[n * parts[min(i, j), max(i, j)] - rest[i] * rest[j] for j in range(width)] for i in range(width)], object)
    turned = one_sided_jacobi(pivoted_cholesky(scatter))
    norms = (turned * turned).sum(0)
    order = np.argsort(-norms, kind="stable")[:components]
    white.eigenvalues, white.components = norms[order] / n / n, (turned[:, order] / np.sqrt(norms[order])).T
    white.trace = float(sum(scatter.diagonal())) / n / n
    return white


def identity_error(distinct: DataFrame, white: Whitening) -> float:
    """Largest entry of the covariance of the whitened, centred vectors less the identity, over the whole fit list."""
    k = len(white.eigenvalues)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())])

    def run(batches):
        total = np.zeros((k, k))
        for batch in batches:
            z = white.whitened(matrix(batch.column(0)))
            total += z.T @ z
        yield to_batch(schema, (*np.indices((k, k)).reshape(2, -1), total.reshape(-1)))

    summed = distinct.mapInArrow(tidy(run), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    return max(abs(r["value"] / white.n - (r["i"] == r["j"])) for r in summed.collect())


def whitened(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """A row per vector and component: its whitened value, the vector's deviation, and the fit's figures."""
    spark = embeddings.sparkSession
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_vectors(embeddings, vector)
    distinct = stored(rows.select("x").distinct(), "distinct-vectors")
    white = fitted(distinct, components)
    k = 0 if white is None else len(white.eigenvalues)
    if not k:
        return spark.createDataFrame([], ddl)
    error, explained = identity_error(distinct, white), white.eigenvalues / white.trace
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches):
        for batch in batches:
            m, x = batch.num_rows, matrix(batch.column(1))
            each = pa.array(np.repeat(np.arange(m), k))
            yield to_batch(schema, (
                batch.column(0).take(each), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, white.n), pa.array(white.deviations(x), pa.int64()).take(each),
                white.whitened(x).reshape(-1), np.tile(explained, m), np.full(m * k, error),
            ))

    return rows.mapInArrow(tidy(run), ddl)
