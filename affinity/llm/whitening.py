"""Whitening of embeddings through a bidiagonal singular value decomposition, without forming the covariance.

1. The fit list's size and exact sums are added up as integers.
2. Each partition reduces its centred rows, block by block, to the triangular
   factor R of a QR decomposition; factors are merged up to 64 at a time until one
   is left. R'R is n times the covariance, but nothing was squared to get it.
3. The driver, which holds d x d numbers only, reduces R to a bidiagonal matrix
   by Householder reflections, finds its singular values by dqds (differential
   quotient-difference with shifts, which keeps the relative accuracy of each)
   and the right singular vectors by twisted factorisations of the tridiagonal
   product. Vectors of close values are made orthogonal inside their group.
4. Rows are projected with the d x k matrix; a pass before that adds up the
   covariance of the projections, to state how far it is from the identity.

Odd rows: null vectors and vectors with null, not finite or unrepresentable
entries (64 times the entry beyond 2^53) have no result. The dimension is the
length that most vectors have (ties: the greater); vectors of another length
take no part. Null ids and repeated rows are rows like others; other columns
are ignored. Directions without variance (up to rounding) cannot be whitened
and are not returned, so one row, or equal rows, give no result, as does an
empty table. Equal eigenvalues leave the choice within their space open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.session import materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
BLOCK_ROWS = 4096        # rows of one QR block
MERGE_WIDTH = 64         # triangular factors of one merging task, at most
MERGE_BYTES = 1 << 27    # their bytes, at most (two factors at least)
EPS = np.finfo(float).eps
LARGEST = float(2 ** 53)


# ------------------------------------------------------------ rows as integers

def _matrix(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the usable vectors, their integers) of one batch."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(lengths == d)
    if not len(fits) or d == 0:
        return fits[:0], np.empty((0, d), np.int64)
    flat = vectors.take(pa.array(fits)).flatten()
    c = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, d)
    scaled = c * SCALE
    with np.errstate(invalid="ignore"):
        good = (np.abs(scaled) <= LARGEST).all(axis=1)      # false for nan too
    return fits[good], np.floor(scaled[good]).astype(np.int64) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    """The usable rows of a partition in blocks of BLOCK_ROWS."""
    held, rows = [], 0
    for batch in batches:
        x = _matrix(batch.column("embedding"), d)[1]
        held.append(x)
        rows += len(x)
        if rows >= BLOCK_ROWS:
            yield np.concatenate(held)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def _dimension(vectors: DataFrame) -> int:
    best = (vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count()
            .orderBy(F.desc("count"), F.desc("d")).first())
    return best.d if best else 0


def _sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """The size of the fit list and its exact sum in each dimension."""
    def partial(batches):
        n, total = 0, np.zeros(d, object)
        for x in _blocks(batches, d):
            n += len(x)
            total += x.sum(axis=0).astype(object)   # a block's sum fits: 2^12 rows below 2^53
        yield pa.RecordBatch.from_pydict({"dim": np.arange(-1, d, dtype=np.int32), "total": [str(v) for v in [n, *total]]})

    added = (vectors.mapInArrow(partial, "dim int, total string").groupBy("dim")
             .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    of = {r.dim: int(r.total) for r in added}
    return of.get(-1, 0), [of.get(i, 0) for i in range(d)]


# ----------------------------------------------------------------- blockwise QR

@dataclass(frozen=True)
class Centre:
    """Subtracts S/n without losing the small difference: S = quotient * n + rest."""
    n: int
    sums: tuple[int, ...]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        quotient = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - quotient).astype(float) - rest

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, exact."""
        quotient = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        off = x - quotient                                        # n x - S = n off - rest
        if not len(off):
            return []
        if (int(np.abs(off).max()) + 1) * self.n < 2 ** 30 // max(1, int(len(self.sums) ** 0.5) + 1):
            return [int(v) for v in ((off * self.n - rest.astype(np.int64)) ** 2).sum(axis=1)]
        out = [int(v) for v in ((off.astype(object) * self.n - rest) ** 2).sum(axis=1)]
        if max(out) >= 2 ** 63:
            raise OverflowError("a deviation doesn't fit in a long")
        return out


def _factor(rows: np.ndarray, d: int) -> np.ndarray:
    """The triangular factor of a QR decomposition, d x d."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


def _triangle(vectors: DataFrame, d: int, centre: Centre) -> np.ndarray:
    """R of the QR decomposition of all centred rows."""
    def reduce_rows(batches):
        r = None
        for x in _blocks(batches, d):
            c = centre(x)
            r = _factor(c if r is None else np.vstack([r, c]), d)
        if r is not None:
            yield pa.RecordBatch.from_pydict({"r": [r.ravel()]}, schema=pa.schema([("r", pa.list_(pa.float64()))]))

    def merge(table: pa.Table) -> pa.Table:
        r = None
        for flat in table.column("r"):
            part = flat.values.to_numpy(zero_copy_only=False).reshape(d, d)
            r = part if r is None else _factor(np.vstack([r, part]), d)
        return pa.table({"slot": table.column("slot").slice(0, 1), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    factors = materialize(vectors.mapInArrow(reduce_rows, "r array<double>")
                          .withColumn("slot", F.spark_partition_id().cast("long")), "factors")
    width = max(2, min(MERGE_WIDTH, MERGE_BYTES // (8 * d * d)))
    while factors.count() > 1:
        factors = materialize(factors.withColumn("slot", F.floor(F.col("slot") / width)).groupBy("slot")
                              .applyInArrow(merge, "slot long, r array<double>"), "factors")
    row = factors.first()
    return np.zeros((d, d)) if row is None else np.array(row.r).reshape(d, d)


# -------------------------------------------- bidiagonal form, dqds, twisted factors

def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V): r = U B V' with B upper bidiagonal; U isn't kept."""
    a, d = r.astype(float).copy(), len(r)
    v = np.eye(d)
    for k in range(d):
        for left in (True, False):
            x = a[k:, k].copy() if left else a[k, k + 1:].copy()
            if len(x) < 2:
                continue
            alpha = -np.copysign(np.linalg.norm(x), x[0])
            x[0] -= alpha
            norm = np.linalg.norm(x)
            if norm == 0:
                continue
            x /= norm
            if left:
                a[k:, k:] -= 2 * np.outer(x, x @ a[k:, k:])
            else:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ x, x)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transform of q, e with a shift; None if the shift was too large."""
    m = len(q)
    nq, ne = [0.0] * m, [0.0] * (m - 1)
    d = least = q[0] - shift
    if d < 0:
        return None
    for i in range(m - 1):
        nq[i] = d + e[i]
        if nq[i] <= 0:
            # an exact zero splits the problem; a shift would hide it
            if shift:
                return None
            ne[i], d = 0.0, q[i + 1]
        else:
            t = q[i + 1] / nq[i]
            ne[i] = e[i] * t
            d = d * t - shift
        if d < 0:
            return None
        least = min(least, d)
    nq[-1] = d
    return nq, ne, least


def dqds(diagonal: np.ndarray, superdiagonal: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, each to high relative accuracy.

    Works on q (squares of the diagonal) and e (squares above it). Shifts stay
    below the smallest eigenvalue left, so that every d remains positive: a
    shift that turned one negative is given up for a smaller one.
    """
    found: list[float] = []
    work = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in superdiagonal], 0.0)]
    while work:
        q, e, sigma = work.pop()
        guess = 0.0
        while q:
            if len(q) == 1:
                found.append(q[0] + sigma)
                break
            cut = next((i for i in range(len(e) - 1, -1, -1)
                        if e[i] <= EPS * EPS * (sigma + q[i]) or e[i] <= EPS * EPS * (sigma + q[i + 1])
                        or e[i] == 0.0), None)
            if cut is not None:
                work.append((q[:cut + 1], e[:cut], sigma))
                q, e, guess = q[cut + 1:], e[cut + 1:], 0.0
                continue
            if q[0] < q[-1] and len(q) > 1 and q[0] * 2.25 < q[-1]:
                # graded the wrong way round: the reversed matrix has the same singular values
                q, e = q[::-1], e[::-1]
            step = None
            for shift in (guess, guess / 4, 0.0):
                step = _sweep(q, e, shift)
                if step is not None:
                    break
            q, e, least = step
            sigma += shift
            # the smallest d is above the smallest eigenvalue left and closes in on it
            tail = max(0.0, q[-1] - (e[-1] ** 0.5) * (q[-1] ** 0.5)) if e else q[-1]
            guess = max(0.0, min(0.9 * least, tail if tail else 0.75 * least))
    return np.sort(np.array(found))[::-1]


class _Twisted:
    """Twisted factorisations N D N' of T - value, T = B'B tridiagonal with q, e the squares of B's entries.

    T - value is factored from the top (stationary qd) and from the bottom
    (progressive qd); at twist k both meet and gamma[k] measures the residual.
    """

    def __init__(self, q: np.ndarray, e: np.ndarray, value: float):
        m, tiny = len(q), np.finfo(float).tiny ** 0.5
        self.lower, self.upper = np.zeros(m - 1), np.zeros(m - 1)
        self.top, self.bottom = np.zeros(m), np.zeros(m)
        s, p, b = np.zeros(m), np.zeros(m), np.sqrt(q[:-1] * e)
        s[0] = -value
        for i in range(m - 1):
            plus = q[i] + s[i]
            self.top[i] = plus = plus if abs(plus) > tiny else tiny
            self.lower[i] = b[i] / plus
            s[i + 1] = e[i] * (s[i] / plus) - value
        p[-1] = q[-1] - value
        for i in range(m - 2, -1, -1):
            minus = e[i] + p[i + 1]
            self.bottom[i + 1] = minus = minus if abs(minus) > tiny else tiny
            self.upper[i] = b[i] / minus
            p[i] = q[i] * (p[i + 1] / minus) - value
        gamma = s + p + value
        self.k = k = int(np.argmin(np.abs(gamma)))
        self.pivots = np.concatenate([self.top[:k], [gamma[k] if abs(gamma[k]) > tiny else tiny], self.bottom[k + 1:]])

    def _back(self, y: np.ndarray) -> np.ndarray:
        """x of N'x = y, of length one."""
        x = y.copy()
        for i in range(self.k - 1, -1, -1):
            x[i] -= self.lower[i] * x[i + 1]
        for i in range(self.k, len(x) - 1):
            x[i + 1] -= self.upper[i] * x[i]
        return x / np.linalg.norm(x)

    def vector(self) -> np.ndarray:
        """The eigenvector that one solution with a unit vector at the twist gives."""
        y = np.zeros(len(self.pivots))
        y[self.k] = 1.0
        return self._back(y)

    def solve(self, b: np.ndarray) -> np.ndarray:
        """The direction of (T - value)^-1 b: a step of inverse iteration."""
        y, k = b.copy(), self.k
        for i in range(1, k):
            y[i] -= self.lower[i - 1] * y[i - 1]
        for i in range(len(y) - 2, k, -1):
            y[i] -= self.upper[i] * y[i + 1]
        if k:
            y[k] -= self.lower[k - 1] * y[k - 1]
        if k < len(y) - 1:
            y[k] -= self.upper[k] * y[k + 1]
        y /= self.pivots
        return self._back(y / np.abs(y).max())


def _orthogonal(z: np.ndarray, group: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """z without its parts along the group's vectors, and what was left of its length."""
    left = 1.0
    for _ in range(2):
        for other in group:
            z = z - (other @ z) * other
        norm = float(np.linalg.norm(z))
        left *= norm
        if norm == 0:
            return z, 0.0
        z = z / norm
    return z, left


def _vector(q: np.ndarray, e: np.ndarray, value: float, group: list[np.ndarray]) -> np.ndarray:
    """The eigenvector of a value; where the group of close values has nearly that one, another by inverse iteration."""
    if len(q) == 1:
        return np.ones(1)
    z, left = _orthogonal(_Twisted(q, e, value).vector(), group)
    if left > 0.1:
        return z
    # a little beside the value all directions of its space grow alike, also those that the group hasn't
    factors = _Twisted(q, e, value * (1 - 8 * EPS * (1 + len(group))))
    noise = np.random.default_rng(len(group))
    best = (left, z)
    for _ in range(20):
        z, _ = _orthogonal(noise.standard_normal(len(q)), group)
        for _ in range(3):
            z, left = _orthogonal(factors.solve(z), group)
        best = max(best, (left, z), key=lambda x: x[0])
        if best[0] > 0.1:
            break
    return best[1]


# Values closer than this, relative to the larger, are one group whose vectors are made orthogonal.
CLOSE = 1e-3


def right_singular(diagonal: np.ndarray, superdiagonal: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest squared singular values of a bidiagonal matrix and their right singular vectors (columns).

    A negligible coupling splits the matrix; each part has vectors of its own.
    """
    m = len(diagonal)
    # a coupling below rounding of both neighbours moves no value beyond its own rounding
    negligible = EPS / 4 * np.minimum(np.abs(diagonal[:-1]), np.abs(diagonal[1:]))
    cuts = [i + 1 for i in range(m - 1) if abs(superdiagonal[i]) <= negligible[i]]
    pairs: list[tuple[float, np.ndarray]] = []
    for lo, hi in zip([0, *cuts], [*cuts, m]):
        d, s = diagonal[lo:hi], superdiagonal[lo:hi - 1]
        values = dqds(d, s)
        sign = np.sign(d[:-1] * s) if hi - lo > 1 else np.zeros(0)      # signs of T's off-diagonal
        flip = np.concatenate([[1.0], np.cumprod(np.where(sign == 0, 1.0, sign))])
        group: list[np.ndarray] = []
        for j, value in enumerate(values[:k]):
            if j and values[j - 1] - value > CLOSE * values[j - 1]:
                group = []
            z = _vector(d ** 2, s ** 2, value, group)
            group.append(z)
            full = np.zeros(m)
            full[lo:hi] = z * flip
            pairs.append((float(value), full))
    pairs.sort(key=lambda x: -x[0])
    return np.array([v for v, _ in pairs[:k]]), np.array([z for _, z in pairs[:k]]).T


def directions(r: np.ndarray, n: int, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns, share of the trace) of R'R / n, falling, without the null space."""
    d = len(r)
    largest = float(np.abs(r).max(initial=0.0))
    if largest == 0 or n == 0:
        return np.empty(0), np.empty((d, 0)), np.empty(0)
    diagonal, above, v = bidiagonalise(r / largest)
    values, z = right_singular(diagonal, above, min(k, d))
    keep = values > (8 * d * EPS) ** 2 * values[0]
    values, z = values[keep], v @ z[:, keep]
    z /= np.linalg.norm(z, axis=0)
    trace = float((diagonal ** 2).sum() + (above ** 2).sum())
    return values * largest ** 2 / n, z, values / trace


# ----------------------------------------------------------------- the operator

@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: whitened = (x - S/n) projected on a component, over the root of its eigenvalue."""
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ (self.vectors / np.sqrt(self.values))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of vectors (embedding), or None if there is no variance."""
    vectors = vectors.select("embedding")
    d = _dimension(vectors)
    n, sums = _sums(vectors, d) if d else (0, [])
    if n < 2:
        return None
    centre = Centre(n, tuple(sums))
    values, basis, explained = directions(_triangle(vectors, d, centre), n, components)
    return Whitening(centre, values, basis, explained) if len(values) else None


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    d, k = w.vectors.shape

    def partial(batches):
        total = np.zeros((k, k))
        for x in _blocks(batches, d):
            y = w.project(x)
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({"cell": np.arange(k * k, dtype=np.int32), "total": total.ravel()})

    cells = (vectors.select("embedding").mapInArrow(partial, "cell int, total double").groupBy("cell")
             .agg((F.sum("total") / w.centre.n).alias("c")))
    off = F.abs(F.col("c") - F.when(F.col("cell") % (k + 1) == 0, 1.0).otherwise(0.0))
    return cells.agg(F.max(off)).first()[0]


RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector of (vec_id, embedding) and component: the whitened coordinate and the fit's figures."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    w = fit(vectors, components)
    if w is None:
        return spark.createDataFrame([], RESULT)
    return vectors.mapInArrow(_rows(w, identity_error(vectors, w)), RESULT)


def _rows(w: Whitening, error: float) -> Callable:
    d, k = w.vectors.shape

    def rows(batches):
        for batch in batches:
            at, x = _matrix(batch.column("embedding"), d)
            if not len(at):
                continue
            m = len(at)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, w.centre.n, np.int64)),
                pa.array(np.repeat(np.array(w.centre.deviation(x), np.int64), k)),
                pa.array(w.project(x).ravel()),
                pa.array(np.tile(w.explained, m)),
                pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows
