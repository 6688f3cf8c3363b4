"""Embedding whitening by FEAST contour integration.

1. Vectors become whole numbers ``x = floor(scale * c) + shift``; the fit list is written once.
2. Tasks sum x, and then the products of x centred on the nearest whole mean; what that
   leaves of the mean, under one half a dimension, is taken out of the sums. All sums are
   of whole numbers and exact, so the covariance does not depend on the order of tasks.
3. Inertia counts (negative pivots of the shifted covariance, by its tridiagonal form)
   tell how many eigenvalues lie above any point. They give intervals that end in gaps of
   the spectrum and together hold the wanted components.
4. In each interval, a quadrature over a circle of solves with the complex shifted covariance
   projects random vectors onto the interval's eigenvectors, and Rayleigh-Ritz extracts
   them. An interval is done when it holds as many as the inertia counts say, to rounding.
5. A last Rayleigh-Ritz over all intervals makes the components orthogonal to each other.

Scale. Rows are never sent anywhere: a task gives one row per pair of dimensions, which a
grouped sum adds up. The driver holds one matrix of dimensions x dimensions, whatever the
number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries are held within this bound, so that products and their sums stay exact; an embedding's entries are near 1.
MOST = 1 << 40
#: Nodes of the quadrature over half a circle, and rounds of projection before the subspace is doubled.
NODES, ROUNDS = 8, 6
#: An interval spans eigenvalues up to this ratio; wider ones are cut at their widest gap.
SPREAD = 4.0
_EXACT = 1 << 53


def fit_list(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(vec_id, x)`` of all vectors without null or non-finite entries, written to the shared folder.

    Vectors of another length than most (ties: the longer) lack entries or have too many; they count as holding nulls.
    """
    vec = F.col(vec_col).cast("array<double>")
    sound = vec.isNotNull() & F.coalesce(F.forall(vec, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))), F.lit(False))
    whole = F.transform("v", lambda c: (F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(-float(MOST)))) + shift).cast("long"))
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.when(sound, vec).alias("v")).where(F.col("v").isNotNull())
    most = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return written(kept.where(F.size("v") == (most["d"] if most else 0)).select("vec_id", whole.alias("x")), "whole_vectors")


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _added(vectors: DataFrame, sums: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, Decimal | float]:
    """Sums over all rows of the flat array that ``sums`` gives for a block of x, by position. One row per position leaves a task."""
    arrow = pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = sums(_matrix(batch.column(0), batch.num_rows))
                total = found if total is None else total + found
        if total is not None:
            values = pa.array([Decimal(int(v)) for v in total], arrow) if arrow != pa.float64() else pa.array(total.astype(float), arrow)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), values], ["cell", "value"])

    found = vectors.select("x").mapInArrow(rows, f"cell long, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    return {r["cell"]: r["value"] for r in found.collect()}


def _whole_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of whole numbers as exact Python integers: blocks small enough for doubles to hold their sums exactly."""
    largest = int(np.abs(y).max(initial=1)) ** 2
    if largest >= _EXACT:
        y = y.astype(object)
        return y.T.dot(y)
    step = max(1, min(4096, _EXACT // max(largest, 1) - 1))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), step):
        block = y[at:at + step].astype(np.float64)
        total = total + (block.T @ block).astype(np.int64).astype(object)
    return total


@dataclass(frozen=True)
class Moments:
    """Count, sums and covariance (divisor n) of the fit list."""
    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray

    @property
    def near(self) -> list[int]:
        """The nearest whole mean."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """n times what the nearest whole mean leaves of the mean."""
        return [s - self.n * m for s, m in zip(self.sums, self.near, strict=True)]


def moments(vectors: DataFrame) -> Moments | None:
    """Moments of a fit list ``(x)``; None without rows or dimensions."""
    def plain(x: np.ndarray) -> np.ndarray:
        safe = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
        return np.append((x if safe else x.astype(object)).sum(axis=0).astype(object), len(x))

    first = _added(vectors, plain, "decimal(38,0)")
    if len(first) < 2:
        return None
    *sums, n = [int(first[k]) for k in range(len(first))]
    base = Moments(n, tuple(sums), np.zeros((0, 0)))
    near, d = np.array(base.near, np.int64), len(sums)
    upper = np.triu_indices(d)
    products = _added(vectors, lambda x: _whole_products(x - near)[upper], "decimal(38,0)")
    v = np.zeros((d, d))
    for k, (i, j) in enumerate(zip(*upper, strict=True)):
        # Whole numbers until the last division: n * sum(y y') - r r', over n * n.
        v[i, j] = v[j, i] = (n * int(products[k]) - base.rest[i] * base.rest[j]) / (n * n)
    return Moments(n, tuple(sums), v)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared side diagonal of a tridiagonal matrix with the eigenvalues of symmetric ``a``, by reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        size = math.sqrt(v @ v)
        if not size:
            continue
        head = -math.copysign(size, v[0])
        v[0] -= head
        v /= math.sqrt(v @ v)
        b = a[k + 1:, k + 1:]
        p = b @ v
        p = 2 * (p - (v @ p) * v)
        b -= np.outer(v, p) + np.outer(p, v)
        a[k + 1, k] = a[k, k + 1] = head
    return np.diag(a).copy(), np.diag(a, 1) ** 2


def above(form: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """Inertia: for each shift, how many eigenvalues lie above it, the positive pivots of the shifted matrix."""
    diagonal, side = form
    shifts = np.atleast_1d(np.asarray(shifts, float))
    tiny = np.finfo(float).tiny ** 0.5
    pivot = diagonal[0] - shifts
    count = (pivot > 0).astype(int)
    for k in range(1, len(diagonal)):
        pivot = diagonal[k] - shifts - side[k - 1] / np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def located(form: tuple[np.ndarray, np.ndarray], top: float, halvings: int = 50) -> np.ndarray:
    """Where the eigenvalues of [0, top] lie, falling, by halving with inertia counts."""
    place = np.arange(1, len(form[0]) + 1)
    lo, hi = np.zeros(len(place)), np.full(len(place), top)
    for _ in range(halvings):
        mid = (lo + hi) / 2
        high = above(form, mid) >= place
        lo, hi = np.where(high, mid, lo), np.where(high, hi, mid)
    return (lo + hi) / 2


def intervals(form: tuple[np.ndarray, np.ndarray], top: float, wanted: int) -> list[tuple[float, float, int]]:
    """``(low, high, eigenvalues within)`` of intervals from the top that hold at least the ``wanted`` largest eigenvalues above rounding.

    The last interval ends in the widest relative gap among as many places again, or among
    all if those eigenvalues are equal. Fewer are held if fewer are above rounding.
    """
    floor = 4 * len(form[0]) * np.finfo(float).eps * top
    places = located(form, top)
    rank = int((places > floor).sum())
    if not rank or not wanted:
        return []
    places = np.append(places[:rank], floor / 4)
    gap = 1 - places[1:] / places[:-1]
    wanted = min(wanted, rank)
    near = range(wanted - 1, min(rank, 2 * wanted))
    end = max(near, key=lambda k: gap[k])
    if gap[end] < 1e-9:
        end = max(range(wanted - 1, rank), key=lambda k: gap[k])
    groups, done = [(0, end)], []
    while groups:
        i, j = groups.pop()
        if i < j and places[i] > SPREAD * places[j]:
            k = max(range(i, j), key=lambda k: gap[k])
            groups += [(i, k), (k + 1, j)]
        else:
            done.append((i, j))
    cut = (places[1:] + places[:-1]) / 2
    out = []
    for i, j in sorted(done):
        low, high = cut[j], cut[i - 1] if i else 1.05 * top
        out.append((low, high, int(above(form, low)[0] - above(form, high)[0])))
    return out


def feast(a: np.ndarray, low: float, high: float, count: int, scale: float, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of symmetric ``a`` in (low, high): contour projections and Rayleigh-Ritz until residuals are rounding.

    If rounds do not settle, the subspace is doubled, up to the whole space.
    """
    d = len(a)
    if not count:
        return np.zeros(0), np.zeros((d, 0))
    middle, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(1j * math.pi / 2 * (at + 1))
    small = 8 * d * np.finfo(float).eps * scale
    random = np.random.default_rng(d)
    y = random.standard_normal((d, min(d, max(2 * count, count + 8))))
    while True:
        for _ in range(ROUNDS):
            q = np.zeros_like(y)
            for t, w in zip(turn, weight, strict=True):
                q += w / 2 * (radius * t * np.linalg.solve((middle + radius * t) * np.eye(d) - a, y)).real
            q = np.linalg.qr(q)[0]
            values, u = np.linalg.eigh(q.T @ a @ q)
            y = q @ u
            inside = (values > low) & (values < high)
            if inside.sum() == count:
                v = y[:, inside]
                if np.abs(a @ v - v * values[inside]).max() <= small:
                    return values[inside], v
        if y.shape[1] == d:
            raise ArithmeticError(f"{inside.sum()} of {count} eigenpairs between {low} and {high}")
        y = np.hstack([y, random.standard_normal((d, min(d, 2 * y.shape[1]) - y.shape[1]))])


def components(a: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and unit eigenvectors as columns, their largest entry positive."""
    top = float(np.trace(a))
    if not top > 0:
        return np.zeros(0), np.zeros((len(a), 0))
    form = tridiagonal(a)
    # The largest eigenvalue, not the trace, sets the scale of rounding and of the first circle.
    top = float(located(form, top)[0])
    parts = [feast(a, low, high, count, top) for low, high, count in intervals(form, 1.0001 * top, wanted)]
    if not parts:
        return np.zeros(0), np.zeros((len(a), 0))
    basis = np.linalg.qr(np.hstack([v for _, v in parts]))[0]
    values, u = np.linalg.eigh(basis.T @ a @ basis)
    v = basis @ u[:, ::-1][:, :wanted]
    v = v / np.sqrt((v * v).sum(axis=0))
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return values[::-1][:wanted], v * sign


class Whitening:
    """Components of a fit list; ``transform`` projects rows, ``error`` measures how far whitened rows are from whitened."""

    def __init__(self, found: Moments, wanted: int = COMPONENTS):
        self.moments = found
        self.values, self.vectors = components(found.covariance, wanted)
        self.explained = self.values / np.trace(found.covariance) if len(self.values) else self.values

    def _project(self) -> Callable[[np.ndarray], np.ndarray]:
        near, rest, n = np.array(self.moments.near, np.int64), np.array([float(r) for r in self.moments.rest]), self.moments.n
        onto = self.vectors / np.sqrt(self.values)
        return lambda x: ((x - near) - rest / n) @ onto

    def error(self, vectors: DataFrame) -> float:
        """Largest absolute entry of the covariance of the whitened rows minus the identity, from the rows themselves."""
        project, k = self._project(), len(self.values)
        if not k:
            return 0.0
        first = _added(vectors, lambda x: project(x).sum(axis=0), "double")
        mean = np.array([first[i] for i in range(k)]) / self.moments.n

        def products(x: np.ndarray) -> np.ndarray:
            w = project(x) - mean
            return (w.T @ w).ravel()

        second = _added(vectors, products, "double")
        cov = np.array([second[i] for i in range(k * k)]).reshape(k, k) / self.moments.n
        return float(np.abs(cov - np.eye(k)).max())

    def transform(self, vectors: DataFrame) -> DataFrame:
        """Rows ``(vec_id, component, deviation, whitened)`` of a fit list ``(vec_id, x)``, one per row and component."""
        project, n, k = self._project(), self.moments.n, len(self.values)
        near, rest = np.array(self.moments.near, np.int64), self.moments.rest

        def deviations(y: np.ndarray) -> list[int | None]:
            bound = (n * int(np.abs(y).max(initial=0)) + n) ** 2 * max(1, y.shape[1])
            t = n * y.astype(np.int64 if bound < 1 << 62 else object) - np.array(rest, np.int64 if bound < 1 << 62 else object)
            return [int(v) if v < 1 << 63 else None for v in (t * t).sum(axis=1)]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1), batch.num_rows)
                again = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(deviations(x - near), pa.int64()).take(again), pa.array(project(x).ravel())],
                    ["vec_id", "component", "deviation", "whitened"])

        kind = dict(vectors.dtypes)["vec_id"]
        return vectors.select("vec_id", "x").mapInArrow(rows, f"vec_id {kind}, component int, deviation long, whitened double")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), one per sound vector and component.

    Null vectors and vectors with null, NaN or infinite entries are dropped. Components with
    no variance above rounding have no whitened value and no rows, so equal vectors, one
    vector or an empty table give no rows. Ids may be null or repeated: every row counts. A
    deviation beyond a long is null. Other columns are not read.
    """
    rows = fit_list(vectors, id_col, vec_col)
    found = moments(rows)
    model = Whitening(found) if found else None
    if not model or not len(model.values):
        kind = dict(rows.dtypes)["vec_id"]
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share: Column = F.element_at(F.array(*[F.lit(float(e)) for e in model.explained]), F.col("component"))
    return model.transform(rows).select("vec_id", "component", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
                                        share.alias("explained"), F.lit(model.error(rows)).alias("identity_error"))


def op11_feast_whitening(spark, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whiten(read_table(spark, sf_dir, "embeddings"))
