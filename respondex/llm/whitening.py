"""Whitening of vectors by mixed-precision refinement of the eigenvectors of their covariance.

The covariance is gathered in the cluster: every task multiplies its own block
of centred integer vectors with itself, and Spark sums the blocks entry by
entry. Only a matrix of (dimension x dimension) reaches the driver, however many
vectors there are. There, eigenvectors found in float32 are corrected by the
matrix-multiplication iteration of Ogita and Aishima in extended precision,
which squares the error in each step; eigenvalues too close to be told apart by
the present error are first separated by a small solve inside their cluster.

Entries are integers, x = floor(64 * c) + 1000000, so sums, block products of
ordinary sizes and deviations are exact and do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from respondex.llm.base import scratch

SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this many steps stand at it: their integers would no longer be exact as doubles.
MOST_STEPS = 2.0**51
SPLIT_BITS = 26
MOST_SWEEPS = 40


def usable(vec: Column) -> Column:
    """The vector is there, and so is every entry, finite."""
    return vec.isNotNull() & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))


def steps(vec: Column) -> Column:
    """The vector as integers of 1/64, moved by a million."""
    one = lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-MOST_STEPS)), F.lit(MOST_STEPS)))
    return F.transform(vec, lambda c: one(c) + F.lit(OFFSET).cast("long"))


def blocks(batch: pa.RecordBatch, col: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length in the batch."""
    lists = batch.column(col)
    ends = lists.offsets.to_numpy().astype(np.int64)
    values, sizes = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        if dim:
            yield rows, values[(ends[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)


# --- eigenvectors ---------------------------------------------------------------------------------------


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Runs of two or more sorted values whose neighbours are not further apart than ``apart``."""
    cuts = np.flatnonzero(np.abs(np.diff(values)) > apart) + 1
    return [run for run in np.split(np.arange(len(values)), cuts) if len(run) > 1]


def refined_eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, in extended precision (double where the machine has none).

    Equal eigenvalues get some orthonormal basis of their space. The float32
    start is only a start: the result does not inherit its error.
    """
    a = np.asarray(matrix, dtype=np.longdouble)
    d = len(a)
    size = np.sqrt((a * a).sum())
    if not size:
        return np.zeros(d, dtype=np.longdouble), np.eye(d, dtype=np.longdouble)
    a = a / size
    unit, eps = np.eye(d, dtype=np.longdouble), float(np.finfo(np.longdouble).eps)
    x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(np.longdouble)
    last = np.inf
    for sweep in range(MOST_SWEEPS):
        r = unit - x.T @ x
        s = x.T @ a @ x
        s = (s + s.T) / 2  # rounding must not differ between (i, j) and (j, i), or close pairs lose their right angle
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
        off = s - np.diag(np.diag(s))
        apart = 2 * float(np.sqrt((off * off).sum()) + np.sqrt((r * r).sum()))
        runs = _clusters(values, apart)
        gap = values[None, :] - values[:, None]
        near = np.zeros((d, d), dtype=bool)
        for run in runs:
            near[np.ix_(run, run)] = True
        np.fill_diagonal(near, True)
        step = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ step
        for run in runs:
            # inside a cluster the common part of the eigenvalues is taken off first, so what tells them apart is seen at full precision
            part = x[:, run]
            inner = part.T @ (a @ part - values[run].mean() * part)
            inner = (inner + inner.T) / 2
            scale = np.abs(inner).max()
            if scale > eps:
                x[:, run] = part @ np.linalg.eigh((inner / scale).astype(np.float64))[1][:, ::-1].astype(np.longdouble)
        change = float(np.abs(step).max())
        if change < 4 * eps or (sweep > 8 and change >= last and change < 64 * d * eps):
            break
        last = change
    for _ in range(2):
        x = x + x @ (unit - x.T @ x) / 2
    values = np.diag(x.T @ a @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.where(np.take_along_axis(x, np.abs(x).argmax(axis=0)[None, :], 0) < 0, -1, 1)
    return values[order] * size, x


# --- statistics of the fit list -------------------------------------------------------------------------


@dataclass
class Whitening:
    """What the tasks need to whiten vectors of one length. ``shift`` is the mean rounded to integers."""

    n: int
    shift: np.ndarray
    rest: list[int]
    weights: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) squared, exact: n * x - S is n * (x - shift) - rest."""
        y = x - self.shift
        if float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] * 4 > 2.0**62 or float(np.abs(y).max(initial=0)) * sum(map(abs, self.rest)) > 2.0**62:
            return [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, self.rest)) for row in y]
        squares, crossed = (y * y).sum(axis=1).tolist(), (y @ np.array(self.rest, dtype=np.int64)).tolist()
        own = sum(r * r for r in self.rest)
        return [self.n * self.n * q - 2 * self.n * c + own for q, c in zip(squares, crossed)]


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sum of each dimension, by length of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for rows, x in blocks(batch, 0):
                n, high, low = total.setdefault(x.shape[1], [0, 0, 0])
                total[x.shape[1]] = [n + len(rows), high + (x >> SPLIT_BITS).sum(axis=0), low + (x & ((1 << SPLIT_BITS) - 1)).sum(axis=0)]
        for dim, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim), pa.array(high), pa.array(low)], names=["dim", "i", "n", "high", "low"])

    parts = fit.mapInArrow(run, "dim int, i int, n long, high long, low long").groupBy("dim", "i").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    found: dict[int, tuple[int, list[int]]] = {}
    for row in parts.orderBy("dim", "i").collect():  # a row for each dimension
        found.setdefault(row["dim"], (row["n"], []))[1].append((row["high"] << SPLIT_BITS) + row["low"])
    return found


def _products(fit: DataFrame, of: dict[int, object], transform) -> dict[int, np.ndarray]:
    """Sum over the fit list of each pair of entries of ``transform(model, vectors)``, by length of the vectors.

    A task multiplies block by block and hands on one row for each row of its
    matrix, upper half only; the sums over tasks are ordinary aggregates.
    """
    shared = fit.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in blocks(batch, 0):
                y = transform(shared.value[x.shape[1]], x)
                total[x.shape[1]] = total.get(x.shape[1], 0) + y.T @ y
        for dim, m in total.items():
            upper = [m[i, i:] for i in range(len(m))]
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array(upper, pa.list_(pa.float64()))], names=["dim", "i", "row"])

    cells = fit.mapInArrow(run, "dim int, i int, row array<double>").select("dim", "i", F.posexplode("row").alias("j", "v"))
    table = cells.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toArrow()  # (dimension squared) / 2 rows
    found: dict[int, np.ndarray] = {}
    dims, i, j, v = (table[c].to_numpy() for c in ("dim", "i", "j", "v"))
    for dim in np.unique(dims).tolist():
        own = dims == dim
        m = np.zeros((int(i[own].max()) + 1,) * 2)
        m[i[own], i[own] + j[own]] = v[own]
        found[dim] = np.triu(m) + np.triu(m, 1).T
    return found


def _covariance(n: int, products: np.ndarray, rest: list[int]) -> np.ndarray:
    """(n * products - rest * rest) / n**2 in extended precision. Products below 2**53 are exact integers."""
    r = np.array(rest, dtype=object)
    top = products.astype(object)
    whole = np.array([[n * int(p) - a * b for p, b in zip(row, r)] for row, a in zip(top, r)], dtype=object)
    high = whole.astype(np.float64)
    low = (whole - np.array([[int(h) for h in row] for row in high], dtype=object)).astype(np.float64)
    return (high.astype(np.longdouble) + low) / (np.longdouble(n) * n)


def fit_whitening(fit: DataFrame, components: int = 16) -> dict[int, Whitening]:
    """A model for each length of vectors in the one column of ``fit`` (each vector once).

    Components without variance (eigenvalue below 1e-15 of the trace for each
    dimension) cannot be brought to unit variance and are left out.
    """
    models: dict[int, Whitening] = {}
    for dim, (n, total) in _sums(fit).items():
        shift = [(2 * t + n) // (2 * n) for t in total]
        models[dim] = Whitening(n, np.array(shift, dtype=np.int64), [t - n * s for t, s in zip(total, shift)], np.zeros((dim, 0)), np.zeros(0))
    if not models:
        return models
    products = _products(fit, models, lambda m, x: (x - m.shift).astype(np.float64))
    for dim, m in models.items():
        matrix = _covariance(m.n, products[dim], m.rest)
        trace = np.trace(matrix)
        values, vectors = refined_eigenvectors(matrix)
        k = int((values[:components] > max(trace, 0) * dim * 1e-15).sum())
        m.weights = (vectors[:, :k] / np.sqrt(values[:k])).astype(np.float64)
        m.explained = (values[:k] / trace if k else values[:0]).astype(np.float64)
    whitened = _products(fit, models, lambda m, x: np.hstack([m.centred(x) @ m.weights, np.ones((len(x), 1))]))
    for dim, m in models.items():
        total = whitened[dim] / m.n  # the column of ones gathers the means
        cov, mean = total[:-1, :-1], total[:-1, -1]
        m.identity_error = float(np.abs(cov - np.outer(mean, mean) - np.eye(len(cov))).max(initial=0.0))
    return models


def whiten_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``, a row for each usable vector and component.

    Vectors that are null or hold null, NaN or infinite entries are dropped, and
    so are empty ones. Every other entry c becomes the integer
    floor(64 * c) + 1000000 (beyond 2**51 steps it stands there). The fit list
    holds each distinct integer vector once: ``n`` of them. Components are its
    covariance's unit eigenvectors by falling eigenvalue, from 1 on, the sign
    such that the largest entry is positive. ``deviation`` is the exact sum over
    dimensions of (n * x - S)**2 as decimal(38, 0), S being the sums of the fit
    list; ``explained`` the eigenvalue's share of the trace; ``identity_error``
    the largest entry by which the covariance of the fit list, whitened,
    measured on all of it, differs from the identity.

    Vectors of different lengths are whitened apart, each length with its own
    fit list. Fewer components come where the covariance has fewer with variance
    (none at all where all vectors are equal: such a table gives no row). Null
    and repeated ids stay; an empty table gives an empty table; other columns
    are ignored, whatever their names. Equal vectors meet through partial
    aggregation, so a vector held by a third of all rows is no hot key. The fit
    list is written to the shared folder and deleted when the model stands; the
    driver and the broadcast hold matrices of the dimension's size only.
    """
    kind = vectors.schema[id_col].dataType
    rows = vectors.select(vectors[id_col].alias("_id"), vectors[vec_col].alias("_vec")).where(usable(F.col("_vec"))).where(F.size("_vec") > 0)
    rows = rows.select("_id", steps(F.col("_vec")).alias("_x"))
    with scratch(rows.select("_x").distinct(), "fit-list") as fit:
        models = fit_whitening(fit, components)
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for picked, x in blocks(batch, 1):
                m = shared.value[x.shape[1]]
                k = m.weights.shape[1]
                if not k:
                    continue
                repeat, total = np.repeat(np.arange(len(picked)), k), len(picked) * k
                deviation = pa.array([Decimal(v) for v in m.deviations(x)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(picked[repeat])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(picked))), pa.array(np.full(total, m.n)),
                    deviation.take(pa.array(repeat)), pa.array((m.centred(x) @ m.weights).ravel()), pa.array(np.tile(m.explained, len(picked))), pa.array(np.full(total, m.identity_error)),
                ], names=schema.names)

    return rows.mapInArrow(run, schema)
