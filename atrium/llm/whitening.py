"""Embedding whitening with a polarisation covariance.

Entries become integers x, and so do centred values y = n * x - S (n vectors, S the sum of x per
dimension).  Three exact aggregates follow each other: n and S; then the sum of squares of y for
every dimension and of y_i + y_j for every pair of dimensions.  Half of the difference
sum (y_i + y_j)^2 - sum y_i^2 - sum y_j^2 is the sum of y_i * y_j, so squares alone give all
cross-covariances.  Divided by n^3 once, as whole numbers, they make the covariance, whose
eigenvectors come from eigh.

What reaches the driver is one number per pair of dimensions, whatever the number of rows.  Squares
are added in tasks as two halves of 32 bits and between tasks in limbs of 30; values too large for
that are added as Python integers.

Defined results: a row goes if its vector is null or empty, or holds a null or non-finite entry; the
dimension is the most frequent length among the rest (the longer of equals), and rows of another
length go too; x keeps within 2^62; repeated rows, equal vectors and null ids count and stay like any
other; fewer dimensions than ``components`` give that many components; a component without variance
(one vector, constant dimensions) has null in ``whitened`` and is left out of ``identity_error``;
``explained`` is null when nothing varies; ``deviation`` is null beyond 64 bits; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
ROWS = 1024  # vectors treated at once in a task
LIMIT = float(1 << 62)


class Model(NamedTuple):
    """Whitening of vectors of one dimension."""

    n: int
    sums: list[int]
    axes: np.ndarray  # dimensions x components, unit columns
    values: np.ndarray  # eigenvalue of each component
    trace: float


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has no null and no non-finite entry and is not empty."""
    bad = F.exists(column, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(~F.coalesce(bad, F.lit(False)))


def _matrices(batches: Iterator[pa.RecordBatch], column: str, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of bounded size with their integers x (rows x dim)."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT).astype(np.int64) + SHIFT
            yield part, x.reshape(part.num_rows, dim)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """y = n * x - S, as int64 if its pair sums fit, else as Python integers."""
    most = max(int(x.max()), -int(x.min())) if x.size else 0
    if 4 * (n * most + max(map(abs, sums.tolist()), default=0)) < 1 << 63:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _square_sum(values: np.ndarray) -> list[int]:
    """Exact sum of squares of each column."""
    if values.dtype != object and values.size and int(np.abs(values).max()) < 1 << 32:
        v = np.abs(values).astype(np.uint64)
        v *= v
        low = (v & np.uint64(0xFFFFFFFF)).sum(axis=0)
        high = (v >> np.uint64(32)).sum(axis=0)
        return [(h << 32) + a for a, h in zip(low.tolist(), high.tolist())]
    return (values.astype(object) ** 2).sum(axis=0).tolist()


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """Most frequent length of the vectors, the longer of equals; 0 without rows."""
    lengths = vectors.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("c"))
    first = lengths.orderBy(F.desc("c"), F.desc("d")).first()
    return first["d"] if first else 0


def sums(vectors: DataFrame, dim: int, column: str = "embedding") -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of x in each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for _, x in _matrices(batches, column, dim):
            n += len(x)
            small = x.size and int(np.abs(x).max()) < 1 << 50
            total = [a + b for a, b in zip(total, (x if small else x.astype(object)).sum(axis=0).tolist())]
        if n:
            yield _numbers([-1, *range(dim)], [n, *total])

    got = _summed(vectors.select(column).mapInArrow(add, "at int, limb int, value long"))
    return got.get(-1, 0), [got.get(i, 0) for i in range(dim)]


def squares(vectors: DataFrame, dim: int, n: int, total: list[int], column: str = "embedding") -> list[list[int]]:
    """Sums of (y_i + y_j)^2 for i < j, and of y_i^2 on the diagonal."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, out = np.array(total, object), None
        for _, x in _matrices(batches, column, dim):
            y = _centred(x, n, center)
            part = _square_sum(y)
            for i in range(dim - 1):
                part += _square_sum(y[:, i:i + 1] + y[:, i + 1:])
            out = part if out is None else [a + b for a, b in zip(out, part)]
        if out is not None:
            yield _numbers(range(len(out)), out)

    got = _summed(vectors.select(column).mapInArrow(add, "at int, limb int, value long"))
    table, at = [[0] * dim for _ in range(dim)], dim
    for i in range(dim):
        table[i][i] = got.get(i, 0)
    for i in range(dim - 1):
        for j in range(i + 1, dim):
            table[i][j] = got.get(at, 0)
            at += 1
    return table


LIMB = 30  # bits of a whole number that are added as one long


def _numbers(at, values: list[int]) -> pa.RecordBatch:
    """Whole numbers of any size as rows (at, limb, value): a task's number is the sum of value * 2^(30 * limb)."""
    rows = []
    for k, v in zip(at, values):
        sign, v, limb = (-1 if v < 0 else 1), abs(v), 0
        while v:
            rows.append((k, limb, sign * (v & ((1 << LIMB) - 1))))
            v, limb = v >> LIMB, limb + 1
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["at", "limb", "value"])


def _summed(parts: DataFrame) -> dict[int, int]:
    """Exact sum per ``at`` over all tasks; limbs are added as longs, which 2^33 tasks do not overflow."""
    out: dict[int, int] = {}
    for r in parts.groupBy("at", "limb").agg(F.sum("value").alias("value")).collect():  # a few numbers per key
        out[r["at"]] = out.get(r["at"], 0) + (r["value"] << (LIMB * r["limb"]))
    return out


def covariance(table: list[list[int]], n: int) -> np.ndarray:
    """Covariance (divisor n) of x from exact sums of squares, each entry rounded once."""
    dim = len(table)
    out = np.zeros((dim, dim))
    for i in range(dim):
        out[i, i] = Fraction(table[i][i], n ** 3)
        for j in range(i + 1, dim):
            out[i, j] = out[j, i] = Fraction(table[i][j] - table[i][i] - table[j][j], 2 * n ** 3)
    return out


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS, column: str = "embedding") -> Model | None:
    """Whitening of usable vectors of one length; None without rows."""
    n, total = sums(vectors, dim, column)
    if not n:
        return None
    v = covariance(squares(vectors, dim, n, total, column), n)
    values, axes = np.linalg.eigh(v)
    top = np.argsort(-values, kind="stable")[:components]
    return Model(n, total, np.ascontiguousarray(axes[:, top]), values[top], float(np.trace(v)))


def _whiten(y: np.ndarray, model: Model) -> np.ndarray:
    """Rows x components; nan where a component has no variance."""
    centred = (y / model.n).astype(np.float64)
    flat = model.values <= model.trace * len(model.sums) * np.finfo(float).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(flat, np.nan, centred @ model.axes / np.sqrt(np.where(flat, 1.0, model.values)))


def identity_error(vectors: DataFrame, model: Model, column: str = "embedding") -> float | None:
    """Largest absolute entry of (covariance of the whitened vectors - identity), measured on all of them."""
    dim, k = len(model.sums), len(model.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros(k), np.zeros((k, k))
        for _, x in _matrices(batches, column, dim):
            z = np.nan_to_num(_whiten(_centred(x, model.n, np.array(model.sums, object)), model))
            total += z.sum(axis=0)
            product += z.T @ z
        values = [*total.tolist(), *product.ravel().tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["at", "value"])

    got = vectors.select(column).mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    value = np.array([r["value"] for r in sorted(got, key=lambda r: r["at"])])
    mean = value[:k] / model.n
    off = np.abs(value[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k))
    live = model.values > model.trace * dim * np.finfo(float).eps
    return float(off[np.ix_(live, live)].max()) if live.any() else None


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    The model is fitted on all usable rows.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = usable(vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding")), "embedding")
    dim = dimension(good)
    good = good.filter(F.size("embedding") == dim)
    model = fit(good, dim, components) if dim else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(good, model)
    k = len(model.values)
    explained = [e / model.trace for e in model.values.tolist()] if model.trace > 0 else [None] * k

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, "embedding", dim):
            y = _centred(x, model.n, np.array(model.sums, object))
            rows, z = len(y), _whiten(y, model).ravel()
            exact = y.dtype != object and (not y.size or int(np.abs(y).max()) <= math.isqrt((1 << 62) // dim))
            deviation = (y * y).sum(axis=1).tolist() if exact else [s if s < 1 << 63 else None for s in (y.astype(object) ** 2).sum(axis=1).tolist()]
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n, np.int64)), pa.array(deviation, pa.int64()).take(pa.array(each)), pa.array(z, from_pandas=True),
                pa.array(explained * rows, pa.float64()), pa.array([error] * (rows * k), pa.float64()),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(work, schema)
