"""Embedding whitening by a two-pass covariance over each distinct vector once.

Components are first put on a grid of integers. The first pass sums them exactly, which gives the mean; the second sums the outer products of centred
vectors, one matrix product a batch; ``treeAggregate`` merges the tasks' matrices in levels, so the driver gets a few however many tasks there are. LAPACK's
symmetric solver gives the axes, which are broadcast (d * k numbers) to project every row. A third pass measures the covariance of what came out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.common import materialize

COMPONENTS = 16
#: x = floor(SCALE * c) + SHIFT. Entries whose x would leave a long count as non-finite.
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 62)
#: A sum is kept in two halves, each of which fits a long for up to 2**31 rows a task.
_HALF = 31


@dataclass(frozen=True)
class Whitening:
    """The fit of one dimension: ``n`` vectors, exact sums, eigenvalues falling, axes as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    error: float | None = None

    @property
    def projection(self) -> np.ndarray:
        """Axes over the roots of their eigenvalues; NaN where a component has no variance beyond rounding."""
        flat = self.values <= self.values[0] * len(self.sums) * np.finfo(float).eps if len(self.values) else np.zeros(0, bool)
        return self.axes / np.sqrt(np.where(flat, np.nan, self.values))


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite entry."""
    fine = lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < LARGEST)  # noqa: E731  (false for NaN and infinity: NaN is the largest)
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(fine(c), F.lit(False)))


def on_grid(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, matrix of longs) of a batch's column x."""
    x = batch.column("x")
    sizes = np.diff(x.offsets.to_numpy())
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _centred(x: np.ndarray, fit: Whitening | tuple[int, list[int]]) -> np.ndarray:
    """x - S/n in double precision: the whole part of the mean is taken off exactly."""
    n, sums = fit if isinstance(fit, tuple) else (fit.n, fit.sums)
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([s % n / n for s in sums])


def _tree(fit_list: DataFrame, task: Callable, schema: str, start: Callable, add: Callable) -> dict[int, object]:
    """Rows that ``task`` makes of each partition, merged by dimension along a tree. ``start`` reads a row's value, ``add`` adds two."""

    def merge(a: dict, b: dict) -> dict:
        return a | {d: add(a[d], v) if d in a else v for d, v in b.items()}

    return fit_list.mapInArrow(task, schema).rdd.treeAggregate({}, lambda found, row: merge(found, {row["d"]: start(row)}), merge, depth=2)


def exact_sums(fit_list: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each dimension how many vectors there are, and their sums as Python integers."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for d, _, x in _by_dimension(batch):
                n, high, low = found.get(d, (0, 0, 0))
                found[d] = [n + len(x), high + (x >> _HALF).sum(axis=0), low + (x & (1 << _HALF) - 1).sum(axis=0)]
        for d, (n, high, low) in found.items():
            longs = lambda v: pa.array([v.tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n], pa.int64()), longs(high), longs(low)], ["d", "n", "high", "low"])

    start = lambda r: (r["n"], [(h << _HALF) + k for h, k in zip(r["high"], r["low"], strict=True)])
    add = lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)])
    return _tree(fit_list, task, "d int, n long, high array<long>, low array<long>", start, add)


def _products(fit_list: DataFrame, rows: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each dimension the sum of outer products of what ``rows`` makes of the vectors."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_dimension(batch):
                y = rows(d, x)
                found[d] = found.get(d, 0) + y.T @ y
        for d, m in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["d", "m"])

    def start(row):
        m = np.frombuffer(row["m"])
        side = round(len(m) ** 0.5)
        return m.reshape(side, side)

    return _tree(fit_list, task, "d int, m binary", start, lambda a, b: a + b)


def fit(spark: SparkSession, fit_list: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each dimension from ``fit_list`` (column x; read three times, so give a written table)."""
    sums = exact_sums(fit_list)
    shared = spark.sparkContext.broadcast(sums)
    fits = {}
    for d, m in _products(fit_list, lambda d, x: _centred(x, shared.value[d])).items():
        n, s = sums[d]
        values, axes = np.linalg.eigh((m + m.T) / (2 * n)) if d else (np.zeros(0), np.zeros((0, 0)))
        keep = slice(None, -components - 1, -1)
        fits[d] = Whitening(n, s, values[keep].copy(), axes[:, keep].copy(), float(np.trace(m)) / n)
    first = spark.sparkContext.broadcast(fits)
    for d, m in _products(fit_list, lambda d, x: _centred(x, first.value[d]) @ np.nan_to_num(first.value[d].projection)).items():
        kept = np.isfinite(fits[d].projection).all(axis=0) if len(m) else np.zeros(0, bool)
        off = np.abs(m / fits[d].n - np.eye(len(m)))[np.ix_(kept, kept)]
        fits[d] = Whitening(fits[d].n, fits[d].sums, fits[d].values, fits[d].axes, fits[d].trace, float(off.max()) if off.size else None)
    return fits


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the exact sum of (n * x - S)**2 over the dimensions; null where a long can't hold it."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    y = x - whole  # n * x - S is n * y - rest
    largest = int(np.abs(y).max()) + 1 if y.size else 0
    if x.shape[1] * (n * largest) ** 2 < 1 << 63:
        return ((n * y - rest) ** 2).sum(axis=1).tolist()
    if x.shape[1] * largest * max(largest, n) < 1 << 63:
        squares, mixed, own = (y * y).sum(axis=1).tolist(), (y * rest).sum(axis=1).tolist(), sum(int(r) ** 2 for r in rest)
        exact = [n * n * a - 2 * n * b + own for a, b in zip(squares, mixed, strict=True)]
    else:
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def _whitened(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_dimension(batch):
                fitted = shared.value[d]
                k = len(fitted.values)
                z = _centred(x, fitted) @ fitted.projection
                each = lambda v, kind: pa.array(v, kind).take(pa.array(np.repeat(np.arange(len(at)), k)))
                of_component = lambda v: pa.array(np.tile(v, len(at)))
                share = fitted.values / fitted.trace if fitted.trace > 0 else np.zeros(k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(np.repeat(at, k))),
                        of_component(np.arange(1, k + 1, dtype=np.int32)),
                        pa.array(np.full(len(at) * k, fitted.n, np.int64)),
                        each(deviations(x, fitted.n, fitted.sums), pa.int64()),
                        pa.array(z.reshape(-1), from_pandas=True),
                        of_component(np.maximum(share, 0)),
                        pa.array([fitted.error] * (len(at) * k), pa.float64()),
                    ],
                    ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(spark: SparkSession, vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry go. Vectors of unlike dimensions are fitted apart, each list with an n of its own; an
    empty vector has no component, so no row. Repeated rows and rows with a null key count once for the fit if their vectors are equal, and each
    has its rows. Equal eigenvalues (ties) come in the solver's order. A component without variance (fewer distinct vectors than dimensions, constant entries) is
    null in ``whitened`` and no part of identity_error; a deviation that no long can hold is null. Other columns aren't read, so
    their names can't clash; an empty table gives none. A task holds d * d numbers for each dimension it meets.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.where(usable(F.col(column))).select(F.col(key).alias("key"), on_grid(F.col(column)).alias("x"))
    fits = fit(spark, materialize(spark, rows.select("x").distinct()), components)
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_whitened(spark.sparkContext.broadcast(fits)), schema).withColumnRenamed("key", key)
