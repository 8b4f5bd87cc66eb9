"""Whitening of embeddings by the leading eigenvectors of their covariance, found by contour integration.

One pass gives sums, one the covariance, both folded in a tree of tasks. Its spectrum is cut into slices by inertia counts, and a
Spark task solves each slice: a quadrature of (zI - V)^-1 Y along a circle around the slice projects onto the slice's
eigenvectors, Rayleigh-Ritz extracts them, and this repeats until the residuals are down to rounding. A slice that gives another
number of eigenvalues than its inertia counts say is solved again with more nodes in a wider space. A last pass measures
the covariance of the whitened rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
DIMENSIONS = 4096  # at most: the covariance, which tasks and the driver hold, is then 128 MB
SLICE, NODES, ROUNDS = 8, 8, 40  # eigenvalues of a slice, points on a half circle, repetitions
ROWS = 4096


def usable(vectors: DataFrame, ids: str = "vec_id", column: str = "embedding") -> DataFrame:
    """ids and column of the rows whose vector isn't null or empty and has only finite entries (below 2^56, so that longs hold them)."""
    entry = F.col(column).cast("array<double>")
    sound = F.forall(entry, lambda c: F.coalesce(F.abs(c) < float(1 << 56), F.lit(False)))  # NaN is larger than any number
    return vectors.select(F.col(ids), entry.alias(column)).where(F.col(column).isNotNull() & sound & (F.size(column) > 0))


def scaled(column: pa.Array, size: int) -> np.ndarray:
    """Rows x entries of a column of vectors, as whole numbers: floor(64 c) + 1000000."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def _folded(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray | None:
    """The sum of the arrays that part makes of each partition, folded in two levels; None if there are no rows.

    An array is summed in the order of partitions, so the same partitions give the same bits.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = part(batches)
        if found is not None:
            yield _row(TaskContext.get().partitionId(), found)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(b.column("part").to_pylist(), b.column("data").to_pylist())), key=lambda r: r[0])
        if rows:
            yield _row(rows[0][0], sum(np.frombuffer(d, kind) for _, d in rows))

    def _row(number: int, array: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.ascontiguousarray(array).tobytes()], pa.binary())], names=["part", "data"])

    kind = part.kind
    schema, tasks = "part long, data binary", rows.rdd.getNumPartitions()
    level = max(math.isqrt(tasks), 1)
    some = rows.mapInArrow(first, schema).repartitionById(level, (F.col("part") % level).cast("int")).mapInArrow(fold, schema)
    found = some.repartitionById(1, F.lit(0)).mapInArrow(fold, schema).collect()
    return np.frombuffer(found[0]["data"], kind) if found else None


def _sums(column: str, size: int):
    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            total[0] += batch.num_rows
            total[1:] += scaled(batch.column(column), size).sum(axis=0)
        return total if total[0] else None

    part.kind = np.int64
    return part


def _products(column: str, size: int, centre: np.ndarray, basis: np.ndarray):
    """Sums of the rows, centred and times basis, and of their products."""
    width = basis.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total, products, seen = np.zeros(width), np.zeros((width, width)), False
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                rows = (scaled(batch.column(column).slice(begin, ROWS), size) - centre) @ basis
                total += rows.sum(axis=0)
                products += rows.T @ rows
                seen = True
        return np.concatenate((total, products.ravel())) if seen else None

    part.kind = np.float64
    return part


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a symmetric matrix after Householder reflections, which leave its inertia as it is."""
    a = matrix.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            continue
        x[0] += math.copysign(size, x[0])
        x /= np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ x
        p -= x * (x @ p)
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(x, p) + np.outer(p, x))
        rest = a[k + 1 :, k] - 2 * x * (x @ a[k + 1 :, k])
        a[k + 1 :, k], a[k, k + 1 :] = rest, rest
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy()


def counts_above(diagonal: np.ndarray, side: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie above each shift: the positive pivots of T - shift I = L D L'."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot, above = diagonal[0] - shifts, np.zeros(len(shifts), np.int64)
    for k in range(len(diagonal)):
        if k:
            pivot = diagonal[k] - shifts - side[k - 1] ** 2 / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        above += pivot > 0
    return above


@dataclass
class Slice:
    """An interval of the spectrum and how many eigenvalues its inertia counts say lie within."""

    low: float
    high: float
    count: int


def slices(covariance: np.ndarray, wanted: int, most: int = SLICE) -> list[Slice]:
    """Intervals that hold the wanted largest eigenvalues (and those that can't be told from the last), about most in each.

    Edges lie within the widest gap at hand; eigenvalues closer than the rounding of the covariance are never parted.
    """
    diagonal, side = tridiagonal(covariance)
    n, top = len(diagonal), float(np.abs(covariance).sum(axis=1).max())
    if top == 0:
        return []
    reach = min(wanted + most, n)  # where the next ones are must be known to leave a gap below the last
    low, high = np.full(reach, -top * 1e-3), np.full(reach, top * 1.001)
    for _ in range(60):  # the k-th largest eigenvalue lies where the count passes k
        middle = (low + high) / 2
        above = counts_above(diagonal, side, middle) > np.arange(reach)
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    places = (low + high) / 2
    apart = 1e-9 * top
    gaps = np.append(places[:-1] - places[1:], np.inf if reach == n else 0)  # below each
    cuts, done = [], 0
    while done < wanted:
        last = min(done + most, reach) - 1
        choice = np.arange(min(max(done + most // 2, done + 1), last + 1) - 1, last + 1)
        if last + 1 >= wanted:
            choice = np.arange(wanted - 1, min(wanted + most, reach))
            choice = choice[:1] if gaps[choice[0]] > max(apart, 1e-3 * places[choice[0]]) else choice
        best = int(choice[np.argmax(gaps[choice])])
        while gaps[best] <= apart and best + 1 < reach:
            best += 1
        below = places[best + 1] if best + 1 < reach else -top if best + 1 == n else low[best] - apart
        cuts.append((best, (places[best] + below) / 2))
        done = best + 1
    edges = np.array([top * 1.001, *(c for _, c in cuts)])
    above = counts_above(diagonal, side, edges)
    return [Slice(float(edges[k + 1]), float(edges[k]), int(above[k + 1] - above[k])) for k in range(len(cuts))]


def solved(covariance: np.ndarray, part: Slice, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) within a slice, as many as its inertia counts say."""
    n, rng = len(covariance), np.random.default_rng(seed)
    centre, radius = (part.low + part.high) / 2, (part.high - part.low) / 2
    norm = float(np.abs(covariance).sum(axis=1).max())
    for attempt in range(4):
        width, nodes = min(n, (part.count + max(4, part.count // 2)) << attempt), NODES << attempt
        x, weight = np.polynomial.legendre.leggauss(nodes)
        turn = np.exp(-0.5j * np.pi * (x - 1))  # points of the upper half circle; the lower half gives the conjugates
        space, best = rng.standard_normal((n, width)), np.inf
        for _ in range(ROUNDS):
            projected = np.zeros((n, width))
            for t, w in zip(turn, weight):
                projected += 0.5 * w * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(n) - covariance, space.astype(complex))).real
            space, _ = np.linalg.qr(projected)
            values, inner = np.linalg.eigh(space.T @ covariance @ space)
            space = space @ inner
            inside = np.flatnonzero((values > part.low) & (values <= part.high))[::-1]
            left = np.abs(covariance @ space[:, inside] - space[:, inside] * values[inside]).max(initial=0)
            if len(inside) == part.count and left <= 4 * np.finfo(float).eps * math.sqrt(n) * norm:
                return values[inside], space[:, inside]
            if left >= best and len(inside) == part.count and left <= 1e-13 * n * norm:
                return values[inside], space[:, inside]  # rounding is all that is left
            best = min(best, left) if len(inside) == part.count else np.inf
    raise RuntimeError(f"inertia counts say that {part.count} eigenvalues lie in ({part.low}, {part.high}], but {len(inside)} were found")


@dataclass
class Whitening:
    """What a fit found: n vectors with sums, and of each component the eigenvalue and (columns) the unit eigenvector."""

    size: int
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def basis(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def eigenvectors(spark: SparkSession, covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted largest eigenvalues of a covariance above its rounding, falling, and their unit eigenvectors; a task for each slice."""
    parts = slices(covariance, wanted)
    if not parts:
        return np.zeros(0), np.zeros((len(covariance), 0))
    shared = spark.sparkContext.broadcast(covariance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values, vectors = solved(shared.value, Slice(r["low"], r["high"], r["count"]), r["number"])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], names=["value", "vector"])

    rows = spark.createDataFrame([(k, p.low, p.high, p.count) for k, p in enumerate(parts) if p.count], "number int, low double, high double, count long")
    found = rows.repartitionById(len(parts), F.col("number")).mapInArrow(run, "value double, vector array<double>").collect()  # wanted + a slice rows at most
    shared.unpersist()
    space, _ = np.linalg.qr(np.array([r["vector"] for r in found]).T)
    values, inner = np.linalg.eigh(space.T @ covariance @ space)  # once more over all slices, so that they are at right angles
    values, vectors = values[::-1], (space @ inner)[:, ::-1]
    kept = np.flatnonzero(values > 8 * len(covariance) * np.finfo(float).eps * np.trace(covariance))[:wanted]
    vectors = vectors[:, kept]
    return values[kept], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))])


def fit(vectors: DataFrame, ids: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fits on all usable vectors of the length that most of them have (of several such, the largest); None without any.

    Repeated vectors count as often as they come. Directions without variance, beyond rounding, have no component.
    """
    rows = usable(vectors, ids, column).select(column)
    common = rows.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return None
    size = common["size"]
    if size > DIMENSIONS:
        raise ValueError(f"vectors of {size} entries: the covariance of more than {DIMENSIONS} is too large for a task")
    rows = rows.where(F.size(column) == size)
    total = _folded(rows, _sums(column, size))
    n, sums = int(total[0]), total[1:]
    centre = np.array([s / n for s in sums.tolist()])

    def covariance(basis: np.ndarray) -> np.ndarray:
        found = _folded(rows, _products(column, size, centre, basis))
        width = basis.shape[1]
        mean = found[:width] / n  # nothing but rounding
        both = found[width:].reshape(width, width) / n - np.outer(mean, mean)
        return (both + both.T) / 2

    own = covariance(np.eye(size))
    values, axes = eigenvectors(vectors.sparkSession, own, min(components, size))
    model = Whitening(size, n, sums, values, axes, float(np.trace(own)), 0.0)
    if len(values):
        model.identity_error = float(np.abs(covariance(model.basis()) - np.eye(len(values))).max())
    return model


def whiten(vectors: DataFrame, model: Whitening, ids: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each usable vector of the model's length and each component: ids, component, n, deviation, whitened, explained, identity_error.

    deviation is exact; where a long can't hold it the query fails. Null and repeated ids are rows like others; further columns are not read.
    """
    rows = usable(vectors, ids, column).where(F.size(column) == model.size)
    kind = rows.schema[ids].dataType.simpleString()
    centre, basis = np.array([s / model.n for s in model.sums.tolist()]), model.basis()
    explained = model.values / model.trace if len(model.values) else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                some = batch.slice(begin, ROWS)
                x = scaled(some.column(column), model.size)
                apart = model.n * x - model.sums
                if (apart.astype(float) ** 2).sum(axis=1).max() > 9e18:
                    raise OverflowError("the deviation of a vector is more than a long holds")
                many, k = len(x), len(explained)
                columns = [
                    some.column(ids).take(pa.array(np.repeat(np.arange(many), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, model.n)),
                    pa.array(np.repeat((apart * apart).sum(axis=1), k)), pa.array(((x - centre) @ basis).ravel()), pa.array(np.tile(explained, many)), pa.array(np.full(many * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[ids, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"`{ids}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(vectors)
    return whiten(vectors, model or Whitening(0, 0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0, 0.0))
