"""Whitening of vectors from an exact, bit-sliced scatter matrix.

Components become integers.  Over a block of rows, each dimension, shifted to start at 0, is split
into bit planes, and each plane is packed across the rows into 64-bit words.  The bits two planes
share, weighted by both planes' powers of two, add up to the exact cross-product of two dimensions.
Blocks, tasks and Spark's sums only ever add integers, so the covariance is exact and centred before
its first rounding, whatever the number or order of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reefline.llm.common import stored

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
BLOCK_ROWS = 4096
# Cross-products travel as two decimals of at most 38 digits, which no sum of them overflows.
LIMB = 10 ** 30
MOMENTS = "dim int, i int, j int, high decimal(38,0), low decimal(38,0)"


def on_grid(vector: Column) -> Column:
    """floor(1024 * c) + 100000 of each component; null if the vector or a component is null or not finite.

    Components beyond 2^52 in size, whose integers would not hold, count as not finite.
    """
    wide = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 52)))
    return F.when(sound, F.transform(wide, lambda c: F.floor(c * SCALE).cast("long") + OFFSET))


def bit_planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """Rows x dims of unsigned integers as (dims, bits, words): row r is bit r % 64 of word r // 64."""
    rows, dims = shifted.shape
    planes = np.zeros((dims, bits, -(-rows // 64) * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        planes[:, b, :packed.shape[1]] = packed
    return planes.view(np.uint64)


def block_moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and the upper triangle of exact cross-products of a block of integer rows, as Python integers."""
    rows, dims = x.shape
    low = x.min(0)
    shifted = x.astype(np.uint64) - low.astype(np.uint64)  # wraps back to the true difference
    bits = int(shifted.max()).bit_length()
    cross = np.zeros((dims, dims), object)
    sums = np.zeros(dims, object)
    if bits:
        planes = bit_planes(shifted, bits)
        flat = planes.reshape(dims * bits, -1)
        fits = 2 * bits + rows.bit_length() < 63
        weights = np.array([1 << b for b in range(bits)], np.int64 if fits else object)
        counted = lambda words: np.bitwise_count(words).sum(-1, dtype=np.int64).astype(weights.dtype)
        sums = (counted(planes) @ weights).astype(object)
        for i in range(dims):
            onward = flat[i * bits:]
            row = sum(weights[a] * (counted(planes[i, a] & onward).reshape(dims - i, bits) @ weights) for a in range(bits))
            cross[i, i:] = row.astype(object)
    base = low.astype(object)
    cross = cross + np.outer(base, sums) + np.outer(sums, base) + rows * np.outer(base, base)
    return sums + rows * base, cross


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, row numbers, integer matrix) of the vectors of each length in a batch."""
    vectors = batch.column(column)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        yield int(dim), rows, vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per sum and cross-product of all rows of a task: i, j from 0; i = -1 sums; i = j = -1 the rows."""
    totals: dict[int, list] = {}
    for batch in batches:
        for dim, _, x in _matrices(batch, "x"):
            mine = totals.setdefault(dim, [0, np.zeros(dim, object), np.zeros((dim, dim), object)])
            for at in range(0, len(x), BLOCK_ROWS):
                sums, cross = block_moments(x[at:at + BLOCK_ROWS])
                mine[0], mine[1], mine[2] = mine[0] + min(BLOCK_ROWS, len(x) - at), mine[1] + sums, mine[2] + cross
    for dim, (rows, sums, cross) in totals.items():
        cells = [(-1, -1, rows), *((-1, j, v) for j, v in enumerate(sums)),
                 *((i, j, cross[i, j]) for i in range(dim) for j in range(i, dim))]
        limbs = [divmod(int(v), LIMB) for _, _, v in cells]
        ints = lambda values: pa.array(values, pa.int32())
        decimals = lambda values: pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [ints([dim] * len(cells)), ints([c[0] for c in cells]), ints([c[1] for c in cells]),
             decimals([h for h, _ in limbs]), decimals([low for _, low in limbs])], names=["dim", "i", "j", "high", "low"])


class Whitening:
    """The fitted constants of vectors of one length: n, exact sums, components by falling eigenvalue.

    A component whose eigenvalue is 0 to double precision has no whitened value.
    """

    def __init__(self, n: int, sums: list[int], cross: np.ndarray, components: int = COMPONENTS):
        dim = len(sums)
        self.n, self.sums = n, sums
        # centred as integers, divided once
        covariance = np.array([[(n * cross[min(i, j), max(i, j)] - sums[i] * sums[j]) / (n * n) for j in range(dim)]
                               for i in range(dim)], np.float64).reshape(dim, dim)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        trace = float(np.trace(covariance))
        self.eigenvalues = np.maximum(values[order], 0.0)
        self.explained = [float(e) / trace if trace > 0 else None for e in self.eigenvalues]
        usable = self.eigenvalues > trace * dim * np.finfo(float).eps
        scale = np.where(usable, 1 / np.sqrt(np.where(usable, self.eigenvalues, 1)), np.nan)
        self.axes = (vectors[:, order] * scale).T
        # the mean as an integer part and a rest under 1
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.floor) - np.array([r / self.n for r in self.rest])) @ self.axes.T

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - sum)^2, exact at any size."""
        moved, rest = x - self.floor, np.array(self.rest, object)
        most = int(np.abs(moved).max(initial=0))
        fits = len(rest) * most * max(most, self.n) < 1 << 62
        if not fits:
            moved = moved.astype(object)
        squares = (moved * moved).sum(1)
        mixed = (moved * (rest.astype(np.int64) if fits else rest)).sum(1)
        left = sum(r * r for r in self.rest)
        n = self.n
        return [n * n * int(s) - 2 * n * int(m) + left for s, m in zip(squares, mixed)]


def fit(points: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The constants of each vector length of `points` (x: array of long).

    The driver gets one number per pair of dimensions, however many rows there are.
    """
    summed = points.select("x").mapInArrow(_scatter, MOMENTS).groupBy("dim", "i", "j").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low"))
    counts, sums, cross = {}, {}, {}
    for dim, i, j, high, low in summed.collect():
        value = int(high) * LIMB + int(low)
        if i >= 0:
            cross.setdefault(dim, np.zeros((dim, dim), object))[i, j] = value
        elif j >= 0:
            sums.setdefault(dim, [0] * dim)[j] = value
        else:
            counts[dim] = value
    return {d: Whitening(n, sums[d], cross[d], components) for d, n in counts.items()}


def _whitened(batches: Iterator[pa.RecordBatch], models: dict[int, Whitening]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, rows, x in _matrices(batch, "x"):
            model = models[dim]
            # what does not fit in 38 digits is left empty
            exact = [Decimal(v) if v < 10 ** 38 else None for v in model.deviations(x)]
            values = [[None if np.isnan(v) else v for v in row] for row in model.apply(x).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), pa.array([dim] * len(rows), pa.int32()),
                 pa.array(exact, pa.decimal128(38, 0)), pa.array(values, pa.list_(pa.float64()))],
                names=["vec_id", "dim", "deviation", "whitened"])


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and component.

    `vectors` has vec_id and vec.  Vectors that are null or hold a null or non-finite component take
    no part; null and repeated ids do, each row for itself.  Vectors of another length are whitened
    among their own.  An empty vector has no component and gives no rows.  `deviation` is
    decimal(38,0), null beyond that; `whitened` is null along a direction without variance.
    `identity_error` is measured over the whitened values of all rows of a length.
    """
    points = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), on_grid(F.col("vec")).alias("x")).filter(
        F.size("x") > 0)
    models = fit(points, components)
    white = stored(points.mapInArrow(lambda batches: _whitened(batches, models),
                                     "vec_id long, dim int, deviation decimal(38,0), whitened array<double>"), "whitened")
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    at = lambda i: F.get("whitened", i)
    seen = white.groupBy("dim").agg(*[F.avg(at(i) * at(j)).alias(f"m{i}_{j}") for i, j in pairs],
                                    *[F.avg(at(i)).alias(f"m{i}") for i in range(components)]).collect()
    known = []
    for r in seen:
        off = [abs(r[f"m{i}_{j}"] - r[f"m{i}"] * r[f"m{j}"] - (i == j)) for i, j in pairs if r[f"m{i}_{j}"] is not None]
        model = models[r["dim"]]
        known.append((r["dim"], model.n, model.explained, max(off, default=None)))
    # one row per vector length
    facts = F.broadcast(vectors.sparkSession.createDataFrame(
        known, "dim int, n long, explained array<double>, identity_error double"))
    return white.join(facts, "dim").select(
        "vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("_at")).alias("explained"), "identity_error")
