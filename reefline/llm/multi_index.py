"""Approximate nearest neighbours by inner product over an inverted multi-index.

Both halves of the vectors are quantised on their own; the pairs of centroids are the cells.  A query
takes cells in falling order of the sum of its halves' products with the two centroids (the summed
distance of an inner product), found by a heap over the two sorted lists, until the cells hold a given
share of all vectors.  The entries of those cells are ranked by their exact products.  The share is
measured when the index is fitted: the least one that finds TARGET of the true neighbours of sample
vectors in the sample.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reefline.functions.frames import top_per_key
from reefline.llm.common import mix64, stored

# The index is fitted on at most SAMPLE vectors, of which TRIALS are asked as queries.
SAMPLE, TRIALS, ROUNDS = 12_000, 400, 10
CENTROIDS = 32
TARGET = 0.97
# Entries a task meets at once, and queries.
SLICE_ROWS, QUERY_BLOCK = 8192, 1024
FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """The vector in doubles; null if it is null, empty or zero or holds a null or non-finite component."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    sound = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(sound & F.exists(wide, lambda c: c != 0), wide)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids ** 2).sum(1) - 2 * (x @ centroids.T)).argmin(1)


def cluster(x: np.ndarray, count: int) -> np.ndarray:
    """k-means from the first `count` rows; `x` comes in hash order, so these are a random choice."""
    centroids = x[:count].copy()
    for _ in range(ROUNDS):
        home = nearest_centroid(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        sizes = np.bincount(home, minlength=len(centroids))
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


class MultiIndex:
    """Centroids of both halves, the share of vectors a query meets, and (later) how many each cell holds."""

    def __init__(self, x: np.ndarray, k: int):
        self.half = x.shape[1] // 2
        count = max(1, min(CENTROIDS, int(len(x) ** 0.5 / 2)))
        self.left, self.right = cluster(x[:, :self.half], count), cluster(x[:, self.half:], count)
        self.sizes = np.bincount(self.cell(x), minlength=count * count)
        self.share = self._needed(x, k)

    def cell(self, x: np.ndarray) -> np.ndarray:
        first = nearest_centroid(x[:, :self.half], self.left)
        return first * len(self.right) + nearest_centroid(x[:, self.half:], self.right)

    def _needed(self, x: np.ndarray, k: int) -> float:
        """The share of the sample that has TARGET of its own vectors' true neighbours, cell by cell."""
        asked = x[:TRIALS]
        products = asked @ x.T
        products[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        near = np.argsort(-products, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
        if not near.size:
            return 1.0
        cells = self.cell(x)
        met = []
        for query, mine in zip(asked, near):
            order = np.fromiter(self.cells(query, 1.0), np.int64)
            before = np.zeros(len(self.sizes), np.int64)
            before[order] = np.cumsum(self.sizes[order]) - self.sizes[order]
            met.append(before[cells[mine]])
        return float(np.quantile(np.concatenate(met), TARGET, method="higher")) / len(x)

    def cells(self, query: np.ndarray, share: float) -> Iterator[int]:
        """Cells by falling summed product, until those taken hold more than the share of all vectors."""
        left, right = self.left @ query[:self.half], self.right @ query[self.half:]
        by_left, by_right = np.argsort(-left, kind="stable").tolist(), np.argsort(-right, kind="stable").tolist()
        left, right = left[by_left].tolist(), right[by_right].tolist()
        width, sizes = len(right), self.sizes
        wanted, taken = share * float(sizes.sum()), 0
        heap = [(-(left[0] + right[0]), 0, 0)]
        while heap and taken <= wanted:
            _, i, j = heapq.heappop(heap)
            cell = by_left[i] * width + by_right[j]
            if sizes[cell]:
                taken += int(sizes[cell])
                yield cell
            # the pair to the right, and a new row once its first pair is due
            if j + 1 < width:
                heapq.heappush(heap, (-(left[i] + right[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(left):
                heapq.heappush(heap, (-(left[i + 1] + right[0]), i + 1, 0))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        yield int(dim), batch.take(pa.array(np.flatnonzero(dims == dim)))


def _fit(key: tuple, rows: pa.Table, k: int) -> pa.Table:
    dim = key[0].as_py()
    # in hash order, so that the fit does not depend on how the sample arrived
    ids = rows.column("vec_id").to_numpy()
    x = _matrix(rows.column("vec"), dim)[np.lexsort((ids, mix64(ids)))]
    index = MultiIndex(x, k)
    body = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
    return pa.table({"dim": pa.array([dim], pa.int32()), "left": body(index.left), "right": body(index.right),
                     "share": pa.array([index.share])})


def fit(entries: DataFrame, k: int, share: float | None = None) -> dict[int, MultiIndex]:
    """The index of each vector length, fitted on at most SAMPLE distinct vectors, sizes counted over all."""
    distinct = entries.filter("copy = 1")
    sample = top_per_key(distinct, ["dim"], [F.xxhash64("vec_id"), F.asc("vec_id")], SAMPLE)
    made = sample.groupBy("dim").applyInArrow(lambda key, rows: _fit(key, rows, k),
                                              "dim int, left binary, right binary, share double").collect()
    indexes = {}
    for r in made:
        index = MultiIndex.__new__(MultiIndex)
        index.half = r["dim"] // 2
        index.right = np.frombuffer(r["right"]).reshape(-1, r["dim"] - index.half)
        index.left = np.frombuffer(r["left"]).reshape(len(index.right), index.half)
        index.share = r["share"] if share is None else share
        index.sizes = np.zeros(len(index.right) ** 2, np.int64)
        indexes[r["dim"]] = index
    return indexes


def _place(batches: Iterator[pa.RecordBatch], indexes: dict[int, MultiIndex]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, rows in _by_dim(batch):
            cells = indexes[dim].cell(_matrix(rows.column("vec"), dim))
            first, second = np.divmod(cells, len(indexes[dim].right))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())],
                names=[*rows.schema.names, "first", "second"])


def _plan(batches: Iterator[pa.RecordBatch], indexes: dict[int, MultiIndex]) -> Iterator[pa.RecordBatch]:
    """One row per query and first centroid, with the second centroids of the cells to visit."""
    for batch in batches:
        for dim, rows in _by_dim(batch):
            index = indexes[dim]
            at, first, second = [], [], []
            for n, query in enumerate(_matrix(rows.column("vec"), dim)):
                by_first: dict[int, list[int]] = {}
                for cell in index.cells(query, index.share):
                    by_first.setdefault(cell // len(index.right), []).append(cell % len(index.right))
                at += [n] * len(by_first)
                first += by_first
                second += by_first.values()
            some = rows.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*some.columns, pa.array(first, pa.int32()), pa.array(second, pa.list_(pa.int32()))],
                names=[*some.schema.names, "first", "seconds"])


def _rank(key: tuple, queries: pa.Table, entries: pa.Table, k: int) -> pa.Table:
    """The best k of a slice of entries for each query that visits their cells."""
    none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not queries.num_rows or not entries.num_rows:
        return none
    dim = key[0].as_py()
    asked, query_ids = _matrix(queries.column("vec"), dim), queries.column("query_id").to_numpy()
    entries = entries.sort_by([("second", "ascending"), ("vec_id", "ascending")])
    points, ids = _matrix(entries.column("vec"), dim), entries.column("vec_id").to_numpy()
    seconds = entries.column("second").to_numpy()
    wanted = queries.column("seconds").combine_chunks()
    flat = wanted.flatten().to_numpy()
    owner = np.repeat(np.arange(len(asked)), wanted.value_lengths().to_numpy())
    best, best_ids = np.full((len(asked), k), -np.inf), np.full((len(asked), k), np.iinfo(np.int64).max)
    for second in np.unique(seconds):
        start, end = np.searchsorted(seconds, [second, second + 1])
        rows = owner[flat == second]
        if not len(rows):
            continue
        # the plain sum over the dimensions: equal vectors get equal scores wherever they lie
        scores = np.einsum("qd,ed->qe", asked[rows], points[start:end])
        scores[query_ids[rows][:, None] == ids[None, start:end]] = -np.inf
        all_scores = np.concatenate([best[rows], scores], axis=1)
        all_ids = np.concatenate([best_ids[rows], np.broadcast_to(ids[start:end], scores.shape)], axis=1)
        first = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        best[rows] = np.take_along_axis(all_scores, first, 1)
        best_ids[rows] = np.take_along_axis(all_ids, first, 1)
    row, place = np.nonzero(best_ids < np.iinfo(np.int64).max)
    found = pa.table({"query_id": pa.array(query_ids[row]), "vec_id": pa.array(best_ids[row, place]),
                      "score": pa.array(best[row, place])})
    return found.filter(pa.array(best[row, place] > -np.inf))


def search(vectors: DataFrame, queries: DataFrame, k: int, share: float | None = None) -> DataFrame:
    """Each query's k nearest found by inner product: query_id, rank, vec_id, score; ties to smaller ids.

    `vectors` has vec_id and vec, `queries` query_id and vec.  Rows with a null id or a vector that is
    null, empty, zero or holds a null or non-finite component take no part.  A query meets vectors of
    its own length only, and not its own id.  Rows that repeat id and vector count once; of rows that
    share a query_id the least vector asks.  All other rows are indexed.  `share` (of all distinct
    vectors, 0 to 1) overrides the measured one; 1 makes the search exact.  Fewer than k vectors met
    give fewer rows.  Scores are finite while components stay within 1e150.
    """
    sound = lambda df, name: df.select(F.col(name).cast("long").alias(name), usable(F.col("vec")).alias("vec")).filter(
        F.col(name).isNotNull() & F.col("vec").isNotNull()).select(name, "vec", F.size("vec").alias("dim"))
    # of equal vectors the k + 1 least ids can be among a query's k best; a query's own id is one of them
    entries = stored(top_per_key(sound(vectors, "vec_id").distinct(), ["dim", "vec"], [F.asc("vec_id")], k + 1, rank="copy"), "entries")
    indexes = fit(entries, k, share)
    placed = stored(entries.mapInArrow(lambda batches: _place(batches, indexes),
                                       "vec_id long, vec array<double>, dim int, copy int, first int, second int"), "placed")
    # at most CENTROIDS^2 cells for each vector length
    for r in placed.filter("copy = 1").groupBy("dim", "first", "second").count().collect():
        indexes[r["dim"]].sizes[r["first"] * len(indexes[r["dim"]].right) + r["second"]] = r["count"]
    slices = placed.groupBy("dim", "first").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
    asked = sound(queries, "query_id").groupBy("query_id", "dim").agg(F.min("vec").alias("vec"))
    asked = top_per_key(asked, ["query_id"], [F.asc("dim")]).filter(F.col("dim").isin(list(indexes)) if indexes else F.lit(False))
    planned = stored(asked.select("query_id", "vec", "dim").mapInArrow(
        lambda batches: _plan(batches, indexes), "query_id long, vec array<double>, dim int, first int, seconds array<int>"), "planned")
    crowds = planned.groupBy("dim", "first").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    # one row per first centroid: how many slices of entries and blocks of queries it has
    deal = slices.join(crowds, ["dim", "first"])
    pick = lambda name, many: F.pmod(F.xxhash64(name), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    by = ["dim", "first", "slice", "block"]
    left = planned.join(deal, ["dim", "first"]).withColumn("block", pick("query_id", "blocks")).withColumn(
        "slice", every("slices")).select("query_id", "vec", "seconds", *by)
    right = placed.join(deal, ["dim", "first"]).withColumn("slice", pick("vec_id", "slices")).withColumn(
        "block", every("blocks")).select("vec_id", "vec", "second", *by)
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda key, q, e: _rank(key, q, e, k), FOUND)
    return top_per_key(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k, rank="rank").select(
        "query_id", "rank", "vec_id", "score")
