"""Exact top-k search by inner product over KD-trees, one for each shard of the vectors.

Each shard's tree splits its vectors at the median of the widest side and keeps tight bounding
boxes.  A box bounds the inner product of a query with any vector inside it.  Every query first
searches the shard of its own id; the k-th score found there is handed on to all other shards,
where whole subtrees under that bound are left out and leaves are visited best bound first.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reefline.functions.frames import top_per_key
from reefline.llm.common import stored

SHARD_ROWS = 4096
LEAF_ROWS = 64
QUERY_BLOCK = 512
EXACT = float(1 << 53)

TREE = ("dim int, shard int, ids binary, points binary, lefts binary, rights binary, starts binary, "
        "ends binary, lows binary, highs binary")
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component, or null if the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(sound, F.transform(wide, lambda x: F.floor(x * 256).cast("long")))


def build_tree(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Order of the points along the leaves, and the nodes: children, row ranges and tight boxes."""
    order = np.arange(len(points))
    nodes: dict[str, list] = {n: [] for n in ("lefts", "rights", "starts", "ends", "lows", "highs")}

    def add(start: int, end: int) -> int:
        inside = points[order[start:end]]
        for name, value in zip(nodes, (-1, -1, start, end, inside.min(0), inside.max(0))):
            nodes[name].append(value)
        return len(nodes["starts"]) - 1
    open_nodes = [add(0, len(points))] if len(points) else []
    while open_nodes:
        at = open_nodes.pop()
        start, end = nodes["starts"][at], nodes["ends"][at]
        widths = nodes["highs"][at] - nodes["lows"][at]
        if end - start <= LEAF_ROWS or not widths.any():
            continue
        side, middle = int(widths.argmax()), (start + end) // 2
        rows = order[start:end]
        order[start:end] = rows[np.argpartition(points[rows, side], middle - start)]
        nodes["lefts"][at], nodes["rights"][at] = add(start, middle), add(middle, end)
        open_nodes += [nodes["lefts"][at], nodes["rights"][at]]
    return order, {n: np.array(v, np.int64) for n, v in nodes.items()}


def _product(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while they hold them, else in 64-bit integers."""
    if not queries.size or not points.size:
        return np.zeros((len(queries), len(points)), np.int64)
    most = float(np.abs(queries).max()) * float(np.abs(points).max()) * queries.shape[1]
    if most < EXACT:
        return (queries.astype(np.float64) @ points.T.astype(np.float64)).astype(np.int64)
    return queries @ points.T


def _bounds(queries: np.ndarray, nodes: dict, some: np.ndarray) -> np.ndarray:
    """The most that any vector in each box can score with each query."""
    zero = np.zeros_like(queries)
    return (_product(np.maximum(queries, zero), nodes["highs"][some])
            + _product(np.minimum(queries, zero), nodes["lows"][some]))


def search_tree(points: np.ndarray, ids: np.ndarray, nodes: dict, queries: np.ndarray, query_ids: np.ndarray,
                floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of each query's best k in this tree that reach its floor.

    Ties at the k-th place go to smaller ids; a box is left out only if its bound is under the floor.
    """
    worst = np.iinfo(np.int64).min
    best = np.full((len(queries), k), worst)
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    if not len(points) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # open subtrees from the root down, and leave out those that no query can use
    leaves, leaf_bounds, level = [], [], np.array([0])
    while len(level):
        bounds = _bounds(queries, nodes, level)
        useful = (bounds >= floors[:, None]).any(0)
        level, bounds = level[useful], bounds[:, useful]
        is_leaf = nodes["lefts"][level] < 0
        leaves.append(level[is_leaf])
        leaf_bounds.append(bounds[:, is_leaf])
        level = np.concatenate([nodes["lefts"][level[~is_leaf]], nodes["rights"][level[~is_leaf]]])
    leaves, leaf_bounds = np.concatenate(leaves), np.concatenate(leaf_bounds, axis=1)
    turn = np.argsort(-leaf_bounds, axis=1, kind="stable")
    active = np.arange(len(queries))
    for step in range(len(leaves)):
        # each query's next best leaf; a query ends when that cannot reach its k-th score
        next_leaf = turn[active, step]
        active = active[leaf_bounds[active, next_leaf] >= np.maximum(floors, best[:, -1])[active]]
        if not len(active):
            break
        next_leaf = turn[active, step]
        by_leaf = np.argsort(next_leaf, kind="stable")
        for rows in np.split(active[by_leaf], np.flatnonzero(np.diff(next_leaf[by_leaf])) + 1):
            node = leaves[turn[rows[0], step]]
            start, end = nodes["starts"][node], nodes["ends"][node]
            scores = _product(queries[rows], points[start:end])
            scores[query_ids[rows][:, None] == ids[None, start:end]] = worst
            scores[scores < floors[rows][:, None]] = worst
            all_scores = np.concatenate([best[rows], scores], axis=1)
            all_ids = np.concatenate([best_ids[rows], np.broadcast_to(ids[start:end], scores.shape)], axis=1)
            first = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
            best[rows] = np.take_along_axis(all_scores, first, 1)
            best_ids[rows] = np.take_along_axis(all_ids, first, 1)
    row, place = np.nonzero(best > worst)
    return row, best_ids[row, place], best[row, place]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    dim = key[0].as_py()
    points, ids = _matrix(rows.column("vec"), dim), rows.column("vec_id").to_numpy()
    order, nodes = build_tree(points)
    cells = {"ids": ids[order], "points": points[order], **nodes}
    names = ["ids", "points", "lefts", "rights", "starts", "ends", "lows", "highs"]
    return pa.table([pa.array([dim], pa.int32()), pa.array([key[1].as_py()], pa.int32()),
                     *[pa.array([np.ascontiguousarray(cells[n]).tobytes()], pa.binary()) for n in names]],
                    names=["dim", "shard", *names])


def _search(key: tuple, trees: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    none = pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
    if not trees.num_rows or not queries.num_rows:
        return none
    dim = key[0].as_py()
    cell = lambda n: np.frombuffer(trees.column(n)[0].as_buffer(), np.int64)
    nodes = {n: cell(n) for n in ("lefts", "rights", "starts", "ends")}
    nodes |= {n: cell(n).reshape(-1, dim) for n in ("lows", "highs")}
    ids = queries.column("query_id").to_numpy()
    row, found, score = search_tree(
        cell("points").reshape(-1, dim), cell("ids"), nodes, _matrix(queries.column("vec"), dim), ids,
        queries.column("floor").to_numpy(), k)
    return pa.table({"query_id": pa.array(ids[row]), "vec_id": pa.array(found), "score": pa.array(score)})


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each query's k best vectors: query_id, rank, vec_id, score; ties to smaller ids.

    `vectors` has vec_id and vec (array of long), `queries` query_id and vec.  Rows with a null id
    or a null or empty vector take no part; a query meets vectors of its own length only, and not
    its own id.  Repeated vectors are ranked one by one, repeated queries once.  Fewer than k
    vectors give fewer rows.
    """
    sound = lambda df, name: df.filter(F.col(name).isNotNull() & (F.size("vec") > 0)).select(
        F.col(name).cast("long").alias(name), "vec", F.size("vec").alias("dim"))
    points = sound(vectors, "vec_id")
    shards = max(1, -(-points.count() // SHARD_ROWS))
    home = lambda name: F.pmod(F.xxhash64(name), F.lit(shards)).cast("int")
    trees = stored(points.withColumn("shard", home("vec_id")).groupBy("dim", "shard").applyInArrow(_build, TREE), "trees")
    asked = stored(sound(queries, "query_id").distinct().withColumn("home", home("query_id")), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(blocks)).cast("int").alias("block")
    by = ["dim", "shard", "block"]

    def searched(some_queries: DataFrame) -> DataFrame:
        copies = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return copies.groupBy(*by).cogroup(some_queries.groupBy(*by)).applyInArrow(partial(_search, k=k), FOUND)
    no_floor = F.lit(-(1 << 62)).cast("long")
    near = stored(searched(asked.select("dim", F.col("home").alias("shard"), block, "query_id", "vec",
                                        no_floor.alias("floor"))), "near")
    floors = near.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    onward = asked.join(floors, "query_id", "left").select(
        "dim", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))).alias("shard"),
        block, "query_id", "vec", F.when(F.col("n") >= k, F.col("kth")).otherwise(no_floor).alias("floor"))
    found = near.unionByName(searched(onward))
    return top_per_key(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k, rank="rank").select(
        "query_id", "rank", "vec_id", "score")
