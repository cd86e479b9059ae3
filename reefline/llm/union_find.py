"""Connected components of links as Spark jobs: local union-find, then labels that jump to the least."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reefline.llm.common import lean, stored

LINKS_AT_ONCE = 1_000_000


@lean
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as stars around the least node of each local component."""
    def emit(parent: dict[int, int]) -> pa.RecordBatch:
        pairs = [(n, find(parent, n)) for n in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        nodes, roots = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])

    def find(parent: dict[int, int], node: int) -> int:
        root = node
        while parent[root] != root:
            root = parent[root]
        while parent[node] != root:
            parent[node], node = root, parent[node]
        return root
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = find(parent, a) if parent.setdefault(a, a) != a else a, find(parent, b) if parent.setdefault(b, b) != b else b
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > LINKS_AT_ONCE:
            yield emit(parent)
            parent = {}
    yield emit(parent)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of `links` (a, b: long, none null): the least node it can reach.

    Loops and repeated links do no harm; no links give no rows.  Each round takes the least label
    among a node's neighbours and then the label of that label, so long chains halve every round.
    Hot nodes are joined on their many side and reduced map-side.
    """
    stars = stored(links.filter("a <> b").mapInArrow(_contract, "a long, b long"), "links")
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "both-ways")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        of = labels.withColumnRenamed("node", "b")
        least = stored(
            both.join(of, "b").select(F.col("a").alias("node"), "label").unionByName(labels)
            .groupBy("node").agg(F.min("label").alias("label")), "least")
        onward = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stored(least.join(onward, "label").select("node", F.least("label", "next").alias("label")), "labels")
        moved = jumped.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old")
        if moved.isEmpty():
            return jumped
        labels = jumped
