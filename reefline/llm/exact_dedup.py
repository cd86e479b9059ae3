"""Exact dedup against an immutable snapshot that carries binary-fuse filters.

A snapshot holds one row per distinct text digest (its exact buckets, by shard) and one static
filter per shard.  A batch is first grouped by digest, which settles duplicates inside the batch;
its distinct digests then meet the filter of their shard, and only those that pass are joined with
the exact buckets.  Groups of more than one row are checked byte by byte; should digests of
different texts ever agree, their rows are grouped anew by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reefline.functions.frames import top_per_key
from reefline.llm import fuse_filter
from reefline.llm.common import bounded, stored, text_of

SHARD_KEYS = 16_384
KEY = F.xxhash64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class Snapshot:
    """Distinct digests of a body of documents with size, largest doc_id and the rows that have it."""

    buckets: DataFrame      # shard, digest, top (doc_id, n), n
    filters: DataFrame      # shard, seed, length, starts, cells
    shards: int


def _grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: rows, and the largest doc_id with its count; nulls are smallest."""
    ids = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return ids.groupBy("digest").agg(F.max(F.struct("doc_id", "n")).alias("top"), F.sum("n").alias("n"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), "digest"), F.lit(shards)).cast("int")


def _build_filter(key: tuple, rows: pa.Table) -> pa.Table:
    seed, length, starts, cells = fuse_filter.build(rows.column("key").to_numpy().view(np.uint64))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "seed": pa.array([seed], pa.int32()),
                     "length": pa.array([length], pa.int32()), "starts": pa.array([starts], pa.int32()),
                     "cells": pa.array([cells], pa.binary())})


def snapshot(rows: DataFrame) -> Snapshot:
    """Freeze rows (doc_id, digest) into exact buckets and one filter for each shard of them."""
    groups = stored(_grouped(rows), "snapshot-groups")
    shards = max(1, -(-groups.count() // SHARD_KEYS))
    buckets = groups.withColumn("shard", _shard(shards))
    filters = buckets.select("shard", KEY("digest").alias("key")).groupBy("shard").applyInArrow(
        _build_filter, "shard int, seed int, length int, starts int, cells binary")
    return Snapshot(buckets, stored(filters, "snapshot-filters"), shards)


def _screen(key: tuple, filters: pa.Table, rows: pa.Table) -> pa.Table:
    passed = np.zeros(rows.num_rows, bool)
    if filters.num_rows and rows.num_rows:
        f = filters.slice(0, 1).to_pylist()[0]
        passed = fuse_filter.contains(rows.column("key").to_numpy().view(np.uint64),
                                      f["seed"], f["length"], f["starts"], f["cells"])
    return rows.select(["digest"]).filter(pa.array(passed))


def screen(digests: DataFrame, frozen: Snapshot, count: int) -> DataFrame:
    """Digests that the snapshot's filters let through: all that it holds and few others.

    `count` is the number of digests; a batch much larger than the snapshot meets copies of the
    filters, so that no task has more than a few shards' worth of keys.
    """
    copies = max(1, -(-count // (frozen.shards * SHARD_KEYS)))
    salted = digests.select(
        "digest", KEY("digest").alias("key"), _shard(frozen.shards).alias("shard"),
        F.pmod(F.xxhash64(F.lit(2), "digest"), F.lit(copies)).cast("int").alias("copy"))
    filters = frozen.filters.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    by = ["shard", "copy"]
    return filters.groupBy(*by).cogroup(salted.groupBy(*by)).applyInArrow(_screen, "digest binary")


def merge(frozen: Snapshot, batch: DataFrame) -> DataFrame:
    """Groups over snapshot and batch rows (doc_id, digest): digest, top, n."""
    groups = stored(_grouped(batch), "batch-groups")
    passed = screen(groups.select("digest"), frozen, groups.count())
    known = passed.join(frozen.buckets.drop("shard"), "digest")
    # a batch digest that the snapshot holds takes the snapshot's rows with it
    parts = groups.unionByName(known).unionByName(frozen.buckets.drop("shard").join(
        known.select("digest"), "digest", "left_anti"))
    return parts.groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("n"))


def group_documents(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row's group of equal texts: doc_id, digest, keep_id, keep_rows, group_size, kept.

    Reads only `doc_id` and `text`.  Half of the rows, by a hash of doc_id, stand as the snapshot,
    the other half come in as a batch.  A null text equals an empty one.  Of a group the row with
    the largest doc_id stays (null ids are smallest); repeated rows with that id are all marked
    kept, and `keep_rows` counts them.  No rows give no rows.
    """
    plain = docs.select("doc_id", text_of().alias("text")).withColumn("digest", digest(F.col("text")))
    rows = stored(plain.select("doc_id", "digest"), "digests")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    groups = stored(merge(snapshot(rows.filter(half == 0)), rows.filter(half == 1)), "groups")
    shape = lambda df: df.select(
        "doc_id", "digest", F.col("top.doc_id").alias("keep_id"), F.col("top.n").alias("keep_rows"),
        F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("top.doc_id")).alias("kept"))
    multiple = groups.filter("n > 1").select("digest")
    multiples = multiple.count()
    mixed = stored(
        plain.join(bounded(multiple, multiples, 128), "digest", "left_semi")
        .groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
        .filter("a <> b").select("digest"), "mixed")
    colliding = mixed.count()
    if not colliding:
        return shape(rows.join(groups, "digest"))
    mixed = bounded(mixed, colliding, 128)
    apart = plain.join(mixed, "digest", "left_semi")
    exact = apart.groupBy("digest", "text", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy(
        "digest", "text").agg(F.max(F.struct("doc_id", "n")).alias("top"), F.sum("n").alias("n"))
    return shape(rows.join(groups, "digest").join(mixed, "digest", "left_anti")).unionByName(
        shape(apart.join(stored(exact, "exact-groups"), ["digest", "text"])))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of `docs`: of each group of equal texts one row."""
    groups = stored(group_documents(docs), "grouped")
    own = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    marked = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()]).withColumn(
        "_digest", sha256(F.coalesce(F.col(own["text"]).cast("string"), F.lit(""))))
    dropped = groups.filter("not kept").select("digest", F.col("doc_id").alias("_dropped"))
    left = marked.join(bounded(dropped, dropped.count(), 64), (marked["_digest"] == dropped["digest"])
                       & marked[own["doc_id"]].eqNullSafe(dropped["_dropped"]), "left_anti")
    # repeated rows of one id: of these the first by their columns stays
    several = groups.filter("kept and keep_rows > 1").select(F.col("digest").alias("_digest")).distinct()
    several = bounded(several, several.count(), 64)
    repeated = top_per_key(left.join(several, "_digest", "left_semi"), ["_digest"],
                           [F.col(n) for n in own.values()])
    return left.join(several, "_digest", "left_anti").unionByName(repeated).select(
        *[F.col(n).alias(c) for c, n in own.items()])
