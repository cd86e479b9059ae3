"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

A uniform shuffle sends a random number of each source block's rows to each shard; these counts
follow a multivariate hypergeometric law with the block sizes as row sums and the shard sizes as
column sums.  The matrix is drawn first, from the block sizes alone.  Each block then permutes its
rows by random keys and deals them out by its line of the matrix, the rows are exchanged, and each
shard permutes what it received.  Only DataFrame functions touch the rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window as W, functions as F

from reefline.llm.common import bounded, stored

SHARDS = 8
SEED = 29
BLOCK_ROWS = 65_536
# Rows that one window of a shard's last permutation holds, about.
SLICE_ROWS = 4096


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` taken without replacement are good; exact inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    at = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mass = math.exp(log(good, at) + log(bad, draws - at) - log(good + bad, draws))
    rest = rng.random() - mass
    down, up, below, above = at, at, mass, mass
    while rest > 0 and (down > low or up < high):
        if up < high:
            above *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            rest -= above
            if rest <= 0:
                return up
        if down > low:
            below *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            rest -= below
            if rest <= 0:
                return down
    return at


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts by block and shard with exactly these row sums; column sums differ by one at most."""
    rng = random.Random(seed)
    total = sum(rows)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for count in rows:
        line, others = [], sum(room)
        for j in range(shards):
            others -= room[j]
            drawn = hypergeometric(rng, room[j], others, count)
            line.append(drawn)
            count -= drawn
            room[j] -= drawn
        matrix.append(line)
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All rows and columns of `df` (renamed to c0, c1, ... while it works) with shard and slot.

    Rows are dealt by place, whatever they hold: nulls, ties and repeated rows are dealt like all
    others.  Shard sizes differ by one at most; slots run from 0 without gaps.  An empty table gives
    no rows.  Columns of `df` named shard or slot come back as input_shard and input_slot.
    """
    own = {c: f"c{i}" for i, c in enumerate(df.columns)}
    row_in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fixed = stored(
        df.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.spark_partition_id().alias("_part"),
                  F.floor(row_in_part / BLOCK_ROWS).alias("_sub"), F.monotonically_increasing_id().alias("_row"))
        .withColumns({"_key": F.xxhash64(F.lit(seed), "_row"), "_deal": F.xxhash64(F.lit(seed + 1), "_row")}),
        "shard-input")
    # one row per block of the input: at most BLOCK_ROWS rows each, so a bounded share of all rows
    sizes = fixed.groupBy("_part", "_sub").agg(F.count(F.lit(1)).alias("n")).orderBy("_part", "_sub").collect()
    matrix = communication_matrix([r["n"] for r in sizes], shards, seed)
    ends = [[sum(line[:j + 1]) for j in range(shards)] for line in matrix]
    plan = df.sparkSession.createDataFrame(
        [(r["_part"], r["_sub"], e) for r, e in zip(sizes, ends)], "_part int, _sub long, _ends array<long>")
    local = W.partitionBy("_part", "_sub").orderBy("_key", "_row")
    dealt = (fixed.withColumn("_pos", F.row_number().over(local) - 1)
             .join(bounded(plan, len(sizes), 32 + 8 * shards), ["_part", "_sub"])
             .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_pos")))))
    total = sum(r["n"] for r in sizes)
    bits = max(0, math.ceil(math.log2(max(1, total / shards / SLICE_ROWS))))
    # a shard's rows in the order of fresh random keys; slices of the key space are even by chance
    sliced = dealt.withColumn("_slice", F.shiftrightunsigned("_deal", 64 - bits) if bits else F.lit(0).cast("long"))
    counts = sliced.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("shard", "_slice", F.coalesce(F.sum("_n").over(
        W.partitionBy("shard").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = W.partitionBy("shard", "_slice").orderBy("_deal", "_row")
    return (sliced.withColumn("_at", F.row_number().over(inside)).join(before, ["shard", "_slice"])
            .select(*[F.col(n).alias(f"input_{c}" if c in ("shard", "slot") else c) for c, n in own.items()], "shard",
                    (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot")))
