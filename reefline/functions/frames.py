"""Small DataFrame idioms shared by the operators, chosen to be safe with hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reefline.session import durable


def pg_order(name: str, descending: bool) -> Column:
    """Database null order: descending puts nulls first, ascending puts them last."""
    return F.desc_nulls_first(name) if descending else F.asc_nulls_last(name)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`withColumn` for a costly value that later steps mention many times.

    Catalyst substitutes a projected column into the filters and projections above it; it
    does not look through a generator, so the value is computed once per row.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1,
                rank: str | None = None) -> DataFrame:
    """First k rows per key.

    The `<= k` filter lets Spark cut every map-side partition to k rows per key
    (WindowGroupLimit) before the shuffle, so a hot key never reaches one task whole.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def rank_within(df: DataFrame, group: str, order: list[str], name: str = "rank") -> DataFrame:
    """1-based dense position inside each group without one task per group.

    Rows are range-partitioned by (group, order), made durable so that the slices
    cannot move between the two passes, counted per slice, and numbered inside the
    slice from the running total of the slices before it.  The totals table has at
    most (partitions + groups) rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = durable(
        df.repartitionByRange(n, group, *order).withColumn("_slice", F.spark_partition_id())
    )
    totals = sliced.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = W.partitionBy(group, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_pos", F.row_number().over(inside))
    # rows without a group are a group of their own, so the join takes nulls as equal
    offsets = offsets.select(F.col(group).alias("_group"), F.col("_slice").alias("_of"), "_before")
    return (
        numbered.join(offsets, numbered[group].eqNullSafe(F.col("_group")) & (F.col("_slice") == F.col("_of")))
        .withColumn(name, F.col("_before") + F.col("_pos"))
        .drop("_slice", "_pos", "_before", "_group", "_of")
    )


def unseen(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored.

    The long stored side is only reduced to the keys of this batch (a semi-join that needs
    no shuffle of it while the batch is small); the short remainder does the anti-join.
    """
    hit = stored.select(key).join(new.select(key), key, "left_semi").distinct()
    return new.join(hit, key, "left_anti")


BLOCK = 4096


def _earlier(part: list[str], order: str) -> W:
    return W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def least_before(rows: DataFrame, key: str, at: str, value: str, name: str, last: int) -> DataFrame:
    """Adds the least `value` among the key's rows at smaller positions (distinct within a key, up to `last`).

    Positions are cut into blocks, so a key shared by very many rows is never one task: no window
    sees more than a block of its positions, or one row per block.
    """
    if last < BLOCK:
        return rows.withColumn(name, F.min(value).over(_earlier([key], at)))
    each = rows.withColumn("_block", F.floor(F.col(at) / BLOCK))
    blocks = each.groupBy(key, "_block").agg(F.min(value).alias("_least")).select(
        key, "_block", F.min("_least").over(_earlier([key], "_block")).alias("_above"))
    inside = each.withColumn("_inside", F.min(value).over(_earlier([key, "_block"], at)))
    return inside.join(blocks, [key, "_block"]).withColumn(name, F.least("_above", "_inside")).drop("_block", "_above", "_inside")


def count_up_to(rows: DataFrame, at: str, name: str, last: int) -> DataFrame:
    """position, and how many rows stand at or before it; positions are distinct and at most `last`."""
    each = rows.select(at, F.floor(F.col(at) / BLOCK).alias("_block"))
    inside = each.withColumn(name, F.row_number().over(W.partitionBy("_block").orderBy(at)))
    if last < BLOCK:
        return inside.drop("_block")
    blocks = each.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    blocks = blocks.select("_block", F.coalesce(F.sum("_n").over(_earlier(["_all"], "_block")), F.lit(0)).alias("_above"))
    return inside.join(blocks, "_block").select(at, (F.col("_above") + F.col(name)).alias(name))
