"""Tables that micro-batches append to, laid out by hash bucket of their key.

A table is a folder of parts: `part=batch-<n>` with the rows of one batch, and now and then
`part=base-<n>`, all rows up to batch n rewritten together; inside a part rows lie in
`bucket=<b>` folders.  A batch reads only the buckets its keys fall into, from the newest base
before it and the batches since.

Re-running a batch overwrites its own part and never sees it as input, and a base only holds
batches that were complete before, so an interrupted batch gives the same result when replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# A table keeps the number of buckets it was begun with; large stores take a few thousand.
BUCKETS = 16
# Parts of single batches that may pile up before they are rewritten as one.
FRAGMENTS = 20
NONE_YET = -1


def bucket_of(key: Column) -> Column:
    """Rows without a key lie in the bucket of their own hash value, too."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def buckets_of(rows: DataFrame, key: str) -> list[int]:
    """The buckets that a batch's keys fall into: at most BUCKETS numbers."""
    return sorted(r["b"] for r in rows.select(bucket_of(F.col(key)).alias("b")).distinct().collect())


def _stored_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType(), True),
                         T.StructField("part", T.StringType(), True), T.StructField("bucket", T.IntegerType(), True)])


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _parts(spark: SparkSession, root: str, name: str) -> dict[str, list[int]]:
    """Numbers of the complete parts of each kind, in order; an interrupted write has no success mark."""
    files, where = _folder(spark, f"{root}/{name}")
    found: dict[str, list[int]] = {"base": [], "batch": []}
    if files.exists(where):
        for entry in files.listStatus(where):
            kind, _, number = entry.getPath().getName().removeprefix("part=").partition("-")
            mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
            if kind in found and files.exists(mark):
                found[kind].append(int(number))
    return {k: sorted(v) for k, v in found.items()}


def _write(df: DataFrame, root: str, name: str, part: str, key: str) -> None:
    df.withColumn("bucket", bucket_of(F.col(key))).repartition(F.col("bucket")).write.mode("overwrite").partitionBy(
        "bucket").parquet(f"{root}/{name}/part={part}")


def put(df: DataFrame, root: str, name: str, batch_id: int, key: str) -> None:
    _write(df.withColumn("batch_id", F.lit(batch_id).cast("long")), root, name, f"batch-{batch_id}", key)


def get(spark: SparkSession, root: str, name: str, schema: T.StructType, before: int | None = None,
        buckets: list[int] | None = None) -> DataFrame:
    """All rows, or those written before a batch, or those of some buckets; with their `batch_id`."""
    parts = _parts(spark, root, name)
    bases = [n for n in parts["base"] if before is None or n < before]
    base = bases[-1] if bases else NONE_YET
    chosen = [f"base-{base}"] * bool(bases) + [
        f"batch-{n}" for n in parts["batch"] if n > base and (before is None or n < before)]
    full = _stored_schema(schema)
    if not chosen:
        return spark.createDataFrame([], full).drop("part", "bucket")
    rows = spark.read.schema(full).option("basePath", f"{root}/{name}").parquet(*[f"{root}/{name}/part={p}" for p in chosen])
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    return rows.drop("part", "bucket")


def compact(spark: SparkSession, root: str, name: str, schema: T.StructType, key: str, before: int) -> None:
    """Rewrite the parts before a batch as one base, if many have piled up.

    Parts that the base before it had taken in are removed; the newest ones stay for readers that
    have begun.
    """
    parts = _parts(spark, root, name)
    base = max([n for n in parts["base"] if n < before], default=NONE_YET)
    since = [n for n in parts["batch"] if base < n < before]
    if len(since) <= FRAGMENTS:
        return
    _write(get(spark, root, name, schema, before), root, name, f"base-{since[-1]}", key)
    files, where = _folder(spark, f"{root}/{name}")
    old = [f"batch-{n}" for n in parts["batch"] if n <= base] + [f"base-{n}" for n in parts["base"] if n < base]
    for part in old:
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, f"part={part}"), True)
