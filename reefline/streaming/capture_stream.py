"""Streaming capture of landed items into the evidence store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from reefline.functions.frames import unseen
from reefline.operators.capture import fold_repeats, shape_evidence
from reefline.schemas import RAW_ITEMS, SOURCE_DOCUMENTS, conform
from reefline.streaming import store

SIGHTINGS = T.StructType([T.StructField("dedup_key", T.StringType(), True),
                          T.StructField("seen_at", T.TimestampNTZType(), True)])


def landed_items(spark: SparkSession, path: str, files_per_batch: int = 200) -> DataFrame:
    return spark.readStream.schema(RAW_ITEMS).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def capture_batch(root: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for name, schema in (("evidence", SOURCE_DOCUMENTS), ("sightings", SIGHTINGS)):
            store.compact(spark, root, name, schema, "dedup_key", batch_id)
        # Repeats and redeliveries need no state: the fold and the anti-join are idempotent, and a
        # late item is as good as any other.
        folded = fold_repeats(batch).persist()
        stored = store.get(spark, root, "evidence", SOURCE_DOCUMENTS, batch_id, store.buckets_of(folded, "dedup_key"))
        fresh = unseen(folded, stored, "dedup_key")
        store.put(conform(fresh, SOURCE_DOCUMENTS), root, "evidence", batch_id, "dedup_key")
        store.put(folded.select("dedup_key", F.col("last_seen_at").alias("seen_at")), root,
                  "sightings", batch_id, "dedup_key")
        folded.unpersist()
    return run


def start_capture(items: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        shape_evidence(items).writeStream.foreachBatch(capture_batch(root))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def evidence(spark: SparkSession, root: str) -> DataFrame:
    """The evidence table: immutable content with the latest sighting laid over it."""
    seen = store.get(spark, root, "sightings", SIGHTINGS).groupBy("dedup_key").agg(
        F.max("seen_at").alias("last_seen_at"))
    rows = store.get(spark, root, "evidence", SOURCE_DOCUMENTS).drop("last_seen_at", "batch_id")
    return conform(rows.join(seen, "dedup_key", "left"), SOURCE_DOCUMENTS)
