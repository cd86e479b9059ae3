"""Job state folded from capture, observation and failure events, as batch or stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from reefline.constants import (
    FIRST_RETRY_SECONDS, LEASE_MINUTES, MAX_ATTEMPTS, MAX_RETRY_SECONDS,
)
from reefline.session import durable
from reefline.streaming import store

LEASE = timedelta(minutes=LEASE_MINUTES)
ORDER = ["source_document_id", "ts", "event_id"]
# input: source_document_id, ts, event_id, kind (capture, observation, failure), retryable
STATE = T.StructType([
    T.StructField("status", T.StringType(), True), T.StructField("attempts", T.IntegerType(), True),
    T.StructField("available_at", T.TimestampNTZType(), True),
    T.StructField("leased_until", T.TimestampNTZType(), True),
    T.StructField("completed_at", T.TimestampNTZType(), True)])
STATE_NAMES = [f.name for f in STATE.fields]
RESULT = T.StructType([T.StructField("source_document_id", T.LongType(), True), *STATE.fields])


class Job(NamedTuple):
    status: str
    attempts: int
    available_at: object
    leased_until: object
    completed_at: object


def advance(job: Job | None, kind: str, at, retryable: bool) -> Job | None:
    """State after one event; an event that does not apply leaves it unchanged."""
    if kind == "capture":
        if job is None:
            return Job("leased", 1, at, at + LEASE, None)
        lapsed = job.status == "leased" and (job.leased_until is None or job.leased_until <= at)
        due = job.status in ("queued", "retrying") and job.available_at <= at
        if lapsed or due:
            return job._replace(status="leased", attempts=job.attempts + 1, leased_until=at + LEASE)
    elif kind == "observation" and job is not None and job.status == "leased":
        return job._replace(status="completed", leased_until=None, completed_at=at)
    elif kind == "failure" and job is not None:
        if not retryable or job.attempts >= MAX_ATTEMPTS:
            return job._replace(status="dead_letter", available_at=at, leased_until=None)
        wait = min(FIRST_RETRY_SECONDS * 2 ** max(job.attempts - 1, 0), MAX_RETRY_SECONDS)
        return job._replace(status="retrying", available_at=at + timedelta(seconds=wait),
                            leased_until=None)
    return job


def _row(key, job: Job | None) -> list:
    return [key, *(job if job is not None else [None] * len(STATE_NAMES))]


def _fold_slices(entries: dict):
    """Fold sorted slices as they stream by; only one job is held at a time.

    `entries` maps (source, slice) to the state the slice starts from.
    """
    names = ["source_document_id", "slice", *STATE_NAMES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, job = None, None
        for pdf in batches:
            done = []
            for source, slice_, kind, at, retryable in zip(
                    pdf["source_document_id"].tolist(), pdf["slice"].tolist(), pdf["kind"].tolist(),
                    [t.to_pydatetime() for t in pdf["ts"]], pdf["retryable"].tolist()):
                if current != (source, slice_):
                    if current is not None:
                        done.append([*current, *_row(None, job)[1:]])
                    current, job = (source, slice_), entries.get((source, slice_))
                job = advance(job, kind, at, retryable)
            if done:
                yield pd.DataFrame(done, columns=names).astype(_PANDAS)
        if current is not None:
            yield pd.DataFrame([[*current, *_row(None, job)[1:]]], columns=names).astype(_PANDAS)
    return run


_PANDAS = {"attempts": "Int32", "available_at": "datetime64[us]", "leased_until": "datetime64[us]",
           "completed_at": "datetime64[us]"}
_SLICED = T.StructType([RESULT.fields[0], T.StructField("slice", T.IntegerType(), True), *STATE.fields])


def _state_of(row) -> Job | None:
    return None if row["status"] is None else Job(
        row["status"], row["attempts"], *[row[c] for c in STATE_NAMES[2:]])


def fold_jobs(events: DataFrame, slices: int | None = None, repeated: bool = False) -> DataFrame:
    """Current state per source from all its events in time order.

    Events are range-partitioned, so a source with very many events spans several slices
    instead of filling one task.  All slices fold at once; where a source spans slices,
    the later ones are folded again from the state the slice before ended in, until no
    start changes.  Only those starts (at most one per slice) pass through the driver.
    With `repeated`, an event that was delivered again counts once.
    """
    spark = events.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.select(
        *ORDER, "kind", F.coalesce("retryable", F.lit(True)).alias("retryable")).repartitionByRange(n, *ORDER)
    if repeated:  # equal events lie in one slice, so this moves no rows
        dealt = dealt.dropDuplicates(ORDER)
    sliced = durable(dealt.sortWithinPartitions(*ORDER).withColumn("slice", F.spark_partition_id()))

    def fold(rows: DataFrame, entries: dict) -> DataFrame:
        return durable(rows.mapInPandas(_fold_slices(entries), _SLICED))
    results = fold(sliced, {})
    spans = results.groupBy("source_document_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    spanning = results.join(spans.select("source_document_id"), "source_document_id", "left_semi")
    # a slice shares its border sources with its neighbours: at most two per slice
    known = {(r["source_document_id"], r["slice"]): _state_of(r) for r in spanning.collect()}
    starts: dict = {}
    while True:
        wanted, before = {}, None
        for key in sorted(known):
            if before is not None and before[0] == key[0]:
                wanted[key] = known[before]
            before = key
        changed = {k: v for k, v in wanted.items() if v is not None and starts.get(k) != v}
        if not changed:
            break
        starts.update(changed)
        again = F.struct("source_document_id", "slice").isin(
            [F.struct(F.lit(s).cast("bigint").alias("source_document_id"),
                      F.lit(i).alias("slice")) for s, i in changed])
        redone = fold(sliced.filter(again), changed)
        known.update({(r["source_document_id"], r["slice"]): _state_of(r) for r in redone.collect()})
    last = {}
    for source, slice_ in sorted(known):
        last[source] = known[(source, slice_)]
    settled = spark.createDataFrame(
        [_row(s, j) for s, j in last.items()], RESULT) if last else spark.createDataFrame([], RESULT)
    alone = results.join(spans.select("source_document_id"), "source_document_id", "left_anti")
    return alone.select(*RESULT.names).unionByName(settled).filter(F.col("status").isNotNull())


# --- stream -----------------------------------------------------------------------------------
EVENTS = T.StructType([
    T.StructField("source_document_id", T.LongType(), True), T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("event_id", T.LongType(), True), T.StructField("kind", T.StringType(), True),
    T.StructField("retryable", T.BooleanType(), True)])


def fold_batch_of_events(root: str):
    """Fold the sources that a micro-batch touches again, from all events they ever had.

    An event counts at its own time however late it comes, and redelivered events count once.  Only
    the touched buckets of the event log are read.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store.compact(spark, root, "events", EVENTS, "source_document_id", batch_id)
        store.compact(spark, root, "jobs", RESULT, "source_document_id", batch_id)
        arrived = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENTS.fields]).persist()
        touched = arrived.select("source_document_id").distinct()
        earlier = store.get(spark, root, "events", EVENTS, batch_id, store.buckets_of(touched, "source_document_id")).join(
            touched, "source_document_id", "left_semi").drop("batch_id")
        store.put(arrived, root, "events", batch_id, "source_document_id")
        folded = fold_jobs(earlier.unionByName(arrived), repeated=True)
        store.put(folded, root, "jobs", batch_id, "source_document_id")
        arrived.unpersist()
    return run


def start_jobs(events: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The same fold over a stream of events, late ones in their place."""
    return events.writeStream.foreachBatch(fold_batch_of_events(root)).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_jobs(spark: SparkSession, root: str) -> DataFrame:
    """The state that the last batch touching each source left."""
    rows = store.get(spark, root, "jobs", RESULT)
    return rows.groupBy("source_document_id").agg(F.max_by(F.struct(*STATE_NAMES), "batch_id").alias("_job")).select(
        "source_document_id", *[f"_job.{c}" for c in STATE_NAMES])
