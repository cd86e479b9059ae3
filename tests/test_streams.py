"""Streams fed in several triggers: late items, failures that later succeed, repeats, hot states."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from reefline.schemas import RAW_ITEMS
from reefline.session import work_folder
from reefline.streaming import capture_stream, collector, job_state, store

GOOD = '{"is_relevant": true, "classification": "unprovoked", "country": "Fiji", "incident_date": "2024-01-02", "location_description": "Reef Bay", "confidence": 0.9}'


def _item(number, url, day, hour=0, minute=0):
    return (number, "news_rss", "feed", f"https://x/{url}", f"Shark seen {number}", "a shark bite", None, None, False,
            datetime(2024, 1, day, hour, minute))


def _land(spark, folder, rows):
    spark.createDataFrame(rows, RAW_ITEMS).coalesce(1).write.mode("append").parquet(folder)


def test_late_items_are_kept(spark):
    root = work_folder(spark, "late")
    for rows in ([_item(1, "a", 10)], [_item(2, "b", 1)], [_item(3, "c", 11), _item(4, "a", 3)], [_item(5, "a", 12)]):
        _land(spark, f"{root}/landed", rows)
        items = capture_stream.landed_items(spark, f"{root}/landed")
        capture_stream.start_capture(items, root, f"{root}/progress").awaitTermination()
    got = {r["dedup_key"][-1]: r for r in capture_stream.evidence(spark, root).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["title"] == "Shark seen 1" and got["a"]["last_seen_at"] == datetime(2024, 1, 12)
    assert got["b"]["last_seen_at"] == datetime(2024, 1, 1)


def test_failed_items_are_tried_again_when_due(spark):
    root = work_folder(spark, "retry")
    key = lambda u: f"news_rss:https://x/{u}"
    answers = {0: [(key("a"), GOOD.replace("2024-01-02", "soon")), (key("b"), GOOD)], 1: [(key("a"), GOOD)], 2: [(key("a"), GOOD)], 3: [(key("a"), GOOD)]}
    responses = lambda n: spark.createDataFrame(answers[n], "dedup_key string, response_text string")
    verifications = spark.createDataFrame(
        [(key(u), True, False, 0.9, None) for u in "ab"],
        "dedup_key string, is_valid boolean, is_duplicate_likely boolean, verification_confidence double, corrections map<string,string>")
    steps = [[_item(1, "a", 5), _item(2, "b", 5)], [_item(3, "a", 5, 0, 2)], [_item(4, "a", 5, 1)], [_item(5, "a", 9), _item(6, "b", 9)]]
    seen = []
    for rows in steps:
        _land(spark, f"{root}/landed", rows)
        items = capture_stream.landed_items(spark, f"{root}/landed")
        collector.start_collector(items, responses, verifications, root, f"{root}/progress").awaitTermination()
        jobs = {r["dedup_key"][-1]: (r["status"], r["attempts"]) for r in collector.collected_jobs(spark, root).collect()}
        routes = {r["dedup_key"][-1]: r["route"] for r in collector.collected_routes(spark, root).collect()}
        seen.append((jobs["a"], routes["a"]))
    # failed; too early to try again; tried and done; done work is not repeated
    assert seen == [(("retrying", 1), "retry_extraction"), (("retrying", 1), "retry_extraction"),
                    (("completed", 2), "candidate"), (("completed", 2), "candidate")]
    sightings = capture_stream.evidence(spark, root).select("dedup_key", "title", "last_seen_at").collect()
    assert {r["dedup_key"][-1]: (r["title"], r["last_seen_at"].day) for r in sightings} == {"a": ("Shark seen 1", 9), "b": ("Shark seen 2", 9)}
    # both reports describe one event, so they share one candidate
    [candidate] = collector.collected_candidates(spark, root).collect()
    assert candidate["observation_count"] == 2 and candidate["status"] == "needs_review" and candidate["match_key"]


def test_a_batch_reads_only_the_buckets_of_its_keys(spark):
    root = work_folder(spark, "buckets")
    rows = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v"))
    schema = rows.schema
    store.put(rows, root, "t", 0, "key")
    some = rows.filter("v IN (3, 77, 1500)")
    buckets = store.buckets_of(some, "key")
    assert 0 < len(buckets) <= 3
    read = store.get(spark, root, "t", schema, 1, buckets)
    assert {r["v"] for r in read.collect()} >= {3, 77, 1500}
    scan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "bucket" in scan[scan.index("PartitionFilters"):]
    files = read.select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r["f"].split("bucket=")[1].split("/")[0]) for r in files} == set(buckets)


def test_parts_are_rewritten_and_replays_see_the_same(spark, monkeypatch):
    monkeypatch.setattr(store, "FRAGMENTS", 3)
    root = work_folder(spark, "parts")
    schema = spark.range(1).select(F.lit("k").alias("key"), "id").schema
    for n in range(12):
        store.compact(spark, root, "t", schema, "key", n)
        before = store.get(spark, root, "t", schema, n)
        assert sorted((r["id"], r["batch_id"]) for r in before.collect()) == [(i, i) for i in range(n)]
        for _ in range(2):  # a replay overwrites its own rows
            store.put(spark.range(n, n + 1).select(F.lit("k").alias("key"), "id"), root, "t", n, "key")
        assert store.get(spark, root, "t", schema, n).count() == n
    parts = store._parts(spark, root, "t")
    assert parts["base"] and len(parts["batch"]) < 12
    assert store.get(spark, root, "t", schema).count() == 12


def test_late_job_events_count_at_their_time(spark):
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    # the failure comes a trigger late; without it the second capture would find a leased job
    events = [(1, at(0), 1, "capture", True), (1, at(6), 3, "capture", True), (1, at(7), 4, "observation", True), (2, at(0), 5, "capture", True),
              (1, at(0) + timedelta(seconds=30), 2, "failure", True), (2, at(1), 6, "failure", False), (2, at(30), 7, "capture", True)]
    root = work_folder(spark, "late-jobs")
    for turn in ([0, 1, 2], [3, 6], [4, 4], [5]):
        spark.createDataFrame([events[i] for i in turn], job_state.EVENTS).write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(job_state.EVENTS).parquet(f"{root}/landed")
        job_state.start_jobs(stream, root, f"{root}/progress").awaitTermination()
    rows = lambda df: {tuple(r) for r in df.select("source_document_id", "status", "attempts", "available_at", "completed_at").collect()}
    got = rows(job_state.current_jobs(spark, root))
    assert got == rows(job_state.fold_jobs(spark.createDataFrame(events, job_state.EVENTS)))
    assert {(r[0], r[1], r[2]) for r in got} == {(1, "completed", 2), (2, "dead_letter", 1)}
