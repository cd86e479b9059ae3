"""Registered queries that run a stream over the given tables to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reefline.plans.capture_side import SUBJECT_RE, TRUSTED_RE
from reefline.plans.registry import query
from reefline.session import work_folder
from reefline.streaming import capture_stream, collector, job_state, store

# --- J1: events as job events, seven seconds apart -----------------------------------------
JOB_EVENTS = """SELECT user_id AS source_document_id, timestamp '2024-01-01 00:00:00' + event_id * INTERVAL 7 SECOND AS ts, event_id,
 CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN CASE WHEN event_id % 9 = 0 THEN 'observation' ELSE 'capture' END ELSE 'capture' END AS kind,
 event_id % 23 <> 0 AS retryable FROM events"""


JOB_STATE_SQL = f"""
WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY source_document_id ORDER BY ts, event_id) AS rn FROM ({JOB_EVENTS})),
walk AS (SELECT DISTINCT source_document_id, cast(0 AS bigint) AS rn, cast(NULL AS string) AS status, 0 AS attempts, cast(NULL AS timestamp) AS available_at, cast(NULL AS timestamp) AS leased_until FROM ev
 UNION ALL SELECT w.source_document_id, e.rn,
  CASE WHEN e.kind = 'capture' AND (w.status IS NULL OR (w.status = 'leased' AND w.leased_until <= e.ts) OR (w.status = 'retrying' AND w.available_at <= e.ts)) THEN 'leased'
   WHEN e.kind = 'observation' AND w.status = 'leased' THEN 'completed'
   WHEN e.kind = 'failure' AND w.status IS NOT NULL THEN CASE WHEN NOT e.retryable OR w.attempts >= 8 THEN 'dead_letter' ELSE 'retrying' END ELSE w.status END,
  CASE WHEN e.kind = 'capture' AND (w.status IS NULL OR (w.status = 'leased' AND w.leased_until <= e.ts) OR (w.status = 'retrying' AND w.available_at <= e.ts)) THEN w.attempts + 1 ELSE w.attempts END,
  CASE WHEN e.kind = 'capture' AND w.status IS NULL THEN e.ts WHEN e.kind = 'failure' AND w.status IS NOT NULL THEN e.ts + to_seconds(CASE WHEN NOT e.retryable OR w.attempts >= 8 THEN 0 ELSE least(300 * pow(2, greatest(w.attempts - 1, 0)), 21600) END) ELSE w.available_at END,
  CASE WHEN e.kind = 'capture' AND (w.status IS NULL OR (w.status = 'leased' AND w.leased_until <= e.ts) OR (w.status = 'retrying' AND w.available_at <= e.ts)) THEN e.ts + INTERVAL 15 MINUTE
   WHEN e.kind = 'observation' AND w.status = 'leased' THEN NULL WHEN e.kind = 'failure' AND w.status IS NOT NULL THEN NULL ELSE w.leased_until END
  FROM walk w JOIN ev e ON e.source_document_id = w.source_document_id AND e.rn = w.rn + 1)
SELECT source_document_id, status, attempts, cast(available_at AS string) AS available_at, cast(leased_until AS string) AS leased_until FROM walk WHERE status IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY source_document_id ORDER BY rn DESC) = 1"""


def _stream(fx, table: str) -> DataFrame:
    """A stream over a table, be it one file or a folder of files."""
    reader = fx.spark.readStream.schema(fx[table].schema)
    if any(f.endswith(f"/{table}.parquet") for f in fx[table].inputFiles()):  # a stream reads folders only
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(fx.sf_dir)
    return reader.parquet(f"{fx.sf_dir}/{table}.parquet")


@query("J01_job_state", JOB_STATE_SQL)
def _(fx) -> DataFrame:
    return job_state.fold_jobs(fx.sql(JOB_EVENTS)).drop("completed_at")


@query("J01_job_state_stream", JOB_STATE_SQL)
def _(fx) -> DataFrame:
    """The same states from a stream over the events file, latest update per source."""
    _stream(fx, "events").createOrReplaceTempView("events_stream")
    events = fx.spark.sql(JOB_EVENTS.replace("FROM events", "FROM events_stream"))
    root = work_folder(fx.spark, "jobs")
    job_state.start_jobs(events, root, f"{root}/progress").awaitTermination()
    return job_state.current_jobs(fx.spark, root).drop("completed_at")


@query("J01_late_job_events", JOB_STATE_SQL)
def _(fx) -> DataFrame:
    """The same states where the events come in three triggers, most of them out of their order."""
    root = work_folder(fx.spark, "late-jobs")
    kind = fx.sql(JOB_EVENTS).withColumn("turn", (2 - F.col("event_id") % 3).cast("int"))
    for turn in range(3):
        kind.filter(F.col("turn") == turn).drop("turn").write.parquet(f"{root}/landed/turn={turn}")
        events = fx.spark.readStream.schema(kind.drop("turn").schema).parquet(f"{root}/landed/turn=*")
        job_state.start_jobs(events, root, f"{root}/progress").awaitTermination()
    return job_state.current_jobs(fx.spark, root).drop("completed_at")


# --- A11 and J4: the documents table as landed items ------------------------------------------
LANDED = """SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'youtube' WHEN 1 THEN 'reddit' WHEN 2 THEN 'news_rss' ELSE 'web_scrape' END AS source_platform,
 source AS source_name, concat('https://', source, '.example/', lang, '/', cast(doc_id % 700 AS string)) AS source_url,
 concat(CASE WHEN doc_id % 3 = 0 THEN 'Shark ' ELSE '' END, 'item ', cast(doc_id AS string)) AS title, text AS content,
 timestamp '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE AS seen_at, cast(NULL AS string) AS author, cast(NULL AS timestamp) AS published_at, doc_id % 8 = 0 AS trusted FROM documents"""
KEY = "concat(source_platform, ':', source_url)"


def _landed(fx) -> DataFrame:
    _stream(fx, "documents").createOrReplaceTempView("documents_stream")
    return fx.spark.sql(LANDED.replace("FROM documents", "FROM documents_stream").replace(
        "cast(NULL AS timestamp)", "cast(NULL AS timestamp_ntz)").replace(
        "timestamp '2024", "timestamp_ntz '2024"))


@query("A11_streaming_capture", f"""
WITH items AS ({LANDED}) SELECT {KEY} AS dedup_key, arg_min(title, seen_at) AS title, cast(min(seen_at) AS string) AS captured_at, cast(max(seen_at) AS string) AS last_seen_at FROM items GROUP BY 1""")
def _(fx) -> DataFrame:
    root = work_folder(fx.spark, "capture")
    capture_stream.start_capture(_landed(fx), root, f"{root}/progress").awaitTermination()
    return capture_stream.evidence(fx.spark, root).select(
        "dedup_key", "title", "captured_at", "last_seen_at")


RESPONSES = f"""SELECT DISTINCT {KEY} AS dedup_key, CASE length(source_url) % 3 WHEN 0 THEN '{{"is_relevant": true, "classification": "sighting", "country": "USA", "confidence": 0.9}}'
 WHEN 1 THEN 'Well: {{"is_relevant": true, "classification": "provoked bite", "country": "Fiji", "confidence": 0.3}}' ELSE '{{"is_relevant": false}}' END AS response_text FROM items"""
VERIFICATIONS = f"""SELECT DISTINCT {KEY} AS dedup_key, source_platform <> 'reddit' AS is_valid, source_platform = 'news_rss' AS is_duplicate_likely, 0.5e0 AS verification_confidence FROM items"""


COLLECTED = f"""
WITH items AS ({LANDED}), folded AS (SELECT {KEY} AS dedup_key, arg_min(title, seen_at) AS title, arg_min(content, seen_at) AS content, arg_min(trusted, seen_at) AS trusted FROM items GROUP BY 1),
r AS (SELECT DISTINCT {KEY} AS dedup_key, length(source_url) % 3 AS a, source_platform AS p FROM items),
t AS (SELECT f.*, r.a, r.p, lower(concat(title, ' ', content)) AS t FROM folded f JOIN r ON r.dedup_key = f.dedup_key)
SELECT dedup_key, route, CASE WHEN route = 'not_relevant' THEN NULL WHEN route = 'candidate' THEN 'sighting' ELSE 'news' END AS news_type, CASE WHEN route = 'candidate' THEN 'United States' END AS country,
 CASE WHEN route = 'candidate' THEN 0.9e0 END AS ai_confidence FROM (SELECT *, CASE WHEN NOT (regexp_matches(t, '{SUBJECT_RE}') OR (trusted AND regexp_matches(t, '{TRUSTED_RE}'))) THEN 'not_relevant'
  WHEN a = 2 THEN 'news_only' WHEN a = 1 THEN 'low_confidence' WHEN p = 'news_rss' THEN 'duplicate' ELSE 'candidate' END AS route FROM t)"""


def _collected(fx) -> str:
    root = work_folder(fx.spark, "collector")
    fx.sql(LANDED).createOrReplaceTempView("items")
    responses = fx.spark.sql(RESPONSES)
    verifications = fx.spark.sql(VERIFICATIONS).withColumn(
        "corrections", F.lit(None).cast("map<string,string>"))
    collector.start_collector(_landed(fx), responses, verifications, root, f"{root}/progress").awaitTermination()
    return root


@query("J04_collector", COLLECTED)
def _(fx) -> DataFrame:
    root = _collected(fx)
    news = collector.collected_news(fx.spark, root).select(
        "dedup_key", F.col("event_type").alias("news_type"), "country", "ai_confidence")
    return collector.collected_routes(fx.spark, root).select("dedup_key", "route").join(news, "dedup_key", "left")


@query("J04_jobs", f"""
WITH items AS ({LANDED}) SELECT {KEY} AS dedup_key, 'completed' AS status, 1 AS attempts, cast(max(seen_at) AS string) AS completed_at FROM items GROUP BY 1""")
def _(fx) -> DataFrame:
    return collector.collected_jobs(fx.spark, _collected(fx)).select("dedup_key", "status", "attempts", "completed_at")


@query("J04_candidates", f"""
SELECT dedup_key, 'needs_review' AS status, 1 AS observations FROM ({COLLECTED}) WHERE route IN ('low_confidence', 'duplicate', 'candidate')""")
def _(fx) -> DataFrame:
    root = _collected(fx)
    rows = store.get(fx.spark, root, "assignments", collector.ASSIGNMENTS)
    found = collector.collected_candidates(fx.spark, root)
    return rows.select("dedup_key", F.col("candidate_id").alias("id")).join(found, "id").select(
        "dedup_key", "status", F.col("observation_count").alias("observations"))


# --- J4 in three triggers: the first answer to every fifth item is no answer, later ones come with repeats a day on


def _three_triggers(fx) -> str:
    """All items once, the same items a minute later (too early to be tried again), and a day later."""
    root = work_folder(fx.spark, "triggers")
    landed = fx.sql(LANDED.replace("cast(NULL AS timestamp)", "cast(NULL AS timestamp_ntz)").replace(
        "timestamp '2024", "timestamp_ntz '2024"))
    landed.createOrReplaceTempView("items")
    answers = fx.spark.sql(RESPONSES)
    # an answer without a proper date fails and is asked for again
    failing = F.length("dedup_key") % 5 == 0
    responses = lambda n: answers if n == 2 else answers.withColumn(
        "response_text", F.when(failing, F.lit('{"is_relevant": true, "classification": "sighting", "incident_date": "soon"}')).otherwise(F.col("response_text")))
    verifications = fx.spark.sql(VERIFICATIONS).withColumn("corrections", F.lit(None).cast("map<string,string>"))
    for turn, delay in enumerate(("0 SECONDS", "60 SECONDS", "30 DAYS")):
        landed.withColumn("seen_at", F.expr(f"seen_at + INTERVAL {delay}")).write.parquet(f"{root}/landed/turn={turn}")
        items = fx.spark.readStream.schema(landed.schema).parquet(f"{root}/landed/turn=*")
        collector.start_collector(items, responses, verifications, root, f"{root}/progress").awaitTermination()
    return root


@query("J04_retried_jobs", f"""
WITH items AS ({LANDED}), t AS (SELECT {KEY} AS dedup_key, max(seen_at) AS last,
  bool_or(regexp_matches(lower(concat(title, ' ', content)), '{SUBJECT_RE}') OR (trusted AND regexp_matches(lower(concat(title, ' ', content)), '{TRUSTED_RE}'))) FILTER (first) AS relevant
 FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY seen_at, id) = 1 AS first FROM items) GROUP BY 1)
SELECT dedup_key, 'completed' AS status, CASE WHEN relevant AND length(dedup_key) % 5 = 0 THEN 2 ELSE 1 END AS attempts,
 cast(CASE WHEN relevant AND length(dedup_key) % 5 = 0 THEN last + INTERVAL 30 DAY ELSE last END AS string) AS completed_at FROM t""")
def _(fx) -> DataFrame:
    return collector.collected_jobs(fx.spark, _three_triggers(fx)).select("dedup_key", "status", "attempts", "completed_at")
