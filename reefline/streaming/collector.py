"""Micro-batch collector: capture, gate, claims, routing, observations and news."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from reefline.constants import MAX_ATTEMPTS
from reefline.operators import candidates, feed, normalize
from reefline.functions.frames import unseen
from reefline.operators.capture import fold_repeats, is_relevant, shape_evidence
from reefline.operators.jobs import retry_seconds
from reefline.schemas import NEWS, OBSERVATIONS, SOURCE_DOCUMENTS, conform
from reefline.streaming import store
from reefline.streaming.capture_stream import SIGHTINGS

FAILED = ["retry_extraction", "retry_verification", "retry_observation", "retry_capture"]
ASSIGNMENTS = T.StructType([
    T.StructField("dedup_key", T.StringType(), True), T.StructField("id", T.LongType(), True),
    T.StructField("candidate_id", T.StringType(), True), T.StructField("match_key", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True)])
JOB_STATES = T.StructType([
    T.StructField("dedup_key", T.StringType(), True), T.StructField("status", T.StringType(), True),
    T.StructField("attempts", T.IntegerType(), True), T.StructField("available_at", T.TimestampNTZType(), True),
    T.StructField("last_error", T.StringType(), True), T.StructField("completed_at", T.TimestampNTZType(), True)])
ROUTES = T.StructType([T.StructField(n, T.StringType(), True)
                       for n in ("dedup_key", "route", "event_type")])
CLAIM_FIELDS = ["incident_date", "location_description", "country", "classification",
                "shark_species_suspected", "victim_activity", "victim_injury_severity", "fatal",
                "description", "source_url", "source_title"]
TABLES = {"evidence": SOURCE_DOCUMENTS, "sightings": SIGHTINGS, "news": NEWS, "observations": OBSERVATIONS,
          "assignments": ASSIGNMENTS, "routes": ROUTES, "jobs": JOB_STATES}
# What each table is looked up by
KEYS = {"observations": "source_document_id", "assignments": "match_key"}
RECORDED = ["not_relevant", "news_only", "low_confidence", "duplicate", "invalid", "candidate"]


def _key(name: str) -> str:
    return KEYS.get(name, "dedup_key")


def route_batch(items: DataFrame, responses: DataFrame, verifications: DataFrame) -> DataFrame:
    """One routed row per new item with its claim laid beside it.

    `responses` (dedup_key, response_text) and `verifications` (dedup_key, is_valid,
    is_duplicate_likely, verification_confidence, corrections) are the answers of the
    external services; an item without a verification answer counts as failed there.
    """
    keyed = items.withColumn("id", F.xxhash64("dedup_key"))
    answers = responses.join(keyed.select("dedup_key", F.col("id").alias("raw_item_id")), "dedup_key")
    parsed = normalize.parse_responses(answers.withColumn("response_id", F.col("raw_item_id")))
    claims = normalize.build_claims(parsed, keyed).drop(
        "source_publisher", "source_date", "response_id", "report_source", "report_platform")
    claims = claims.withColumnRenamed("raw_item_key", "dedup_key").drop("raw_item_id", "source_url")
    joined = keyed.withColumn("relevant", is_relevant()).join(
        claims.withColumn("has_claim", F.lit(True)), "dedup_key", "left").join(
        verifications.withColumn("verified", F.lit(True)), "dedup_key", "left")
    flags = joined.withColumns({
        "captured": F.lit(True), "should_process": F.lit(True),
        "extraction_error": F.col("claim_error"), "observation_recorded": F.lit(True),
        "verification_error": F.col("verified").isNull()})
    routed = normalize.route(flags)
    # corrections other than the class apply to accepted claims only
    accepted = routed.withColumn("corrections", F.when(
        F.col("route") == "candidate", F.map_filter("corrections", lambda k, v: k != "classification")))
    return normalize.apply_corrections(accepted)


def job_states(jobs: DataFrame) -> DataFrame:
    """The latest state of each source's job."""
    fields = [c for c in JOB_STATES.names if c != "dedup_key"]
    return jobs.groupBy("dedup_key").agg(F.max_by(F.struct(*fields), "batch_id").alias("_job")).select(
        "dedup_key", *[f"_job.{c}" for c in fields])


def _answers(source, batch_id: int) -> DataFrame:
    return source(batch_id) if callable(source) else source


def _work(folded: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items without a job yet and items whose retry is due when they are seen again, with attempts so far."""
    mine = job_states(jobs.join(folded.select("dedup_key"), "dedup_key", "left_semi"))
    state = folded.join(mine, "dedup_key", "left")
    due = F.col("status").isNull() | ((F.col("status") == "retrying") & (F.col("available_at") <= F.col("last_seen_at")))
    return state.filter(due).withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1).drop(
        "status", "available_at", "last_error", "completed_at")


def _outcome(routed: DataFrame) -> DataFrame:
    """One job row per item worked on: completed, or failed with the time of its next try."""
    failed = F.col("route").isin(FAILED)
    final = F.col("attempts") >= MAX_ATTEMPTS
    wait = F.when(failed & ~final, retry_seconds(F.col("attempts"))).otherwise(0).cast("decimal(18,6)")
    return routed.select(
        "dedup_key", F.when(~failed, "completed").when(final, "dead_letter").otherwise("retrying").alias("status"),
        "attempts", (F.col("last_seen_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait)).alias("available_at"),
        F.when(failed, F.col("route")).alias("last_error"), F.when(~failed, F.col("last_seen_at")).alias("completed_at"))


def collect_batch(root: str, responses, verifications):
    """Work on one micro-batch; answers are tables, or functions of the batch number that give them."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for name, schema in TABLES.items():
            store.compact(spark, root, name, schema, _key(name), batch_id)

        def before(name: str, rows: DataFrame) -> DataFrame:
            """What earlier batches stored in the buckets of these rows' keys."""
            return store.get(spark, root, name, TABLES[name], batch_id, store.buckets_of(rows, _key(name)))

        def put(rows: DataFrame, name: str) -> None:
            store.put(rows, root, name, batch_id, _key(name))
        folded = fold_repeats(batch).persist()
        # evidence keeps what came first; every sighting moves the time it was seen last
        put(conform(unseen(folded, before("evidence", folded), "dedup_key"), SOURCE_DOCUMENTS), "evidence")
        put(folded.select("dedup_key", F.col("last_seen_at").alias("seen_at")), "sightings")
        # several tables come from the same routed rows: keep them for the writes
        routed = route_batch(_work(folded, before("jobs", folded)), _answers(responses, batch_id),
                             _answers(verifications, batch_id)).persist()
        promoted = F.col("route") == "candidate"
        news = routed.filter(~F.col("route").isin("not_relevant")).withColumns({
            "event_type": F.when(promoted, F.col("event_type")).otherwise(F.lit("news")),
            "country": F.when(promoted, F.col("country")),
            "ai_confidence": F.when(promoted, F.col("confidence")),
            "source_document_id": F.col("id")})
        put(conform(news, NEWS), "news")
        seen = routed.filter(F.col("route").isin(RECORDED)).withColumns({
            "source_document_id": F.col("id"), "extractor_name": F.lit("collector"),
            "prompt_version": F.lit("v1"), "created_at": F.col("last_seen_at"),
            "event_type": F.when(F.col("route") == "news_only", "news").otherwise(F.col("event_type"))})
        shaped = candidates.with_payload(seen, CLAIM_FIELDS)
        fresh = candidates.new_observations(shaped, before("observations", shaped)).persist()
        keyed = candidates.assign_candidates(fresh).filter("match_key IS NOT NULL")
        existing = candidates.candidate_rows(before("assignments", keyed))
        assigned = candidates.assign_candidates(fresh, existing)
        put(assigned.select(*ASSIGNMENTS.names), "assignments")
        linked = fresh.join(assigned.select("dedup_key", "candidate_id"), "dedup_key", "left")
        put(conform(linked, OBSERVATIONS), "observations")
        put(routed.select(*ROUTES.names), "routes")
        put(_outcome(routed).select(*JOB_STATES.names), "jobs")
        fresh.unpersist()
        routed.unpersist()
        folded.unpersist()
    return run


def start_collector(items: DataFrame, responses, verifications, root: str,
                    checkpoint: str, **trigger) -> StreamingQuery:
    return (
        shape_evidence(items).writeStream
        .foreachBatch(collect_batch(root, responses, verifications))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def _latest(spark: SparkSession, root: str, name: str) -> DataFrame:
    return store.get(spark, root, name, TABLES[name])


def collected_news(spark: SparkSession, root: str) -> DataFrame:
    """The feed: first write wins, later batches move only the updated columns."""
    return conform(feed.fold_batch(_latest(spark, root, "news"), "batch_id"), NEWS)


def collected_jobs(spark: SparkSession, root: str) -> DataFrame:
    return job_states(_latest(spark, root, "jobs"))


def collected_routes(spark: SparkSession, root: str) -> DataFrame:
    """Where each item ended when it was last worked on."""
    return _latest(spark, root, "routes").groupBy("dedup_key").agg(
        F.max_by(F.struct("route", "event_type"), "batch_id").alias("r")).select("dedup_key", "r.*")


def collected_candidates(spark: SparkSession, root: str) -> DataFrame:
    return candidates.candidate_rows(_latest(spark, root, "assignments"))
