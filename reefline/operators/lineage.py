"""Rows derived from existing tables: news from incidents, evidence from news, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reefline.constants import GENERATED_NEWS_PREFIX, LINEAGE_RATIONALE
from reefline.functions.text import blank_to_null, normal_part, title_case
from reefline.schemas import CANDIDATES, JOBS, NEWS, SOURCE_DOCUMENTS, conform


def incident_event_type(classification: Column) -> Column:
    return F.when(classification == "sighting", "sighting").otherwise("attack")


def news_from_incidents(incidents: DataFrame, sources: DataFrame,
                        default_publisher: str = "registry") -> DataFrame:
    """One feed item per incident, from its first source where that says something."""
    first = sources.groupBy("incident_id").agg(F.min_by(
        F.struct("source_title", "source_publisher", "source_url"), "id").alias("s"))
    joined = incidents.join(first, incidents["id"] == first["incident_id"], "left")
    noon = F.col("incident_date").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
    when = F.coalesce(noon, "submitted_at")
    heading = F.concat(title_case(F.replace("classification", F.lit("_"), F.lit(" "))),
                       F.lit(" — "), "location_description")
    publisher = blank_to_null(F.col("s.source_publisher"))
    return conform(joined.select(
        F.concat(F.lit(GENERATED_NEWS_PREFIX), F.col("id").cast("string")).alias("dedup_key"),
        F.coalesce(blank_to_null(F.col("report_platform")), F.lit("web_scrape")).alias("source_platform"),
        F.coalesce(publisher, blank_to_null(F.col("report_source")), F.lit(default_publisher))
        .alias("source_name"),
        F.coalesce("s.source_url", F.lit("")).alias("source_url"),
        F.coalesce(blank_to_null(F.col("s.source_title")), heading).alias("title"),
        F.col("description").alias("summary"), F.col("s.source_publisher").alias("author"),
        when.alias("published_at"), when.alias("captured_at"),
        incident_event_type(F.col("classification")).alias("event_type"), "country",
        F.col("id").alias("promoted_incident_id")), NEWS)


def evidence_from_news(news: DataFrame) -> DataFrame:
    return conform(news.select(
        "id", "dedup_key", "source_platform", "source_name", "source_url", "title",
        F.col("summary").alias("body_excerpt"), "author", "published_at", "captured_at",
        F.col("captured_at").alias("last_seen_at"),
        F.lit('{"migrated_from": "news_items"}').alias("raw_metadata")), SOURCE_DOCUMENTS)


def jobs_from_evidence(documents: DataFrame) -> DataFrame:
    """A completed job per evidence row."""
    return conform(documents.select(
        F.col("id").alias("source_document_id"), F.lit("extract").alias("job_type"),
        F.lit("completed").alias("status"), F.lit(1).alias("attempts"), F.lit(8).alias("max_attempts"),
        F.lit('{"outcome": "migrated"}').alias("result"), F.col("captured_at").alias("created_at"),
        F.col("captured_at").alias("available_at"), F.col("captured_at").alias("completed_at")), JOBS)


def lineage_candidates(incidents: DataFrame, news: DataFrame) -> DataFrame:
    """A published candidate per incident with news, from its first to its last capture.

    Unlike live grouping, the key here only needs its parts to be present, not non-empty.
    """
    spans = news.filter(F.col("promoted_incident_id").isNotNull()).groupBy(
        F.col("promoted_incident_id").alias("id")).agg(
        F.min("captured_at").alias("created_at"), F.max("captured_at").alias("updated_at"))
    parts = ["country", "location_description", "classification"]
    complete = F.col("incident_date").isNotNull()
    for part in parts:
        complete = complete & F.col(part).isNotNull()
    key = F.when(complete, F.concat_ws("|", F.col("incident_date").cast("string"),
                                       *[normal_part(F.col(p)) for p in parts]))
    known = incidents.select("id", "incident_date", *parts)
    return conform(known.join(spans, "id").select(
        F.concat(F.lit("m-"), F.col("id").cast("string")).alias("id"),
        F.lit("published").alias("status"), key.alias("match_key"), F.lit(1.0).alias("match_score"),
        F.lit(LINEAGE_RATIONALE).alias("match_rationale"),
        F.col("id").alias("canonical_incident_id"), "created_at", "updated_at"), CANDIDATES)


LINEAGE_FIELDS = [
    "incident_date", "location_description", "country", "state_province", "body_of_water",
    "classification", "shark_species_suspected", "victim_activity", "victim_injury_severity",
    "fatal", "description",
]


def lineage_observations(news: DataFrame, documents: DataFrame, incidents: DataFrame,
                         candidates: DataFrame, extractor: str = "collector") -> DataFrame:
    """An observation per promoted news item: evidence, incident and candidate joined."""
    item = news.filter(F.col("promoted_incident_id").isNotNull()).select(
        F.col("source_document_id"), F.col("promoted_incident_id").alias("incident_id"),
        F.col("source_url"), F.col("title").alias("source_title"),
        F.col("source_name").alias("source_publisher"),
        F.col("published_at").cast("date").alias("source_date"), F.col("event_type").alias("news_type"),
        F.col("ai_confidence").alias("confidence"), F.col("captured_at").alias("created_at"))
    evidence = documents.select(F.col("id").alias("source_document_id"))
    known = incidents.select(F.col("id").alias("incident_id"), *LINEAGE_FIELDS)
    owner = candidates.select(F.col("canonical_incident_id").alias("incident_id"),
                              F.col("id").alias("candidate_id"))
    rows = item.join(evidence, "source_document_id").join(known, "incident_id").join(owner, "incident_id")
    payload = F.to_json(F.struct(*LINEAGE_FIELDS, "source_url", "source_title", "source_publisher",
                                 "source_date"))
    identity = F.concat(
        F.lit('{"incident_id": '), F.col("incident_id").cast("string"),
        F.coalesce(F.concat(F.lit(', "classification": "'), "classification", F.lit('"')), F.lit("")),
        F.lit(', "source_document_id": '), F.col("source_document_id").cast("string"), F.lit("}"))
    return rows.select(
        "source_document_id", "incident_id", "candidate_id", F.lit(extractor).alias("extractor_name"),
        F.lit("legacy").alias("model_name"), F.lit("migration-v1").alias("prompt_version"),
        F.lit("1").alias("schema_version"), payload.alias("payload"),
        F.sha2(identity, 256).alias("payload_sha256"),
        F.when(F.col("news_type").isin("attack", "sighting"), F.col("news_type"))
        .otherwise(incident_event_type(F.col("classification"))).alias("event_type"),
        "confidence", F.lit('{"migrated": true}').alias("verification"),
        F.lit("[]").alias("validation_errors"), "created_at")
