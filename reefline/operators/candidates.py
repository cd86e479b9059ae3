"""Observations to reviewable candidates, and the review queue over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reefline.constants import MATCHED_RATIONALE, UNMATCHED_RATIONALE
from reefline.functions.frames import pg_order
from reefline.functions.text import normal_part
from reefline.operators.browse import page_of

OBSERVATION_KEY = ["source_document_id", "extractor_name", "prompt_version", "payload_sha256"]


# --- idempotent observations ------------------------------------------------------------
def canonical_json(fields: list[str]) -> Column:
    """Compact JSON with keys in name order, nulls kept and non-ASCII escaped."""
    return F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {
        "ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})


def with_payload(observations: DataFrame, fields: list[str]) -> DataFrame:
    return observations.withColumn("payload", canonical_json(fields)).withColumn(
        "payload_sha256", F.sha2("payload", 256))


def new_observations(batch: DataFrame, stored: DataFrame | None = None,
                     order: list[str] = ("created_at", "id")) -> DataFrame:
    """First observation per (source, extractor, prompt version, payload), unless stored."""
    if stored is not None:
        batch = batch.join(stored.select(*OBSERVATION_KEY), OBSERVATION_KEY, "left_anti")
    rest = [c for c in batch.columns if c not in OBSERVATION_KEY]
    first = batch.groupBy(*OBSERVATION_KEY).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*OBSERVATION_KEY, *[f"_row.{c}" for c in rest])


# --- grouping -----------------------------------------------------------------------------
def match_key(incident_date: Column, country: Column, place: Column, classification: Column) -> Column:
    """Normalised date|country|place|class; null when any part is missing or empty."""
    parts = [incident_date.cast("string"), country, place, classification]
    complete = F.lit(True)
    for part in parts:
        complete = complete & part.isNotNull() & (part != "")
    return F.when(complete, F.concat_ws("|", *[normal_part(p) for p in parts]))


def first_open(candidates: DataFrame) -> DataFrame:
    """match_key -> the earliest candidate still open or published."""
    open_ = candidates.filter(
        F.col("match_key").isNotNull() & F.col("status").isin("needs_review", "published"))
    return open_.groupBy("match_key").agg(
        F.min_by(F.struct("id", "canonical_incident_id"), F.struct("created_at", "id")).alias("_c")
    ).select("match_key", F.col("_c.id").alias("candidate_id"),
             F.col("_c.canonical_incident_id").alias("canonical_incident_id"))


def assign_candidates(observations: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Adds `match_key` and `candidate_id` to attack and sighting observations.

    A key joins the first open candidate of that key, else all its observations share a new
    one; without a key every observation stands alone.
    """
    keyed = observations.filter(F.col("event_type").isin("attack", "sighting")).withColumn(
        "match_key", match_key(F.col("incident_date"), F.col("country"),
                               F.col("location_description"), F.col("classification")))
    own = F.coalesce(F.concat(F.lit("k-"), F.sha2("match_key", 256)),
                     F.concat(F.lit("o-"), F.col("id").cast("string")))
    if existing is None:
        return keyed.withColumn("candidate_id", own)
    known = first_open(existing).select("match_key", F.col("candidate_id").alias("_known"))
    return keyed.join(known, "match_key", "left").withColumn(
        "candidate_id", F.coalesce("_known", own)).drop("_known")


def candidate_rows(assigned: DataFrame) -> DataFrame:
    """One row per candidate; published as soon as an observation names an incident."""
    canonical = F.col("canonical_incident_id") if "canonical_incident_id" in assigned.columns \
        else F.lit(None).cast("bigint")
    order = F.struct("created_at", "id")
    grouped = assigned.withColumn("_canonical", canonical).groupBy("candidate_id", "match_key").agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"),
        F.count(F.lit(1)).alias("observation_count"),
        F.min_by("_canonical", F.when(F.col("_canonical").isNotNull(), order))
        .alias("canonical_incident_id"))
    has_key = F.col("match_key").isNotNull()
    return grouped.select(
        F.col("candidate_id").alias("id"),
        F.when(F.col("canonical_incident_id").isNotNull(), "published")
        .otherwise("needs_review").alias("status"),
        "match_key", F.when(has_key, F.lit(1.0)).alias("match_score"),
        F.when(has_key, F.lit(MATCHED_RATIONALE)).otherwise(F.lit(UNMATCHED_RATIONALE))
        .alias("match_rationale"),
        "canonical_incident_id", "created_at", "updated_at", "observation_count")


# --- review queue ---------------------------------------------------------------------------
def latest_observation(observations: DataFrame, fields: list[str]) -> DataFrame:
    """candidate_id, latest{fields}, observation_count; combined map-side, no group in memory."""
    return observations.groupBy("candidate_id").agg(
        F.max_by(F.struct(*fields), F.struct("created_at", "id")).alias("latest"),
        F.count(F.lit(1)).alias("observation_count"))


def with_latest(candidates: DataFrame, observations: DataFrame, documents: DataFrame,
                fields: list[str], document_fields: list[str]) -> DataFrame:
    """Candidates with latest observation, its evidence and the observation count."""
    mine = observations.join(candidates.select(F.col("id").alias("candidate_id")), "candidate_id",
                             "left_semi")
    latest = latest_observation(mine, [*fields, "source_document_id"])
    joined = candidates.join(latest, candidates["id"] == latest["candidate_id"], "left").drop(
        "candidate_id").withColumn("observation_count", F.coalesce("observation_count", F.lit(0)))
    evidence = documents.select(F.col("id").alias("_doc"), F.struct("id", *document_fields)
                                .alias("source"))
    return joined.join(
        evidence, F.col("latest.source_document_id") == F.col("_doc"), "left").drop("_doc")


def candidate_page(candidates: DataFrame, status: str | None = None, page: int = 1,
                   per_page: int = 50) -> DataFrame:
    if status:
        candidates = candidates.filter(F.col("status") == status)
    return page_of(candidates, [pg_order("created_at", True), F.asc("id")], page, per_page)
