"""Table schemas; scans never infer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Time zone free timestamps throughout: every time in the data is UTC.
TS = T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


S, L, I, D, B, DT = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.DateType(),
)

INCIDENTS = _struct(
    id=L, case_number=S, incident_date=DT, incident_time=S, date_precision=S,
    location_description=S, country=S, state_province=S, county_region=S, body_of_water=S,
    longitude=D, latitude=D, location_precision=S, classification=S,
    classification_subtype=S, provocation_subtype=S, report_source=S, report_platform=S,
    shark_species_confirmed=S, shark_species_suspected=S, shark_size_estimate=S,
    species_identification_method=S, victim_activity=S, victim_injury_severity=S,
    victim_injury_description=S, victim_age=I, victim_sex=S, victim_name=S, fatal=B,
    description=S, verification_status=S, submitted_by=S, verified_by=S, verified_at=TS,
    submitted_at=TS, updated_at=TS,
)
SOURCES = _struct(
    id=L, incident_id=L, source_type=S, source_url=S, source_title=S, source_publisher=S,
    source_date=DT, source_notes=S, created_at=TS,
)
NEWS = _struct(
    id=L, dedup_key=S, source_platform=S, source_name=S, source_url=S, title=S, summary=S,
    author=S, image_url=S, published_at=TS, captured_at=TS, event_type=S, country=S,
    ai_confidence=D, promoted_incident_id=L, source_document_id=L,
)
SOURCE_DOCUMENTS = _struct(
    id=L, dedup_key=S, source_platform=S, source_name=S, source_url=S, title=S, body_excerpt=S,
    author=S, published_at=TS, content_sha256=S, raw_metadata=S, captured_at=TS, last_seen_at=TS,
)
JOBS = _struct(
    source_document_id=L, job_type=S, status=S, attempts=I, max_attempts=I, available_at=TS,
    leased_by=S, leased_until=TS, last_error=S, result=S, created_at=TS, completed_at=TS,
)
CANDIDATES = _struct(
    id=S, status=S, match_key=S, match_score=D, match_rationale=S, canonical_incident_id=L,
    created_at=TS, updated_at=TS, review_notes=S, reviewed_by=S, reviewed_at=TS,
)
OBSERVATIONS = _struct(
    id=L, source_document_id=L, candidate_id=S, extractor_name=S, model_name=S,
    prompt_version=S, schema_version=S, payload=S, payload_sha256=S, event_type=S,
    confidence=D, verification_confidence=D, verification=S, validation_errors=S, created_at=TS,
)
AUDIT = _struct(id=L, incident_id=L, action=S, changed_by=S, changed_at=TS, changes=S, notes=S)
COUNTERS = _struct(year=I, last_value=I)
SPECIES = _struct(
    id=I, common_name=S, scientific_name=S, family=S, danger_level=S,
    max_size_meters=T.DecimalType(4, 1),
)
RAW_ITEMS = _struct(
    id=L, source_platform=S, source_name=S, source_url=S, title=S, content=S,
    published_at=TS, author=S, trusted=B, seen_at=TS,
)

TABLES = {
    "incidents": INCIDENTS, "incident_sources": SOURCES, "news_items": NEWS,
    "source_documents": SOURCE_DOCUMENTS, "collection_jobs": JOBS,
    "incident_candidates": CANDIDATES, "extracted_observations": OBSERVATIONS,
    "incident_audit_log": AUDIT, "case_number_counters": COUNTERS,
    "shark_species": SPECIES, "raw_items": RAW_ITEMS,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to exactly the schema; absent columns become typed nulls."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
