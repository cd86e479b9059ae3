"""Registered queries for normalisation, routing, validation and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from reefline.constants import CLASSIFICATIONS
from reefline.operators import candidates, normalize, stats, validate
from reefline.operators.capture import item_key
from reefline.plans.registry import query
from reefline.schemas import INCIDENTS, conform

FENCE = "```"


@query("H01_answer_parse", f"""
SELECT response_id, CASE response_id % 4 WHEN 0 THEN json_extract_string(response_text, '$.classification') WHEN 1 THEN 'provoked' END AS classification,
 response_id % 4 = 3 AS rejected FROM responses_v""")
def _(fx):
    parsed = normalize.parse_responses(fx["responses_v"])
    return parsed.select("response_id", F.col("answer.classification").alias("classification"),
                         F.col("object_text").isNull().alias("rejected"))


def _longest_sql(value: str) -> str:
    tests = " ".join(f"WHEN contains({value}, '{o}') THEN '{o}'"
                     for o in sorted(CLASSIFICATIONS, key=len, reverse=True))
    return f"CASE {tests} END"


NOISY = """concat(CASE id % 5 WHEN 0 THEN ' An ' WHEN 1 THEN '' WHEN 2 THEN 'likely ' WHEN 3 THEN 'No-' ELSE 'x' END,
 upper(replace(CASE WHEN id % 7 = 0 THEN 'nothing' ELSE classification END, '_', ' ')), CASE WHEN id % 4 = 0 THEN ' or sighting' ELSE '' END)"""


@query("H02_enumeration_repair", f"""
WITH v AS (SELECT id, replace(trim(lower({NOISY})), ' ', '_') AS t FROM incidents_v)
SELECT id, {_longest_sql("t")} AS classification FROM v""")
def _(fx):
    from reefline.functions.text import best_option
    noisy = fx["incidents_v"].select("id", F.expr(NOISY).alias("t"))
    return noisy.select("id", best_option(F.col("t"), CLASSIFICATIONS).alias("classification"))


COUNTRY_TEXT = """CASE id % 6 WHEN 0 THEN ' USA ' WHEN 1 THEN 'u.k.' WHEN 2 THEN 'England' WHEN 3 THEN concat('  ', country) WHEN 4 THEN 'nz' ELSE NULL END"""


@query("H03_country_canonical", f"""
SELECT id, CASE id % 6 WHEN 0 THEN 'United States' WHEN 1 THEN 'United Kingdom' WHEN 2 THEN 'United Kingdom' WHEN 3 THEN country WHEN 4 THEN 'New Zealand' END AS country
FROM incidents_v""")
def _(fx):
    return fx["incidents_v"].select("id", normalize.canonical_country(F.expr(COUNTRY_TEXT)).alias("country"))


SPECIES_TEXT = """CASE id % 7 WHEN 0 THEN 'A scalloped Hammerhead!' WHEN 1 THEN 'Great White Shark' WHEN 2 THEN ' Galeus melastomus ' WHEN 3 THEN 'some fish'
 WHEN 4 THEN 'blacktip reef shark' WHEN 5 THEN '' ELSE 'Shortfin MAKO' END"""


@query("H04_species_canonical", """
SELECT id, CASE id % 7 WHEN 0 THEN 'Sphyrna mokarran' WHEN 1 THEN 'Carcharodon carcharias' WHEN 2 THEN 'Galeus melastomus' WHEN 3 THEN 'some fish'
 WHEN 4 THEN 'Carcharhinus limbatus' WHEN 6 THEN 'Isurus oxyrinchus' END AS species FROM incidents_v""")
def _(fx):
    return fx["incidents_v"].select("id", normalize.canonical_species(F.expr(SPECIES_TEXT)).alias("species"))


ITEMS = """SELECT id, CASE id % 4 WHEN 0 THEN 'youtube' WHEN 1 THEN 'reddit' WHEN 2 THEN 'news_rss' ELSE 'web_scrape' END AS source_platform,
 concat('https://i.example/', cast(id AS string)) AS source_url, concat('Title ', cast(id AS string)) AS title, 'Writer' AS author,
 CASE WHEN id % 6 <> 0 THEN submitted_at END AS published_at FROM incidents_v"""


def _claims(fx):
    items = fx.sql(ITEMS).withColumn("dedup_key", item_key())
    return normalize.build_claims(normalize.parse_responses(
        fx["responses_v"]), items)


CLAIMS_SQL = """claims AS (SELECT i.id AS response_id, CASE WHEN i.id % 6 <> 0 THEN cast(submitted_at AS date) END AS incident_date,
 concat('Title ', cast(i.id AS string)) AS location_description, CASE i.id % 4 WHEN 0 THEN 'United States' ELSE country END AS country,
 CASE i.id % 4 WHEN 0 THEN 'unprovoked' ELSE 'provoked' END AS classification, 'social_media' AS report_source,
 CASE i.id % 4 WHEN 0 THEN 'youtube' ELSE 'reddit' END AS report_platform, CASE i.id % 4 WHEN 0 THEN 'video' ELSE 'social_media' END AS source_type,
 CASE i.id % 4 WHEN 0 THEN cast(i.id % 10 AS double) / 10e0 ELSE 0.5e0 END AS confidence,
 concat(CASE i.id % 4 WHEN 0 THEN 'youtube' ELSE 'reddit' END, ':https://i.example/', cast(i.id AS string)) AS raw_item_key,
 i.id FROM incidents_v i WHERE i.id % 4 IN (0, 1))"""


@query("H05_claim_rows", f"""
WITH {CLAIMS_SQL} SELECT response_id, cast(incident_date AS string) AS incident_date, location_description, country, classification, report_source, report_platform,
 source_type, confidence, raw_item_key, false AS fatal FROM claims""")
def _(fx):
    return _claims(fx).select(
        "response_id", "incident_date", "location_description", "country", "classification",
        "report_source", "report_platform", "source_type", "confidence", "raw_item_key", "fatal")


@query("H06_constraint_check", """
SELECT id, concat_ws('; ', CASE WHEN length(location_description) > 8 THEN 'location_description: longer than 8' END,
 CASE WHEN NOT list_contains(['fatal','severe','moderate','minor','no_injury'], victim_injury_severity) THEN 'victim_injury_severity: not allowed' END,
 CASE WHEN victim_age > 120 THEN 'victim_age: out of range' END, CASE WHEN lon > 180 THEN 'longitude: out of range' END,
 CASE WHEN (lon IS NULL) <> (latitude IS NULL) THEN 'coordinates: incomplete' END) AS reasons
FROM (SELECT id, location_description, latitude, CASE WHEN id % 9 = 0 THEN 'awful' ELSE victim_injury_severity END AS victim_injury_severity,
 victim_age * 3 AS victim_age, CASE WHEN id % 100 = 3 THEN NULL ELSE longitude + 30e0 END AS lon FROM incidents_v)
WHERE length(location_description) > 8 OR coalesce(victim_injury_severity, 'fatal') = 'awful' OR victim_age > 120 OR lon > 180 OR (lon IS NULL) <> (latitude IS NULL)""")
def _(fx):
    rows = conform(fx["incidents_v"], INCIDENTS).withColumns({
        "victim_injury_severity": F.when(F.col("id") % 9 == 0, "awful").otherwise(
            F.col("victim_injury_severity")),
        "victim_age": F.col("victim_age") * 3,
        "longitude": F.when(F.col("id") % 100 != 3, F.col("longitude") + 30.0)})
    rules = {"location_description: longer than 8": F.length("location_description") > 8,
             **validate.incident_rules()}
    _, rejects = validate.split(rows, rules)
    return rejects.select("id", F.concat_ws("; ", "reasons").alias("reasons"))


CORRECTIONS = """CASE id % 5 WHEN 0 THEN map('country', 'Fiji', 'classification', 'Boat bite', 'confidence', '0.9')
 WHEN 1 THEN map('fatal', 'TRUE', 'victim_age', '31', 'shark_species', 'bull shark') WHEN 2 THEN map('classification', 'banana', 'description', NULL)
 WHEN 3 THEN map('location_description', 'Pier', 'victim_activity', 'was surfing') END"""


@query("H07_correction_overlay", f"""
WITH {CLAIMS_SQL} SELECT response_id, CASE id % 5 WHEN 0 THEN 'Fiji' ELSE country END AS country, CASE id % 5 WHEN 0 THEN 'boat_bite' ELSE classification END AS classification,
 id % 5 = 1 AS fatal, CASE id % 5 WHEN 1 THEN '31' END AS victim_age, CASE id % 5 WHEN 1 THEN 'Carcharhinus leucas' END AS species,
 CASE id % 5 WHEN 3 THEN 'Pier' ELSE location_description END AS place, CASE id % 5 WHEN 3 THEN 'surfing' END AS activity, confidence FROM claims""")
def _(fx):
    claims = _claims(fx).withColumn("id", F.col("response_id"))
    fixed = normalize.apply_corrections(claims.withColumn("corrections", F.expr(CORRECTIONS)))
    return fixed.select(
        "response_id", "country", "classification", "fatal",
        F.col("victim_age").cast("string").alias("victim_age"),
        F.col("shark_species_suspected").alias("species"),
        F.col("location_description").alias("place"), F.col("victim_activity").alias("activity"),
        "confidence")


RUN = """SELECT id, id % 97 <> 0 AS captured, id % 11 <> 0 AS should_process, id % 5 <> 0 AS relevant, id % 31 = 0 AS extraction_error,
 id % 3 <> 0 AS has_claim, cast(id % 10 AS double) / 10e0 AS confidence, classification, id % 13 = 0 AS verification_error, id % 13 <> 0 AS verified,
 id % 17 = 0 AS is_duplicate_likely, id % 7 <> 0 AS is_valid, cast(id % 9 AS double) / 10e0 AS verification_confidence, id % 41 <> 0 AS observation_recorded,
 CASE WHEN id % 19 = 0 THEN 'Near miss' END AS fix FROM incidents_v"""

RUN_SQL = f"""r AS (SELECT *, CASE WHEN NOT captured THEN 'retry_capture' WHEN NOT should_process THEN 'seen' WHEN NOT relevant THEN 'not_relevant'
 WHEN extraction_error THEN 'retry_extraction' WHEN NOT has_claim THEN 'news_only' WHEN confidence < 0.4 THEN 'low_confidence'
 WHEN verification_error AND confidence < 0.7 THEN 'retry_verification' WHEN verified AND is_duplicate_likely THEN 'duplicate'
 WHEN verified AND NOT is_valid AND verification_confidence >= 0.6 THEN 'invalid' WHEN NOT observation_recorded THEN 'retry_observation'
 ELSE 'candidate' END AS route FROM ({RUN})),
final AS (SELECT *, CASE WHEN route IN ('candidate','retry_observation') AND verified AND fix IS NOT NULL THEN 'near_miss'
  WHEN route IN ('candidate','retry_observation') AND verified AND NOT is_valid AND classification <> 'sighting' THEN 'unverified_report' ELSE classification END AS klass FROM r)"""


def _routed(fx):
    run = fx.sql(RUN).withColumn("corrections", F.when(
        F.col("fix").isNotNull(), F.create_map(F.lit("classification"), F.col("fix"))))
    return normalize.route(run)


@query("H08_routing", f"""
WITH {RUN_SQL} SELECT id, route, klass AS classification, CASE WHEN route = 'not_relevant' THEN 'not_relevant' WHEN NOT has_claim THEN 'news'
 WHEN klass = 'sighting' THEN 'sighting' ELSE 'attack' END AS event_type FROM final""")
def _(fx):
    return _routed(fx).select("id", "route", "classification", "event_type")


@query("D09_run_counters", f"""
WITH {RUN_SQL}, c AS (SELECT *, route IN ('retry_verification','duplicate','invalid','retry_observation','candidate') AS past FROM final)
SELECT count(*) AS processed, count(*) FILTER (NOT route IN ('retry_capture','seen','not_relevant') AND id % 4 <> 0) AS captured_news,
 count(*) FILTER (NOT route IN ('retry_capture','seen','not_relevant','retry_extraction','news_only')) AS extracted,
 count(*) FILTER (past AND verified) AS verified, cast(0 AS bigint) AS submitted, count(*) FILTER (route = 'candidate') AS candidates,
 cast(0 AS bigint) AS promoted_attack, cast(0 AS bigint) AS promoted_sighting, count(*) FILTER (route = 'seen') AS skipped_seen,
 count(*) FILTER (route = 'not_relevant') AS skipped_not_shark, count(*) FILTER (route = 'news_only') AS skipped_irrelevant,
 count(*) FILTER (route IN ('low_confidence','invalid')) AS skipped_low_confidence, count(*) FILTER (route = 'duplicate') AS skipped_duplicate,
 count(*) FILTER (route LIKE 'retry%') AS retryable_failures,
 count(*) FILTER (route IN ('retry_capture','retry_extraction','retry_observation') OR (past AND verification_error)) AS errors FROM c""")
def _(fx):
    return stats.run_counters(_routed(fx).withColumn("news_captured", F.col("id") % 4 != 0))


# --- observations and candidates ----------------------------------------------------------
PAYLOAD = ["incident_date", "country", "location_description", "classification"]


@query("H10_observation_idempotence", """
WITH o AS (SELECT *, sha256(concat('{"classification":"', classification, '","country":"', country, '"}')) AS payload_sha256 FROM observations_v)
SELECT source_document_id, extractor_name, prompt_version, payload_sha256, min(id) AS id FROM o
WHERE NOT (source_document_id % 4 = 0 AND prompt_version = 'v1') GROUP BY 1, 2, 3, 4""")
def _(fx):
    seen = candidates.with_payload(fx["observations_v"], ["country", "classification"])
    stored = seen.filter("source_document_id % 4 = 0 AND prompt_version = 'v1'")
    return candidates.new_observations(seen, stored, ["id"]).select(
        "source_document_id", "extractor_name", "prompt_version", "payload_sha256", "id")


KEY_SQL = """CASE WHEN incident_date IS NOT NULL AND country <> '' AND location_description <> '' AND classification <> '' THEN
 concat_ws('|', cast(incident_date AS string), lower(country), lower(trim(regexp_replace(location_description, '\\s+', ' ', 'g'))), lower(classification)) END"""

OPEN = "SELECT *, CASE id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'published' ELSE 'needs_review' END AS status FROM observations_v WHERE id % 3 = 0"


def _stored(fx):
    """A third of the observations as candidates of an earlier run."""
    old = fx.sql(OPEN).withColumn("match_key", candidates.match_key(
        F.col("incident_date"), F.col("country"), F.col("location_description"),
        F.col("classification")))
    return old.select(F.concat(F.lit("c-"), F.col("id").cast("string")).alias("id"), "match_key",
                      "status", "created_at", F.lit(None).cast("bigint").alias("canonical_incident_id"))


@query("E04_first_open_candidate", f"""
SELECT k AS match_key, concat('c-', cast(id AS string)) AS candidate_id FROM (SELECT *, {KEY_SQL} AS k FROM ({OPEN}))
WHERE k IS NOT NULL AND status IN ('needs_review','published')
QUALIFY row_number() OVER (PARTITION BY k ORDER BY created_at, concat('c-', cast(id AS string))) = 1""")
def _(fx):
    return candidates.first_open(_stored(fx)).select("match_key", "candidate_id")


GROUPED = f"""grouped AS (SELECT *, {KEY_SQL} AS k FROM observations_v WHERE event_type IN ('attack','sighting')),
stored AS (SELECT k, concat('c-', cast(id AS string)) AS cid FROM (SELECT *, {KEY_SQL} AS k FROM ({OPEN}))
 WHERE k IS NOT NULL AND status IN ('needs_review','published')
 QUALIFY row_number() OVER (PARTITION BY k ORDER BY created_at, concat('c-', cast(id AS string))) = 1),
linked AS (SELECT g.*, coalesce(s.cid, 'k-' || sha256(g.k), concat('o-', cast(g.id AS string))) AS candidate_id FROM grouped g LEFT JOIN stored s ON s.k = g.k)"""


@query("H11_candidate_grouping", f"""
WITH {GROUPED} SELECT candidate_id AS id, k AS match_key, CASE WHEN k IS NOT NULL THEN 1e0 END AS match_score,
 CASE WHEN k IS NOT NULL THEN 'Exact normalized date, country, location, and classification' ELSE 'Insufficient deterministic fields; manual review required' END AS match_rationale,
 count(*) AS observation_count, cast(min(created_at) AS string) AS created_at FROM linked GROUP BY 1, 2, 3, 4""")
def _(fx):
    rows = candidates.candidate_rows(candidates.assign_candidates(fx["observations_v"], _stored(fx)))
    return rows.select("id", "match_key", "match_score", "match_rationale", "observation_count",
                       "created_at")


def _documents(fx):
    return fx["observations_v"].groupBy(F.col("source_document_id").alias("id")).agg(
        F.min("created_at").alias("captured_at"))


@query("E03_latest_observation", f"""
WITH {GROUPED} SELECT candidate_id AS id, count(*) AS observation_count, arg_max(id, concat(cast(created_at AS string), lpad(cast(id AS string), 12, '0'))) AS observation_id,
 arg_max(source_document_id, concat(cast(created_at AS string), lpad(cast(id AS string), 12, '0'))) AS source_id FROM linked GROUP BY 1""")
def _(fx):
    linked = candidates.assign_candidates(fx["observations_v"], _stored(fx))
    rows = candidates.with_latest(candidates.candidate_rows(linked).select("id"), linked,
                                  _documents(fx), ["id", "event_type"], ["captured_at"])
    return rows.select("id", "observation_count", F.col("latest.id").alias("observation_id"),
                       F.col("source.id").alias("source_id"))


@query("F05_candidate_page", f"""
WITH {GROUPED}, c AS (SELECT candidate_id AS id, min(created_at) AS created_at, count(*) AS observation_count FROM linked GROUP BY 1)
SELECT id, cast(created_at AS string) AS created_at, observation_count FROM c ORDER BY c.created_at DESC, id LIMIT 50 OFFSET 50""")
def _(fx):
    linked = candidates.assign_candidates(fx["observations_v"], _stored(fx))
    page = candidates.candidate_page(candidates.candidate_rows(linked).drop("observation_count"),
                                     status="needs_review", page=2)
    shown = candidates.with_latest(page, linked, _documents(fx), ["id"], ["captured_at"])
    return shown.select("id", "created_at", "observation_count")
