"""Registered queries for matching, clustering and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from reefline.constants import ENRICH_FIELDS, GENERATED_NEWS_PREFIX
from reefline.operators import resolve
from reefline.plans.registry import query
from reefline.schemas import AUDIT, CANDIDATES, INCIDENTS, NEWS, SOURCES, conform

LIVE = "live AS (SELECT * FROM incidents_v WHERE verification_status <> 'rejected')"
HEADLINE = """CASE WHEN length({t}) >= 30 AND NOT starts_with({t}, 'a full list of') AND NOT starts_with({t}, 'latest articles') AND NOT starts_with({t}, 'recent articles') THEN {t} END"""
HEAD = "lower(trim(regexp_replace(regexp_replace(source_title, '^(.*) - .*$', '\\1'), '\\s+', ' ', 'g')))"

BY_URL = f"""by_url AS (SELECT q.submission_id, min(l.case_number) AS case_number FROM submission_sources_v q
 JOIN (SELECT source_url, min(case_number) AS case_number FROM sources_v s JOIN live l ON l.id = s.incident_id WHERE source_url <> '' GROUP BY 1) l
 ON l.source_url = q.source_url GROUP BY 1)"""
BY_TITLE = f"""stored_titles AS (SELECT {HEAD} AS h, min(l.case_number) AS case_number FROM sources_v s JOIN live l ON l.id = s.incident_id
 WHERE starts_with(lower(source_title), substr({HEAD}, 1, 80)) GROUP BY 1),
by_title AS (SELECT q.submission_id, min(t.case_number) AS case_number FROM (SELECT submission_id, {HEAD} AS h FROM submission_sources_v) q
 JOIN stored_titles t ON t.h = q.h WHERE {HEADLINE.format(t='q.h')} IS NOT NULL GROUP BY 1)"""
KM = """2 * 6371.0 * asin(least(1, sqrt(pow(sin(radians(b.latitude - a.latitude) / 2), 2)
 + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"""
BY_PLACE = f"""by_place AS (SELECT a.submission_id, min(b.case_number) AS case_number FROM submissions_v a JOIN live b
 ON a.incident_date = b.incident_date AND a.classification = b.classification
 WHERE a.date_precision = 'exact' AND a.longitude IS NOT NULL AND b.longitude IS NOT NULL AND {KM} * 1000 <= 150
 AND NOT coalesce(a.victim_age <> b.victim_age, false) AND NOT coalesce(a.victim_sex <> b.victim_sex, false) GROUP BY 1)"""


@query("C02_match_by_url", f"WITH {LIVE}, {BY_URL} SELECT submission_id, case_number FROM by_url")
def _(fx):
    return resolve.match_by_url(fx["submission_sources_v"], fx["sources_v"], fx["incidents_v"]).select(
        "submission_id", "case_number")


@query("C03_match_by_headline", f"WITH {LIVE}, {BY_TITLE} SELECT submission_id, case_number FROM by_title")
def _(fx):
    return resolve.match_by_headline(
        fx["submission_sources_v"], fx["sources_v"], fx["incidents_v"]).select(
        "submission_id", "case_number")


@query("C04_match_by_place", f"WITH {LIVE}, {BY_PLACE} SELECT submission_id, case_number FROM by_place")
def _(fx):
    return resolve.match_by_place(fx["submissions_v"], fx["incidents_v"]).select(
        "submission_id", "case_number")


CASCADE = f"""{LIVE}, {BY_URL}, {BY_TITLE}, {BY_PLACE}, cascade AS (SELECT q.submission_id, coalesce(u.case_number, t.case_number, p.case_number) AS case_number,
 CASE WHEN u.case_number IS NOT NULL THEN 'url' WHEN t.case_number IS NOT NULL THEN 'headline' WHEN p.case_number IS NOT NULL THEN 'place' END AS matched_by
 FROM submissions_v q LEFT JOIN by_url u ON u.submission_id = q.submission_id LEFT JOIN by_title t ON t.submission_id = q.submission_id
 LEFT JOIN by_place p ON p.submission_id = q.submission_id)"""


@query("C05_match_cascade", f"WITH {CASCADE} SELECT submission_id, case_number, matched_by FROM cascade")
def _(fx):
    return resolve.match_cascade(
        fx["submissions_v"], fx["submission_sources_v"],
        fx["sources_v"], fx["incidents_v"]).select(
        "submission_id", "case_number", "matched_by")


CHAINS = """days AS (SELECT *, CASE WHEN date_diff('day', lag(incident_date) OVER w, incident_date) <= 3 THEN 0 ELSE 1 END AS brk
 FROM incidents_v WHERE date_precision = 'exact' AND incident_date IS NOT NULL WINDOW w AS (PARTITION BY country, classification ORDER BY incident_date, id)),
islands AS (SELECT *, sum(brk) OVER (PARTITION BY country, classification ORDER BY incident_date, id ROWS UNBOUNDED PRECEDING) AS island FROM days),
sized AS (SELECT *, count(*) OVER (PARTITION BY country, classification, island) AS size, min(incident_date) OVER (PARTITION BY country, classification, island) AS chain_start,
 max(incident_date) OVER (PARTITION BY country, classification, island) AS chain_end FROM islands)"""


@query("E02_near_duplicate_blocks", f"""
WITH {CHAINS} SELECT id, concat_ws('|', country, classification, cast(chain_start AS string)) AS cluster_id, size FROM sized WHERE size BETWEEN 2 AND 10""")
def _(fx):
    return resolve.near_duplicate_blocks(fx["incidents_v"]).select("id", "cluster_id", "size")


@query("E02_blocks_of_any_size", f"""
WITH {CHAINS} SELECT id, concat_ws('|', country, classification, cast(chain_start AS string)) AS cluster_id, size FROM sized WHERE size >= 2""")
def _(fx):
    return resolve.near_duplicate_blocks(fx["incidents_v"], max_size=None).select("id", "cluster_id", "size")


@query("E02_oversized_chains", f"""
WITH {CHAINS} SELECT DISTINCT country, classification, cast(chain_start AS string) AS chain_start, cast(chain_end AS string) AS chain_end, size FROM sized WHERE size > 3""")
def _(fx):
    return resolve.oversized_chains(fx["incidents_v"], max_size=3)


CLUSTERS = """keyed AS (SELECT *, round(latitude, 3) AS la, round(longitude, 3) AS lo FROM incidents_v
 WHERE date_precision = 'exact' AND incident_date IS NOT NULL AND longitude IS NOT NULL),
ranked AS (SELECT *, count(*) OVER w AS size, first_value(id) OVER o AS canonical_id, first_value(case_number) OVER o AS canonical_case,
 first_value(victim_age) OVER o AS head_age, first_value(victim_sex) OVER o AS head_sex FROM keyed
 WINDOW w AS (PARTITION BY incident_date, classification, la, lo), o AS (PARTITION BY incident_date, classification, la, lo ORDER BY case_number, id)),
clusters AS (SELECT * FROM ranked WHERE size > 1),
merge_map AS (SELECT id AS absorbed_id, case_number AS absorbed_case, canonical_id, canonical_case FROM clusters
 WHERE id <> canonical_id AND NOT coalesce(head_age <> victim_age, false) AND NOT coalesce(head_sex <> victim_sex, false))"""


# Coarser dates make enough duplicates for the merge queries: same year and month, class and spot.
def _monthly(fx):
    return fx["incidents_v"].withColumn("incident_date", F.trunc("incident_date", "month")).withColumn(
        "victim_age", F.when(F.col("id") % 3 == 0, F.col("victim_age"))).withColumn(
        "victim_sex", F.when(F.col("id") % 2 == 0, F.col("victim_sex")))


MONTHLY = """monthly AS (SELECT * REPLACE (cast(date_trunc('month', incident_date) AS date) AS incident_date, CASE WHEN id % 3 = 0 THEN victim_age END AS victim_age,
 CASE WHEN id % 2 = 0 THEN victim_sex END AS victim_sex) FROM incidents_v)"""
MONTHLY_MAP = MONTHLY + ", " + CLUSTERS.replace("FROM incidents_v", "FROM monthly")


def _map(fx):
    return resolve.guarded_merge_map(resolve.exact_clusters(_monthly(fx)))


@query("I01_exact_clusters", f"WITH {CLUSTERS} SELECT id, canonical_id, size FROM clusters")
def _(fx):
    return resolve.exact_clusters(fx["incidents_v"]).select("id", "canonical_id", "size")


@query("I02_guarded_merge_map", f"""
WITH {MONTHLY_MAP} SELECT absorbed_id, absorbed_case, canonical_id, canonical_case FROM merge_map""")
def _(fx):
    return _map(fx)


# One answer per block: the members with even ids in one group, a stranger, and all members in another.
@query("I03_adjudicated_groups", f"""
WITH {CHAINS}, b AS (SELECT *, concat_ws('|', country, classification, cast(chain_start AS string)) AS cluster_id FROM sized WHERE size BETWEEN 2 AND 10),
one AS (SELECT cluster_id, id, case_number, count(*) OVER (PARTITION BY cluster_id) AS n, min(case_number) OVER (PARTITION BY cluster_id) AS canonical_case,
  min(id) FILTER (true) OVER (PARTITION BY cluster_id) AS x FROM b WHERE id % 2 = 0),
pairs AS (SELECT cluster_id, id AS absorbed_id, case_number AS absorbed_case, canonical_case FROM one WHERE n >= 2 AND case_number <> canonical_case),
gone AS (SELECT absorbed_id FROM pairs),
two AS (SELECT cluster_id, id, case_number, count(*) OVER (PARTITION BY cluster_id) AS n, min(case_number) OVER (PARTITION BY cluster_id) AS canonical_case
  FROM b WHERE id NOT IN (SELECT absorbed_id FROM gone) AND chain_start >= date '1998-01-01'),
pairs2 AS (SELECT cluster_id, id AS absorbed_id, case_number AS absorbed_case, canonical_case FROM two WHERE n >= 2 AND case_number <> canonical_case)
SELECT absorbed_id, absorbed_case, canonical_case FROM pairs UNION ALL SELECT absorbed_id, absorbed_case, canonical_case FROM pairs2""")
def _(fx):
    blocks = resolve.near_duplicate_blocks(fx["incidents_v"])
    # blocks hold at most ten members, so their answers may be assembled per block
    cases = lambda c: F.array_sort(F.collect_list(c))
    answers = blocks.groupBy("cluster_id", "chain_start").agg(
        cases(F.when(F.col("id") % 2 == 0, F.col("case_number"))).alias("even"),
        cases(F.col("case_number")).alias("everyone")).select(
        "cluster_id", F.to_json(F.struct(F.array(
            F.concat("even", F.array(F.lit("CASE-STRANGER")), "even"),
            F.when(F.col("chain_start") >= F.lit("1998-01-01").cast("date"), F.col("everyone")))
            .alias("groups"))).alias("body"))
    answers = answers.select("cluster_id", F.concat(F.lit("Sure:\n```json\n"), "body", F.lit("\n```"))
                             .alias("response_text"))
    return resolve.adjudicated_merge_map(blocks, answers).select(
        "absorbed_id", "absorbed_case", "canonical_case")


@query("I04_adjudication_payload", f"""
WITH {CHAINS}, b AS (SELECT *, concat_ws('|', country, classification, cast(chain_start AS string)) AS cluster_id FROM sized WHERE size BETWEEN 2 AND 10),
t AS (SELECT incident_id, least(count(*), 5) AS n FROM sources_v GROUP BY 1),
f AS (SELECT incident_id, source_title FROM sources_v QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY id) = 1)
SELECT cluster_id, count(*) AS records, cast(sum(coalesce(t.n, 0)) AS bigint) AS titles, arg_min(case_number, concat(cast(incident_date AS string), case_number)) AS first_case,
 arg_min(coalesce(f.source_title, '-'), concat(cast(incident_date AS string), case_number)) AS first_title
FROM b LEFT JOIN t ON t.incident_id = b.id LEFT JOIN f ON f.incident_id = b.id GROUP BY 1""")
def _(fx):
    full = conform(fx["incidents_v"], INCIDENTS)
    payloads = resolve.adjudication_payload(
        resolve.near_duplicate_blocks(full), fx["sources_v"])
    kind = "array<struct<case_number:string,source_titles:array<string>>>"
    rows = payloads.withColumn("r", F.from_json("payload", kind))
    return rows.select(
        "cluster_id", F.size("r").cast("bigint").alias("records"),
        F.aggregate("r", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["source_titles"]))
        .alias("titles"), F.col("r")[0]["case_number"].alias("first_case"),
        F.coalesce(F.get(F.col("r")[0]["source_titles"], 0), F.lit("-")).alias("first_title"))


FIRST_IN_CASE_ORDER = """(SELECT a.{f} FROM monthly a JOIN merge_map m ON m.absorbed_id = a.id WHERE m.canonical_id = c.id AND a.{f} IS NOT NULL ORDER BY a.case_number LIMIT 1)"""
CHECKED_FIELDS = ["shark_species_confirmed", "shark_species_suspected", "victim_activity",
                  "victim_injury_severity", "victim_age", "victim_sex", "description"]
_absorbed = ", ".join(f"arg_min(a.{f}, a.case_number) FILTER (a.{f} IS NOT NULL) AS {f}" for f in CHECKED_FIELDS)
ENRICHED = f"""offers AS (SELECT m.canonical_id, {_absorbed}, bool_or(a.fatal) AS fatal FROM merge_map m JOIN monthly a ON a.id = m.absorbed_id GROUP BY 1),
enriched AS (SELECT c.id AS canonical_id, {", ".join(f"coalesce(c.{f}, o.{f}) AS {f}" for f in CHECKED_FIELDS)}, c.fatal OR o.fatal AS fatal,
 concat_ws(',', {", ".join(f"CASE WHEN c.{f} IS NULL AND o.{f} IS NOT NULL THEN '{f}' END" for f in CHECKED_FIELDS[:4])},
  CASE WHEN c.victim_age IS NULL AND o.victim_age IS NOT NULL THEN 'victim_age' END, CASE WHEN c.victim_sex IS NULL AND o.victim_sex IS NOT NULL THEN 'victim_sex' END,
  CASE WHEN c.description IS NULL AND o.description IS NOT NULL THEN 'description' END, CASE WHEN o.fatal AND NOT c.fatal THEN 'fatal' END) AS filled
 FROM offers o JOIN monthly c ON c.id = o.canonical_id)"""


@query("I05_enrichment", f"""
WITH {MONTHLY_MAP}, {ENRICHED} SELECT canonical_id, {", ".join(CHECKED_FIELDS)}, fatal, filled FROM enriched""")
def _(fx):
    full = conform(_monthly(fx), INCIDENTS)
    rows = resolve.enrich(full, _map(fx))
    return rows.select("canonical_id", *CHECKED_FIELDS, "fatal", F.concat_ws(",", "filled").alias("filled"))


def _merged(fx):
    """All five tables from one call."""
    return resolve.merge(
        conform(_monthly(fx), INCIDENTS), conform(fx["sources_v"], SOURCES), conform(fx.sql(MERGE_NEWS), NEWS),
        conform(fx["audit_v"].withColumn("incident_id", F.col("id")), AUDIT),
        conform(fx["incidents_v"].select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"),
                                         F.col("id").alias("canonical_incident_id")), CANDIDATES),
        _map(fx), GENERATED_NEWS_PREFIX)


@query("I06_merged_incidents", f"""
WITH {MONTHLY_MAP}, {ENRICHED} SELECT i.id, i.case_number, coalesce(e.victim_age, i.victim_age) AS victim_age, coalesce(e.description, i.description) AS description,
 coalesce(e.fatal, i.fatal) AS fatal FROM monthly i LEFT JOIN enriched e ON e.canonical_id = i.id WHERE i.id NOT IN (SELECT absorbed_id FROM merge_map)""")
def _(fx):
    return _merged(fx)["incidents"].select(
        "id", "case_number", "victim_age", "description", "fatal")


@query("I06_merged_sources", f"""
WITH {MONTHLY_MAP}, marked AS (SELECT s.*, m.canonical_id, m.absorbed_case FROM sources_v s LEFT JOIN merge_map m ON m.absorbed_id = s.incident_id),
held AS (SELECT DISTINCT incident_id, source_url FROM sources_v WHERE source_url <> '')
SELECT id, incident_id, source_url FROM marked WHERE canonical_id IS NULL
UNION ALL SELECT id, canonical_id AS incident_id, source_url FROM marked WHERE canonical_id IS NOT NULL AND source_url IS NULL
UNION ALL SELECT id, canonical_id AS incident_id, source_url FROM (SELECT k.* FROM marked k LEFT JOIN held h ON h.incident_id = k.canonical_id AND h.source_url = k.source_url
 WHERE k.canonical_id IS NOT NULL AND k.source_url <> '' AND h.source_url IS NULL) QUALIFY row_number() OVER (PARTITION BY canonical_id, source_url ORDER BY absorbed_case, id) = 1""")
def _(fx):
    return _merged(fx)["sources"].select(
        "id", "incident_id", "source_url")


MERGE_NEWS = """SELECT id, CASE WHEN id % 6 = 0 THEN concat('backfill:', cast(user_id AS string)) ELSE dedup_key END AS dedup_key, inc AS promoted_incident_id
 FROM (SELECT n.*, e.user_id, CASE WHEN n.id % 4 <> 1 THEN n.id END AS inc FROM news_v n JOIN events e ON e.event_id = n.id)"""


@query("I06_merged_news", f"""
WITH {MONTHLY_MAP}, n AS ({MERGE_NEWS}) SELECT n.id, n.dedup_key, coalesce(m.canonical_id, n.promoted_incident_id) AS promoted_incident_id
FROM n LEFT JOIN merge_map m ON m.absorbed_id = n.promoted_incident_id WHERE NOT (m.canonical_id IS NOT NULL AND starts_with(n.dedup_key, 'backfill:'))""")
def _(fx):
    return _merged(fx)["news"].select(
        "id", "dedup_key", "promoted_incident_id")


@query("I06_merged_audit", f"""
WITH {MONTHLY_MAP}, a AS (SELECT id, id AS incident_id, action FROM audit_v)
SELECT incident_id, action, CAST(NULL AS string) AS notes FROM a WHERE incident_id NOT IN (SELECT absorbed_id FROM merge_map)
UNION ALL SELECT canonical_id, 'merged', concat('Absorbed duplicate ', absorbed_case) FROM merge_map""")
def _(fx):
    return _merged(fx)["audit"].select("incident_id", "action", "notes")


@query("I06_unlinked_candidates", f"""
WITH {MONTHLY_MAP} SELECT concat('c', cast(id AS string)) AS id, CASE WHEN id IN (SELECT absorbed_id FROM merge_map) THEN NULL ELSE id END AS canonical_incident_id FROM incidents_v""")
def _(fx):
    return _merged(fx)["candidates"].select("id", "canonical_incident_id")


@query("I06_touched_incidents", f"""
WITH {MONTHLY_MAP} SELECT absorbed_id AS id FROM merge_map UNION SELECT canonical_id FROM merge_map""")
def _(fx):
    return _merged(fx)["touched"]


@query("I07_merge_summary", f"""
WITH {MONTHLY_MAP} SELECT count(DISTINCT canonical_id) AS clusters, count(*) AS incidents_merged FROM merge_map""")
def _(fx):
    return resolve.merge_summary(_map(fx))
