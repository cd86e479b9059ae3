"""Views that shape the given tables like the incident tables.

The SQL runs unchanged in Spark SQL and in the checking database, so one text serves
both sides.  A view may use the views listed before it.
"""

from __future__ import annotations

import re



from pyspark.sql import DataFrame, SparkSession

from reefline.session import tune

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {
    "incidents_v": """
SELECT o.o_orderkey AS id,
  concat('CASE-', cast(year(o.o_orderdate) AS string), '-', lpad(cast(o.o_orderkey AS string), 7, '0')) AS case_number,
  CASE WHEN o.o_orderkey % 50 = 0 THEN NULL ELSE cast(o.o_orderdate AS date) END AS incident_date,
  CASE o.o_orderkey % 10 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'exact' END AS date_precision,
  n.n_name AS country,
  CASE WHEN o.o_orderkey % 13 = 0 THEN n.n_name ELSE concat('Place ', cast(o.o_custkey % 200 AS string)) END AS location_description,
  CASE o.o_orderkey % 12 WHEN 0 THEN 'unprovoked' WHEN 1 THEN 'provoked' WHEN 2 THEN 'boat_bite' WHEN 3 THEN 'scavenge' WHEN 4 THEN 'aquaria' WHEN 5 THEN 'doubtful' WHEN 6 THEN 'no_assignment' WHEN 7 THEN 'not_confirmed' WHEN 8 THEN 'sighting' WHEN 9 THEN 'near_miss' WHEN 10 THEN 'equipment_bite' WHEN 11 THEN 'unverified_report' END AS classification,
  CASE WHEN o.o_orderkey % 40 = 0 THEN 'Galeocerdo cuvier' END AS shark_species_confirmed,
  CASE o.o_orderkey % 7 WHEN 0 THEN 'Carcharodon carcharias' WHEN 1 THEN 'Galeocerdo cuvier'
    WHEN 2 THEN 'Carcharhinus leucas' END AS shark_species_suspected,
  CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE lower(c.c_mktsegment) END AS victim_activity,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'fatal' WHEN '2-HIGH' THEN 'severe' WHEN '3-MEDIUM' THEN 'moderate'
    WHEN '5-LOW' THEN 'minor' END AS victim_injury_severity,
  CASE WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE cast(o.o_custkey % 60 AS int) END AS victim_age,
  CASE o.o_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS victim_sex,
  (o.o_orderstatus = 'F') AS fatal,
  CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE concat('Narrative ', cast(o.o_orderkey AS string)) END AS description,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' WHEN 2 THEN 'needs_review' ELSE 'verified' END AS verification_status,
  CASE WHEN o.o_orderkey % 8 = 0 THEN 'approximate' ELSE 'exact' END AS location_precision,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE cast(c.c_nationkey * 13 + o.o_orderkey % 4 AS double) - 160e0 + 0.0625e0 END AS longitude,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE cast(c.c_nationkey * 5 + o.o_orderkey % 3 AS double) - 60e0 + 0.03125e0 END AS latitude,
  o.o_orderdate AS submitted_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
""",
    "sources_v": """
SELECT l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS id, l_orderkey AS incident_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'news_article' WHEN 1 THEN 'video' ELSE 'social_media' END AS source_type,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('https://s', cast(l_suppkey % 20 AS string), '.example/', cast(l_partkey % 500 AS string)) END AS source_url,
  concat('Incident reported near harbour number ', cast(l_partkey % 500 AS string), ' - Outlet ', cast(l_suppkey % 20 AS string)) AS source_title,
  concat('Outlet ', cast(l_suppkey % 20 AS string)) AS source_publisher, cast(l_shipdate AS date) AS source_date
FROM lineitem
""",
    "news_v": """
SELECT event_id AS id, concat('news_rss:https://n.example/', cast(event_id AS string)) AS dedup_key,
  CASE event_id % 3 WHEN 0 THEN 'news_rss' WHEN 1 THEN 'youtube' ELSE 'reddit' END AS source_platform,
  concat(event_type, CASE WHEN event_id % 20 = 0 THEN ' 100% sure' ELSE ' report' END) AS title, props AS summary,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS published_at, ts AS captured_at,
  CASE event_type WHEN 'error' THEN 'attack' WHEN 'click' THEN 'sighting' ELSE 'news' END AS event_type,
  concat('NATION_', cast(user_id % 25 AS string)) AS country, value AS ai_confidence,
  CASE WHEN event_id % 3 = 0 THEN user_id END AS promoted_incident_id
FROM events
""",
    "news_batch_v": """
SELECT event_id AS seq, concat('reddit:https://r.example/', cast(user_id AS string)) AS dedup_key, concat('title ', cast(event_id AS string)) AS title,
  CASE event_type WHEN 'error' THEN 'attack' WHEN 'click' THEN 'sighting' ELSE 'news' END AS event_type,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('NATION_', cast(event_id % 25 AS string)) END AS country,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS ai_confidence
FROM events
""",
    "raw_items_v": """
SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'youtube' WHEN 1 THEN 'reddit' WHEN 2 THEN 'news_rss' ELSE 'web_scrape' END AS source_platform,
  source AS source_name, concat('https://', source, '.example/', lang, '/', cast(doc_id % 700 AS string)) AS source_url,
  substr(text, 1, 90) AS title, text AS content,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE cast('2024-01-01' AS date) + cast(doc_id % 365 AS int) END AS published_date,
  (doc_id % 4 = 0) AS trusted
FROM documents
""",
    "register_v": """
SELECT o_orderkey AS id, concat(cast(day(o_orderdate) AS string), CASE o_orderkey % 4 WHEN 0 THEN 'th' ELSE '' END, ' ',
    CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'Feb' WHEN 3 THEN 'March' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' WHEN 6 THEN 'June'
      WHEN 7 THEN 'July' WHEN 8 THEN 'Aug' WHEN 9 THEN 'September' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'December' END) AS date_text,
  cast(year(o_orderdate) AS string) AS year_text,
  CASE o_orderkey % 6 WHEN 0 THEN 'Unprovoked' WHEN 1 THEN 'Provoked' WHEN 2 THEN 'Watercraft' WHEN 3 THEN 'Sea Disaster' WHEN 4 THEN 'Invalid' ELSE '' END AS type_text,
  CASE o_orderkey % 4 WHEN 0 THEN 'USA' WHEN 1 THEN 'AUSTRALIA' WHEN 2 THEN 'REUNION ISLAND' ELSE 'atlantis' END AS country_text,
  CASE o_orderkey % 5 WHEN 0 THEN 'Surfing' WHEN 1 THEN 'spearfishing at reef' WHEN 2 THEN 'Scuba diving' WHEN 3 THEN '' ELSE 'sleeping' END AS activity_text,
  CASE o_orderkey % 5 WHEN 0 THEN 'FATAL' WHEN 1 THEN 'No injury' WHEN 2 THEN 'Minor laceration' WHEN 3 THEN 'Leg severed' ELSE 'Bite to foot' END AS injury_text,
  CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS fatal_text,
  CASE o_orderkey % 3 WHEN 0 THEN '1715hrs' WHEN 1 THEN '9:05' ELSE 'Afternoon' END AS time_text,
  CASE o_orderkey % 4 WHEN 0 THEN 'White shark, 3.5m' WHEN 1 THEN 'scalloped hammerhead' WHEN 2 THEN 'unknown' ELSE '6ft bull shark' END AS species_text,
  CASE o_orderkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE '' END AS sex_text, cast(o_custkey % 140 AS string) AS age_text
FROM orders
""",
    "species_v": """
SELECT * FROM (VALUES (1, 'Great White Shark', 'Carcharodon carcharias', 6.1), (2, 'Tiger Shark', 'Galeocerdo cuvier', 5.5),
  (3, 'Bull Shark', 'Carcharhinus leucas', 3.5)) AS t(id, common_name, scientific_name, max_size_meters)
""",
    "observations_v": """
SELECT id, id % 3000 AS source_document_id, 'collector' AS extractor_name, CASE id % 2 WHEN 0 THEN 'v1' ELSE 'v2' END AS prompt_version,
  incident_date, country, CASE WHEN id % 15 = 0 THEN '' ELSE concat('  Place ', cast(id % 5 AS string), '  X ') END AS location_description, classification,
  CASE WHEN classification = 'sighting' THEN 'sighting' WHEN classification = 'doubtful' THEN 'news' ELSE 'attack' END AS event_type,
  cast(id % 100 AS double) / 100e0 AS confidence, submitted_at AS created_at
FROM incidents_v
""",
    "responses_v": """
SELECT id AS response_id, id AS raw_item_id, CASE id % 4
    WHEN 0 THEN concat('{"is_relevant": true, "classification": "Unprovoked attack", "country": "USA", "confidence": 0.', cast(id % 10 AS string), '}')
    WHEN 1 THEN concat('```json', chr(10), '{"is_relevant": true, "classification": "provoked", "country": "', country, '"}', chr(10), '```')
    WHEN 2 THEN 'Here it is: {"is_relevant": false} as asked' ELSE 'no structured answer' END AS response_text
FROM incidents_v
""",
    "jobs_v": """
SELECT event_id AS source_document_id, CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'leased' WHEN 2 THEN 'retrying' WHEN 3 THEN 'completed' ELSE 'dead_letter' END AS status,
  cast(event_id % 9 AS int) AS attempts, 8 AS max_attempts, (event_id % 7 <> 0) AS retryable, ts AS available_at,
  CASE WHEN event_id % 5 = 1 THEN ts END AS leased_until, CASE WHEN event_id % 5 = 3 THEN ts END AS completed_at
FROM events
""",
    "gazetteer_v": """
SELECT c_nationkey AS place_key, cast(c_custkey % 3 AS int) AS query_rank, c_custkey AS candidate_id,
  cast(c_custkey % 23 AS double) - 5e0 + 0.3e0 AS latitude, cast(c_custkey % 19 AS double) - 4e0 + 0.7e0 AS longitude, cast(c_custkey % 10 AS double) / 10e0 AS importance
FROM customer
""",
    "land_edges_v": """
SELECT * FROM (VALUES (1, 0e0, 0e0, 10e0, 0e0), (1, 10e0, 0e0, 10e0, 10e0), (1, 10e0, 10e0, 0e0, 10e0), (1, 0e0, 10e0, 0e0, 0e0),
  (2, 20e0, -5e0, 26e0, -5e0), (2, 26e0, -5e0, 23e0, 3e0), (2, 23e0, 3e0, 20e0, -5e0)) AS t(poly_id, x1, y1, x2, y2)
""",
    "decisions_v": """
SELECT id AS incident_id, CASE id % 3 WHEN 0 THEN 'verify' WHEN 1 THEN 'reject' ELSE 'patch' END AS action,
  case_number, submitted_at AS decided_at
FROM incidents_v
""",
    "audit_v": """
SELECT event_id AS id, user_id AS incident_id, CASE event_type WHEN 'error' THEN 'merged' WHEN 'click' THEN 'verified' ELSE 'created' END AS action, ts AS changed_at
FROM events
""",
    # incidents_v with the columns the plain view leaves out
    "incidents_full_v": """
SELECT v.*,
  CASE id % 8 WHEN 0 THEN 'qld' WHEN 1 THEN 'Florida' WHEN 2 THEN 'Nowhere' WHEN 3 THEN ' New South Wales ' WHEN 4 THEN NULL WHEN 5 THEN '' WHEN 6 THEN 'texas' ELSE country END AS state_province,
  CASE id % 4 WHEN 0 THEN 'isaf' WHEN 1 THEN 'news_media' WHEN 2 THEN 'social_media' END AS report_source,
  CASE id % 5 WHEN 0 THEN 'youtube' WHEN 1 THEN 'reddit' END AS report_platform,
  CASE id % 6 WHEN 0 THEN 'Bay' WHEN 1 THEN 'Swan River' END AS body_of_water,
  CASE WHEN id % 7 = 0 THEN NULL ELSE concat('Person ', cast(id % 90 AS string)) END AS victim_name,
  CASE WHEN id % 3 = 1 THEN '10:30:00' END AS incident_time
FROM incidents_v v
""",
    # the part of the register of incidents that arrives as submissions
    "submissions_v": """
SELECT id * 10 + 7 AS submission_id, incident_date, date_precision, location_description, country, classification,
  victim_age, victim_sex, fatal, description,
  CASE WHEN id % 5 < 2 THEN longitude + 0.0005e0 ELSE longitude + 0.03e0 END AS longitude, latitude,
  CASE id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'verified_contributor' ELSE 'public' END AS role, submitted_at
FROM incidents_v WHERE verification_status = 'needs_review'
""",
    "submission_sources_v": """
SELECT s.submission_id, l.l_linenumber AS position, 'news_article' AS source_type,
  CASE WHEN l.l_linenumber = 6 THEN NULL WHEN l.l_partkey % 4 = 0 THEN concat('https://s', cast(l.l_suppkey % 20 AS string), '.example/', cast(l.l_partkey AS string))
    ELSE concat('https://new.example/', cast(l.l_partkey AS string), '/', cast(s.submission_id AS string)) END AS source_url,
  concat(CASE WHEN l.l_partkey % 3 = 0 THEN 'Incident reported near harbour number ' ELSE 'Fresh report of an incident at pier ' END, cast(l.l_partkey AS string), ' - Paper ', cast(l.l_suppkey % 7 AS string)) AS source_title,
  concat('Paper ', cast(l.l_suppkey % 7 AS string)) AS source_publisher
FROM submissions_v s JOIN lineitem l ON l.l_orderkey * 10 + 7 = s.submission_id
""",
}


class Fixtures:
    """`Fixtures(spark, sf_dir)["incidents_v"]` is the view or table as a DataFrame.

    Only what a query asks for is registered.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in VIEWS:
                df = self.sql(VIEWS[name])
            else:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            self._known[name] = df
        return self._known[name]

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables and views it names."""
        for name in [*BASE_TABLES, *VIEWS]:
            if re.search(rf"\b{name}\b", text):
                self[name].createOrReplaceTempView(name)
        return self.spark.sql(text)


def with_views(body: str) -> str:
    """Prefix a query with the view definitions it needs, in order."""
    needed: set[str] = set()
    frontier = body
    for name in reversed(list(VIEWS)):
        if name in frontier:
            needed.add(name)
            frontier += VIEWS[name]
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*ctes, body[5:]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
