"""Registered queries for browse, statistics, feed and map."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reefline.operators import browse, search, stats
from reefline.plans.fixtures import Fixtures
from reefline.plans.registry import query
from reefline.schemas import INCIDENTS, SOURCES, conform

ATTACK = "classification IN ('unprovoked','provoked','boat_bite','scavenge','aquaria')"


@query("A01_incident_scan", """
SELECT verification_status, count(*) AS n, count(incident_date) AS dated, count(longitude) AS placed,
  cast(sum(victim_age) AS bigint) AS ages FROM incidents_v GROUP BY 1""")
def _(fx: Fixtures) -> DataFrame:
    rows = conform(fx["incidents_v"], INCIDENTS)
    return rows.groupBy("verification_status").agg(
        F.count(F.lit(1)).alias("n"), F.count("incident_date").alias("dated"),
        F.count("longitude").alias("placed"), F.sum("victim_age").alias("ages"))


BROWSE_COLUMNS = ["id", "case_number", "incident_date", "country", "classification"]


@query("B01_incident_filter_set", """
SELECT id, case_number, cast(incident_date AS string) AS incident_date, country, classification FROM incidents_full_v
WHERE verification_status = 'verified' AND classification IN ('unprovoked','provoked','aquaria','no_assignment')
 AND country IN ('NATION_1','NATION_2','NATION_3','NATION_4','NATION_5','NATION_6','NATION_7')
 AND fatal = true AND incident_date >= date '1994-01-01' AND incident_date <= date '1999-12-31'
 AND report_source IN ('isaf','news_media','social_media') AND victim_injury_severity IN ('fatal','severe','minor')""")
def _(fx):
    return browse.filter_incidents(
        fx["incidents_full_v"], classification="unprovoked, provoked,aquaria , no_assignment",
        country=",".join(f"NATION_{i}" for i in range(1, 8)), fatal=True,
        date_from="1994-01-01", date_to="1999-12-31", severity="fatal, severe ,minor",
        report_source="isaf,news_media,social_media").select(BROWSE_COLUMNS)


@query("B02_multi_value_filter", """
SELECT id, case_number, cast(incident_date AS string) AS incident_date, country, classification FROM incidents_v
WHERE verification_status = 'verified' AND victim_activity IN ('machinery', 'building')""")
def _(fx):
    return browse.filter_incidents(
        fx["incidents_v"].withColumn("report_source", F.lit(None).cast("string")),
        activity=" machinery , building").select(BROWSE_COLUMNS)


@query("B03_species_either", """
SELECT id, case_number, cast(incident_date AS string) AS incident_date, country, classification FROM incidents_v
WHERE verification_status = 'verified'
 AND (shark_species_confirmed = 'Galeocerdo cuvier' OR shark_species_suspected = 'Galeocerdo cuvier')""")
def _(fx):
    return browse.filter_incidents(fx["incidents_v"], species="Galeocerdo cuvier").select(BROWSE_COLUMNS)


@query("B04_date_ranges", """
SELECT 'incident' AS kind, id FROM incidents_v WHERE incident_date >= date '1995-03-01' AND incident_date <= date '1996-03-31'
UNION ALL
SELECT 'news' AS kind, id FROM news_v WHERE captured_at >= timestamp '2024-01-05 00:00:00' AND captured_at <= timestamp '2024-01-09 00:00:00'""")
def _(fx):
    incidents = fx["incidents_v"].filter(browse.date_range("incident_date", "1995-03-01", "1996-03-31"))
    news = fx["news_v"].filter(browse.captured_range("captured_at", "2024-01-05", "2024-01-09"))
    return incidents.select(F.lit("incident").alias("kind"), "id").unionByName(
        news.select(F.lit("news").alias("kind"), "id"))


STOPS = """['', 'a','an','and','are','as','at','be','but','by','for','from','had','has','have','he','her','his','i','if',
'in','into','is','it','its','no','not','of','on','or','our','she','so','such','that','the','their','then','there','these',
'they','this','to','was','we','were','will','with','you']"""


# Every form that the stemmer's steps lead back to the two words of the query, written out.
SEARCH_FORMS = [
    "ention(s|e|es|ed|edly|ings?|ingly|ly|ers?|als?|ally|ality|alism|alize|ics?|ical|icate|icity|ates?|ated|ating|ations?|ators?|able|ible|ably|ances?|ences?|ancy|ency|ants?|ents?|ently|ments?|ements?|isms?|iti|ity|ous|ously|ousness|ives?|ively|iveness|ivity|izes?|ized|izing|izers?|ization|ful|fully|fulness|ness)?",
    "whin(s|ly|ned|nedly|ning|nings|ningly|ness|ful|fully|fulness)?"]
SEARCH_SQL = f"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: NOT list_contains({STOPS}, w)) AS t FROM documents)
SELECT doc_id AS id FROM words WHERE {" AND ".join(f"len(list_filter(t, lambda w: regexp_full_match(w, '{f}'))) > 0" for f in SEARCH_FORMS)}
UNION ALL
SELECT doc_id AS id FROM documents WHERE contains(concat('DOC-', cast(doc_id AS string)), 'the entions whin')"""


@query("B05_index_search", SEARCH_SQL)
def _(fx):
    index = search.token_index(fx["documents"].select(F.col("doc_id").alias("id"), "text"), F.col("text"))
    return search.search_index(index, "the entions whin")


@query("B05_text_search", SEARCH_SQL)
def _(fx):
    docs = fx["documents"].select(
        F.col("doc_id").alias("id"), F.col("text").alias("description"),
        F.lit(None).cast("string").alias("location_description"),
        F.lit(None).cast("string").alias("country"), F.lit(None).cast("string").alias("victim_name"),
        F.concat(F.lit("DOC-"), F.col("doc_id").cast("string")).alias("case_number"))
    return docs.filter(browse.incident_search("the entions whin")).select("id")


@query("B06_literal_contains", """
SELECT id, title FROM news_v WHERE contains(lower(title), '100% s') OR contains(lower(summary), '100% s')""")
def _(fx):
    from reefline.operators import feed
    return fx["news_v"].filter(feed.news_search("100% S")).select("id", "title")


# every nested source, in order, as text
NESTED = "coalesce(source_url, '~'), coalesce(source_title, '~'), coalesce(source_publisher, '~')"


def _nested_text():
    return F.array_join(F.transform("sources", lambda s: F.concat_ws("|", *[
        F.coalesce(s[n], F.lit("~")) for n in ("source_url", "source_title", "source_publisher")])), ";")


@query("B07_public_view", f"""
WITH s AS (SELECT incident_id, count(*) AS n_sources, string_agg(concat_ws('|', {NESTED}), ';' ORDER BY id) AS sources FROM sources_v GROUP BY 1)
SELECT i.id, i.case_number, i.location_precision,
 CASE WHEN location_precision = 'exact' THEN round_even(longitude, 3) ELSE round_even(longitude, 2) END AS longitude,
 CASE WHEN location_precision = 'exact' THEN round_even(latitude, 3) ELSE round_even(latitude, 2) END AS latitude,
 i.victim_sex, i.fatal, coalesce(s.n_sources, 0) AS n_sources, coalesce(s.sources, '') AS sources
FROM incidents_v i LEFT JOIN s ON s.incident_id = i.id WHERE i.verification_status = 'verified'""")
def _(fx):
    shown = browse.public_view(conform(fx["incidents_v"], INCIDENTS), conform(fx["sources_v"], SOURCES))
    return shown.select("id", "case_number", "location_precision", "longitude", "latitude", "victim_sex", "fatal",
                        F.size("sources").alias("n_sources"), _nested_text().alias("sources"))


@query("B08_point_lookup", """
SELECT id, case_number, verification_status, false AS public FROM incidents_v WHERE id = 36
UNION ALL SELECT id, case_number, verification_status, true AS public FROM incidents_v WHERE id = 36 AND verification_status = 'verified'
UNION ALL SELECT id, case_number, verification_status, true AS public FROM incidents_v WHERE id = 35 AND verification_status = 'verified'""")
def _(fx):
    columns = ["id", "case_number", "verification_status"]
    parts = [browse.by_id(fx["incidents_v"], i, public=p).select(*columns, F.lit(p).alias("public"))
             for i, p in ((36, False), (36, True), (35, True))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("C01_attach_sources", f"""
WITH s AS (SELECT incident_id, count(*) AS n, string_agg(concat_ws('|', {NESTED}), ';' ORDER BY id) AS sources FROM sources_v GROUP BY 1)
SELECT i.id, coalesce(s.n, 0) AS n, coalesce(s.sources, '') AS sources FROM incidents_v i LEFT JOIN s ON s.incident_id = i.id""")
def _(fx):
    nested = browse.attach_sources(fx["incidents_v"].select("id"), conform(fx["sources_v"], SOURCES))
    return nested.select("id", F.size("sources").alias("n"), _nested_text().alias("sources"))


@query("C01_source_list", """
SELECT id, incident_id, row_number() OVER (PARTITION BY incident_id ORDER BY id) AS position FROM sources_v""")
def _(fx):
    return browse.source_list(fx["sources_v"]).select("id", "incident_id", F.col("position").cast("long").alias("position"))


# --- statistics ----------------------------------------------------------------------
@query("D01_overview", f"""
SELECT count(*) AS total_incidents, count(*) FILTER (fatal) AS total_fatal,
 round(count(*) FILTER (fatal) / count(*) * 100, 1) AS fatality_rate,
 (SELECT country FROM incidents_v WHERE {ATTACK} GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 1) AS most_active_country,
 (SELECT coalesce(shark_species_confirmed, shark_species_suspected) AS s FROM incidents_v WHERE {ATTACK}
   AND coalesce(shark_species_confirmed, shark_species_suspected) IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 1) AS most_common_species,
 concat(cast(min(year(incident_date)) AS string), '-', cast(max(year(incident_date)) AS string)) AS year_range
FROM incidents_v WHERE {ATTACK}""")
def _(fx):
    return stats.overview(fx["incidents_v"])


@query("D02_by_year", f"""
SELECT cast(year(incident_date) AS int) AS year, count(*) AS count, count(*) FILTER (fatal) AS fatal
FROM incidents_v WHERE {ATTACK} AND incident_date IS NOT NULL GROUP BY 1""")
def _(fx):
    return stats.by_year(fx["incidents_v"])


@query("D03_by_country", f"""
SELECT country, count(*) AS count, count(*) FILTER (fatal) AS fatal
FROM incidents_v WHERE {ATTACK} GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 20""")
def _(fx):
    return stats.by_country(fx["incidents_v"])


SPECIES_SQL = f"""SELECT coalesce(shark_species_confirmed, shark_species_suspected) AS species, count(*) AS count
FROM incidents_v WHERE {ATTACK} AND coalesce(shark_species_confirmed, shark_species_suspected) IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"""


@query("D04_by_species", SPECIES_SQL)
def _(fx):
    return stats.by_species(fx["incidents_v"])


@query("D05_by_activity", f"""
SELECT victim_activity AS activity, count(*) AS count FROM incidents_v
WHERE {ATTACK} AND victim_activity IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(fx):
    return stats.by_activity(fx["incidents_v"])


@query("D03_all_countries", f"""
SELECT country, count(*) AS count, count(*) FILTER (fatal) AS fatal FROM incidents_v WHERE {ATTACK} GROUP BY 1""")
def _(fx):
    return stats.by_country(fx["incidents_v"], None)


@query("D04_all_species", SPECIES_SQL.replace("LIMIT 15", ""))
def _(fx):
    return stats.by_species(fx["incidents_v"], None)


@query("D05_all_activities", f"""
SELECT victim_activity AS activity, count(*) AS count FROM incidents_v WHERE {ATTACK} AND victim_activity IS NOT NULL GROUP BY 1""")
def _(fx):
    return stats.by_activity(fx["incidents_v"], None)


@query("D06_fatality_trend", f"""
SELECT cast(year(incident_date) AS int) AS year, count(*) FILTER (fatal) AS fatal, count(*) FILTER (NOT fatal) AS non_fatal
FROM incidents_v WHERE {ATTACK} AND incident_date IS NOT NULL GROUP BY 1""")
def _(fx):
    return stats.fatality_trend(fx["incidents_v"])


@query("D07_country_chart", f"""
SELECT country, count(*) FILTER (fatal) AS fatal, count(*) - count(*) FILTER (fatal) AS non_fatal
FROM incidents_v WHERE {ATTACK} GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 10""")
def _(fx):
    return stats.country_chart(fx["incidents_v"])


@query("D07_year_chart", f"""
SELECT cast(year(incident_date) AS int) AS year, count(*) FILTER (fatal) AS fatal, count(*) - count(*) FILTER (fatal) AS non_fatal
FROM incidents_v WHERE {ATTACK} AND incident_date IS NOT NULL GROUP BY 1""")
def _(fx):
    return stats.year_chart(fx["incidents_v"])


@query("D07_species_chart", f"""
SELECT CASE species WHEN 'Carcharodon carcharias' THEN 'Great White' WHEN 'Galeocerdo cuvier' THEN 'Tiger Shark'
 WHEN 'Carcharhinus leucas' THEN 'Bull Shark' ELSE species END AS species, count FROM ({SPECIES_SQL})""")
def _(fx):
    return stats.species_chart(fx["incidents_v"])


@query("D08_ingestion_health", """
SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'leased') AS leased,
 count(*) FILTER (status = 'retrying') AS retrying, count(*) FILTER (status = 'dead_letter') AS dead_letter,
 count(*) FILTER (status = 'completed') AS completed,
 cast((SELECT max(captured_at) FROM news_v) AS string) AS last_source_captured_at, cast(max(completed_at) AS string) AS last_job_completed_at
FROM jobs_v""")
def _(fx):
    return stats.ingestion_health(fx["jobs_v"], fx["news_v"].select("captured_at"))


# --- order and pages -------------------------------------------------------------------
@query("F01_database_null_order", """
SELECT id, victim_injury_severity, row_number() OVER (ORDER BY victim_injury_severity DESC NULLS FIRST, id) AS place
FROM incidents_v WHERE verification_status = 'verified' QUALIFY place <= 500
UNION ALL
SELECT id, victim_injury_severity, -row_number() OVER (ORDER BY victim_injury_severity ASC NULLS LAST, id) AS place
FROM incidents_v WHERE verification_status = 'verified' QUALIFY place >= -500""")
def _(fx):
    shown = browse.filter_incidents(fx["incidents_v"]).select("id", "victim_injury_severity")

    def first(order: str, sign: int) -> DataFrame:
        top = shown.orderBy(*browse.incident_order("victim_injury_severity", order)).limit(500)
        # number the page only; its size is fixed
        from pyspark.sql import Window as W
        place = F.row_number().over(W.orderBy(*browse.incident_order("victim_injury_severity", order)))
        return top.withColumn("place", (place * sign).cast("bigint"))
    return first("desc", 1).unionByName(first("asc", -1))


@query("F02_offset_page", """
SELECT id, case_number, cast(incident_date AS string) AS incident_date FROM incidents_v WHERE verification_status = 'verified'
ORDER BY incidents_v.incident_date DESC NULLS FIRST, id LIMIT 50 OFFSET 100""")
def _(fx):
    shown = browse.filter_incidents(fx["incidents_v"]).select("id", "case_number", "incident_date")
    return browse.page_of(shown, browse.incident_order("nonsense", "desc"), page=3, per_page=50)


@query("F02_keyset_page", """
SELECT id, case_number, cast(incident_date AS string) AS incident_date FROM incidents_v WHERE verification_status = 'verified'
 AND (incident_date < date '1996-05-05' OR (incident_date = date '1996-05-05' AND id > 100))
ORDER BY incidents_v.incident_date DESC, id LIMIT 50""")
def _(fx):
    from datetime import date
    shown = browse.filter_incidents(fx["incidents_v"]).select("id", "case_number", "incident_date")
    return browse.page_after(shown, "incident_date", "desc", date(1996, 5, 5), 100)


@query("F02_page_meta", """
SELECT count(*) AS total, 1 AS page, 50 AS per_page, cast(ceil(count(*) / 50) AS bigint) AS pages
FROM incidents_v WHERE verification_status = 'verified'""")
def _(fx):
    return browse.page_meta(browse.filter_incidents(fx["incidents_v"]))


@query("F03_review_queue", """
SELECT id, case_number, cast(submitted_at AS string) AS submitted_at FROM incidents_v WHERE verification_status IN ('pending', 'needs_review')
ORDER BY incidents_v.submitted_at DESC, id LIMIT 25 OFFSET 25""")
def _(fx):
    return browse.review_queue(fx["incidents_v"].select(
        "id", "case_number", "submitted_at", "verification_status"), page=2).drop("verification_status")


@query("F04_audit_page", """
SELECT * FROM (SELECT id, incident_id, action, cast(changed_at AS string) AS changed_at, 'all' AS scope FROM audit_v ORDER BY audit_v.changed_at DESC, id LIMIT 50)
UNION ALL
SELECT * FROM (SELECT id, incident_id, action, cast(changed_at AS string) AS changed_at, 'one' AS scope FROM audit_v WHERE incident_id = 5 ORDER BY audit_v.changed_at DESC, id LIMIT 50)""")
def _(fx):
    return browse.audit_page(fx["audit_v"]).withColumn("scope", F.lit("all")).unionByName(
        browse.audit_page(fx["audit_v"], incident_id=5).withColumn("scope", F.lit("one")))
