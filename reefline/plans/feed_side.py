"""Registered queries for the news feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from reefline.operators import capture, feed
from reefline.plans.registry import query
from reefline.schemas import NEWS, conform

COLLAPSED = """SELECT * FROM news_v WHERE {where} QUALIFY row_number() OVER (
 PARTITION BY coalesce(cast(promoted_incident_id AS string), concat('n', cast(id AS string)))
 ORDER BY coalesce(published_at, captured_at) DESC, captured_at DESC, id DESC) = 1"""


@query("E01_feed_collapse", f"""
SELECT id, dedup_key, event_type, country, promoted_incident_id IS NULL AS general FROM (
{COLLAPSED.format(where="event_type IN ('attack','sighting')")})""")
def _(fx):
    news = feed.collapse(feed.filter_news(fx["news_v"], event_type="attack, sighting"))
    return news.select("id", "dedup_key", "event_type", "country",
                       F.col("promoted_incident_id").isNull().alias("general"))


@query("F06_feed_page", f"""
SELECT id, title, cast(published_at AS string) AS published_at, cast(captured_at AS string) AS captured_at FROM (
{COLLAPSED.format(where="captured_at >= timestamp '2024-01-03 00:00:00' AND captured_at <= timestamp '2024-01-20 00:00:00' AND source_platform IN ('reddit','youtube')")}) q
ORDER BY coalesce(q.published_at, q.captured_at) DESC, q.captured_at DESC, id DESC LIMIT 50 OFFSET 50""")
def _(fx):
    return feed.feed_page(
        fx["news_v"], page=2, source_platform="reddit,youtube", date_from="2024-01-03",
        date_to="2024-01-20").select("id", "title", "published_at", "captured_at")


# the stored feed of A10: one row for every third reader
STORED = """SELECT concat('reddit:https://r.example/', cast(user_id AS string)) AS dedup_key,
 min(event_id) AS id, concat('old ', cast(user_id AS string)) AS title, 'news' AS event_type, 'Old' AS country,
 0.5e0 AS ai_confidence, cast(7 AS bigint) AS promoted_incident_id, cast(9 AS bigint) AS source_document_id
FROM events WHERE user_id % 3 = 0 GROUP BY user_id"""


@query("A10_news_upsert", f"""
WITH stored AS ({STORED}),
batch AS (SELECT b.*, i.id AS inc, s.id AS doc FROM news_batch_v b
  LEFT JOIN incidents_v i ON i.id = b.seq % 400 AND b.seq % 2 = 0
  LEFT JOIN (SELECT dedup_key, min(seq) AS id FROM news_batch_v GROUP BY 1) s ON s.dedup_key = b.dedup_key),
firsts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY seq) = 1),
lasts AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY seq DESC) = 1)
SELECT coalesce(s.dedup_key, f.dedup_key) AS dedup_key, coalesce(s.title, f.title) AS title,
 coalesce(l.event_type, s.event_type) AS event_type,
 CASE WHEN l.dedup_key IS NULL THEN s.country ELSE l.country END AS country,
 CASE WHEN l.dedup_key IS NULL THEN s.ai_confidence ELSE l.ai_confidence END AS ai_confidence,
 CASE WHEN l.dedup_key IS NULL THEN s.promoted_incident_id ELSE l.inc END AS promoted_incident_id,
 CASE WHEN s.dedup_key IS NULL THEN f.doc ELSE s.source_document_id END AS source_document_id
FROM stored s FULL OUTER JOIN firsts f ON s.dedup_key = f.dedup_key LEFT JOIN lasts l ON l.dedup_key = f.dedup_key""")
def _(fx):
    batch = fx["news_batch_v"].join(
        fx["incidents_v"].select(F.col("id").alias("_i"), F.col("case_number")
                                 .alias("promoted_case_number")),
        F.when(F.col("seq") % 2 == 0, F.col("seq") % 400) == F.col("_i"), "left").drop("_i")
    documents = batch.groupBy("dedup_key").agg(F.min("seq").alias("id"))
    resolved = feed.resolve_news_keys(batch, fx["incidents_v"], documents).drop(
        "promoted_case_number")
    stored = conform(fx.sql(STORED), NEWS)
    return feed.upsert_news(stored, resolved).select(
        "dedup_key", "title", "event_type", "country", "ai_confidence", "promoted_incident_id",
        "source_document_id")


@query("C08_fill_source_ids", """
SELECT n.id, CASE WHEN n.id % 2 = 0 THEN n.id + 1000000 ELSE NULL END AS source_document_id FROM news_v n""")
def _(fx):
    news = conform(fx["news_v"], NEWS)
    documents = fx["news_v"].filter("id % 2 = 0").select(
        "dedup_key", (F.col("id") + 1000000).alias("id"))
    return capture.fill_source_ids(news, documents).select("id", "source_document_id")
