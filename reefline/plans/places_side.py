"""Registered queries for map, coast and gazetteer work."""

from __future__ import annotations

from pyspark.sql import functions as F

from reefline.operators import coast, mapview, places
from reefline.plans.registry import query
from reefline.schemas import INCIDENTS, conform

BOX = "-120.5,-40,20.0625,55.5"
IN_BOX = "longitude > -120.5 AND longitude < 20.0625 AND latitude > -40 AND latitude < 55.5"


@query("G01_bounding_box", f"SELECT id, longitude, latitude FROM incidents_v WHERE {IN_BOX}")
def _(fx):
    return fx["incidents_v"].filter(mapview.inside_box(BOX)).select("id", "longitude", "latitude")


@query("G02_map_features", f"""
SELECT id, 'Feature' AS kind, round_even(longitude, 3) AS x, round_even(latitude, 3) AS y, coalesce(shark_species_confirmed, shark_species_suspected) AS species,
 cast(incident_date AS string) AS incident_date, victim_activity AS activity FROM incidents_v
WHERE verification_status = 'verified' AND longitude IS NOT NULL AND {IN_BOX} AND classification IN ('scavenge','near_miss')""")
def _(fx):
    rows = mapview.features(conform(fx["incidents_v"], INCIDENTS), BOX, classification="scavenge, near_miss")
    at = lambda path: F.get_json_object("feature", path)
    return rows.select(
        "id", at("$.type").alias("kind"), at("$.geometry.coordinates[0]").cast("double").alias("x"),
        at("$.geometry.coordinates[1]").cast("double").alias("y"),
        at("$.properties.species").alias("species"),
        at("$.properties.incident_date").alias("incident_date"),
        at("$.properties.activity").alias("activity"))


@query("G03_grid_clusters", """
WITH p AS (SELECT round_even(longitude / 11.25, 0) AS gx, round_even(latitude / 11.25, 0) AS gy, * FROM incidents_v
 WHERE verification_status = 'verified' AND longitude IS NOT NULL AND fatal),
m AS (SELECT gx, gy, classification FROM p GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY gx, gy ORDER BY count(*) DESC, classification) = 1)
SELECT round(avg(longitude), 6) AS longitude, round(avg(latitude), 6) AS latitude, count(*) AS count, count(*) FILTER (fatal) AS fatal_count,
 any_value(m.classification) AS dominant_classification FROM p JOIN m ON m.gx = p.gx AND m.gy = p.gy GROUP BY p.gx, p.gy""")
def _(fx):
    rows = mapview.clusters(fx["incidents_v"], zoom=4, fatal=True)
    return rows.withColumns({"longitude": F.round("longitude", 6), "latitude": F.round("latitude", 6)})


# --- vague places -------------------------------------------------------------------------
# one text per incident: regions, generic coast wording and specific places
TEXTS = """SELECT id, country, state_province, CASE id % 9 WHEN 0 THEN country WHEN 1 THEN 'off the coast of QLD' WHEN 2 THEN 'Beach, Florida' WHEN 3 THEN ''
 WHEN 4 THEN 'near northern beach' WHEN 5 THEN 'South Australian waters' WHEN 6 THEN 'Point Plomber, north of Port' WHEN 7 THEN state_province ELSE location_description END AS place
 FROM incidents_full_v"""


@query("G05_vague_places", f"""
SELECT id, CASE id % 9 WHEN 0 THEN true WHEN 1 THEN trim(coalesce(state_province, '')) = 'qld' WHEN 2 THEN trim(coalesce(state_province, '')) = 'Florida'
 WHEN 3 THEN true WHEN 4 THEN true WHEN 5 THEN false WHEN 6 THEN false WHEN 7 THEN true
 ELSE coalesce(place = country OR place = state_province, false) END AS vague FROM ({TEXTS})""")
def _(fx):
    return fx.sql(TEXTS).select("id", coast.is_vague(
        F.col("place"), F.col("country"), F.col("state_province")).alias("vague"))


# --- coast: points of the incidents moved over the test land -----------------------------------
SPOTS = """SELECT id, location_description, country, cast(NULL AS string) AS state_province,
 cast(id % 97 AS double) * 0.31e0 - 2.013e0 AS longitude, cast(id % 89 AS double) * 0.19e0 - 6.017e0 AS latitude FROM incidents_v"""

ON_LAND = """crossed AS (SELECT p.longitude, p.latitude, e.poly_id, count(*) AS hits FROM (SELECT DISTINCT longitude, latitude FROM spots) p JOIN land_edges_v e
 ON (e.y1 > p.latitude) <> (e.y2 > p.latitude) AND p.longitude < e.x1 + (e.x2 - e.x1) * (p.latitude - e.y1) / (e.y2 - e.y1) GROUP BY 1, 2, 3),
land AS (SELECT DISTINCT longitude, latitude FROM crossed WHERE hits % 2 = 1)"""

NEAREST = """t AS (SELECT p.longitude, p.latitude, e.*, least(1, greatest(0, ((p.longitude - x1) * (x2 - x1) + (p.latitude - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t
 FROM land p CROSS JOIN land_edges_v e),
s AS (SELECT longitude, latitude, x1 + t * (x2 - x1) AS sx, y1 + t * (y2 - y1) AS sy FROM t),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY longitude, latitude ORDER BY pow(sx - longitude, 2) + pow(sy - latitude, 2), sy, sx) = 1),
near AS (SELECT *, 2 * 6371.0 * asin(least(1, sqrt(pow(sin(radians(sy - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(sy)) * pow(sin(radians(sx - longitude) / 2), 2)))) AS km FROM b)"""


@query("G06_on_land", f"WITH spots AS ({SPOTS}), {ON_LAND} SELECT longitude, latitude FROM land")
def _(fx):
    return coast.on_land(fx.sql(SPOTS), fx["land_edges_v"])


@query("G07_nearest_coast", f"""
WITH spots AS ({SPOTS}), {ON_LAND}, {NEAREST} SELECT q.id, round(coalesce(n.km, 0), 6) AS inland_km, round(n.sx, 9) AS coast_lon, round(n.sy, 9) AS coast_lat
FROM spots q LEFT JOIN near n ON n.longitude = q.longitude AND n.latitude = q.latitude""")
def _(fx):
    rows = coast.with_inland(fx.sql(SPOTS), fx["land_edges_v"])
    return rows.select("id", F.round("inland_km", 6).alias("inland_km"),
                       F.round("coast_lon", 9).alias("coast_lon"), F.round("coast_lat", 9).alias("coast_lat"))


@query("G08_coast_snap", f"""
WITH spots AS ({SPOTS}), {ON_LAND}, {NEAREST} SELECT q.id, CASE WHEN q.location_description = q.country AND n.km >= 25 THEN 'updated' ELSE 'skipped' END AS outcome,
 round(CASE WHEN q.location_description = q.country AND n.km >= 25 THEN n.sx ELSE q.longitude END, 9) AS new_longitude,
 round(CASE WHEN q.location_description = q.country AND n.km >= 25 THEN n.sy ELSE q.latitude END, 9) AS new_latitude
FROM spots q LEFT JOIN near n ON n.longitude = q.longitude AND n.latitude = q.latitude""")
def _(fx):
    rows = coast.coast_snap(fx.sql(SPOTS), fx["land_edges_v"])
    return rows.select("id", "outcome", F.round("new_longitude", 9).alias("new_longitude"),
                       F.round("new_latitude", 9).alias("new_latitude"))


@query("G08_coast_snap_report", f"""
WITH spots AS ({SPOTS}), {ON_LAND}, {NEAREST}, o AS (SELECT q.location_description = q.country AND coalesce(n.km, 0) >= 25 AS moved
 FROM spots q LEFT JOIN near n ON n.longitude = q.longitude AND n.latitude = q.latitude)
SELECT count(*) FILTER (moved) AS updated, count(*) FILTER (NOT moved) AS skipped, cast(0 AS bigint) AS failed FROM o""")
def _(fx):
    return coast.outcome_report(coast.coast_snap(fx.sql(SPOTS), fx["land_edges_v"]))


# --- gazetteer -------------------------------------------------------------------------------
G9 = """SELECT id, CASE id % 8 WHEN 0 THEN 'New South Wales' WHEN 4 THEN NULL ELSE 'Florida' END AS state_province, country,
 CASE id % 4 WHEN 0 THEN concat('off ', location_description) WHEN 1 THEN concat(location_description, ', Port') WHEN 2 THEN 'Cape One south of Bay Two' ELSE 'beach' END AS location_description
 FROM incidents_v WHERE location_description <> country"""


@query("G09_query_variants", f"""
WITH q AS (SELECT id, coalesce(state_province, '') AS st, country AS c, location_description AS l FROM ({G9})),
v AS (SELECT id, st, c, 0 AS r, CASE WHEN id % 4 = 3 THEN NULL ELSE l END AS f FROM q
 UNION ALL SELECT id, st, c, 1, CASE id % 4 WHEN 0 THEN substr(l, 5) WHEN 1 THEN split_part(l, ',', 1) WHEN 2 THEN 'Cape One' END FROM q
 UNION ALL SELECT id, st, c, 2, CASE id % 4 WHEN 2 THEN 'Bay Two' END FROM q)
SELECT id, r AS query_rank, concat(f, CASE WHEN st <> '' THEN concat(', ', st) ELSE '' END, ', ', c) AS query FROM v WHERE f IS NOT NULL
UNION ALL SELECT id, 0 AS query_rank, CASE WHEN st <> '' THEN concat(st, ', ', c) ELSE c END AS query FROM q WHERE id % 4 = 3""")
def _(fx):
    return places.ranked_queries(fx.sql(G9))


PLACES = """SELECT n_nationkey AS place_key, CASE n_nationkey % 5 WHEN 0 THEN 'Swan River bank' WHEN 1 THEN n_name ELSE 'Cove Nine' END AS location_description,
 n_name AS country, CASE n_nationkey % 4 WHEN 0 THEN 'Queensland' END AS state_province, cast(NULL AS string) AS body_of_water FROM nation"""
# candidates spread over the test land and, for one state, over the state's own box
CANDIDATES = """SELECT place_key, query_rank, candidate_id AS candidate_rank, importance,
 CASE WHEN place_key % 4 = 0 AND candidate_id % 2 = 0 THEN longitude + 139.9e0 ELSE longitude * 0.4e0 + 0.011e0 END AS longitude,
 CASE WHEN place_key % 4 = 0 AND candidate_id % 2 = 0 THEN latitude - 25.1e0 ELSE latitude * 0.9e0 + 0.017e0 END AS latitude FROM gazetteer_v"""


@query("G10_gazetteer_ranking", f"""
WITH p AS ({PLACES}), spots AS ({CANDIDATES}), {ON_LAND}, {NEAREST},
c AS (SELECT q.*, p.place_key % 5 = 0 AS water, coalesce(n.km, 0) AS km, n.sx, n.sy FROM spots q JOIN p ON p.place_key = q.place_key
 LEFT JOIN near n ON n.longitude = q.longitude AND n.latitude = q.latitude
 WHERE p.place_key % 5 <> 1 AND (p.state_province IS NULL OR (q.latitude BETWEEN -29 AND -10 AND q.longitude BETWEEN 138 AND 154))),
best AS (SELECT * FROM c WHERE water OR km <= 25 QUALIFY row_number() OVER (PARTITION BY place_key
  ORDER BY query_rank, CASE WHEN water THEN 0 ELSE km END, CASE WHEN water THEN 0 ELSE -importance END, candidate_rank) = 1)
SELECT p.place_key, round(CASE WHEN NOT b.water AND b.km >= 1 THEN b.sx ELSE b.longitude END, 9) AS longitude,
 round(CASE WHEN NOT b.water AND b.km >= 1 THEN b.sy ELSE b.latitude END, 9) AS latitude, NOT b.water AND b.km >= 1 AS moved
FROM p LEFT JOIN best b ON b.place_key = p.place_key""")
def _(fx):
    rows = places.rank_candidates(fx.sql(PLACES), fx.sql(CANDIDATES), fx["land_edges_v"])
    return rows.select("place_key", F.round("longitude", 9).alias("longitude"),
                       F.round("latitude", 9).alias("latitude"), "moved")


NEW_POINTS = """SELECT id, CASE WHEN id % 8 = 0 THEN NULL ELSE longitude + cast(id % 5 AS double) * 0.3e0 END AS new_longitude,
 CASE WHEN id % 8 = 0 THEN NULL ELSE latitude + cast(id % 3 AS double) * 0.004e0 END AS new_latitude FROM incidents_v"""
JUDGED = f"""j AS (SELECT b.id, CASE WHEN b.id % 14 = 3 THEN '' ELSE b.location_description END AS place, b.longitude, b.latitude, n.new_longitude, n.new_latitude,
 CASE WHEN n.new_longitude IS NOT NULL THEN 2 * 6371.0 * asin(least(1, sqrt(pow(sin(radians(n.new_latitude - b.latitude) / 2), 2) + cos(radians(b.latitude)) * cos(radians(n.new_latitude)) * pow(sin(radians(n.new_longitude - b.longitude) / 2), 2)))) END AS km
 FROM incidents_v b JOIN ({NEW_POINTS}) n ON n.id = b.id WHERE b.longitude IS NOT NULL),
o AS (SELECT *, CASE WHEN place = '' THEN 'skipped' WHEN new_longitude IS NULL THEN 'failed' WHEN km < 1 OR km > 100 THEN 'skipped' ELSE 'updated' END AS outcome FROM j)"""


def _regeocoded(fx):
    rows = fx["incidents_v"].withColumn("location_description", F.when(
        F.col("id") % 14 == 3, "").otherwise(F.col("location_description")))
    return places.regeocode(rows, fx.sql(NEW_POINTS))


@query("G11_regeocode", f"""
WITH {JUDGED} SELECT id, outcome, round(km, 6) AS moved_km, CASE WHEN outcome = 'updated' THEN new_longitude ELSE longitude END AS longitude FROM o""")
def _(fx):
    return _regeocoded(fx).select("id", "outcome", F.round("moved_km", 6).alias("moved_km"), "longitude")


@query("G11_regeocode_report", f"""
WITH {JUDGED} SELECT count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed FROM o""")
def _(fx):
    return coast.outcome_report(_regeocoded(fx))


@query("G12_place_reuse", """
SELECT id, cast(length(location_description) AS double) AS longitude FROM incidents_full_v
UNION ALL SELECT -count(DISTINCT concat(location_description, '|', coalesce(state_province, ''), '|', country)) AS id, cast(NULL AS double) AS longitude FROM incidents_full_v""")
def _(fx):
    rows = conform(fx["incidents_full_v"], INCIDENTS)
    keys = places.distinct_places(rows)
    answers = keys.select("place_key", F.length("location_description").cast("double").alias("longitude"),
                          F.lit(1.0).alias("latitude"))
    # the extra row tells how many lookups were needed, as a negative id
    lookups = keys.agg((-F.count(F.lit(1))).alias("id")).withColumn("longitude", F.lit(None).cast("double"))
    return places.reuse_points(rows, answers).select("id", "longitude").unionByName(lookups)


MANIFEST = """SELECT CASE WHEN o_orderkey % 5 = 0 THEN concat('GONE-', cast(o_orderkey AS string)) ELSE concat('CASE-', cast(year(o_orderdate) AS string), '-', lpad(cast(o_orderkey AS string), 7, '0')) END AS case_number,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 151.25e0 END AS longitude, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE -33.5e0 END AS latitude,
 CASE WHEN o_orderkey % 4 = 0 THEN 'Reviewed Beach' END AS location_description, CASE WHEN o_orderkey % 7 = 0 THEN 'Tasmania' END AS state_province
FROM orders WHERE o_custkey % 4 = 1"""


@query("C10_manifest_repair", f"""
SELECT i.id, CASE WHEN m.case_number IS NULL THEN i.longitude ELSE m.longitude END AS longitude,
 CASE WHEN m.case_number IS NULL THEN i.location_precision WHEN m.longitude IS NULL THEN 'unknown' ELSE 'approximate' END AS location_precision,
 coalesce(m.location_description, i.location_description) AS location_description, coalesce(m.state_province, i.state_province) AS state_province
FROM incidents_full_v i LEFT JOIN ({MANIFEST}) m ON m.case_number = i.case_number""")
def _(fx):
    rows = conform(fx["incidents_full_v"], INCIDENTS)
    return places.apply_manifest(rows, fx.sql(MANIFEST)).select(
        "id", "longitude", "location_precision", "location_description", "state_province")


@query("C10_manifest_report", f"""
SELECT count(*) AS planned, count(i.id) AS updated, count(*) - count(i.id) AS missing FROM ({MANIFEST}) m LEFT JOIN incidents_v i ON i.case_number = m.case_number""")
def _(fx):
    return places.manifest_report(fx["incidents_v"], fx.sql(MANIFEST))


@query("C10_manifest_missing", f"SELECT case_number FROM ({MANIFEST}) WHERE case_number LIKE 'GONE-%'")
def _(fx):
    return places.manifest_missing(fx["incidents_v"], fx.sql(MANIFEST))


@query("C11_region_bounds", """
SELECT id, CASE lower(trim(state_province)) WHEN 'qld' THEN latitude BETWEEN -29 AND -10 AND longitude BETWEEN 138 AND 154
 WHEN 'florida' THEN latitude BETWEEN 24.5 AND 31 AND longitude BETWEEN -87.6 AND -80 WHEN 'new south wales' THEN latitude BETWEEN -37.5 AND -28 AND longitude BETWEEN 141 AND 154
 WHEN 'texas' THEN latitude BETWEEN 25.8 AND 36.5 AND longitude BETWEEN -106.6 AND -93.5 ELSE true END AS inside FROM incidents_full_v WHERE longitude IS NOT NULL""")
def _(fx):
    placed = fx["incidents_full_v"].filter(F.col("longitude").isNotNull())
    return placed.select("id", places.in_state(F.col("latitude"), F.col("longitude"), F.col("state_province"))
                         .alias("inside"))
