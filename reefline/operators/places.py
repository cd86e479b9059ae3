"""Gazetteer work: region bounds, query variants, candidate ranking and point repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reefline.constants import (
    GAZETTEER_SNAP_KM, INLAND_WATER_TERMS, MAX_CORRECTION_KM, MAX_INLAND_KM, MIN_CORRECTION_KM,
    PLACE_CORRECTIONS, STATE_ALIASES, STATE_BOUNDS,
)
from reefline.functions.frames import once
from reefline.functions.geo import haversine_km
from reefline.functions.text import any_term, blank_to_null, let, lookup, title_case
from reefline.operators.coast import is_vague, with_inland

PLACE_KEY = ["location_description", "state_province", "country"]


# --- region bounds -------------------------------------------------------------------------
def canonical_state(state: Column) -> Column:
    tidy = blank_to_null(F.lower(F.trim(state)))
    return F.coalesce(lookup(tidy, STATE_ALIASES), tidy)


def in_state(lat: Column, lon: Column, state: Column) -> Column:
    """Inside the state's box; an unknown or missing state always passes."""
    table = F.create_map(*[x for known, box in STATE_BOUNDS.items()
                           for x in (F.lit(known), F.array(*[F.lit(v) for v in box]))])
    box = F.try_element_at(table, canonical_state(state))
    inside = lat.between(box[0], box[1]) & lon.between(box[2], box[3])
    return box.isNull() | inside


# --- query variants -----------------------------------------------------------------------
def _corrected(place: Column, canonical: Column) -> Column:
    loc = F.regexp_replace(F.trim(F.coalesce(place, F.lit(""))), r"(?i)\bPoint Plomber\b", "Point Plomer")
    for (name, where), better in PLACE_CORRECTIONS.items():
        loc = F.when((F.lower(loc) == name) & canonical.eqNullSafe(F.lit(where)), F.lit(better)).otherwise(loc)
    return loc


def _variants() -> Column:
    """Array of queries, most specific first, without repeats, from the staged columns."""
    loc, state, label, land = (F.col(c) for c in ("_loc", "_state", "_label", "_land"))
    anchor = F.coalesce(label, land)
    region = F.array(F.array_join(F.array_distinct(F.array_compact(F.array(anchor, land))), ", "))
    bare = F.regexp_replace(loc, r"(?i)^(?:near|off|at|outside)\s+", "")
    around = F.split(loc, r"(?i)\s+(?:north|south|east|west)\s+of\s+", -1)
    sides = let(around, lambda a: F.when(F.size(a) == 2, F.transform(a, F.trim)))
    forms = F.concat(
        F.array(loc, bare, F.trim(F.substring_index(loc, ",", 1))),
        F.coalesce(sides, F.array().cast("array<string>")))

    def in_context(form: Column) -> Column:
        lower = F.lower(form)
        return F.concat_ws(
            ", ", form, F.when(~F.contains(lower, state), label),
            F.when(~F.contains(lower, F.lower(land)), land))
    return F.when(F.col("_vague") & anchor.isNotNull(), region).otherwise(
        F.array_distinct(F.transform(F.array_distinct(forms), in_context)))


def ranked_queries(incidents: DataFrame) -> DataFrame:
    """id, query_rank, query; each stage is computed once per row."""
    rows = incidents.select("id", "location_description", "country", "state_province",
                            blank_to_null(F.col("country")).alias("_land"))
    rows = once(rows, "_state", canonical_state(F.col("state_province")))
    rows = once(rows, "_label", title_case(F.col("_state")))
    rows = once(rows, "_loc", _corrected(F.col("location_description"), F.col("_state")))
    rows = once(rows, "_vague", is_vague(F.col("_loc"), F.col("country"), F.col("state_province")))
    return rows.select("id", F.posexplode(_variants()).alias("query_rank", "query"))


# --- ranking ----------------------------------------------------------------------------------
def names_inland_water(place: Column, water: Column) -> Column:
    return any_term(F.lower(F.concat_ws(" ", place, F.coalesce(water, F.lit("")))), INLAND_WATER_TERMS)


def rank_candidates(places: DataFrame, candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """place_key, longitude, latitude, moved: the accepted point of each place, null if none.

    `places` has place_key, location_description, country, state_province, body_of_water;
    `candidates` has place_key, query_rank, candidate_rank, longitude, latitude, importance.
    A candidate must lie in the state and at most 25 km inland; the first query with one
    wins, then least inland, then importance.  Named inland waters take the first candidate
    as it is; vague places get no point.
    """
    known = places.select(
        "place_key", "state_province",
        is_vague(F.col("location_description"), F.col("country"), F.col("state_province")).alias("vague"),
        names_inland_water(F.col("location_description"), F.col("body_of_water")).alias("water"))
    offered = candidates.join(known.filter(~F.col("vague")), "place_key").filter(
        in_state(F.col("latitude"), F.col("longitude"), F.col("state_province")))
    sea = with_inland(offered.filter(~F.col("water")), edges).filter(F.col("inland_km") <= MAX_INLAND_KM)
    fresh = offered.filter("water").withColumns({
        "inland_km": F.lit(0.0), "coast_lon": F.lit(None).cast("double"),
        "coast_lat": F.lit(None).cast("double")})
    # named waters go by the provider's order alone; a constant takes importance out of the order
    order = F.struct(
        "query_rank", "inland_km",
        F.when(F.col("water"), F.lit(0.0)).otherwise(-F.col("importance")).alias("w"),
        "candidate_rank")
    best = sea.unionByName(fresh).groupBy("place_key").agg(F.min_by(
        F.struct("longitude", "latitude", "coast_lon", "coast_lat", "inland_km"), order).alias("b"))
    snap = F.col("b.inland_km") >= GAZETTEER_SNAP_KM
    chosen = best.select(
        "place_key", F.when(snap, F.col("b.coast_lon")).otherwise(F.col("b.longitude")).alias("longitude"),
        F.when(snap, F.col("b.coast_lat")).otherwise(F.col("b.latitude")).alias("latitude"),
        snap.alias("moved"))
    return places.select("place_key").join(chosen, "place_key", "left")


def distinct_places(incidents: DataFrame) -> DataFrame:
    """Each (place, state, country) once, with a key: what has to be looked up."""
    return incidents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in PLACE_KEY]).distinct() \
        .withColumn("place_key", F.sha2(F.concat_ws("|", *PLACE_KEY), 256))


def reuse_points(incidents: DataFrame, resolved: DataFrame) -> DataFrame:
    """Lay resolved points (place_key, longitude, latitude) over all incidents of the place."""
    key = F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in PLACE_KEY]), 256)
    points = resolved.select("place_key", F.col("longitude").alias("_lon"), F.col("latitude").alias("_lat"))
    return incidents.withColumn("place_key", key).join(points, "place_key", "left").withColumns({
        "longitude": F.col("_lon"), "latitude": F.col("_lat")}).drop("_lon", "_lat", "place_key")


# --- repairs -----------------------------------------------------------------------------------
def regeocode(incidents: DataFrame, points: DataFrame) -> DataFrame:
    """Placed incidents with the outcome of a new lookup (id, new_longitude, new_latitude).

    A move counts between 1 and 100 km; without text or within 1 km the row is skipped,
    without a new point it failed.
    """
    placed = incidents.filter(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    joined = placed.join(points.select("id", "new_longitude", "new_latitude"), "id", "left")
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("new_latitude"), F.col("new_longitude"))
    outcome = (
        F.when(F.coalesce("location_description", F.lit("")) == "", "skipped")
        .when(F.col("new_longitude").isNull() | F.col("new_latitude").isNull(), "failed")
        .when((F.col("moved_km") < MIN_CORRECTION_KM) | (F.col("moved_km") > MAX_CORRECTION_KM), "skipped")
        .otherwise("updated"))
    judged = joined.withColumn("moved_km", km).withColumn("outcome", outcome)
    moved = F.col("outcome") == "updated"
    return judged.withColumns({
        "longitude": F.when(moved, F.col("new_longitude")).otherwise(F.col("longitude")),
        "latitude": F.when(moved, F.col("new_latitude")).otherwise(F.col("latitude")),
    }).drop("new_longitude", "new_latitude")


def apply_manifest(incidents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Reviewed corrections by case number: set or clear the point, fix place and state.

    `manifest` has case_number, longitude, latitude, location_description, state_province;
    a row without a point clears it.
    """
    fixes = manifest.select("case_number", F.struct(
        "longitude", "latitude", "location_description", "state_province").alias("fix"))
    joined = incidents.join(fixes, "case_number", "left")
    hit = F.col("fix").isNotNull()
    with_point = F.col("fix.longitude").isNotNull() & F.col("fix.latitude").isNotNull()
    return joined.withColumns({
        "longitude": F.when(hit & with_point, F.col("fix.longitude")).when(~hit, F.col("longitude")),
        "latitude": F.when(hit & with_point, F.col("fix.latitude")).when(~hit, F.col("latitude")),
        "location_precision": F.when(hit, F.when(with_point, "approximate").otherwise("unknown"))
        .otherwise(F.col("location_precision")),
        "location_description": F.coalesce(
            blank_to_null(F.col("fix.location_description")), "location_description"),
        "state_province": F.coalesce(blank_to_null(F.col("fix.state_province")), "state_province"),
    }).select(*incidents.columns)


def manifest_report(incidents: DataFrame, manifest: DataFrame) -> DataFrame:
    """planned, updated and missing counts of a manifest."""
    cases = incidents.select("case_number", F.lit(True).alias("_there"))
    return manifest.join(cases, "case_number", "left").agg(
        F.count(F.lit(1)).alias("planned"), F.count("_there").alias("updated"),
        F.count_if(F.col("_there").isNull()).alias("missing"))


def manifest_missing(incidents: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(incidents.select("case_number"), "case_number", "left_anti").select("case_number")
