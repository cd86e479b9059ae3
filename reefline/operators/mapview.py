"""Map queries: bounding box, features and grid clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reefline.functions.text import blank_to_null
from reefline.operators.browse import filter_incidents


def parse_box(text: str) -> tuple[float, float, float, float]:
    parts = [float(p) for p in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a box has exactly four numbers: west,south,east,north")
    return parts[0], parts[1], parts[2], parts[3]


def inside_box(text: str) -> Column:
    """Strictly inside: a point on the edge is not within the box.  Pushes down to the scan."""
    west, south, east, north = parse_box(text)
    return ((F.col("longitude") > west) & (F.col("longitude") < east)
            & (F.col("latitude") > south) & (F.col("latitude") < north))


def map_rows(incidents: DataFrame, box: str | None = None, **filters) -> DataFrame:
    """Verified incidents with a point, under the usual filters."""
    rows = filter_incidents(incidents, **filters).filter(
        F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    return rows.filter(inside_box(box)) if box else rows


def features(incidents: DataFrame, box: str | None = None, **filters) -> DataFrame:
    """id, feature: one GeoJSON feature per row, points rounded to three places."""
    properties = F.struct(
        F.col("id").cast("string").alias("id"), "case_number",
        F.col("incident_date").cast("string").alias("incident_date"), "classification",
        "classification_subtype",
        F.coalesce(blank_to_null(F.col("shark_species_confirmed")),
                   F.col("shark_species_suspected")).alias("species"),
        F.col("victim_activity").alias("activity"),
        F.col("victim_injury_severity").alias("severity"), "fatal",
        F.col("location_description").alias("location"), "country")
    geometry = F.struct(
        F.lit("Point").alias("type"),
        F.array(F.bround("longitude", 3), F.bround("latitude", 3)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                       properties.alias("properties"))
    return map_rows(incidents, box, **filters).select(
        "id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def clusters(incidents: DataFrame, zoom: int = 3, box: str | None = None, **filters) -> DataFrame:
    """Nearest-node grid of 180 / 2^zoom degrees: mean point, counts, commonest class.

    Counting per (node, class) first keeps the exchange at a few rows per node, however
    many incidents share it.
    """
    size = 180.0 / 2 ** zoom
    node = [F.rint(F.col("longitude") / size).alias("gx"), F.rint(F.col("latitude") / size).alias("gy")]
    per_class = map_rows(incidents, box, **filters).groupBy(*node, "classification").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("fatal").eqNullSafe(F.lit(True))).alias("f"),
        F.sum("longitude").alias("x"), F.sum("latitude").alias("y"))
    return per_class.groupBy("gx", "gy").agg(
        (F.sum("x") / F.sum("n")).alias("longitude"), (F.sum("y") / F.sum("n")).alias("latitude"),
        F.sum("n").alias("count"), F.sum("f").alias("fatal_count"),
        F.min(F.struct(-F.col("n"), "classification"))["classification"]
        .alias("dominant_classification"),
    ).drop("gx", "gy")
