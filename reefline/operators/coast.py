"""Coast work: vague places, points on land, nearest coast and the snap job.

Land is a table of polygon edges (poly_id, x1, y1, x2, y2); rings of holes carry the
poly_id of their polygon.  Every test runs on distinct points, so a spot shared by very
many incidents is measured once, and every join is an equi-join on grid cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reefline.constants import (
    COAST_SNAP_KM, GENERIC_COAST_WORDS, PLACE_ALIASES, VAGUE_MODIFIERS,
)
from reefline.functions.geo import haversine_km
from reefline.functions.frames import once
from reefline.functions.text import let

# Cells for the on-land test.  The odd origin keeps cell borders off round coordinates.
LAND_CELL = 0.25
ORIGIN = 0.0317
# Cell sizes for the nearest-coast search, from about 400 m up; the last one spans the globe.
NEAREST_CELLS = [4.0 ** i / 256 for i in range(10)]
# How far beyond a piece of an edge its cells are looked for, against rounding at cell borders.
PAD = 1e-9
POINT = ["longitude", "latitude"]


# --- vague places ------------------------------------------------------------------------
def normal_place(value: Column) -> Column:
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^a-z0-9]+", " "))
    for alias, name in PLACE_ALIASES.items():
        text = F.regexp_replace(text, rf"\b{alias}\b", name)
    return text


def is_vague(place: Column, country: Column, state: Column) -> Column:
    """No text, a bare region name, or nothing left beside modifiers and coast words."""
    filler = F.array(*[F.lit(w) for w in (*VAGUE_MODIFIERS, *GENERIC_COAST_WORDS)])

    def judge(parts: Column) -> Column:
        loc = parts[0]
        tokens = F.array_except(F.split(loc, " "), filler)
        vague = (loc == "") | (F.size(tokens) == 0)
        for region in (parts[1], parts[2]):
            words = F.split(region, " ")
            same = (F.size(F.array_except(tokens, words)) == 0) & (
                F.size(F.array_except(words, tokens)) == 0)
            vague = vague | ((region != "") & ((loc == region) | same))
        return vague
    return let(F.array(*[normal_place(v) for v in (place, country, state)]), judge)


# --- on land ----------------------------------------------------------------------------------
def _cell(value: Column, size: float = LAND_CELL) -> Column:
    return F.floor((value + ORIGIN) / size)


def _span(a: Column, b: Column, size: float) -> Column:
    return F.sequence(_cell(F.least(a, b) - PAD, size), _cell(F.greatest(a, b) + PAD, size))


def _edges_by_cell(edges: DataFrame, size: float) -> DataFrame:
    """Each edge, whole, in every cell it passes.

    The edge is followed in pieces about as long as a cell, so a long slanting edge comes in the
    cells along it and not in all cells of its box.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pieces = F.greatest(F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / size), F.lit(1))

    def cells(k: Column) -> Column:
        a, b = k / pieces, (k + 1) / pieces
        xs = _span(F.col("x1") + dx * a, F.col("x1") + dx * b, size)
        ys = _span(F.col("y1") + dy * a, F.col("y1") + dy * b, size)
        return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(
            cx.alias("cx"), cy.alias("cy")))))
    passed = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), pieces - 1), cells)))
    return edges.withColumn("_at", F.explode(passed)).select("*", "_at.cx", "_at.cy").drop("_at")


def _crossing_x(y: Column) -> Column:
    return F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1"))


def _crossing_y(x: Column) -> Column:
    return F.col("y1") + (F.col("y2") - F.col("y1")) * (x - F.col("x1")) / (F.col("x2") - F.col("x1"))


def on_land(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct points that lie in at least one polygon.

    A corner of every used cell is placed by ray crossings: it meets the edges that cross the
    latitude of its row of cells, no others.  A point then differs from its cell's corner by the
    edges of that one cell crossed on the way there: right to the cell border, up along it.
    """
    spots = points.filter(F.col("longitude").isNotNull() & F.col("latitude").isNotNull()).select(
        *POINT).distinct().withColumns({"cx": _cell(F.col("longitude")), "cy": _cell(F.col("latitude"))})
    right = (F.col("cx") + 1) * LAND_CELL - ORIGIN
    top = (F.col("cy") + 1) * LAND_CELL - ORIGIN
    corners = spots.select("cx", "cy").distinct().withColumns({"px": right, "py": top})
    # rows whose upper border the edge crosses; one row more on both sides is tested than can be
    crossing = edges.filter(F.col("y1") != F.col("y2")).withColumn("cy", F.explode(F.sequence(
        _cell(F.least("y1", "y2")) - 1, _cell(F.greatest("y1", "y2"))))).filter(
        (F.col("y1") > top) != (F.col("y2") > top))
    py, px = F.col("py"), F.col("px")
    corner_in = corners.join(crossing, "cy").filter(_crossing_x(py) > px).groupBy("cx", "cy", "poly_id").agg(F.count(F.lit(1)).alias("hits"))
    near = spots.join(_edges_by_cell(edges, LAND_CELL), ["cx", "cy"])
    lon, lat = F.col("longitude"), F.col("latitude")
    # the guards keep a level or upright edge from dividing by zero
    sideways = F.when((F.col("y1") > lat) != (F.col("y2") > lat),
                      (_crossing_x(lat) > lon) & (_crossing_x(lat) <= right)).otherwise(F.lit(False))
    upward = F.when((F.col("x1") > right) != (F.col("x2") > right),
                    (_crossing_y(right) > lat) & (_crossing_y(right) <= top)).otherwise(F.lit(False))
    local = near.select(*POINT, "poly_id", (sideways.cast("int") + upward.cast("int")).alias("hits"))
    from_corner = spots.join(corner_in, ["cx", "cy"]).select(*POINT, "poly_id", "hits")
    parity = local.unionByName(from_corner).groupBy(*POINT, "poly_id").agg(F.sum("hits").alias("hits"))
    return parity.filter(F.col("hits") % 2 == 1).select(*POINT).distinct()


# --- nearest coast -------------------------------------------------------------------------------
def coast_pairs(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Each distinct point with the few edges among which its nearest one is.

    A vertex in the 3 x 3 block of cells of size s lies within 2*sqrt(2)*s < 4s, so the block
    one level up (cells of 4s) must hold the nearest edge.  Each used cell looks up the
    smallest level with a vertex nearby; each point then meets only the edges of one block.
    """
    top = len(NEAREST_CELLS) - 1
    spots = points.select(*POINT).distinct().withColumns({
        "c0x": _cell(F.col("longitude"), NEAREST_CELLS[0]),
        "c0y": _cell(F.col("latitude"), NEAREST_CELLS[0])})
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(4 ** i).alias("step"))
                       for i in range(top + 1)])
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))

    def block(cx: Column, cy: Column) -> Column:
        return F.flatten(F.transform(around, lambda dx: F.transform(around, lambda dy: F.struct(
            (cx + dx).alias("cx"), (cy + dy).alias("cy")))))

    def up(cell: Column, step: Column) -> Column:
        return F.floor(cell / step)

    ends = edges.select(_cell(F.col("x1"), NEAREST_CELLS[0]).alias("vx"),
                        _cell(F.col("y1"), NEAREST_CELLS[0]).alias("vy")).distinct()
    occupied = ends.select(F.explode(levels).alias("l"), "vx", "vy").select(
        "l.level", up(F.col("vx"), F.col("l.step")).alias("cx"),
        up(F.col("vy"), F.col("l.step")).alias("cy")).distinct()
    used = spots.select("c0x", "c0y").distinct()
    looked = used.select("c0x", "c0y", F.explode(levels).alias("l")).select(
        "c0x", "c0y", "l.level", F.explode(block(up(F.col("c0x"), F.col("l.step")),
                                                 up(F.col("c0y"), F.col("l.step")))).alias("b"))
    chosen = looked.select("c0x", "c0y", "level", "b.cx", "b.cy").join(
        occupied, ["level", "cx", "cy"]).groupBy("c0x", "c0y").agg(
        F.least(F.min("level") + 1, F.lit(top)).alias("level"))
    steps = F.pow(F.lit(4.0), F.col("level"))
    asked = spots.join(chosen, ["c0x", "c0y"]).select(*POINT, "level", F.explode(block(
        up(F.col("c0x"), steps), up(F.col("c0y"), steps))).alias("b")).select(
        *POINT, "level", "b.cx", "b.cy")
    placed = None
    for i, size in enumerate(NEAREST_CELLS):
        part = _edges_by_cell(edges, size).withColumn("level", F.lit(i))
        placed = part if placed is None else placed.unionByName(part)
    return asked.join(placed, ["level", "cx", "cy"])


def nearest_coast(points: DataFrame, edges: DataFrame) -> DataFrame:
    """longitude, latitude, coast_lon, coast_lat, km for each distinct point.

    Nearest is planar in degrees; the distance is spherical.
    """
    pairs = coast_pairs(points, edges)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length2 = dx * dx + dy * dy
    along = ((F.col("longitude") - F.col("x1")) * dx + (F.col("latitude") - F.col("y1")) * dy)
    t = F.when(length2 > 0, F.least(F.greatest(F.try_divide(along, length2), F.lit(0.0)), F.lit(1.0))
               ).otherwise(F.lit(0.0))
    measured = pairs.select(*POINT, (F.col("x1") + t * dx).alias("sx"), (F.col("y1") + t * dy).alias("sy"))
    d2 = F.pow(F.col("sx") - F.col("longitude"), 2) + F.pow(F.col("sy") - F.col("latitude"), 2)
    best = measured.groupBy(*POINT).agg(F.min(F.struct(d2.alias("d2"), "sy", "sx")).alias("s"))
    return best.select(
        *POINT, F.col("s.sx").alias("coast_lon"), F.col("s.sy").alias("coast_lat"),
        haversine_km(F.col("latitude"), F.col("longitude"), F.col("s.sy"), F.col("s.sx")).alias("km"))


def inland(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Points on land with nearest coast and distance; a point not listed is at distance 0."""
    return nearest_coast(on_land(points, edges), edges)


def with_inland(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds coast_lon, coast_lat and inland_km (0 offshore) to any rows with a point."""
    return rows.join(inland(rows, edges), POINT, "left").withColumn(
        "inland_km", F.coalesce("km", F.lit(0.0))).drop("km")


# --- snap job ----------------------------------------------------------------------------------------
def coast_snap(incidents: DataFrame, edges: DataFrame, threshold_km: float = COAST_SNAP_KM) -> DataFrame:
    """Every placed incident with new point and outcome.

    Only vague places are eligible, and only when their point is on land at least the
    threshold from the coast; everything else is skipped unchanged.
    """
    placed = incidents.filter(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    vague = is_vague(F.col("location_description"), F.col("country"), F.col("state_province"))
    marked = once(placed, "_vague", vague)
    found = inland(marked.filter("_vague"), edges).filter(F.col("km") >= threshold_km)
    joined = marked.join(found.withColumn("_vague", F.lit(True)), [*POINT, "_vague"], "left")
    moved = F.col("km").isNotNull()
    return joined.select(
        *incidents.columns,
        F.when(moved, F.col("coast_lon")).otherwise(F.col("longitude")).alias("new_longitude"),
        F.when(moved, F.col("coast_lat")).otherwise(F.col("latitude")).alias("new_latitude"),
        F.when(moved, F.col("km")).alias("moved_km"),
        F.when(moved, F.lit("updated")).otherwise(F.lit("skipped")).alias("outcome"))


def outcome_report(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("outcome") == o).alias(o)
                      for o in ("updated", "skipped", "failed")])
