"""Spherical distance and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reefline.constants import EARTH_RADIUS_KM

# Height of a match cell in degrees of latitude; 0.002 deg is about 222 m, so a
# 150 m circle never leaves the 3 x 3 block around its own cell.
MATCH_CELL_DEG = 0.002


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), 2
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def match_row(lat: Column) -> Column:
    return F.floor(lat / MATCH_CELL_DEG)


def _columns_in_row(row: Column) -> Column:
    """Number of cells round the globe in a cell row: as many as stay at least as wide as high."""
    farthest = F.greatest(F.abs(row), F.abs(row + 1)) * MATCH_CELL_DEG
    shrink = F.cos(F.radians(F.least(farthest, F.lit(90.0))))
    return F.greatest(F.floor(shrink * (360.0 / MATCH_CELL_DEG)), F.lit(1))


def match_column(lon: Column, row: Column) -> Column:
    n = _columns_in_row(row)
    return F.pmod(F.floor((lon + 180.0) / 360.0 * n), n)


def match_cell(lat: Column, lon: Column) -> Column:
    row = match_row(lat)
    return F.struct(row.alias("r"), match_column(lon, row).alias("c"))


def match_block(lat: Column, lon: Column) -> Column:
    """The 3 x 3 block of cells around a point, wrapping at the antimeridian."""
    def in_row(d_row: Column) -> Column:
        row = match_row(lat) + d_row
        n = _columns_in_row(row)
        return F.transform(
            F.array(F.lit(-1), F.lit(0), F.lit(1)),
            lambda d: F.struct(
                row.alias("r"), F.pmod(match_column(lon, row) + d, n).alias("c")
            ),
        )
    rows = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), in_row)
    return F.array_distinct(F.flatten(rows))
