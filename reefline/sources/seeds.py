"""Dimension and sample loads that skip what is already present."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reefline.operators.capture import insert_absent


def seed_rows(seed: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Seed rows whose key is not stored; append the result."""
    return insert_absent(seed, existing, [key])


def species_listing(species: DataFrame) -> DataFrame:
    return species.orderBy(F.asc("common_name"))
