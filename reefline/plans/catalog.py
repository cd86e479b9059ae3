"""All registered queries, by the inventory row they cover."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from reefline.plans.fixtures import Fixtures
from reefline.plans.registry import ORACLES, QUERIES

for _module in ("read_side", "feed_side", "capture_side", "claims_side", "resolve_side",
                "places_side", "lifecycle_side", "stream_side"):
    importlib.import_module(f"reefline.plans.{_module}")


def names() -> list[str]:
    return sorted(QUERIES)


def run(name: str, fixtures: Fixtures) -> DataFrame:
    return QUERIES[name](fixtures)


def bind(name: str):
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(name, Fixtures(spark, sf_dir))
    call.__name__ = name
    return call


def oracles() -> dict[str, str]:
    return dict(ORACLES)
