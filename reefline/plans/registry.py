"""Where plan modules register a query and, where SQL can say it, its checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from reefline.plans.fixtures import Fixtures, with_views

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def printable(df: DataFrame) -> DataFrame:
    """Dates and times as text, so that results compare across engines."""
    return df.select(*[
        F.col(f.name).cast("string").alias(f.name)
        if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col(f.name)
        for f in df.schema.fields])


def query(name: str, oracle: str | None = None):
    def add(fn: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda fixtures: printable(fn(fixtures))
        if oracle:
            ORACLES[name] = with_views(oracle)
        return fn
    return add
