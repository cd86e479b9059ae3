"""Dashboard statistics.  Attack classes only; verification status is not considered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reefline.constants import ATTACK_CLASSES, JOB_STATUSES, SPECIES_CHART_LABELS
from reefline.functions.text import lookup

def is_fatal(value: bool = True) -> Column:
    return F.col("fatal").eqNullSafe(F.lit(value))


def attacks(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("classification").isin(ATTACK_CLASSES))


def species_label() -> Column:
    return F.coalesce("shark_species_confirmed", "shark_species_suspected")


def _tally(*extra: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("count"), *extra]


def _fatal() -> Column:
    return F.count_if(is_fatal()).alias("fatal")


def overview(incidents: DataFrame) -> DataFrame:
    """One row from one scan: grouping sets give totals and both rankings together."""
    year = F.year("incident_date")
    cells = attacks(incidents).groupBy(
        F.col("country"), species_label().alias("species")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_fatal()).alias("f"),
        F.min(year).alias("y0"), F.max(year).alias("y1"),
    )
    country, species = F.col("country"), F.col("species")
    levels = cells.groupingSets([[], [country], [species]], country, species).agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n"), F.sum("f").alias("f"),
        F.min("y0").alias("y0"), F.max("y1").alias("y1"),
    )
    # grouping_id bits are (country, species); a set bit means "rolled up"
    total, per_country, per_species = (F.col("level") == v for v in (3, 1, 2))
    ranked = F.struct(-F.col("n"), F.col("country"))
    ranked_species = F.struct(-F.col("n"), F.col("species"))
    one = levels.agg(
        F.coalesce(F.max(F.when(total, F.col("n"))), F.lit(0)).alias("total_incidents"),
        F.coalesce(F.max(F.when(total, F.col("f"))), F.lit(0)).alias("total_fatal"),
        F.min(F.when(per_country, ranked))["country"].alias("most_active_country"),
        F.min(F.when(per_species & F.col("species").isNotNull(), ranked_species))["species"]
        .alias("most_common_species"),
        F.min(F.when(total, F.col("y0"))).alias("y0"), F.max(F.when(total, F.col("y1"))).alias("y1"),
    )
    return one.select(
        "total_incidents", "total_fatal",
        F.when(F.col("total_incidents") > 0, F.round(
            F.col("total_fatal") / F.col("total_incidents") * 100, 1))
        .otherwise(F.lit(0.0)).alias("fatality_rate"),
        "most_active_country", "most_common_species",
        F.concat(F.col("y0").cast("string"), F.lit("-"), F.col("y1").cast("string"))
        .alias("year_range"),
    )


def by_year(incidents: DataFrame) -> DataFrame:
    return (
        attacks(incidents).filter(F.col("incident_date").isNotNull())
        .groupBy(F.year("incident_date").alias("year")).agg(*_tally(_fatal())).orderBy("year")
    )


def _most(counts: DataFrame, name: str, limit: int | None) -> DataFrame:
    """The most frequent first; without a limit all."""
    ordered = counts.orderBy(F.desc("count"), name)
    return ordered if limit is None else ordered.limit(limit)


def by_country(incidents: DataFrame, limit: int | None = 20) -> DataFrame:
    return _most(attacks(incidents).groupBy("country").agg(*_tally(_fatal())), "country", limit)


def by_species(incidents: DataFrame, limit: int | None = 15) -> DataFrame:
    counts = attacks(incidents).groupBy(species_label().alias("species")).agg(*_tally())
    return _most(counts.filter(F.col("species").isNotNull()), "species", limit)


def by_activity(incidents: DataFrame, limit: int | None = 15) -> DataFrame:
    counts = attacks(incidents).filter(F.col("victim_activity").isNotNull()).groupBy(
        F.col("victim_activity").alias("activity")).agg(*_tally())
    return _most(counts, "activity", limit)


def fatality_trend(incidents: DataFrame) -> DataFrame:
    return (
        attacks(incidents).filter(F.col("incident_date").isNotNull())
        .groupBy(F.year("incident_date").alias("year"))
        .agg(_fatal(), F.count_if(is_fatal(False)).alias("non_fatal")).orderBy("year")
    )


def country_chart(incidents: DataFrame) -> DataFrame:
    return by_country(incidents, 10).select(
        "country", "fatal", (F.col("count") - F.col("fatal")).alias("non_fatal"))


def year_chart(incidents: DataFrame) -> DataFrame:
    return by_year(incidents).select(
        "year", "fatal", (F.col("count") - F.col("fatal")).alias("non_fatal"))


def species_chart(incidents: DataFrame) -> DataFrame:
    return by_species(incidents, 10).select(
        F.coalesce(lookup(F.col("species"), SPECIES_CHART_LABELS), F.col("species")).alias("species"),
        "count",
    )


def ingestion_health(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Zero-filled job counts and the two latest times, in one aggregate over both tables."""
    stamped = jobs.select("status", "completed_at").unionByName(
        sources.select("captured_at"), allowMissingColumns=True)
    return stamped.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in JOB_STATUSES],
        F.max("captured_at").alias("last_source_captured_at"),
        F.max("completed_at").alias("last_job_completed_at"),
    )


# route -> the run counters it adds to
ROUTE_COUNTERS = {
    "processed": None,
    "captured_news": ["news_only", "low_confidence", "duplicate", "invalid", "candidate",
                      "retry_extraction", "retry_verification", "retry_observation"],
    "extracted": ["low_confidence", "duplicate", "invalid", "candidate", "retry_verification",
                  "retry_observation"],
    "candidates": ["candidate"],
    "skipped_seen": ["seen"],
    "skipped_not_shark": ["not_relevant"],
    "skipped_irrelevant": ["news_only"],
    "skipped_low_confidence": ["low_confidence", "invalid"],
    "skipped_duplicate": ["duplicate"],
    "retryable_failures": ["retry_capture", "retry_extraction", "retry_verification",
                           "retry_observation"],
}


def run_counters(routed: DataFrame) -> DataFrame:
    """The fifteen counters of a run.

    `routed` carries `route`, `news_captured`, `verified` (a verification answer was used)
    and `verification_error`.  Three counters exist but are never raised.
    """
    counts = []
    for name, routes in ROUTE_COUNTERS.items():
        test = F.lit(True) if routes is None else F.col("route").isin(routes)
        if name == "captured_news":
            test = test & F.col("news_captured")
        counts.append(F.count_if(test).alias(name))
    failed = F.col("route").isin("retry_capture", "retry_extraction", "retry_observation")
    return routed.agg(
        *counts,
        F.count_if("verified").alias("verified"),
        F.count_if(failed | F.col("verification_error")).alias("errors"),
    ).select(
        "*", *[F.lit(0).cast("bigint").alias(c)
               for c in ("submitted", "promoted_attack", "promoted_sighting")])
