"""Constraint checks: rows split into valid ones and rejects with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reefline.constants import (
    CLASSIFICATIONS, EXCERPT_CHARS, MAX_KEY_CHARS, MAX_LENGTHS, REPORT_PLATFORMS, REPORT_SOURCES,
    SEVERITIES, VERIFICATION_STATUSES,
)

Rules = dict[str, Column]


def _longer(name: str, limit: int) -> Column:
    return F.length(name) > limit


def _outside(name: str, low: float, high: float) -> Column:
    return ~F.col(name).between(low, high)


def _unlisted(name: str, allowed: list[str]) -> Column:
    return ~F.col(name).isin(allowed)


def incident_rules() -> Rules:
    """Reason -> condition that breaks the rule; a null condition passes."""
    rules: Rules = {
        f"{name}: longer than {limit}": _longer(name, limit) for name, limit in MAX_LENGTHS.items()
    }
    for name in ("location_description", "country", "classification", "date_precision",
                 "location_precision", "fatal"):
        rules[f"{name}: required"] = F.col(name).isNull()
    for name, allowed in (("classification", CLASSIFICATIONS), ("report_source", REPORT_SOURCES),
                          ("report_platform", REPORT_PLATFORMS),
                          ("victim_injury_severity", SEVERITIES),
                          ("verification_status", VERIFICATION_STATUSES)):
        rules[f"{name}: not allowed"] = _unlisted(name, allowed)
    rules["victim_age: out of range"] = _outside("victim_age", 0, 120)
    rules["longitude: out of range"] = _outside("longitude", -180, 180)
    rules["latitude: out of range"] = _outside("latitude", -90, 90)
    rules["coordinates: incomplete"] = F.col("longitude").isNull() != F.col("latitude").isNull()
    return rules


def source_rules() -> Rules:
    limits = {"source_type": 30, "source_url": 2048, "source_title": 500,
              "source_publisher": 200, "source_notes": 2000}
    rules: Rules = {f"{n}: longer than {k}": _longer(n, k) for n, k in limits.items()}
    rules["source_type: required"] = F.col("source_type").isNull()
    return rules


def evidence_rules() -> Rules:
    limits = {"dedup_key": MAX_KEY_CHARS, "source_platform": 30, "source_name": 200,
              "body_excerpt": EXCERPT_CHARS, "author": 200}
    rules: Rules = {f"{n}: longer than {k}": _longer(n, k) for n, k in limits.items()}
    for name in ("dedup_key", "source_platform", "source_name", "source_url", "title"):
        rules[f"{name}: required"] = F.col(name).isNull()
    rules["content_sha256: not a digest"] = ~F.col("content_sha256").rlike("^[0-9a-fA-F]{64}$")
    return rules


def observation_rules() -> Rules:
    limits = {"extractor_name": 100, "model_name": 200, "prompt_version": 100, "schema_version": 30}
    rules: Rules = {f"{n}: longer than {k}": _longer(n, k) for n, k in limits.items()}
    for name in ("extractor_name", "model_name", "prompt_version", "event_type", "payload"):
        rules[f"{name}: required"] = F.col(name).isNull()
    rules["event_type: not allowed"] = _unlisted(
        "event_type", ["attack", "sighting", "news", "not_relevant"])
    for name in ("confidence", "verification_confidence"):
        rules[f"{name}: out of range"] = _outside(name, 0, 1)
    return rules


def check(rows: DataFrame, rules: Rules) -> DataFrame:
    """Adds `reasons`, the broken rules of each row, in rule order."""
    broken = F.array(*[F.when(bad, F.lit(reason)) for reason, bad in rules.items()])
    return rows.withColumn("reasons", F.array_compact(broken))


def split(rows: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    checked = check(rows, rules)
    good = F.size("reasons") == 0
    return checked.filter(good).drop("reasons"), checked.filter(~good)
