"""From model answers to claims: one job, each stage adds columns to the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from reefline.constants import (
    ACTIVITIES, CLASSIFICATIONS, CORRECTABLE_TEXT_FIELDS, COUNTRY_ALIASES, DEFAULT_CONFIDENCE,
    INVALID_CERTAIN_CONFIDENCE, MIN_EXTRACTION_CONFIDENCE, PLATFORM_REPORT_PLATFORM,
    PLATFORM_REPORT_SOURCE, PLATFORM_SOURCE_TYPE, SEVERITIES, SPECIES_BY_COMMON_NAME,
    UNVERIFIED_OK_CONFIDENCE,
)
from reefline.functions.frames import once
from reefline.functions.text import best_option, blank_to_null, first_contained, let, lookup

ANSWER_FIELDS = [
    "is_relevant", "classification", "victim_injury_severity", "victim_activity",
    "shark_species", "incident_date", "location_description", "country", "state_province",
    "body_of_water", "victim_name", "victim_age", "victim_sex", "fatal", "description",
    "confidence",
]
# every field as text: answers are loosely typed, stages below repair them
ANSWER = T.StructType([T.StructField(f, T.StringType(), True) for f in ANSWER_FIELDS])


JSON_LOOK = r'(?s)^\s*(\{.*\}|\[.*\]|".*"|-?\d[\d.eE+-]*|true|false|null)\s*$'


# --- stage: answer text to object ------------------------------------------------------
def json_object(text: Column) -> Column:
    """The JSON object in an answer: whole text, else fenced block, else outer braces.

    The first form that is JSON decides; if it is not an object there is none.
    """
    def chosen(whole: Column) -> Column:
        fenced = F.trim(F.regexp_extract(whole, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1))
        braces = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
        parsed = F.when(F.lit(False), F.lit(None).cast("string"))
        for form in (whole, fenced, braces):
            # the pattern spares the parser, which fails by exception, most plain prose
            parsed = parsed.when(form.rlike(JSON_LOOK) & F.try_parse_json(form).isNotNull(), form)
        return parsed
    form = let(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), chosen)
    return F.get(F.filter(F.array(form), lambda f: f.rlike(r"^\s*\{")), 0)


def parse_responses(responses: DataFrame) -> DataFrame:
    """Adds `object_text` and the typed-later `answer`; rejects keep both null."""
    found = once(responses, "object_text", json_object(F.col("response_text")))
    return once(found, "answer", F.from_json("object_text", ANSWER))


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("object_text").isNull())


# --- stages: repair of single fields -----------------------------------------------------
def canonical_country(value: Column) -> Column:
    return let(F.trim(value), lambda tidy: F.coalesce(lookup(F.lower(tidy), COUNTRY_ALIASES), tidy))


def canonical_species(value: Column) -> Column:
    """First listed common name contained, else the text: trimmed if it is a binomial."""
    tidy = F.trim(value)
    binomial = tidy.rlike(r"(?U)^\p{Lu}\S*\s+\p{Ll}\S*$")
    common = let(F.lower(value), lambda v: first_contained(v, SPECIES_BY_COMMON_NAME))
    return F.coalesce(common, F.when(binomial, tidy), blank_to_null(value))


def to_bool(value: Column, default: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(text.isin("true", "1"), F.lit(True)).when(
        text.isin("false", "0"), F.lit(False)).otherwise(default)


def is_truthy(value: Column) -> Column:
    return F.coalesce(~F.lower(value).isin("false", "0", "0.0", "", "null", "[]", "{}"), F.lit(False))


# --- stage: claim rows --------------------------------------------------------------------
def build_claims(parsed: DataFrame, items: DataFrame) -> DataFrame:
    """Relevant answers joined with their item as claim rows.

    `claim_error` marks answers whose date, age or confidence has no valid value; the
    router sends those items back for another try.
    """
    a = F.col("answer")
    relevant = parsed.filter(F.col("object_text").isNotNull() & is_truthy(a["is_relevant"]))
    item = items.select(
        F.col("id").alias("raw_item_id"), "source_platform", "source_url",
        F.col("title").alias("item_title"), "author", F.col("published_at").cast("date")
        .alias("published_date"), F.col("dedup_key").alias("raw_item_key"))
    joined = relevant.join(item, "raw_item_id")
    text = {f: blank_to_null(a[f]) for f in ANSWER_FIELDS}
    given_date = F.try_to_date(text["incident_date"], "yyyy-MM-dd")
    age = text["victim_age"].try_cast("double").try_cast("int")
    confidence = text["confidence"].try_cast("double")
    error = (
        (text["incident_date"].isNotNull() & given_date.isNull())
        | (text["victim_age"].isNotNull() & age.isNull())
        | (text["confidence"].isNotNull() & confidence.isNull()))
    platform = F.col("source_platform")
    return joined.select(
        "response_id", "raw_item_id", "raw_item_key",
        F.coalesce(given_date, "published_date").alias("incident_date"),
        F.coalesce(text["location_description"], "item_title").alias("location_description"),
        F.coalesce(canonical_country(text["country"]), F.lit("Unknown")).alias("country"),
        a["state_province"].alias("state_province"), a["body_of_water"].alias("body_of_water"),
        F.lit("approximate").alias("location_precision"),
        F.coalesce(best_option(text["classification"], CLASSIFICATIONS), F.lit("not_confirmed"))
        .alias("classification"),
        F.coalesce(lookup(platform, PLATFORM_REPORT_SOURCE), F.lit("community"))
        .alias("report_source"),
        lookup(platform, PLATFORM_REPORT_PLATFORM).alias("report_platform"),
        canonical_species(text["shark_species"]).alias("shark_species_suspected"),
        best_option(text["victim_activity"], ACTIVITIES).alias("victim_activity"),
        best_option(text["victim_injury_severity"], SEVERITIES).alias("victim_injury_severity"),
        a["victim_name"].alias("victim_name"), age.alias("victim_age"),
        a["victim_sex"].alias("victim_sex"),
        to_bool(a["fatal"], F.lit(False)).alias("fatal"), a["description"].alias("description"),
        "source_url", F.col("item_title").alias("source_title"),
        F.col("author").alias("source_publisher"), F.col("published_date").alias("source_date"),
        F.coalesce(lookup(platform, PLATFORM_SOURCE_TYPE), F.lit("other")).alias("source_type"),
        F.coalesce(confidence, F.lit(DEFAULT_CONFIDENCE)).alias("confidence"),
        error.alias("claim_error"),
    )


# --- stage: correction overlay ---------------------------------------------------------------
def apply_corrections(claims: DataFrame, corrections: str = "corrections") -> DataFrame:
    """Lay a `map<string,string>` of corrections over each claim.

    Only permitted fields move.  A null map value sets a plain field to null; it never
    blanks an enumeration.
    """
    fix = F.col(corrections)

    def given(key: str) -> Column:
        return F.coalesce(F.map_contains_key(fix, key), F.lit(False))

    def value(key: str) -> Column:
        return F.try_element_at(fix, F.lit(key))

    new: dict[str, Column] = {}
    for field, options in (("classification", CLASSIFICATIONS),
                           ("victim_injury_severity", SEVERITIES), ("victim_activity", ACTIVITIES)):
        new[field] = F.coalesce(best_option(value(field), options), F.col(field))
    new["shark_species_suspected"] = F.when(
        given("shark_species"), canonical_species(value("shark_species"))
    ).otherwise(F.col("shark_species_suspected"))
    new["fatal"] = F.when(given("fatal"), to_bool(value("fatal"), F.col("fatal"))).otherwise(
        F.col("fatal"))
    for field in CORRECTABLE_TEXT_FIELDS:
        if field in claims.columns:
            kind = claims.schema[field].dataType
            new[field] = F.when(given(field), value(field).try_cast(kind)).otherwise(F.col(field))
    return claims.withColumns(new)


# --- routing ------------------------------------------------------------------------------------
def event_type(classification: Column, has_claim: Column) -> Column:
    return F.when(~has_claim, F.lit("news")).when(
        classification == "sighting", F.lit("sighting")).otherwise(F.lit("attack"))


def route(items: DataFrame) -> DataFrame:
    """Where each item of a run ends, as one ordered decision.

    Boolean inputs: `captured`, `should_process`, `relevant`, `extraction_error`,
    `has_claim`, `verification_error`, `verified` (an answer came), `is_duplicate_likely`,
    `is_valid`, `observation_recorded`; plus `confidence`, `verification_confidence`,
    `classification` and the `corrections` map.  A null flag counts as false.
    """
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))
    certain = F.coalesce("verification_confidence", F.lit(0.0)) >= INVALID_CERTAIN_CONFIDENCE
    refused = flag("verified") & ~flag("is_valid")
    decision = (
        F.when(~flag("captured"), "retry_capture")
        .when(~flag("should_process"), "seen")
        .when(~flag("relevant"), "not_relevant")
        .when(flag("extraction_error"), "retry_extraction")
        .when(~flag("has_claim"), "news_only")
        .when(F.col("confidence") < MIN_EXTRACTION_CONFIDENCE, "low_confidence")
        .when(flag("verification_error") & (F.col("confidence") < UNVERIFIED_OK_CONFIDENCE),
              "retry_verification")
        .when(flag("verified") & flag("is_duplicate_likely"), "duplicate")
        .when(refused & certain, "invalid")
        .when(~flag("observation_recorded"), "retry_observation")
        .otherwise("candidate"))
    routed = items.withColumn("route", decision)
    reached = F.col("route").isin("candidate", "retry_observation")
    downgrade = reached & refused & (F.col("classification") != "sighting")
    corrected = F.coalesce(
        F.when(reached & flag("verified"), best_option(
            F.try_element_at("corrections", F.lit("classification")), CLASSIFICATIONS)),
        F.when(downgrade, F.lit("unverified_report")), F.col("classification"))
    tried = F.col("confidence") >= MIN_EXTRACTION_CONFIDENCE
    past_gate = ~F.col("route").isin("retry_capture", "seen", "not_relevant", "retry_extraction",
                                     "news_only", "low_confidence")
    return routed.withColumns({
        "classification": corrected,
        "downgraded": downgrade,
        "verified": flag("verified") & past_gate & ~flag("verification_error"),
        "verification_error": flag("verification_error") & past_gate & tried,
    }).withColumn("event_type", F.when(F.col("route") == "not_relevant", F.lit("not_relevant"))
                  .otherwise(event_type(F.col("classification"), flag("has_claim"))))
