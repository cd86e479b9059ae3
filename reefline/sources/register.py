"""Historic register import: wide text rows to typed incidents in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reefline.constants import (
    MONTH_NAMES, REGISTER_ACTIVITIES, REGISTER_CLASSES, REGISTER_COUNTRIES,
    REGISTER_DEFAULT_NOTE, REGISTER_PUBLISHER, REGISTER_SEVERITY_WORDS, REGISTER_TITLE,
    REGISTER_YEARS, SPECIES_BY_COMMON_NAME,
)
from reefline.functions.frames import once
from reefline.functions.text import any_term, blank_to_null, first_contained, let, lookup, title_case

# the first columns of the register, in file order
COLUMNS = [
    "date_text", "year_text", "type_text", "country_text", "state_text", "location_text",
    "activity_text", "name_text", "sex_text", "age_text", "injury_text", "fatal_text",
    "time_text", "species_text", "source_text",
]
MIN_COLUMNS = 14


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """CSV extract of the register.  Rows with too few columns are dropped."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in COLUMNS] +
                          [T.StructField("_bad", T.StringType(), True)])
    rows = (
        spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE")
        .option("multiLine", "false").option("columnNameOfCorruptRecord", "_bad").csv(path)
    )
    fields = F.size(F.split("_bad", ","))
    return rows.filter(F.col("_bad").isNull() | (fields >= MIN_COLUMNS)).drop("_bad")


def _digits(text: Column, pattern: str, group: int = 1) -> Column:
    """A short run of digits as a number; null, not a failed cast, where there is none."""
    return blank_to_null(F.regexp_extract(text, pattern, group)).cast("int")


def _text(name: str) -> Column:
    return F.coalesce(F.trim(name), F.lit(""))


def _month_number(word: Column) -> Column:
    """Full name or three-letter abbreviation."""
    table = {m: str(i) for i, m in enumerate(MONTH_NAMES, 1)}
    table.update({m[:3]: str(i) for i, m in enumerate(MONTH_NAMES, 1)})
    return lookup(F.lower(word), table).cast("int")


def _real_date(year: Column, month: Column, day: Column) -> Column:
    """Calendar date or null, never an error."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _date_and_precision(text: Column, year: Column) -> Column:
    """Day and month, else the first month named, else the year alone."""
    def pair(when: Column, precision: str) -> Column:
        return F.when(when.isNotNull(), F.struct(when.alias("date"), F.lit(precision).alias("precision")))

    def day_and_month(plain: Column, pattern: str, day_group: int, month_group: int) -> Column:
        found = F.struct(
            _digits(plain, pattern, day_group).alias("day"),
            _month_number(F.regexp_extract(plain, pattern, month_group)).alias("month"))
        return let(found, lambda f: F.when(
            f["day"].between(1, 31) & f["month"].isNotNull(), _real_date(year, f["month"], f["day"])))

    plain = F.regexp_replace(text, r"(?i)(\d+)(st|nd|rd|th)", "$1")
    exact = let(plain, lambda p: F.coalesce(
        day_and_month(p, r"^(\d{1,2})\s+(\w+)", 1, 2), day_and_month(p, r"^(\w+)\s+(\d{1,2})", 2, 1)))
    # full names first, then abbreviations, each in calendar order
    names = {m: str(i) for i, m in enumerate(MONTH_NAMES, 1)}
    names.update({m[:3]: str(i) for i, m in enumerate(MONTH_NAMES, 1)})
    month = first_contained(F.lower(text), names).cast("int")
    nothing = F.struct(F.lit(None).cast("date").alias("date"), F.lit("year").alias("precision"))
    return F.when(F.length(text) == 0, nothing).otherwise(F.coalesce(
        let(exact, lambda d: pair(d, "exact")),
        let(_real_date(year, month, F.lit(1)), lambda d: pair(d, "month")),
        pair(F.make_date(year, F.lit(1), F.lit(1)), "year")))


def _time(text: Column) -> Column:
    def clock(pattern: str) -> Column:
        clock_parts = F.array(_digits(text, pattern, 1), _digits(text, pattern, 2))
        return let(clock_parts, lambda p: F.when(
            p[0].between(0, 23) & p[1].between(0, 59),
            F.format_string("%02d:%02d:00", p[0], p[1])))
    return F.coalesce(clock(r"(?i)^(\d{2})(\d{2})\s*h"), clock(r"^(\d{1,2}):(\d{2})"))


def _severity(injury: Column, fatal: Column) -> Column:
    lower = F.lower(injury)
    chain = F.when(fatal, F.lit("fatal")).when(F.length(injury) == 0, F.lit(None))
    for level, words in REGISTER_SEVERITY_WORDS.items():
        chain = chain.when(any_term(lower, words), F.lit(level))
    return chain.otherwise(F.lit("moderate"))


def _country(text: Column) -> Column:
    known = lookup(F.upper(text), REGISTER_COUNTRIES)
    return F.when(F.length(text) == 0, F.lit("Unknown")).otherwise(
        F.coalesce(known, title_case(text)))


def _species(text: Column) -> Column:
    lower = F.lower(text)
    unsure = any_term(lower, ["unknown", "involvement", "not confirmed"])
    return F.when(~unsure, let(lower, lambda t: first_contained(t, SPECIES_BY_COMMON_NAME)))


def import_register(rows: DataFrame, year_from: int = REGISTER_YEARS[0],
                    year_to: int = REGISTER_YEARS[1]) -> DataFrame:
    """Typed incidents of the year range, each with its one source stub as columns."""
    for name in COLUMNS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    years = _digits(F.trim("year_text"), r"^(\d{4})(?:\.0*)?$")
    dated = rows.withColumn("_year", years).filter(
        F.col("_year").between(max(year_from, REGISTER_YEARS[0]), min(year_to, REGISTER_YEARS[1])))
    dated = once(dated, "_when", _date_and_precision(_text("date_text"), F.col("_year")))
    dated = once(dated, "_species", _species(_text("species_text")))
    activity, injury, species = _text("activity_text"), _text("injury_text"), _text("species_text")
    location, state, name = _text("location_text"), _text("state_text"), _text("name_text")
    fatal = F.startswith(F.upper(_text("fatal_text")), F.lit("Y"))
    country = _country(_text("country_text"))
    act = F.lower(activity)
    found = F.col("_species")
    age = _digits(_text("age_text"), r"^(\d{1,9})")
    size = F.trim(F.regexp_extract(
        species, r"(?iU)(\d+[.\d]*\s*(?:ft|foot|feet|m|meter|metre|cm)[\w\s]*)", 1))
    sentence = F.concat_ws(
        " ",
        F.when(F.length(activity) > 0, F.concat(F.lit("Victim was "), act, F.lit("."))),
        F.when(F.length(injury) > 0, F.concat(F.lit("Injury: "), injury, F.lit("."))),
        F.when((F.length(species) > 0) & ~F.contains(F.lower(species), F.lit("unknown")),
               F.concat(F.lit("Species: "), species, F.lit("."))))
    fallback_place = F.regexp_replace(
        F.concat(state, F.lit(", "), country), r"^[, ]+|[, ]+$", "")
    keep = [c for c in rows.columns if c not in COLUMNS]
    return dated.select(
        *keep, "_when", F.col("_year").alias("register_year"),
        _time(_text("time_text")).alias("incident_time"),
        F.coalesce(blank_to_null(location), fallback_place).alias("location_description"),
        country.alias("country"),
        F.when(~F.lower(state).isin("", "n/a"), state).alias("state_province"),
        F.coalesce(lookup(F.lower(_text("type_text")), REGISTER_CLASSES),
                   F.lit("not_confirmed")).alias("classification"),
        F.lit("isaf").alias("report_source"),
        found.alias("shark_species_suspected"), blank_to_null(size).alias("shark_size_estimate"),
        F.when(found.isNotNull(), F.lit("witness")).alias("species_identification_method"),
        F.coalesce(lookup(act, REGISTER_ACTIVITIES), first_contained(act, REGISTER_ACTIVITIES))
        .alias("victim_activity"),
        _severity(injury, fatal).alias("victim_injury_severity"),
        blank_to_null(injury).alias("victim_injury_description"),
        F.when(~F.lower(name).isin("", "unknown", "n/a"), name).alias("victim_name"),
        F.when(age.between(0, 120), age).alias("victim_age"),
        lookup(F.upper(_text("sex_text")), {"M": "male", "F": "female"}).alias("victim_sex"),
        fatal.alias("fatal"), blank_to_null(sentence).alias("description"),
        F.lit("approximate").alias("location_precision"),
        F.lit("other").alias("source_type"), F.lit(REGISTER_TITLE).alias("source_title"),
        F.lit(REGISTER_PUBLISHER).alias("source_publisher"),
        F.coalesce(F.concat(F.lit("GSAF source: "), blank_to_null(_text("source_text"))),
                   F.lit(REGISTER_DEFAULT_NOTE)).alias("source_notes"),
    ).withColumn("incident_date", F.col("_when.date")).withColumn(
        "date_precision", F.col("_when.precision")).drop("_when")
