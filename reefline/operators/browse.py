"""Browse side: filters, ordering, paging, nested sources and the public view."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from reefline.constants import PUBLIC_FIELDS, PUBLIC_SOURCE_FIELDS, SORT_FIELDS
from reefline.functions.frames import pg_order, rank_within
from reefline.functions.text import contains_ci, csv_values
from reefline.operators.search import matches_all_tokens



# --- predicates --------------------------------------------------------------------
def in_list(column: str, csv: str) -> Column:
    return F.col(column).isin(csv_values(csv))


def species_is(name: str) -> Column:
    return (F.col("shark_species_confirmed") == name) | (F.col("shark_species_suspected") == name)


def date_range(column: str, date_from: str | None, date_to: str | None) -> Column:
    """Inclusive calendar range; a missing end is open."""
    test = F.lit(True)
    if date_from:
        test = test & (F.col(column) >= F.lit(date.fromisoformat(date_from)))
    if date_to:
        test = test & (F.col(column) <= F.lit(date.fromisoformat(date_to)))
    return test


def captured_range(column: str, date_from: str | None, date_to: str | None) -> Column:
    """News range on the capture time; the end date means its midnight."""
    def midnight(text: str) -> Column:
        return F.lit(datetime.fromisoformat(text).isoformat(" ")).cast("timestamp_ntz")
    test = F.lit(True)
    if date_from:
        test = test & (F.col(column) >= midnight(date_from))
    if date_to:
        test = test & (F.col(column) <= midnight(date_to))
    return test


def incident_search(text: str) -> Column:
    words = F.concat_ws(
        " ", *[F.coalesce(F.col(c), F.lit("")) for c in
               ("location_description", "description", "country", "victim_name")]
    )
    return matches_all_tokens(words, text) | contains_ci(F.col("case_number"), text)


def filter_incidents(
    df: DataFrame, *, classification: str | None = None, country: str | None = None,
    species: str | None = None, fatal: bool | None = None, date_from: str | None = None,
    date_to: str | None = None, activity: str | None = None, severity: str | None = None,
    report_source: str | None = None, search: str | None = None,
) -> DataFrame:
    """Verified incidents meeting every given condition."""
    df = df.filter(F.col("verification_status") == "verified")
    for column, csv in (("classification", classification), ("country", country),
                        ("victim_activity", activity), ("victim_injury_severity", severity),
                        ("report_source", report_source)):
        if csv:
            df = df.filter(in_list(column, csv))
    if species:
        df = df.filter(species_is(species))
    if fatal is not None:
        df = df.filter(F.col("fatal") == fatal)
    if date_from or date_to:
        df = df.filter(date_range("incident_date", date_from, date_to))
    if search:
        df = df.filter(incident_search(search))
    return df


def by_id(df: DataFrame, incident_id: int | str, *, public: bool) -> DataFrame:
    found = df.filter(F.col("id") == F.lit(incident_id))
    return found.filter(F.col("verification_status") == "verified") if public else found


# --- order and pages ---------------------------------------------------------------
def incident_order(sort: str = "incident_date", order: str = "desc") -> list[Column]:
    """Allow-listed sort with the id as tie-break; anything but `desc` ascends."""
    field = sort if sort in SORT_FIELDS else "incident_date"
    return [pg_order(field, order == "desc"), F.asc("id")]


def page_of(df: DataFrame, order: list[Column], page: int = 1, per_page: int = 50) -> DataFrame:
    """One offset page; planned as a distributed top-n, meant for shallow pages."""
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def page_after(df: DataFrame, sort: str, order: str, last_value, last_id,
               per_page: int = 50) -> DataFrame:
    """Keyset page for any depth: the rows after (last_value, last_id) in the same order.

    The bound is an ordinary filter, so the work does not grow with the page number.
    """
    field = sort if sort in SORT_FIELDS else "incident_date"
    column, tie = F.col(field), F.col("id") > F.lit(last_id)
    descending = order == "desc"
    if last_value is None:
        beyond = (column.isNull() & tie) | (column.isNotNull() if descending else F.lit(False))
    else:
        last = F.lit(last_value)
        step = (column < last) if descending else ((column > last) | column.isNull())
        beyond = step | ((column == last) & tie)
    return df.filter(beyond).orderBy(*incident_order(sort, order)).limit(per_page)


def page_meta(df: DataFrame, page: int = 1, per_page: int = 50) -> DataFrame:
    total = F.count(F.lit(1))
    return df.agg(total.alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(per_page).alias("per_page"),
        F.ceil(F.col("total") / F.lit(per_page)).alias("pages"),
    )


def review_queue(incidents: DataFrame, page: int = 1, per_page: int = 25) -> DataFrame:
    waiting = incidents.filter(F.col("verification_status").isin("pending", "needs_review"))
    return page_of(waiting, [pg_order("submitted_at", True), F.asc("id")], page, per_page)


def audit_page(audit: DataFrame, incident_id=None, page: int = 1, per_page: int = 50) -> DataFrame:
    if incident_id is not None:
        audit = audit.filter(F.col("incident_id") == F.lit(incident_id))
    return page_of(audit, [pg_order("changed_at", True), F.asc("id")], page, per_page)


# --- nested sources and disclosure ---------------------------------------------------
def nest_sources(sources: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """incident_id, sources[] in the order of their ids: one row per incident, so one array each.

    Where an incident may have more sources than a row should hold, read `source_list` instead.
    """
    fields = fields or [c for c in sources.columns if c != "incident_id"]
    item = F.struct(F.col("id").alias("_order"), *[F.col(f) for f in fields if f != "id"],
                    *([F.col("id")] if "id" in fields else []))
    packed = sources.groupBy("incident_id").agg(
        F.sort_array(F.collect_list(item)).alias("sources")
    )
    return packed.withColumn("sources", F.transform(
        "sources", lambda s: F.struct(*[s[f].alias(f) for f in fields])))


def source_list(sources: DataFrame) -> DataFrame:
    """The sources as a table of their own, numbered within their incident in the order of their ids."""
    return rank_within(sources, "incident_id", ["id"], "position")


def attach_sources(incidents: DataFrame, sources: DataFrame,
                   fields: list[str] | None = None) -> DataFrame:
    """Each incident with its sources; incidents without any keep an empty array."""
    nested = nest_sources(
        sources.join(incidents.select(F.col("id").alias("incident_id")), "incident_id",
                     "left_semi"), fields)
    joined = incidents.join(nested, incidents["id"] == nested["incident_id"], "left").drop(
        "incident_id")
    return joined.withColumn(
        "sources", F.coalesce("sources", F.array().cast(nested.schema["sources"].dataType)))


def disclosed_point(column: str) -> Column:
    return F.when(F.col("location_precision") == "exact", F.bround(column, 3)).otherwise(
        F.bround(column, 2))


def public_view(incidents: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Verified rows, allow-listed columns, coarsened coordinates, safe source fields."""
    shown = incidents.filter(F.col("verification_status") == "verified").select(*[
        disclosed_point(c).alias(c) if c in ("longitude", "latitude") else F.col(c)
        for c in PUBLIC_FIELDS
    ])
    return shown if sources is None else attach_sources(shown, sources, PUBLIC_SOURCE_FIELDS)
