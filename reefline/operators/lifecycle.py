"""Submissions, reviews, partial updates and deletes as set operations over batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from reefline.constants import MAX_LENGTHS, REVIEWED_SOURCE_NOTE, UPDATABLE_FIELDS
from reefline.functions.frames import rank_within, top_per_key
from reefline.functions.text import blank_to_null
from reefline.operators import candidates as cand
from reefline.operators.batch import decide_batch
from reefline.operators.validate import check, incident_rules
from reefline.session import durable, written
from reefline.schemas import AUDIT, INCIDENTS, SOURCES, conform

AUTO_VERIFIED_ROLES = ["admin", "verified_contributor"]


# --- case numbers -------------------------------------------------------------------------
def highest_suffix(incidents: DataFrame, prefix: str = "CASE") -> DataFrame:
    """year, last_value: the largest number used per year among well-formed case numbers.

    Numbers beyond 64 bits are left out; no allocated number can meet them.
    """
    pattern = rf"^{prefix}-([0-9]{{4}})-([0-9]+)$"
    case = F.col("case_number")
    return incidents.filter(case.rlike(pattern)).groupBy(
        F.regexp_extract(case, pattern, 1).cast("int").alias("year")
    ).agg(F.max(F.regexp_extract(case, pattern, 2).try_cast("bigint")).alias("last_value"))


def case_number(prefix: str, year: Column, number: Column) -> Column:
    """At least four digits, more when needed."""
    return F.format_string(f"{prefix}-%d-%04d", year, number)


def allocate_case_numbers(new: DataFrame, incidents: DataFrame, counters: DataFrame,
                          order: list[str], prefix: str = "CASE") -> DataFrame:
    """Adds `case_number` to new rows (with `year`), in order, after the highest number used.

    A used number never returns, so the durable counter counts as well as the rows present.
    """
    used = highest_suffix(incidents, prefix).unionByName(counters.select("year", "last_value"))
    floor = used.groupBy("year").agg(F.max("last_value").alias("_floor"))
    ranked = rank_within(new, "year", order, "_rank")
    return ranked.join(floor, "year", "left").withColumn(
        "case_number", case_number(prefix, F.col("year").cast("int"), (
            F.coalesce("_floor", F.lit(0)) + F.col("_rank")).cast("bigint"))).drop("_floor", "_rank")


# --- attaching coverage --------------------------------------------------------------------
def attach_coverage(coverage: DataFrame, sources: DataFrame, report: str = "submission_id",
                    order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new source rows, audit rows) for reports that joined an existing incident.

    `coverage` has one row per report source with report, position and incident_id; a
    report without sources has one row with a null position.  URLs the incident holds, or
    got earlier in the batch (by `order`, else by report), are skipped; sources without a URL
    are always added.
    """
    given = coverage.filter(F.col("position").isNotNull())
    has_url = F.coalesce(F.length("source_url") > 0, F.lit(False))
    first = top_per_key(given.filter(has_url), ["incident_id", "source_url"],
                        [F.asc(order or report), F.asc("position"), F.asc("source_title"), F.asc("source_publisher")])
    held = sources.filter(has_url).select("incident_id", "source_url").join(
        first.select("incident_id", "source_url"), ["incident_id", "source_url"], "left_semi").distinct()
    added = first.join(held, ["incident_id", "source_url"], "left_anti").unionByName(
        given.filter(~has_url))
    label = F.coalesce(blank_to_null(F.col("source_publisher")), blank_to_null(F.col("source_url")),
                       blank_to_null(F.col("source_title")), F.lit("source"))
    # one note per report, with all its labels
    notes = added.groupBy("incident_id", report).agg(F.concat(
        F.lit("Merged duplicate coverage: "), F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("position", label.alias("l")))),
            lambda s: s["l"]), ", ")).alias("notes"))
    reports = coverage.select("incident_id", report).distinct()
    audit = reports.join(notes, ["incident_id", report], "left").select(
        "incident_id", report, F.lit("source_merged").alias("action"),
        F.coalesce("notes", F.lit("Duplicate submission (no new sources)")).alias("notes"))
    return added, audit


# --- submission batch -------------------------------------------------------------------------
def submit(submissions: DataFrame, submission_sources: DataFrame, incidents: DataFrame,
           sources: DataFrame, counters: DataFrame, year: int, prefix: str = "CASE",
           new_id: Column | None = None) -> dict[str, DataFrame]:
    """Apply a batch of submissions, in the order of submitted_at and submission_id.

    Returns `outcome` (submission, incident, case, how it was matched or `created`), the new
    `incidents` and `sources`, and `audit` rows.  Every submission looks at the stored incidents and
    at what the earlier ones of the batch made of them (see `batch.decide_batch`).
    """
    key = "submission_id"
    used = highest_suffix(incidents, prefix).unionByName(counters.select("year", "last_value"))
    floor = used.filter(F.col("year") == year).agg(F.max("last_value")).first()[0] or 0
    decided = durable(decide_batch(
        submissions, submission_sources, sources, incidents,
        lambda n: case_number(prefix, F.lit(year), (n + F.lit(floor)).cast("bigint")), key))
    own_id = new_id if new_id is not None else F.col(key)
    founders = submissions.join(
        decided.filter("matched_by = 'created'").select(key, "pos", "case_number"), key).withColumn("id", own_id)
    trusted = F.col("role").isin(AUTO_VERIFIED_ROLES)
    created = founders.withColumns({
        "verification_status": F.when(trusted, "verified").otherwise("pending"),
        "submitted_by": F.col("role"), "verified_by": F.when(trusted, F.col("role")),
        "verified_at": F.when(trusted, F.col("submitted_at")).cast("timestamp_ntz"),
        "date_precision": F.coalesce("date_precision", F.lit("exact")),
        "fatal": F.coalesce("fatal", F.lit(False)),
        "updated_at": F.col("submitted_at")})
    made = founders.select(F.col("pos").alias("founder"), F.col("id").alias("_made"))
    outcome = decided.join(made, "founder", "left").select(
        key, "pos", F.coalesce("incident_id", "_made").alias("incident_id"), "case_number", "matched_by")
    attached = outcome.filter("matched_by <> 'created'")
    own_sources = submission_sources.join(outcome.filter("matched_by = 'created'").select(key, "incident_id"), key).drop(key)
    known = sources.select("incident_id", "source_url").unionByName(own_sources.select("incident_id", "source_url"))
    coverage = attached.select(key, "pos", "incident_id").join(submission_sources, key, "left")
    added, notes = attach_coverage(coverage, known, key, "pos")
    audit = created.select(
        F.col("id").alias("incident_id"), key, F.lit("created").alias("action"),
        F.when(trusted, "auto-verified submission").otherwise("submitted").alias("notes")
    ).unionByName(notes)
    return {
        "outcome": outcome.drop("pos"),
        "incidents": conform(created, INCIDENTS),
        "sources": conform(own_sources.unionByName(added, allowMissingColumns=True), SOURCES),
        "audit": audit,
    }


# --- review of submissions -----------------------------------------------------------------------
def review(incidents: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Apply verify and reject decisions (decision_id, incident_id, action, decided_at, ...).

    Verifying a verified incident is an error, judged against the decision before it, which
    is found by joining neighbouring ranks rather than by walking an incident's history.
    """
    ranked = rank_within(decisions.filter(F.col("action").isin("verify", "reject")), "incident_id",
                         ["decided_at", "decision_id"], "rank")
    before = ranked.select("incident_id", (F.col("rank") + 1).alias("rank"), F.when(
        F.col("action") == "verify", "verified").otherwise("rejected").alias("_before"))
    status = incidents.select(F.col("id").alias("incident_id"), F.col("verification_status")
                              .alias("_stored"))
    judged = ranked.join(before, ["incident_id", "rank"], "left").join(status, "incident_id", "left")
    error = F.when(F.col("_stored").isNull(), "Incident not found").when(
        (F.col("action") == "verify") & (F.coalesce("_before", "_stored") == "verified"),
        "Already verified")
    judged = judged.withColumn("error", error)
    done = judged.filter(F.col("error").isNull())
    outcome = F.when(F.col("action") == "verify", "verified").otherwise("rejected")
    last = done.groupBy("incident_id").agg(
        F.max_by(F.struct(outcome.alias("status"), "decided_by", "decided_at"), "rank").alias("d"))
    joined = incidents.join(last.withColumnRenamed("incident_id", "id"), "id", "left")
    hit = F.col("d").isNotNull()
    updated = joined.withColumns({
        "verification_status": F.coalesce("d.status", "verification_status"),
        "verified_by": F.when(hit, F.col("d.decided_by")).otherwise(F.col("verified_by")),
        "verified_at": F.when(hit, F.col("d.decided_at")).otherwise(F.col("verified_at")),
    }).select(*incidents.columns)
    audit = conform(done.select(
        "incident_id", outcome.alias("action"), F.col("decided_by").alias("changed_by"),
        F.col("decided_at").alias("changed_at"), "notes"), AUDIT)
    errors = judged.filter(F.col("error").isNotNull()).select(
        "decision_id", "incident_id", "action", "error")
    return {"incidents": updated, "audit": audit, "errors": errors}


# --- review of candidates -------------------------------------------------------------------------
PAYLOAD = T.StructType(
    [T.StructField(f.name, f.dataType, True) for f in INCIDENTS.fields
     if f.name in (*MAX_LENGTHS, "incident_date", "incident_time", "classification", "victim_age",
                   "fatal", "longitude", "latitude")]
    + [T.StructField(n, T.StringType(), True)
       for n in ("source_type", "source_url", "source_title", "source_publisher")]
    + [T.StructField("source_date", T.DateType(), True)])


def judge_candidates(candidates: DataFrame, decisions: DataFrame, observations: DataFrame,
                     documents: DataFrame) -> DataFrame:
    """The first decision per candidate with its latest observation and any error.

    `decisions` has candidate_id, action (publish or reject), decided_at, decided_by, notes.
    Later decisions on the same candidate find it reviewed already.
    """
    # one row per candidate carries all there is to judge by; its payload is read and checked once
    first = decisions.groupBy(F.col("candidate_id").alias("id")).agg(
        F.min(F.struct("decided_at", "decision_id")).alias("_first"))
    latest = cand.with_latest(candidates.join(first, "id"), observations, documents,
                              ["id", "event_type", "payload"], ["source_url", "title", "source_name"])
    parsed = latest.withColumn("p", F.from_json("latest.payload", PAYLOAD)).select(
        F.col("id").alias("candidate_id"), F.col("status").alias("_status"), "_first", "latest", "source", "p.*")
    shaped = parsed.withColumns({
        "fatal": F.coalesce("fatal", F.lit(False)),
        "date_precision": F.coalesce("date_precision", F.lit("exact")),
        "location_precision": F.coalesce("location_precision", F.lit("exact")),
        "verification_status": F.lit("verified")})
    checked = check(shaped, incident_rules()).withColumn("_ok", F.size("reasons") == 0).drop("reasons")
    rows = decisions.join(checked, "candidate_id", "left").withColumn(
        "late", ~F.struct("decided_at", "decision_id").eqNullSafe(F.col("_first")))
    publish = F.col("action") == "publish"
    error = (
        F.when(F.col("_status").isNull(), "Incident candidate not found")
        .when(F.col("late") | (F.col("_status") != "needs_review"), "Candidate has already been reviewed")
        .when(publish & F.col("latest").isNull(), "Candidate has no supporting observation")
        .when(publish & ~F.col("_ok"), "Candidate data is not publishable"))
    return rows.withColumn("error", error).drop("_first", "_ok")


def candidate_submissions(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Published candidates as (submissions, submission_sources); the key is the candidate id."""
    good = judged.filter((F.col("action") == "publish") & F.col("error").isNull())
    fields = [f.name for f in PAYLOAD.fields if not f.name.startswith("source_")]
    point = F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    submissions = good.select(
        F.col("candidate_id").alias("submission_id"),
        *[F.col(f) for f in fields if f not in ("longitude", "latitude")],
        F.when(point, F.col("longitude")).alias("longitude"),
        F.when(point, F.col("latitude")).alias("latitude"),
        F.lit("admin").alias("role"), F.col("decided_at").alias("submitted_at"))
    sources = good.select(
        F.col("candidate_id").alias("submission_id"), F.lit(0).alias("position"),
        F.coalesce(blank_to_null(F.col("source_type")), F.lit("other")).alias("source_type"),
        F.coalesce(blank_to_null(F.col("source_url")), "source.source_url").alias("source_url"),
        F.coalesce(blank_to_null(F.col("source_title")), "source.title").alias("source_title"),
        F.coalesce(blank_to_null(F.col("source_publisher")), "source.source_name")
        .alias("source_publisher"), "source_date", F.lit(REVIEWED_SOURCE_NOTE).alias("source_notes"))
    return submissions, sources


def review_candidates(judged: DataFrame, candidates: DataFrame, outcome: DataFrame) -> DataFrame:
    """Candidates after review; `outcome` maps submission_id (candidate) to incident_id."""
    done = judged.filter(F.col("error").isNull()).join(
        outcome.select(F.col("submission_id").alias("candidate_id"), "incident_id"),
        "candidate_id", "left").select(F.col("candidate_id").alias("id"), F.struct(
            F.when(F.col("action") == "publish", "published").otherwise("rejected").alias("status"),
            "incident_id", "notes", "decided_by", "decided_at").alias("d"))
    joined = candidates.join(done, "id", "left")
    hit = F.col("d").isNotNull()
    return joined.withColumns({
        "status": F.coalesce("d.status", "status"),
        "canonical_incident_id": F.coalesce("d.incident_id", "canonical_incident_id"),
        "review_notes": F.when(hit, F.col("d.notes")).otherwise(F.col("review_notes")),
        "reviewed_by": F.when(hit, F.col("d.decided_by")).otherwise(F.col("reviewed_by")),
        "reviewed_at": F.when(hit, F.col("d.decided_at")).otherwise(F.col("reviewed_at")),
    }).select(*candidates.columns)


def link_reviewed_news(news: DataFrame, judged: DataFrame, observations: DataFrame,
                       outcome: DataFrame) -> DataFrame:
    """News of every supporting source of a published candidate points to its incident.

    A source supporting several published candidates follows the decision made last.
    """
    published = judged.filter((F.col("action") == "publish") & F.col("error").isNull()).join(
        outcome.select(F.col("submission_id").alias("candidate_id"), "incident_id"), "candidate_id"
    ).select("candidate_id", "incident_id", "country", F.col("latest.event_type").alias("event_type"),
             "decided_at", "decision_id")
    support = observations.select("candidate_id", "source_document_id").distinct()
    links = support.join(published, "candidate_id").groupBy("source_document_id").agg(F.max_by(
        F.struct("incident_id", "event_type", "country"), F.struct("decided_at", "decision_id"))
        .alias("l"))
    joined = news.join(links, "source_document_id", "left")
    hit = F.col("l").isNotNull()
    return joined.withColumns({
        "promoted_incident_id": F.when(hit, F.col("l.incident_id")).otherwise(F.col("promoted_incident_id")),
        "event_type": F.when(hit, F.col("l.event_type")).otherwise(F.col("event_type")),
        "country": F.when(hit, F.col("l.country")).otherwise(F.col("country")),
    }).select(*news.columns)


def publish_candidates(candidates: DataFrame, decisions: DataFrame, observations: DataFrame, documents: DataFrame,
                       news: DataFrame, incidents: DataFrame, sources: DataFrame, counters: DataFrame, year: int,
                       prefix: str = "CASE", new_id: Column | None = None) -> dict[str, DataFrame]:
    """Review decisions carried through to the end, in the order they were made.

    Every published candidate is submitted: it joins the incident it matches, stored or founded by a
    candidate published before it, or becomes one.  Returns `judged` (each decision with its error),
    `candidates` and `news` as they are afterwards, and the new `incidents`, `sources` and `audit`
    rows.  `new_id` makes the id of a new incident from `submission_id`, the candidate's id.
    """
    judged = written(judge_candidates(candidates, decisions, observations, documents), "judged")
    submissions, given = candidate_submissions(judged)
    made_id = new_id if new_id is not None else F.xxhash64("submission_id")
    made = submit(submissions, given, incidents, sources, counters, year, prefix, made_id)
    outcome = durable(made["outcome"])
    return {
        "judged": judged, "outcome": outcome,
        "candidates": review_candidates(judged, candidates, outcome),
        "news": link_reviewed_news(news, judged, observations, outcome),
        "incidents": made["incidents"], "sources": made["sources"], "audit": made["audit"],
    }


# --- partial update and delete ----------------------------------------------------------------------
def partial_update(incidents: DataFrame, patches: DataFrame) -> DataFrame:
    """Lay `map<string,string>` patches over incidents: absent keeps, null clears.

    Several patches of one incident (incident_id, seq, patch) apply in order, per field.
    """
    fields = patches.select("incident_id", "seq", F.explode("patch").alias("field", "value")).filter(
        F.col("field").isin(UPDATABLE_FIELDS))
    last = fields.groupBy("incident_id", "field").agg(
        F.max(F.struct("seq", "value"))["value"].alias("value"))
    # at most one entry per updatable field
    merged = last.groupBy(F.col("incident_id").alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_patch"))
    joined = incidents.join(merged, "id", "left")
    new = {}
    for f in UPDATABLE_FIELDS:
        kind = incidents.schema[f].dataType
        set_ = F.coalesce(F.map_contains_key("_patch", f), F.lit(False))
        new[f] = F.when(set_, F.try_element_at("_patch", F.lit(f)).try_cast(kind)).otherwise(F.col(f))
    return joined.withColumns(new).select(*incidents.columns)


def delete_incidents(ids: DataFrame, incidents: DataFrame, sources: DataFrame, audit: DataFrame,
                     news: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """Delete with its consequences: sources and audit go, news and candidates lose the link."""
    gone = ids.select(F.col("id").alias("_id")).distinct()

    def without(df: DataFrame, column: str) -> DataFrame:
        return df.join(gone, df[column] == gone["_id"], "left_anti")

    def unlinked(df: DataFrame, column: str) -> DataFrame:
        return df.join(gone, df[column] == gone["_id"], "left").withColumn(
            column, F.when(F.col("_id").isNull(), F.col(column))).select(*df.columns)
    return {
        "incidents": without(incidents, "id"), "sources": without(sources, "incident_id"),
        "audit": without(audit, "incident_id"), "news": unlinked(news, "promoted_incident_id"),
        "candidates": unlinked(candidates, "canonical_incident_id"),
    }
