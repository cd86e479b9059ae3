"""Entity resolution: matching incoming reports, exact clusters, blocked near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from reefline.constants import (
    BLOCK_MAX_SIZE, BLOCK_WINDOW_DAYS, ENRICH_FIELDS, HEADLINE_MIN_CHARS, HEADLINE_PREFIX_CHARS,
    MATCH_RADIUS_M,
)
from reefline.functions.frames import once, top_per_key
from reefline.functions.geo import haversine_km, match_block, match_cell
from reefline.functions.text import headline_text, is_specific
from reefline.operators.normalize import json_object
from reefline.session import durable, written

# Matching always reduces the stored side to its lowest case per key before the join, so a
# URL, headline or spot shared by very many incidents still meets each report once.


def _live(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("verification_status") != "rejected")


def _sources_of_live(sources: DataFrame, incidents: DataFrame) -> DataFrame:
    ids = _live(incidents).select(F.col("id").alias("incident_id"), "case_number")
    return sources.join(ids, "incident_id").withColumnRenamed("id", "source_id")


def _best(matches: DataFrame, report: str) -> DataFrame:
    return matches.groupBy(report).agg(F.min("hit").alias("hit")).select(
        report, F.col("hit.id").alias("incident_id"), F.col("hit.case_number").alias("case_number"))


def _kept(reports: DataFrame, report: str, *columns: str) -> DataFrame:
    """The reports' sources, written once: each step asks for them twice, to reduce the stored side and to meet it."""
    return written(reports.select(report, *columns), "report_sources")


def match_by_url(reports: DataFrame, sources: DataFrame, incidents: DataFrame,
                 report: str = "submission_id") -> DataFrame:
    """report -> lowest case among incidents already holding one of its URLs.

    `reports` has one row per report source.
    """
    return _by_url(_kept(reports, report, "source_url"), sources, incidents, report)


def _by_url(reports: DataFrame, sources: DataFrame, incidents: DataFrame, report: str) -> DataFrame:
    wanted = reports.filter(F.length("source_url") > 0).select(report, "source_url")
    # the stored side first loses what no report asks for
    asked = sources.select("id", "incident_id", "source_url").join(wanted.select("source_url"), "source_url", "left_semi")
    known = _sources_of_live(asked, incidents).groupBy("source_url").agg(
        F.min(F.struct("case_number", F.col("incident_id").alias("id"))).alias("hit"))
    return _best(wanted.join(known, "source_url"), report)


ODD_BLANKS = r"(?U)^\s|\s\s|[\s&&[^ ]]"


def _headlined(rows: DataFrame) -> DataFrame:
    """Rows with a headline that says enough to be matched."""
    return once(rows, "headline", headline_text(F.col("source_title"))).filter(is_specific(F.col("headline")))


def _stored_headlines(sources: DataFrame, incidents: DataFrame, wanted: DataFrame) -> DataFrame:
    """headline, among the wanted ones -> lowest case whose sources show it in the searchable form.

    Equal headlines are not enough: a source of the same incident must also start, letter
    for letter, with the first 80 characters.  Nearly always it is the same source; the few
    headlines with odd blanks are looked up among the incident's other titles.
    """
    title = F.col("source_title")
    titled = sources.select("id", "incident_id", "source_title").filter(title.isNotNull())
    direct = F.startswith(F.lower(title), F.substring("headline", 1, HEADLINE_PREFIX_CHARS))
    # only odd white space can make a title differ from its own headline: a small remainder
    shown = _headlined(titled).select("id", "incident_id", "headline", F.when(direct, True).when(
        title.rlike(ODD_BLANKS), False).alias("direct"))
    live = _sources_of_live(shown.join(wanted, "headline", "left_semi"), incidents)
    # one row per headline, and one per odd one and incident; written first, so that the titles of
    # these few incidents are found without a shuffle of all titles.  Rows that are neither are left
    # out afterwards: a filter before would judge each title twice
    found = written(live.groupBy("headline", "direct", F.when(~F.col("direct"), F.col("incident_id")).alias("odd")).agg(
        F.min(F.struct("case_number", F.col("incident_id").alias("id"))).alias("hit")), "stored_headlines")
    odd = found.filter("NOT direct").select(
        "headline", F.col("odd").alias("incident_id"), F.substring("headline", 1, HEADLINE_PREFIX_CHARS).alias("prefix"), "hit")
    # prefixes have 30..80 characters: offer each title of those incidents at every length
    other = titled.join(odd.select("incident_id").distinct(), "incident_id", "left_semi").select(
        "incident_id", F.explode(F.transform(
            F.sequence(F.lit(HEADLINE_MIN_CHARS), F.lit(HEADLINE_PREFIX_CHARS)),
            lambda n: F.substring(F.lower("source_title"), F.lit(1), n))).alias("prefix")).distinct()
    backed = odd.join(other, ["incident_id", "prefix"], "left_semi").select("headline", "hit")
    plain = found.filter("direct").select("headline", "hit")
    return plain.unionByName(backed).groupBy("headline").agg(F.min("hit").alias("hit"))


def match_by_headline(reports: DataFrame, sources: DataFrame, incidents: DataFrame,
                      report: str = "submission_id") -> DataFrame:
    return _by_headline(_kept(reports, report, "source_title"), sources, incidents, report)


def _by_headline(reports: DataFrame, sources: DataFrame, incidents: DataFrame, report: str) -> DataFrame:
    wanted = _headlined(reports).select(report, "headline")
    return _best(wanted.join(_stored_headlines(sources, incidents, wanted.select("headline")), "headline"), report)


def contradicts(a_age: Column, b_age: Column, a_sex: Column, b_sex: Column) -> Column:
    """Both sides known and different; an unknown never contradicts."""
    return F.coalesce(a_age != b_age, F.lit(False)) | F.coalesce(a_sex != b_sex, F.lit(False))


SIGNATURE = ["incident_date", "classification", "longitude", "latitude", "victim_age", "victim_sex"]


def near_signatures(asking: DataFrame, holding: DataFrame) -> DataFrame:
    """r, h: signatures (column `s`) of one date and class within the radius whose victims do not contradict.

    Cells of about 222 m turn the radius into an equi-join on date, class and cell.
    """
    where = ["date", "class", "cell"]
    at = lambda rows, cell: rows.withColumns({
        "date": F.col("s.incident_date"), "class": F.col("s.classification"), "cell": cell})
    left = at(asking, F.explode(match_block(F.col("s.latitude"), F.col("s.longitude")))).select("r", *where, F.col("s").alias("a"))
    right = at(holding, match_cell(F.col("s.latitude"), F.col("s.longitude"))).select("h", *where, F.col("s").alias("b"))
    close = haversine_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude")) * 1000 <= MATCH_RADIUS_M
    return left.join(right, where).filter(close & ~contradicts(
        F.col("b.victim_age"), F.col("a.victim_age"), F.col("b.victim_sex"), F.col("a.victim_sex"))).select("r", "h")


def match_by_place(reports: DataFrame, incidents: DataFrame,
                   report: str = "submission_id") -> DataFrame:
    """Same date and class within 150 m, victim not contradicting, lowest case.

    Both sides first collapse to distinct signatures; cells of about 222 m turn the radius
    into an equi-join on date, class and cell.
    """
    placed = F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    asked = reports.filter(
        placed & (F.col("date_precision") == "exact") & F.col("incident_date").isNotNull())
    spots = asked.select(*SIGNATURE).distinct().withColumn("r", F.struct(*SIGNATURE)).withColumn(
        "cell", F.explode(match_block(F.col("latitude"), F.col("longitude")))).select(
        "incident_date", "classification", "cell", "r")
    where = ["incident_date", "classification", "cell"]
    # only incidents of a day, class and cell that some report asks about are reduced
    stored = _live(incidents).filter(placed & F.col("incident_date").isNotNull()).withColumn(
        "cell", match_cell(F.col("latitude"), F.col("longitude"))).join(
        spots.select(*where), where, "left_semi").groupBy(*SIGNATURE, "cell").agg(
        F.min(F.struct("case_number", "id")).alias("hit")).select(
        *where, F.struct(*SIGNATURE[2:]).alias("s"), "hit")
    near = spots.join(stored, ["incident_date", "classification", "cell"]).filter(
        (haversine_km(F.col("r.latitude"), F.col("r.longitude"), F.col("s.latitude"),
                      F.col("s.longitude")) * 1000 <= MATCH_RADIUS_M)
        & ~contradicts(F.col("s.victim_age"), F.col("r.victim_age"),
                       F.col("s.victim_sex"), F.col("r.victim_sex")))
    found = near.groupBy("r").agg(F.min("hit").alias("hit")).select("r.*", "hit")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"f.{c}")) for c in SIGNATURE]
    condition = same[0]
    for test in same[1:]:
        condition = condition & test
    return asked.alias("a").join(found.alias("f"), condition).select(
        F.col(f"a.{report}").alias(report), F.col("f.hit.id").alias("incident_id"),
        F.col("f.hit.case_number").alias("case_number"))


def match_cascade(reports: DataFrame, report_sources: DataFrame, sources: DataFrame,
                  incidents: DataFrame, report: str = "submission_id") -> DataFrame:
    """report, incident_id, case_number, matched_by: URL first, then headline, then place.

    The reduction of the stored side dominates each step and does not depend on the reports,
    so the steps run side by side and the first one with a hit counts.
    """
    asked = _kept(report_sources, report, "source_url", "source_title")
    steps = (
        ("url", _by_url(asked, sources, incidents, report)),
        ("headline", _by_headline(asked, sources, incidents, report)),
        ("place", match_by_place(reports, incidents, report)))
    found = None
    for n, (name, rows) in enumerate(steps):
        part = rows.select(report, F.struct(
            F.lit(n).alias("step"), "case_number", "incident_id", F.lit(name).alias("matched_by"))
            .alias("hit"))
        found = part if found is None else found.unionByName(part)
    first = found.groupBy(report).agg(F.min("hit").alias("hit"))
    return reports.select(report).join(first, report, "left").select(
        report, "hit.incident_id", "hit.case_number", "hit.matched_by")


# --- batch clusters ---------------------------------------------------------------------------
def exact_clusters(incidents: DataFrame) -> DataFrame:
    """Members of every exact duplicate cluster with their cluster's lowest case.

    Exact precision, same date, class and point rounded to three places; rejected rows
    count too.
    """
    cell = ["incident_date", "classification", "lat3", "lon3"]
    keyed = incidents.filter(
        (F.col("date_precision") == "exact") & F.col("incident_date").isNotNull()
        & F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    ).select("id", "case_number", "victim_age", "victim_sex", "incident_date", "classification",
             F.round("latitude", 3).alias("lat3"), F.round("longitude", 3).alias("lon3"))
    heads = keyed.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("size"),
        F.min(F.struct("case_number", "id", "victim_age", "victim_sex")).alias("head"),
    ).filter(F.col("size") > 1)
    return keyed.join(heads, cell).select(
        F.col("head.id").alias("canonical_id"), F.col("head.case_number").alias("canonical_case"),
        "id", "case_number", "victim_age", "victim_sex", "size", "head")


def guarded_merge_map(clusters: DataFrame) -> DataFrame:
    """absorbed -> canonical, leaving out members that contradict the canonical's victim.

    Members are compared with the canonical only, not with each other.
    """
    safe = ~contradicts(F.col("head.victim_age"), F.col("victim_age"),
                        F.col("head.victim_sex"), F.col("victim_sex"))
    return clusters.filter((F.col("id") != F.col("canonical_id")) & safe).select(
        F.col("id").alias("absorbed_id"), F.col("case_number").alias("absorbed_case"),
        "canonical_id", "canonical_case")


def merge_summary(merge_map: DataFrame) -> DataFrame:
    return merge_map.agg(F.count_distinct("canonical_id").alias("clusters"),
                         F.count(F.lit(1)).alias("incidents_merged"))


def date_chains(incidents: DataFrame, window_days: int = BLOCK_WINDOW_DAYS) -> DataFrame:
    """country, class, date, chain_start, size: chains of exact dates at most n days apart.

    Works on counted distinct dates, so a country holding a third of all rows is still only
    a calendar's worth of rows in the window.
    """
    block = ["country", "classification"]
    days = incidents.filter(
        (F.col("date_precision") == "exact") & F.col("incident_date").isNotNull()
    ).groupBy(*block, "incident_date").agg(F.count(F.lit(1)).alias("n"))
    in_order = W.partitionBy(*block).orderBy("incident_date")
    gap = F.date_diff(F.col("incident_date"), F.lag("incident_date").over(in_order))
    starts = days.withColumn("_start", F.when(
        gap.isNull() | (gap > window_days), F.col("incident_date")))
    so_far = in_order.rowsBetween(W.unboundedPreceding, 0)
    chained = starts.withColumn("chain_start", F.max("_start").over(so_far)).drop("_start")
    chain = W.partitionBy(*block, "chain_start")
    return chained.withColumn("size", F.sum("n").over(chain)).drop("n")


def near_duplicate_blocks(incidents: DataFrame, window_days: int = BLOCK_WINDOW_DAYS,
                          max_size: int | None = BLOCK_MAX_SIZE) -> DataFrame:
    """Incidents in chains of 2 to `max_size` members (None: of any size); bigger ones are left to the report.

    Chains are filtered before the rows are joined back, so with a limit every joined key is small;
    without one the join has one row per day and class on its other side, and Spark may split it.
    """
    chains = date_chains(incidents, window_days).filter(F.col("size") >= 2)
    if max_size is not None:
        chains = chains.filter(F.col("size") <= max_size)
    keys = ["country", "classification", "incident_date"]
    exact = incidents.filter(F.col("date_precision") == "exact")
    return exact.join(chains, keys).withColumn(
        "cluster_id", F.concat_ws("|", "country", "classification",
                                  F.col("chain_start").cast("string")))


def oversized_chains(incidents: DataFrame, window_days: int = BLOCK_WINDOW_DAYS,
                     max_size: int = BLOCK_MAX_SIZE) -> DataFrame:
    """Chains skipped for their size: one row each, none of them dropped silently."""
    return date_chains(incidents, window_days).filter(F.col("size") > max_size).groupBy(
        "country", "classification", "chain_start").agg(
        F.max("incident_date").alias("chain_end"), F.max("size").alias("size"))


# --- adjudication ---------------------------------------------------------------------------------
def adjudication_payload(blocks: DataFrame, sources: DataFrame, titles: int = 5) -> DataFrame:
    """cluster_id, payload: JSON of at most ten records with at most five titles each."""
    mine = sources.join(blocks.select(F.col("id").alias("incident_id")), "incident_id", "left_semi")
    first = top_per_key(mine, ["incident_id"], [F.asc("id")], titles)
    heads = first.groupBy("incident_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("id", F.coalesce("source_title", F.lit("")).alias("t")))),
        lambda s: s["t"]).alias("source_titles"))
    joined = blocks.join(heads, blocks["id"] == heads["incident_id"], "left")
    record = F.struct(
        "case_number", F.col("incident_date").cast("string").alias("date"),
        F.col("location_description").alias("location"), F.col("state_province").alias("state"),
        "body_of_water", "victim_age", "victim_sex", F.col("victim_activity").alias("activity"),
        F.col("shark_species_suspected").alias("species"),
        F.substring(F.coalesce("description", F.lit("")), 1, 500).alias("description"),
        F.coalesce("source_titles", F.array().cast("array<string>")).alias("source_titles"))
    ordered = F.sort_array(F.collect_list(F.struct("incident_date", "case_number",
                                                   record.alias("record"))))
    return joined.groupBy("cluster_id").agg(ordered.alias("_rows")).select(
        "cluster_id", F.to_json(F.transform("_rows", lambda r: r["record"]),
                                {"ignoreNullFields": "false"}).alias("payload"))


GROUPS = T.StructType([T.StructField("groups", T.ArrayType(T.ArrayType(T.StringType())), True)])


def adjudicated_merge_map(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """absorbed -> canonical from the answered groups of each cluster.

    `answers` has cluster_id and response_text.  Only case numbers of the cluster count,
    each once, and a group needs two; an incident absorbed by one group is gone for the
    next.  Clusters have at most ten members, so this stays inside one row per cluster.
    """
    members = blocks.groupBy("cluster_id").agg(
        F.map_from_entries(F.collect_list(F.struct("case_number", "id"))).alias("members"))
    parsed = answers.select("cluster_id", F.from_json(json_object(F.col("response_text")), GROUPS)
                            ["groups"].alias("groups"))
    row = parsed.filter(F.size("groups") > 0).join(members, "cluster_id")
    empty = F.array().cast("array<struct<absorbed:string,canonical:string>>")

    def absorb(done: Column, group: Column) -> Column:
        gone = F.transform(done, lambda d: d["absorbed"])
        known = F.array_distinct(F.filter(group, lambda c: F.map_contains_key(F.col("members"), c)))
        left = F.array_except(known, gone)
        keeper = F.array_min(left)
        pairs = F.transform(F.array_except(left, F.array(keeper)), lambda c: F.struct(
            c.alias("absorbed"), keeper.alias("canonical")))
        return F.concat(done, F.when(F.size(left) >= 2, pairs).otherwise(empty))
    merged = row.select("members", F.aggregate(
        F.filter("groups", lambda g: g.isNotNull()), empty, absorb).alias("pairs"))
    return merged.select("members", F.explode("pairs").alias("p")).select(
        F.try_element_at("members", F.col("p.absorbed")).alias("absorbed_id"),
        F.col("p.absorbed").alias("absorbed_case"),
        F.try_element_at("members", F.col("p.canonical")).alias("canonical_id"),
        F.col("p.canonical").alias("canonical_case"))


# --- merge of the four tables ------------------------------------------------------------------------
def enrich(incidents: DataFrame, merge_map: DataFrame) -> DataFrame:
    """canonical_id, the filled values and the list of filled fields.

    Every empty field takes the first value in case order over the absorbed rows, which is
    what filling from one absorbed row after the other gives.
    """
    absorbed = incidents.join(
        merge_map.select(F.col("absorbed_id").alias("id"), "canonical_id"), "id")
    picks = [
        F.min_by(f, F.when(F.col(f).isNotNull(), F.struct("case_number", "id"))).alias(f)
        for f in ENRICH_FIELDS
    ]
    offers = absorbed.groupBy("canonical_id").agg(
        *picks, F.bool_or(F.coalesce("fatal", F.lit(False))).alias("fatal"))
    own = incidents.select(F.col("id").alias("canonical_id"), F.struct(*ENRICH_FIELDS, "fatal")
                           .alias("own"))
    joined = offers.join(own, "canonical_id")
    gains = {f: F.col(f"own.{f}").isNull() & F.col(f).isNotNull() for f in ENRICH_FIELDS}
    gains["fatal"] = F.col("fatal") & ~F.coalesce("own.fatal", F.lit(False))
    return joined.select(
        "canonical_id", *[F.coalesce(F.col(f"own.{f}"), F.col(f)).alias(f) for f in ENRICH_FIELDS],
        (F.coalesce("own.fatal", F.lit(False)) | F.col("fatal")).alias("fatal"),
        F.array_compact(F.array(*[F.when(g, F.lit(f)) for f, g in gains.items()])).alias("filled"))


def merge_incidents(incidents: DataFrame, merge_map: DataFrame) -> DataFrame:
    """Absorbed rows go, canonical rows carry the filled fields."""
    left = incidents.join(merge_map.select(F.col("absorbed_id").alias("id")), "id", "left_anti")
    gained = enrich(incidents, merge_map).select(
        F.col("canonical_id").alias("id"), F.struct(*ENRICH_FIELDS, "fatal").alias("_new"))
    joined = left.join(gained, "id", "left")
    hit = F.col("_new").isNotNull()
    return joined.withColumns({
        f: F.when(hit, F.col(f"_new.{f}")).otherwise(F.col(f)) for f in (*ENRICH_FIELDS, "fatal")
    }).select(*incidents.columns)


def merge_sources(sources: DataFrame, merge_map: DataFrame) -> DataFrame:
    """Sources of absorbed rows move to the canonical unless it has the URL already.

    Sources without URL always move; the canonical's own rows are never touched.
    """
    moves = merge_map.select(F.col("absorbed_id").alias("incident_id"), "canonical_id",
                             "absorbed_case")
    marked = sources.join(moves, "incident_id", "left")
    staying = marked.filter(F.col("canonical_id").isNull())
    moving = marked.filter(F.col("canonical_id").isNotNull())
    has_url = F.coalesce(F.length("source_url") > 0, F.lit(False))
    held = sources.filter(has_url).select(F.col("incident_id").alias("canonical_id"), "source_url")
    # one row per (canonical, url): map-side cut first, then drop what the canonical holds
    first = top_per_key(moving.filter(has_url), ["canonical_id", "source_url"],
                        [F.asc("absorbed_case"), F.asc("id")])
    fresh = first.join(held, ["canonical_id", "source_url"], "left_anti")
    moved = fresh.unionByName(moving.filter(~has_url)).withColumn("incident_id", F.col("canonical_id"))
    return staying.unionByName(moved).select(*sources.columns)


def merge_news(news: DataFrame, merge_map: DataFrame, generated_prefix: str) -> DataFrame:
    """News of absorbed rows points to the canonical; generated items of theirs are dropped."""
    moves = merge_map.select(F.col("absorbed_id").alias("promoted_incident_id"), "canonical_id")
    marked = news.join(moves, "promoted_incident_id", "left")
    absorbed = F.col("canonical_id").isNotNull()
    kept = marked.filter(~(absorbed & F.startswith("dedup_key", F.lit(generated_prefix))))
    return kept.withColumn("promoted_incident_id", F.coalesce(
        "canonical_id", "promoted_incident_id")).select(*news.columns)


def merge_audit(audit: DataFrame, merge_map: DataFrame, action: str = "merged",
                changed_at: Column | None = None) -> DataFrame:
    """Audit rows of absorbed incidents go with them; one row per absorption is added."""
    left = audit.join(merge_map.select(F.col("absorbed_id").alias("incident_id")), "incident_id",
                      "left_anti")
    when = changed_at if changed_at is not None else F.lit(None)
    added = merge_map.select(
        F.col("canonical_id").alias("incident_id"), F.lit(action).alias("action"),
        when.cast("timestamp_ntz").alias("changed_at"),
        F.concat(F.lit("Absorbed duplicate "), "absorbed_case").alias("notes"))
    return left.unionByName(added, allowMissingColumns=True).select(*audit.columns)


def unlink_candidates(candidates: DataFrame, removed: DataFrame, key: str = "absorbed_id") -> DataFrame:
    """Candidates of a removed incident lose the link; a merge does not re-point them."""
    gone = removed.select(F.col(key).alias("canonical_incident_id"), F.lit(True).alias("_gone"))
    return candidates.join(gone, "canonical_incident_id", "left").withColumn(
        "canonical_incident_id", F.when(F.col("_gone").isNull(), F.col("canonical_incident_id"))
    ).select(*candidates.columns)


def merge(incidents: DataFrame, sources: DataFrame, news: DataFrame, audit: DataFrame, candidates: DataFrame,
          merge_map: DataFrame, generated_prefix: str, action: str = "merged",
          changed_at: Column | None = None) -> dict[str, DataFrame]:
    """The five tables after a merge, all from one merge map.

    The map is made durable once, so clustering runs once and all outputs follow the same map even
    where a lost executor has its part of it computed again.  Beside the tables comes `touched`: the
    ids whose rows differ from before, for a store that rewrites only the parts that hold them.
    """
    fixed = durable(merge_map)
    touched = fixed.select(F.col("canonical_id").alias("id")).unionByName(
        fixed.select(F.col("absorbed_id").alias("id"))).distinct()
    return {
        "incidents": merge_incidents(incidents, fixed), "sources": merge_sources(sources, fixed),
        "news": merge_news(news, fixed, generated_prefix), "audit": merge_audit(audit, fixed, action, changed_at),
        "candidates": unlink_candidates(candidates, fixed), "merge_map": fixed, "touched": touched,
    }
