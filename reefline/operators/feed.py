"""News feed: search, filters, collapse to one item per incident, paging and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reefline.functions.frames import top_per_key, unseen
from reefline.functions.text import contains_ci
from reefline.operators.browse import captured_range, in_list, page_of
from reefline.session import durable

UPDATED_ON_REPEAT = ["event_type", "country", "ai_confidence", "promoted_incident_id"]


def news_search(text: str) -> Column:
    return contains_ci(F.col("title"), text) | contains_ci(F.col("summary"), text)


def filter_news(news: DataFrame, *, event_type: str | None = None, country: str | None = None,
                source_platform: str | None = None, date_from: str | None = None,
                date_to: str | None = None, search: str | None = None) -> DataFrame:
    for column, csv in (("event_type", event_type), ("country", country),
                        ("source_platform", source_platform)):
        if csv:
            news = news.filter(in_list(column, csv))
    if date_from or date_to:
        news = news.filter(captured_range("captured_at", date_from, date_to))
    return news.filter(news_search(search)) if search else news


def feed_order() -> list[Column]:
    return [F.desc(F.coalesce("published_at", "captured_at")), F.desc("captured_at"), F.desc("id")]


def collapse(news: DataFrame) -> DataFrame:
    """Newest item per promoted incident; items without one are all kept.

    Only promoted items are shuffled, and of those one per incident and map task.
    """
    promoted = news.filter(F.col("promoted_incident_id").isNotNull())
    newest = top_per_key(promoted, ["promoted_incident_id"], feed_order())
    return newest.unionByName(news.filter(F.col("promoted_incident_id").isNull()))


def feed_page(news: DataFrame, page: int = 1, per_page: int = 50, **filters) -> DataFrame:
    return page_of(collapse(filter_news(news, **filters)), feed_order(), page, per_page)


def resolve_news_keys(batch: DataFrame, incidents: DataFrame, documents: DataFrame) -> DataFrame:
    """Case number -> incident id and item key -> evidence id, both null when unknown."""
    cases = incidents.select(F.col("case_number").alias("promoted_case_number"),
                             F.col("id").alias("promoted_incident_id"))
    evidence = documents.select("dedup_key", F.col("id").alias("source_document_id"))
    return batch.join(cases, "promoted_case_number", "left").join(evidence, "dedup_key", "left")


def fold_batch(batch: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per key: first arrival for fixed columns, last arrival for the updated ones."""
    fixed = [c for c in batch.columns if c not in (*UPDATED_ON_REPEAT, "dedup_key", seq)]
    moving = [c for c in UPDATED_ON_REPEAT if c in batch.columns]
    picks = []
    if fixed:
        picks.append(F.min_by(F.struct(*fixed), seq).alias("_first"))
    folded = batch.groupBy("dedup_key").agg(
        *picks, F.max_by(F.struct(*moving), seq).alias("_last"), F.min(seq).alias(seq))
    return folded.select("dedup_key", seq, *[f"_first.{c}" for c in fixed],
                         *[f"_last.{c}" for c in moving])


def upsert_news(news: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Insert new keys; on a known key only the four updated columns move, nulls included."""
    incoming = fold_batch(batch, seq)
    arrived = incoming.select(
        "dedup_key", F.lit(True).alias("_hit"),
        F.struct(*[c for c in incoming.columns if c not in ("dedup_key", seq)]).alias("_new"))
    # the fold is behind these rows, and they are read three times below
    arrived = durable(arrived)
    current = news.select("dedup_key", F.struct(*[c for c in news.columns if c != "dedup_key"])
                          .alias("_old"))
    # the stored feed meets the batch in a left join, which needs no shuffle of it for a small batch
    both = current.join(arrived, "dedup_key", "left").unionByName(
        unseen(arrived, current, "dedup_key"), allowMissingColumns=True)
    fresh = F.col("_old").isNull()
    out = [F.col("dedup_key")]
    offered = set(incoming.columns)
    for f in news.schema.fields:
        if f.name == "dedup_key":
            continue
        old = F.col("_old")[f.name]
        if f.name not in offered:
            out.append(old.alias(f.name))
        else:
            use_new = (F.coalesce("_hit", F.lit(False)) if f.name in UPDATED_ON_REPEAT else fresh)
            out.append(F.when(use_new, F.col("_new")[f.name].cast(f.dataType)).otherwise(old)
                       .alias(f.name))
    return both.select(*out)
