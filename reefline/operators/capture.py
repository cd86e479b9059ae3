"""Evidence capture: relevance gate, item shaping, idempotent insert, keyed updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reefline.constants import (
    EXCERPT_CHARS, MAX_KEY_CHARS, SUBJECT_TERMS, SUMMARY_CHARS, TRUSTED_TERMS,
)
from reefline.functions.frames import top_per_key, unseen
from reefline.functions.text import any_term, blank_to_null
from reefline.session import durable


def item_key() -> Column:
    """`platform:url`, or a digest of the url where that would be too long."""
    platform, url = F.col("source_platform"), F.col("source_url")
    key = F.concat(platform, F.lit(":"), url)
    return F.when(F.length(key) <= MAX_KEY_CHARS, key).otherwise(
        F.concat(platform, F.lit(":sha256:"), F.sha2(url, 256)))


def shape_evidence(items: DataFrame, excerpt_chars: int | None = EXCERPT_CHARS,
                   summary_chars: int | None = SUMMARY_CHARS) -> DataFrame:
    """Key, content digest, excerpt and summary of each raw item; without a length the whole content."""
    content = F.coalesce("content", F.lit(""))

    def start(chars: int | None) -> Column:
        return blank_to_null(content if chars is None else F.substring(content, 1, chars))
    return items.withColumns({
        "dedup_key": item_key(),
        "content_sha256": F.sha2(content, 256),
        "body_excerpt": start(excerpt_chars),
        "summary": start(summary_chars),
    })


def is_relevant(subject: list[str] = SUBJECT_TERMS, trusted: list[str] = TRUSTED_TERMS) -> Column:
    """A subject term anywhere, or an incident term when the source is trusted."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    return any_term(text, subject) | (F.coalesce("trusted", F.lit(False)) & any_term(text, trusted))


def keep_relevant(items: DataFrame, **terms: list[str]) -> DataFrame:
    return items.filter(is_relevant(**terms))


def first_per_source(items: DataFrame, k: int, source: str = "source_name",
                     order: str = "id") -> DataFrame:
    return top_per_key(items, [source], [F.asc(order)], k)


# --- idempotent capture ---------------------------------------------------------------
def fold_repeats(evidence: DataFrame, seq: str = "id", seen: str = "seen_at") -> DataFrame:
    """One row per key: the first arrival's content, first and last time seen."""
    content = [c for c in evidence.columns if c not in ("dedup_key", seen)]
    return evidence.groupBy("dedup_key").agg(
        F.min_by(F.struct(*content), F.struct(seen, seq)).alias("_first"),
        F.min(seen).alias("captured_at"), F.max(seen).alias("last_seen_at"),
    ).select("dedup_key", *[f"_first.{c}" for c in content], "captured_at", "last_seen_at")


def capture(documents: DataFrame, batch: DataFrame) -> DataFrame:
    """Evidence is immutable: known keys only move `last_seen_at`, new keys are added.

    `batch` is already folded to one row per key.
    """
    columns = documents.columns
    rest = [c for c in columns if c not in ("dedup_key", "last_seen_at")]
    stored = documents.select("dedup_key", F.struct(*rest).alias("_old"),
                              F.col("last_seen_at").alias("_seen"))
    offered = {c: c in batch.columns for c in rest}
    arrived = batch.select(
        "dedup_key", F.col("last_seen_at").alias("_again"),
        F.struct(*[
            (F.col(c) if offered[c] else F.lit(None)).cast(documents.schema[c].dataType).alias(c)
            for c in rest
        ]).alias("_new"))
    # the fold of the batch is behind these rows, and they are read three times below
    arrived = durable(arrived)
    # a left join lets the optimizer broadcast a small batch; an outer join would shuffle the bodies
    moved = stored.join(arrived.select("dedup_key", "_again"), "dedup_key", "left").select(
        "dedup_key", F.greatest("_seen", "_again").alias("last_seen_at"), F.col("_old").alias("_row"))
    fresh = unseen(arrived, stored, "dedup_key").select(
        "dedup_key", F.col("_again").alias("last_seen_at"), F.col("_new").alias("_row"))
    return moved.unionByName(fresh).select(*[F.col(c) if c in ("dedup_key", "last_seen_at") else F.col(f"_row.{c}").alias(c)
               for c in columns])


def insert_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Only the rows whose key is not stored yet, one per key.  Rows of one key are taken as equal."""
    return new.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys)


def fill_source_ids(news: DataFrame, documents: DataFrame) -> DataFrame:
    """Set the evidence id on news by shared key, leaving unmatched rows as they are."""
    ids = documents.select("dedup_key", F.col("id").alias("_doc"))
    return news.join(ids, "dedup_key", "left").withColumn(
        "source_document_id", F.coalesce("_doc", "source_document_id")).drop("_doc")
