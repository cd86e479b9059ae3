"""Full-text search: stemmed tokens, by scan or through a token index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reefline.functions.stemming import OWN_STEMS, stem
from reefline.functions.text import STOP_WORDS, let

PREFIX = 2
LETTER = r"[\p{L}\p{N}]"


def words(text: Column) -> Column:
    """Distinct lower-case words without stop words."""
    return F.array_except(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), F.array(F.lit(""), *[F.lit(w) for w in STOP_WORDS]))


def search_tokens(text: Column) -> Column:
    return F.array_distinct(F.transform(words(text), stem))


def query_tokens(query: str) -> list[str]:
    """The tokens of a query, worked out once instead of beside every row."""
    return SparkSession.active().range(1).select(search_tokens(F.lit(query)).alias("t")).first()["t"] or []


def beginnings(token: str) -> list[str]:
    """One of these begins every word that has this stem.

    A stem without its last letter begins every word it comes from, but for the words with a stem of their own.
    """
    return [token[:max(len(token) - 1, 1)], *[w for w, own in OWN_STEMS.items() if own == token]]


def matches_all_tokens(text: Column, query: str) -> Column:
    """Every token of the query occurs in the text; an empty query matches nothing.

    A text without a word that can have the stem is refused, and only words that can have one are stemmed.
    """
    wanted = query_tokens(query)
    if not wanted:
        return F.lit(False)
    begin = [beginnings(t) for t in wanted]
    likely = rf"(?<!{LETTER})(?:{'|'.join(b for some in begin for b in some)}){LETTER}*"

    def found(low: Column) -> Column:
        plausible = F.lit(True)
        for some in begin:
            one = F.contains(low, F.lit(some[0]))
            for other in some[1:]:
                one = one | F.contains(low, F.lit(other))
            plausible = plausible & one
        stems = search_tokens(F.array_join(F.regexp_extract_all(low, F.lit(likely), F.lit(0)), " "))
        return plausible & (F.size(F.array_except(F.array(*[F.lit(t) for t in wanted]), stems)) == 0)
    return let(F.lower(text), found)


def token_index(rows: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """prefix, token, key: each row once per token of its text and beginning of a word that has it.

    Every distinct word is stemmed once.  `prefix` (the first letters of the word) is there to store the
    index partitioned by it, so that a query reads only the partitions of its tokens; of an index that is
    not stored, a query stems and shuffles only the words that begin so.
    """
    found = rows.select(key, F.explode(words(text)).alias("word")).withColumn("prefix", F.left("word", F.lit(PREFIX)))
    # joined by the prefix, too, so that what a query asks of it holds for the words to be stemmed
    stems = found.select("prefix", "word").distinct().withColumn("token", stem(F.col("word")))
    return found.join(stems, ["prefix", "word"]).select("prefix", "token", key).distinct()


def search_index(index: DataFrame, query: str, key: str = "id") -> DataFrame:
    """Keys of the rows that have every token of the query."""
    # the tokens of a query are few: as literals they prune the partitions and row groups of a stored index
    tokens = query_tokens(query)
    begin = sorted({b[:PREFIX] for t in tokens for b in beginnings(t)})
    whole, short = [b for b in begin if len(b) == PREFIX], [b for b in begin if len(b) < PREFIX]
    starts = F.col("prefix").isin(whole)
    for b in short:
        starts = starts | F.startswith("prefix", F.lit(b))
    hits = index.filter(starts & F.col("token").isin(tokens)).select(key, "token").distinct()
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(tokens)).select(key)
