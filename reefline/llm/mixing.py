"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to.  Word capacity flows from patterns
to source quotas; the k-th use of a pattern's words costs k - 1, so words repeat only when nothing
fresh reaches a quota.  Inside a pattern a seeded order of its documents decides which of them the
last, incomplete pass takes.  Only one row per pattern and per source reaches the driver.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reefline.llm.common import WORD_PATTERN, bounded, stored, text_of

MAX_USES = 2
SHARE = 1.5
WEIGHTS = (3, 1, 2)
SEED = 17
BLOCK_ROWS = 8192


@dataclass
class Pattern:
    """A membership pattern: its key, its sources, the words it holds and where its words go."""

    key: str
    sources: tuple
    words: int
    flow: dict


def level(total: float, sizes: list[int], weights: list[float], uses: int = MAX_USES) -> list[float]:
    """Shares of `total` by weight, none above `uses` times its size; the excess is shared anew."""
    caps = [uses * size for size in sizes]
    by_ratio = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    rest, weight = float(total), float(sum(weights))
    rate = 0.0
    for i in by_ratio:
        rate = rest / weight
        if rate <= caps[i] / weights[i]:
            break
        rest, weight = rest - caps[i], weight - weights[i]
        rate = float("inf")
    return [min(float(cap), w * rate) for cap, w in zip(caps, weights)]


def route(patterns: list[Pattern], quotas: dict, uses: int = MAX_USES) -> None:
    """Fill each pattern's flow: the most words at the least cost of repetition.

    Successive shortest paths: every path that uses fresh words is cheaper than one that repeats
    them, so all paths of one use are exhausted before the next use's capacity opens.
    """
    owners = defaultdict(list)
    for pattern in patterns:
        pattern.flow = dict.fromkeys(pattern.sources, 0)
        for source in pattern.sources:
            owners[source].append(pattern)
    missing = dict(quotas)
    used = {pattern.key: 0 for pattern in patterns}
    for use in range(1, uses + 1):
        for start in patterns:
            while used[start.key] < use * start.words and (path := _path(start, owners, missing)):
                amount = min(missing[path[0][1]], use * start.words - used[start.key],
                             *(pattern.flow[back] for (pattern, _), (_, back) in zip(path, path[1:])))
                for pattern, source in path:
                    pattern.flow[source] += amount
                for (pattern, _), (_, back) in zip(path, path[1:]):
                    pattern.flow[back] -= amount
                missing[path[0][1]] -= amount
                used[start.key] += amount


def _path(start: Pattern, owners: dict, missing: dict) -> list[tuple[Pattern, str | None]]:
    """Shortest path of free words to a source that misses some, from its end: (pattern, source it serves).

    A pattern on the way gives up words for the next step's source; empty if there is no path.
    """
    came = {start.key: ()}
    reached: dict = {}
    queue = deque([start])
    while queue:
        at = queue.popleft()
        for source in at.sources:
            if source in reached:
                continue
            reached[source] = at
            if missing.get(source, 0) > 0:
                path = [(at, source)]
                while came[path[-1][0].key]:
                    back = came[path[-1][0].key][0]
                    path.append((reached[back], back))
                return path
            for other in owners[source]:
                if other.key not in came and other.flow[source] > 0:
                    came[other.key] = (source,)
                    queue.append(other)
    return []


def _pattern(sources: Column) -> Column:
    # "s" marks a name, "n" the missing source; the separator sorts before every other character
    return F.array_join(F.sort_array(F.array_distinct(F.transform(
        sources, lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("n"))))), "\0")


def mix(docs: DataFrame, sources: Column, seed: int = SEED, share: float = SHARE,
        weights: tuple = WEIGHTS, uses: int = MAX_USES) -> DataFrame:
    """One row per document: doc_id, text_hash, size, pattern, target and source_size of its first source, taken,
    allocated (words by source).

    `sources` gives the array of sources of a document; a null source is a source of its own and
    sorts last.  Sources in code-point order weigh `weights`, repeating, and share `share` times all
    words.  Size counts words; a null or empty text has none and is never taken.  Repeated rows are
    documents of their own.  Ties in the seeded order are rows alike.  No rows give no rows.
    """
    text = text_of()
    rows = docs.select("doc_id", text.alias("_text"), _pattern(sources).alias("pattern")).select(
        "doc_id", "pattern", F.xxhash64("_text").alias("text_hash"), F.regexp_count("_text", F.lit(WORD_PATTERN)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5("_text"))))
        .alias("_order"))
    found = rows.groupBy("pattern").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).collect()
    held: dict = defaultdict(int)
    patterns = []
    for row in found:
        names = tuple(None if part == "n" else part[1:] for part in row["pattern"].split("\0")) if row["pattern"] else ()
        patterns.append(Pattern(row["pattern"], names, row["words"], {}))
        for name in names:
            held[name] += row["words"]
    names = sorted(held, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, level(
        share * sum(p.words for p in patterns), [held[n] for n in names],
        [weights[i % len(weights)] for i in range(len(names))], uses)))
    patterns.sort(key=lambda p: p.key)
    route(patterns, {n: int(t) for n, t in targets.items()}, uses)
    plan = docs.sparkSession.createDataFrame([
        (p.key, p.words, sum(p.flow.values()), held[p.sources[0]] if p.sources else 0,
         targets[p.sources[0]] if p.sources else 0.0, [(s, p.flow[s]) for s in p.sources]) for p in patterns],
        "pattern string, _capacity long, _flow long, source_size long, target double, "
        "_routes array<struct<source: string, words: long>>")
    # blocks of the seeded order keep every window small, however large a source is
    largest = max((row["rows"] for row in found), default=0)
    digits = 1
    while largest / 16 ** digits > BLOCK_ROWS / 16 and digits < 6:
        digits += 1
    blocked = rows.withColumn("_block", F.substring("_order", 1, digits))
    before_block = blocked.groupBy("pattern", "_block").agg(F.sum("size").alias("_words")).select(
        "pattern", "_block", F.coalesce(F.sum("_words").over(W.partitionBy("pattern").orderBy("_block").rowsBetween(
            W.unboundedPreceding, -1)), F.lit(0)).alias("_before_block"))
    inside = W.partitionBy("pattern", "_block").orderBy("_order", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (blocked.withColumn("_in_block", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(before_block, ["pattern", "_block"])
              .join(bounded(plan, len(patterns), 512), "pattern")
              .withColumn("_before", F.col("_before_block") + F.col("_in_block")))
    return _taken(placed, uses)


def _overlap(start: Column, size: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0), F.least(start + size, high) - F.greatest(start, low))


def _taken(placed: DataFrame, uses: int) -> DataFrame:
    """Each pass runs over the pattern's words in order until the flow ends; routes take their turn."""
    passes = F.sequence(F.lit(0), F.lit(uses - 1))

    def words(low: Column, high: Column) -> Column:
        return F.aggregate(passes, F.lit(0).cast("long"), lambda total, k: total + _overlap(
            F.col("_before") + k * F.col("_capacity"), F.col("size"), low, high))
    ends = F.transform("_routes", lambda r, i: F.struct(
        r["source"].alias("source"), F.aggregate(F.slice(F.col("_routes"), 1, i), F.lit(0).cast("long"),
                                                 lambda t, x: t + x["words"]).alias("low"), r["words"].alias("words")))
    allocated = F.transform(ends, lambda r: F.struct(
        r["source"].alias("source"), words(r["low"], r["low"] + r["words"]).alias("words")))
    return placed.select("doc_id", "text_hash", "size", "pattern", "source_size", "target",
                         words(F.lit(0).cast("long"), F.col("_flow")).alias("taken"), allocated.alias("allocated"))


def materialise(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of `docs`, each whole and as often as the mix takes it: `taken / size`, rounded.

    Documents that the mix leaves out are gone.  Rows alike share their uses evenly.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    chosen = stored(mixed.filter("taken > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("_uses")).filter("_uses > 0"), "chosen")
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.xxhash64(text_of()).alias("_own"))
    joined = renamed.join(bounded(chosen, chosen.count(), 32), (F.col("_own") == F.col("_hash"))
                          & F.col(own["doc_id"]).eqNullSafe(F.col("_id")))
    return joined.withColumn("_use", F.explode(F.sequence(F.lit(1), "_uses"))).select(
        *[F.col(n).alias(c) for c, n in own.items()])


# The same mix in SQL: one source a document, documents in the order of md5(seed:doc_id).
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, md5('{SEED}:' || doc_id::VARCHAR) AS ord,
         len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS n FROM sources),
rates AS (
  SELECT *, ({SHARE} * (sum(source_size) OVER ()) - coalesce(sum(2 * source_size) OVER
              (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate FROM ranked),
rate AS (SELECT arg_min(rate, n) AS rate FROM rates WHERE rate <= 2 * source_size / w),
targets AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, w * (SELECT rate FROM rate)) AS target FROM sources),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS flow,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, flow - before))
        + greatest(0, least(size, flow - source_size - before)))::BIGINT AS taken
FROM placed
"""
