"""MinHash near-dedup: SuperMinHash signatures, banding, verification, union-find groups.

Texts with equal shingle sets form one class, linked without comparing.  One document of each class
goes into the bands.  Buckets of up to PLAIN_BUCKET classes give all their pairs; those whose sizes
or signatures rule the similarity out leave, each class first verifies its most similar one, and
only what these links do not join is verified in turn.  A larger bucket first drops classes that no
document can be close enough to (too many of their shingles occur nowhere else), and compares
everyone with one pivot, its most typical class.  That comparison says which of the pivot's shingles
a class holds and how many it has beside them.  Two classes share at most the pivot's shingles that
both hold, and beside them the fewer of what either shares with anybody, so pairs that the pivot
did not join need a look only where this bound allows the similarity.  Every link is confirmed on
the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reefline.functions.frames import top_per_key
from reefline.llm.common import WordHashes, bounded, buffers, chunks, lean, mix64, small_batches, stored, text_of
from reefline.llm.superminhash import shingles, signatures
from reefline.llm.union_find import components

PLAIN_BUCKET = 32


@dataclass(frozen=True)
class Rule:
    """Shingle width and least similarity in hundredths; bands and rows for candidates.

    A pair at the least similarity s misses all bands with probability (1 - s ** rows) ** bands:
    under 1e-10 for 0.85 and 1e-7 for 0.8.  Its signatures agree on fewer than s - slack of their
    slots with a probability of about 4e-8 for 0.85 and 8e-7 for 0.8.
    """

    width: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    slack: float = 0.17


def _word_arrays(data: bytes, offsets: list[int], words: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    lists = [data[a:b].lower().split() for a, b in zip(offsets[:-1], offsets[1:])]
    lengths = np.array([len(x) for x in lists], np.int64)
    return words.of([w for x in lists for w in x]), lengths


@lean
def _signatures(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    size = rule.bands * rule.rows
    for batch in batches:
        offsets, body = buffers(batch.column("text"))
        for start, stop in chunks(np.diff(offsets)):
            part = offsets[start:stop + 1]
            found, lengths = _word_arrays(body[part[0]:part[-1]].tobytes(), (part - part[0]).tolist(), words)
            elements, counts = shingles(found, lengths, rule.width)
            filled = counts > 0
            n = len(counts)
            sig, bands = np.zeros((n, size), np.uint64), np.zeros((n, rule.bands), np.uint64)
            sums = np.zeros((2, n), np.uint64)
            if filled.any():
                sig[filled] = signatures(elements, counts[filled], size)
                first = (np.cumsum(counts) - counts)[filled]
                sums[0, filled] = np.add.reduceat(mix64(elements), first)
                sums[1, filled] = np.bitwise_xor.reduceat(mix64(elements ^ np.uint64(0xABCDEF)), first)
                bands += np.arange(rule.bands, dtype=np.uint64)[None, :]
                for r in range(rule.rows):
                    bands = mix64(bands + sig.reshape(n, rule.bands, rule.rows)[:, :, r])
            ends = np.concatenate([[0], np.cumsum(np.where(filled, rule.bands, 0))]).astype(np.int32)
            marks = np.concatenate([[0], np.cumsum(np.where(filled, size, 0))]).astype(np.int32)
            short = (mix64(sig[filled]) >> np.uint64(48)).astype(np.uint16).view(np.int16)
            rows = batch.slice(start, stop - start)
            yield pa.RecordBatch.from_arrays([
                rows.column("row"), rows.column("doc_id"), rows.column("text_hash"), pa.array(counts.astype(np.int64)),
                pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[filled].reshape(-1).view(np.int64))),
                pa.ListArray.from_arrays(pa.array(marks), pa.array(short.reshape(-1))),
            ], ["row", "doc_id", "text_hash", "n", "set_a", "set_b", "bands", "marks"])


def _text_sets(batch: pa.RecordBatch, node: str, text: str, words: WordHashes, width: int, known: dict) -> None:
    """Shingle sets of a batch's texts by node, each computed once."""
    nodes = batch.column(node).to_pylist()
    new = {n: i for i, n in enumerate(nodes) if n not in known}
    offsets, body = buffers(batch.column(text).take(pa.array(list(new.values()), pa.int64())))
    found, lengths = _word_arrays(body.tobytes(), offsets.tolist(), words)
    elements, counts = shingles(found, lengths, width)
    known |= zip(new, np.split(elements, np.cumsum(counts)[:-1]))


def _pair_sets(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows of pairs (a, b) with the shingle sets of both."""
    words = WordHashes()
    for batch in batches:
        sizes = np.diff(buffers(batch.column("text_a"))[0]) + np.diff(buffers(batch.column("text_b"))[0])
        for start, stop in chunks(sizes, 4_000_000):
            rows, sets = batch.slice(start, stop - start), {}
            for side in "ab":
                _text_sets(rows, side, f"text_{side}", words, rule.width, sets)
            pairs = zip(rows.column("a").to_pylist(), rows.column("b").to_pylist())
            yield rows.select(["a", "b"]), [(sets[a], sets[b]) for a, b in pairs]


def _close(rule: Rule, x: np.ndarray, y: np.ndarray, common: int) -> bool:
    return 100 * common >= rule.percent * (len(x) + len(y) - common)


@lean
def _verify(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for rows, pairs in _pair_sets(batches, rule):
        linked = [_close(rule, x, y, len(np.intersect1d(x, y, assume_unique=True))) for x, y in pairs]
        yield rows.filter(pa.array(linked, pa.bool_()))


@lean
def _measure(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Of pivots a and rows b: whether they link, a's shingles that b holds (one bit each), and their number."""
    for rows, pairs in _pair_sets(batches, rule):
        linked, hits, inside = [], [], []
        for x, y in pairs:
            held = np.isin(x, y, assume_unique=True, kind="sort")
            inside.append(int(held.sum()))
            linked.append(_close(rule, x, y, inside[-1]))
            hits.append(np.packbits(np.append(held, np.zeros(-len(held) % 64, bool))).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(linked, pa.bool_()), pa.array(inside, pa.int64()), pa.array(hits, pa.list_(pa.int64()))],
            ["a", "b", "linked", "inside", "hits"])


@lean
def _elements(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        offsets, body = buffers(batch.column("text"))
        for start, stop in chunks(np.diff(offsets)):
            part = offsets[start:stop + 1]
            found, lengths = _word_arrays(body[part[0]:part[-1]].tobytes(), (part - part[0]).tolist(), words)
            elements, counts = shingles(found, lengths, width)
            node = np.repeat(batch.column("row").to_numpy()[start:stop], counts)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(elements.view(np.int64))], ["row", "shingle"])


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.lit(7), text)


def _sizes_allow(rule: Rule, x: str, y: str) -> Column:
    return 100 * F.least(x, y) >= rule.percent * F.greatest(x, y)


def _agreement(x: str, y: str) -> Column:
    """Number of slots in which two signatures agree."""
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same))


def _least_agreement(rule: Rule) -> float:
    return rule.bands * rule.rows * (rule.percent / 100 - rule.slack)


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Every row's group: row, doc_id, text_hash, n_shingles, component_id, kept.

    Reads only `doc_id` and `text`.  Words are lower-cased (A-Z) and split at ASCII white space.
    Rows without words have no shingles and are linked with nothing; null texts are such rows.
    `component_id` is the least doc_id of the rows a row reaches over links, itself included (null
    only if all of them are null); `kept` marks rows with that id.  Rows with a null or repeated
    doc_id are documents of their own.  No rows give no rows.
    """
    text = text_of()
    signed = stored(
        small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                                   text_hash(text).alias("text_hash"), text.alias("text"))
        .mapInArrow(partial(_signatures, rule=rule),
                    "row long, doc_id long, text_hash long, n long, set_a long, set_b long, bands array<long>, "
                    "marks array<smallint>"), "signatures")
    key = ["n", "set_a", "set_b"]
    classes = stored(signed.filter("n > 0").groupBy(*key).agg(
        F.min(F.struct("row", "doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("least")), "classes")
    typical = classes.select("first.row", "first.doc_id", "first.text_hash", "n")
    copies = stored(signed.filter("n > 0").select("row", *key).join(classes.select(*key, F.col("first.row").alias("_first")), key)
                    .filter("row <> _first").select("row"), "copies")
    rows = signed.filter("n > 0").join(bounded(copies, copies.count(), 16), "row", "left_anti")
    entries = _live_entries(rows)
    labels = _groups(entries, rows, lambda some: _texts(docs, typical.join(some, "row", "left_semi")), rule)
    labelled = classes.select(*key, "least", F.col("first.row").alias("row")).join(labels, "row", "left")
    together = labelled.filter("label is not null").groupBy("label").agg(F.min("least").alias("reached"))
    groups = stored(labelled.join(together, "label", "left").select(
        *key, F.coalesce("reached", "least").alias("component_id")), "components")
    members = signed.select("row", "doc_id", "text_hash", *key)
    out = lambda df: df.select(
        "row", "doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out(members.filter("n > 0").join(groups, key)).unionByName(
        out(members.filter("n = 0").withColumn("component_id", F.col("doc_id"))))


def deduplicate(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of `docs` that stay: of each group of near-duplicates the one with the least doc_id."""
    dropped = stored(near_duplicates(docs, rule).filter("not kept").select(
        F.col("doc_id").alias("_dropped"), F.col("text_hash").alias("_hash")).distinct(), "dropped")
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], text_hash(text_of()).alias("_own"))
    left = renamed.join(bounded(dropped, dropped.count(), 32), (F.col("_own") == F.col("_hash"))
                        & F.col(own["doc_id"]).eqNullSafe(F.col("_dropped")), "left_anti")
    return left.select(*[F.col(n).alias(c) for c, n in own.items()])


def _live_entries(rows: DataFrame) -> DataFrame:
    """Band entries of buckets that hold more than one row: band, size, row, n."""
    spread = rows.select("row", "n", F.explode("bands").alias("band"))
    shared = stored(spread.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    return stored(spread.join(shared, "band"), "entries")


def _texts(docs: DataFrame, typical: DataFrame) -> DataFrame:
    """(row, text) of the given rows, found again by doc_id and text hash."""
    wanted = stored(typical.select("row", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "wanted")
    text = text_of()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_hash(text).alias("hash"))
    found = plain.join(bounded(wanted, wanted.count(), 40), (plain["hash"] == wanted["_hash"])
                       & plain["doc_id"].eqNullSafe(wanted["_id"]))
    # repeated rows of one document would be found again and again
    return stored(found.select("row", "text").dropDuplicates(["row"]), "texts")


def _groups(entries: DataFrame, rows: DataFrame, texts_of, rule: Rule) -> DataFrame:
    """(row, label) of every row that has a link, from the band entries."""
    few = entries.filter(F.col("size") <= PLAIN_BUCKET).select("band", "row", "n")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.row") < F.col("y.row"))
                                & _sizes_allow(rule, "x.n", "y.n")).select(F.col("x.row").alias("a"), F.col("y.row").alias("b"))
    signs = stored(rows.select("row", "marks").join(few.select("row").distinct(), "row", "left_semi"), "marks")
    likely = stored(_plausible(pairs.distinct(), signs, rule), "likely")
    homes = _homes(entries.filter(F.col("size") > PLAIN_BUCKET).select("band", "row", "n"), texts_of, rule)
    near = stored(homes.select(F.col("pivot").alias("a"), F.col("row").alias("b")).distinct(), "near")
    ends = [p.select(F.col(c).alias("row")) for p in (likely, near) for c in "ab"]
    texts = texts_of(reduce(DataFrame.unionByName, ends).distinct())
    measured = stored(_with_texts(near, texts).mapInArrow(
        partial(_measure, rule=rule), "a long, b long, linked boolean, inside long, hits array<long>"), "measured")
    best = top_per_key(likely, ["b"], [F.desc("agree"), F.asc("a")]).select("a", "b")
    links = stored(measured.filter("linked").select("a", "b").unionByName(_verified(best, texts, rule)), "best-links")
    rest = _across(likely.select("a", "b"), components(links)).join(best, ["a", "b"], "left_anti")
    links = stored(links.unionByName(_verified(rest, texts, rule)), "links")
    labels = components(links).withColumnRenamed("node", "row")
    if homes.isEmpty():
        return labels
    last = stored(_undecided(homes, labels, measured, rows, rule), "last")
    if last.isEmpty():
        return labels
    involved = last.select(F.col("a").alias("row")).unionByName(last.select(F.col("b").alias("row"))).distinct()
    return components(links.unionByName(_verified(last, texts_of(involved), rule))).withColumnRenamed("node", "row")


def _homes(crowd: DataFrame, texts_of, rule: Rule) -> DataFrame:
    """Entries of crowded buckets with their bucket's pivot, without the pivot's own: band, row, n, alone, pivot.

    The pivot of a bucket is the row with the fewest shingles of its own.
    """
    crowded = stored(_reachable(crowd, texts_of, rule), "crowded")
    pivots = stored(crowded.groupBy("band").agg(F.min(F.struct("alone", "row")).alias("pivot")).select(
        "band", F.col("pivot.row").alias("pivot")), "pivots")
    return stored(crowded.join(bounded(pivots, pivots.count(), 16), "band").filter("row <> pivot"), "homes")


def _undecided(homes: DataFrame, labels: DataFrame, measured: DataFrame, rows: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of a crowded bucket, in different components, that what the pivot shows lets be linked.

    Everyone has met the pivot.  Of x and y, both measured against it, the common shingles are those
    of the pivot that both hold and others; an other one is none that only one row has.
    """
    marked = stored(homes.join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")), "labelled")
    open_bands = marked.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter(
        "low <> high").select("band")
    known = measured.select(F.col("a").alias("pivot"), F.col("b").alias("row"), "inside", "hits")
    left = marked.join(open_bands, "band", "left_semi").join(known, ["pivot", "row"]).join(rows.select("row", "bands"), "row")
    left = stored(left.withColumn("beside", F.col("n") - F.col("inside") - F.col("alone")), "open")

    def allowed(inside: Column) -> Column:
        most = inside + F.least("x.beside", "y.beside")
        return (100 + rule.percent) * most >= rule.percent * (F.col("x.n") + F.col("y.n"))
    both = F.aggregate(F.zip_with("x.hits", "y.hits", lambda p, q: F.bit_count(p.bitwiseAND(q)).cast("long")),
                       F.lit(0).cast("long"), lambda total, bits: total + bits)
    # each pair once, in the first band it shares
    shared = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True).cast("int")
    return left.alias("x").join(left.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.row") < F.col("y.row"))
                                & (F.col("x.label") != F.col("y.label")) & allowed(F.least("x.inside", "y.inside"))
                                & allowed(both) & (F.element_at("x.bands", shared) == F.col("x.band"))).select(
        F.col("x.row").alias("a"), F.col("y.row").alias("b"))


def _plausible(pairs: DataFrame, signs: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a < b) whose signatures allow the similarity, with their agreement."""
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = signs.select(F.col("row").alias("a"), F.col("marks").alias("x"))
    two = signs.select(F.col("row").alias("b"), F.col("marks").alias("y"))
    return ordered.join(one, "a").join(two, "b").select("a", "b", _agreement("x", "y").alias("agree")).filter(
        F.col("agree") >= _least_agreement(rule))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    one = labels.select(F.col("node").alias("a"), F.col("label").alias("_x"))
    two = labels.select(F.col("node").alias("b"), F.col("label").alias("_y"))
    return pairs.join(one, "a", "left").join(two, "b", "left").filter(
        F.coalesce("_x", "a") != F.coalesce("_y", "b")).select("a", "b")


def _reachable(entries: DataFrame, texts_of, rule: Rule) -> DataFrame:
    """Entries of rows that another row can be close enough to, with their count of shingles of their own.

    A shingle that no other row has lies in no intersection.  Another row has `m` shingles at least
    (by its share of this row's, and by the least in the row's buckets), so of n shingles with n - k
    shared ones the similarity is at most (n - k) / (n + m - (n - k)).
    """
    lows = stored(entries.groupBy("band").agg(F.min("n").alias("_low")), "lows")
    rows = stored(entries.join(bounded(lows, lows.count(), 16), "band").groupBy("row").agg(
        F.min("n").alias("n"), F.min("_low").alias("_low")), "crowd")
    spread = small_batches(texts_of(rows.select("row"))).mapInArrow(
        partial(_elements, width=rule.width), "row long, shingle long")
    alone = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("row").alias("row")).filter(
        "k = 1").groupBy("row").agg(F.count(F.lit(1)).alias("alone"))
    least = F.greatest(F.col("_low"), F.ceil(F.col("n") * rule.percent / 100))
    shared = F.col("n") - F.col("alone")
    counted = rows.join(alone, "row", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    kept = stored(counted.filter(100 * shared >= rule.percent * (F.col("n") + F.greatest(least - shared, F.lit(0)))).select(
        "row", "alone"), "alone")
    return entries.join(kept, "row")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    one = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    # the same plan at every size: texts are shuffled to the pairs
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "text_a", "text_b")


def _verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    return _with_texts(pairs, texts).mapInArrow(partial(_verify, rule=rule), "a long, b long")
