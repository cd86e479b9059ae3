"""Repeated windows across a corpus: what the suffix sort and the recompression operators share.

Every window of `width` tokens (bytes or words) belongs to one anchor, chosen from the window's own
content, so equal windows have equal anchors wherever they stand.  Windows with one anchor that
follow each other make a context.  Anchors whose key occurs once leave; equal contexts are counted
as one; and only keys with several different contexts have their windows compared, as hashes of
128 bits together with the key, in tasks that each take a bounded number of contexts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reefline.llm.common import buffers, chunks, lean, mix64, small_batches, stored, text_of

BUCKET_CONTEXTS = 8192
# A key with more contexts than this has its windows counted by the shuffle, one row each.
CROWDED_CONTEXTS = 100_000
NO_ID = (1 << 63) - 1
BASES = (0xD6E8FEB86659FD93, 0x9E6C63D0876A9A47)


class Rolling:
    """Hashes of any stretch of a token array, from prefix sums of tokens times powers (mod 2 ** 64)."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, tokens: np.ndarray, base: int):
        self.inverse = self.table(base, len(tokens) + 1)[1]
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * self.table(base, len(tokens) + 1)[0][:len(tokens)], out=self.sums[1:])

    @classmethod
    def table(cls, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        held = cls.powers.get(base)
        if held is None or len(held[0]) < size:
            steps = [np.full(size + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
            for step in steps:
                step[0] = 1
            held = cls.powers[base] = tuple(np.cumprod(step, dtype=np.uint64) for step in steps)
        return held

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


@dataclass(frozen=True)
class Rule:
    """What a window is.  `tokens` turns texts into token arrays, `anchors` picks each window's anchor."""

    width: int
    tokens: object      # (bytes of all texts, offsets) -> tokens of all texts, tokens in each
    anchors: object     # (tokens, tokens in each text, width) -> key per window start, anchor number, is a window
    any_repeat: bool    # True: a window repeats if it occurs twice; False: if it starts in an earlier document
    raw: bool           # True: each byte of a text is a token, so contexts travel as bytes


def _segments(lengths: np.ndarray, width: int, limit: int = 1 << 21) -> list[tuple[int, int, int]]:
    """(text, start, end) pieces of long texts that overlap so that each window lies in one of them."""
    out = []
    for i, n in enumerate(lengths.tolist()):
        start = 0
        while True:
            end = min(n, start + limit + width - 1)
            out.append((i, start, end))
            if end == n:
                break
            start += limit
    return out


def _runs(rule: Rule, tokens: np.ndarray, lengths: np.ndarray):
    """Contexts of some texts: text number, key, context hash, first window, windows."""
    key, anchor, is_window = rule.anchors(tokens, lengths, rule.width)
    at = np.flatnonzero(is_window)
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
    begin = at[new]
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    hashes = Rolling(tokens, BASES[1]).of(begin, begin + count - 1 + rule.width)
    text = np.repeat(np.arange(len(lengths)), lengths)[begin]
    first = begin - (np.cumsum(lengths) - lengths)[text]
    return text, key[begin], mix64(hashes + count.astype(np.uint64)), first, count


@lean
def _scan(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    names = ["key", "ctx", "ord", "thash", "first", "windows"]
    for batch in batches:
        offsets, body = buffers(batch.column("text"))
        order, thash = batch.column("ord").to_numpy(), batch.column("thash").to_numpy()
        for start, stop in chunks(np.diff(offsets)):
            part = offsets[start:stop + 1]
            tokens, lengths = rule.tokens(body[part[0]:part[-1]], part - part[0])
            ends = np.cumsum(lengths)
            pieces = _segments(lengths, rule.width)
            if len(pieces) == len(lengths):
                groups = [(tokens, lengths, np.arange(len(lengths)), np.zeros(len(lengths), np.int64))]
            else:
                groups = [(tokens[ends[i] - lengths[i] + a:ends[i] - lengths[i] + b], np.array([b - a]),
                           np.array([i]), np.array([a])) for i, a, b in pieces]
            for some, sizes, text, shift in groups:
                found = _runs(rule, some, sizes)
                if found is None:
                    continue
                piece, key, ctx, first, count = found
                row = start + text[piece]
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(order[row]), pa.array(thash[row]),
                    pa.array((first + shift[piece]).astype(np.int64)), pa.array(count.astype(np.int32))], names)


@lean
def _cut(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """The token stretch of each wanted context of a text."""
    for batch in batches:
        offsets, body = buffers(batch.column("text"))
        for start, stop in chunks(np.diff(offsets)):
            part = offsets[start:stop + 1]
            tokens, lengths = rule.tokens(body[part[0]:part[-1]], part - part[0])
            base = np.cumsum(lengths) - lengths
            rows = batch.slice(start, stop - start).column("wanted")
            struct = rows.flatten()
            text = np.repeat(np.arange(stop - start), np.diff(rows.offsets.to_numpy()))
            get = lambda n: struct.field(n).to_numpy(zero_copy_only=False)
            begin = base[text] + get("first")
            end = begin + get("windows") - 1 + rule.width
            size = 1 if rule.raw else 8
            data = body[part[0]:part[-1]].tobytes() if rule.raw else tokens.astype("<u8").tobytes()
            contents = [data[size * a:size * b] for a, b in zip(begin.tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays(
                [struct.field(n) for n in ("key", "ctx", "n", "ord")] + [pa.array(contents, pa.binary())],
                ["key", "ctx", "n", "ord", "content"])


def _windows(table, rule: Rule):
    """Every window of every context: context number, place in it, and a hash of 128 bits."""
    offsets, body = buffers(table.column("content"))
    tokens = rule.tokens(body, offsets)[0] if rule.raw else np.frombuffer(body.tobytes(), np.uint64)
    ends, width = offsets if rule.raw else offsets // 8, rule.width
    count = np.diff(ends) - width + 1
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = ends[:-1][owner] + place
    return owner, place, Rolling(tokens, BASES[0]).of(at, at + width), Rolling(tokens, BASES[1]).of(at, at + width)


def _ranges(owner: np.ndarray, place: np.ndarray, hit: np.ndarray, width: int, contexts: int):
    """Stretches of each context that its hit windows cover, as lists of starts and ends."""
    o, p = owner[hit], place[hit]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (p[1:] > p[:-1] + width)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(o)) - 1 if len(o) else heads
    borders = np.concatenate([[0], np.cumsum(np.bincount(o[heads], minlength=contexts))]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(borders), pa.array(v.astype(np.int64)))
             for v in (p[heads], p[tails] + width)]
    return lists, np.diff(borders) > 0


def _compare(key: tuple, table: pa.Table, rule: Rule) -> pa.Table:
    table = table.combine_chunks()
    owner, place, one, two = _windows(table, rule)
    keys, n, order = (table.column(c).to_numpy() for c in ("key", "n", "ord"))
    sort = np.lexsort((two, one, keys[owner]))
    so, s1, s2 = owner[sort], one[sort], two[sort]
    new = np.ones(len(sort), bool)
    new[1:] = (keys[so[1:]] != keys[so[:-1]]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    hit = np.zeros(len(sort), bool)
    if len(sort):
        if rule.any_repeat:
            hit[sort] = np.add.reduceat(n[so], heads)[group] > 1
        else:
            hit[sort] = np.minimum.reduceat(order[so], heads)[group] < order[so]
    lists, some = _ranges(owner, place, hit, rule.width, table.num_rows)
    out = pa.table([table.column("key"), table.column("ctx"), *lists], names=["key", "ctx", "starts", "ends"])
    return out.filter(pa.array(some))


@lean
def _spread(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            owner, place, one, two = _windows(batch, rule)
            taken = [batch.column(c).take(pa.array(owner)) for c in ("key", "ctx", "n", "ord")]
            yield pa.RecordBatch.from_arrays(
                [*taken, pa.array(place), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                ["key", "ctx", "n", "ord", "place", "one", "two"])


def _crowded(contents: DataFrame, rule: Rule) -> DataFrame:
    """The same comparison for keys with very many contexts, window by window through the shuffle."""
    spread = stored(contents.mapInArrow(
        partial(_spread, rule=rule),
        "key long, ctx long, n long, ord long, place long, one long, two long"), "crowded")
    met = F.sum("n") > 1 if rule.any_repeat else F.min("ord") < F.max("ord")
    sums = stored(spread.groupBy("key", "one", "two").agg(met.alias("met"), F.min("ord").alias("least"))
                  .filter("met").drop("met"), "met")
    found = spread.join(sums, ["key", "one", "two"])
    if not rule.any_repeat:
        found = found.filter("least < ord")
    return found.groupBy("key", "ctx").agg(F.collect_list("place").alias("starts")).withColumn(
        "ends", F.transform("starts", lambda p: p + rule.width))


def covers(docs: DataFrame, rule: Rule, crowded: int = CROWDED_CONTEXTS) -> DataFrame:
    """(ord, thash, spans): the token stretches of each text that repeated windows cover, not merged.

    `ord` is doc_id (a null id comes after all others), `thash` a hash of the text; texts without a
    repeated window have no row.
    """
    schema = "key long, ctx long, ord long, thash long, first long, windows int"
    anchors = small_batches(docs).select(*identity(), text_of().alias("text")).mapInArrow(
        partial(_scan, rule=rule), schema)
    shared = stored(anchors.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key"), "keys")
    kept = stored(anchors.join(shared, "key", "left_semi"), "anchors")
    groups = stored(kept.groupBy("key", "ctx").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "thash", "first", "windows")).alias("rep")), "contexts")
    several = stored(groups.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1"), "several")
    compared = groups.join(several, "key").select("key", "ctx", "n", "contexts", "rep.*")
    wanted = stored(compared.groupBy("ord", "thash").agg(
        F.collect_list(F.struct("key", "ctx", "n", "ord", "first", "windows")).alias("wanted"),
        F.max("contexts").alias("most")), "wanted")
    total, most = wanted.agg(F.sum(F.size("wanted")), F.max("most")).first()
    texts = docs.select(*identity(), text_of().alias("text")).join(wanted, ["ord", "thash"])
    contents = texts.select("text", "wanted").mapInArrow(
        partial(_cut, rule=rule), "key long, ctx long, n long, ord long, content binary")
    many = (most or 0) > crowded
    if many:
        contents = stored(contents, "contents")
        hot = several.filter(F.col("contexts") > crowded).select("key")
        rest, hot_contents = contents.join(hot, "key", "left_anti"), contents.join(hot, "key", "left_semi")
    else:
        rest = contents
    buckets = max(1, -(-(total or 0) // BUCKET_CONTEXTS))
    compare = lambda key, table: _compare(key, table, rule)
    # all contexts of a key meet in one bucket, and a bucket holds about BUCKET_CONTEXTS of them
    ranges = rest.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInArrow(
        compare, "key long, ctx long, starts array<long>, ends array<long>")
    if many:
        ranges = ranges.unionByName(_crowded(hot_contents, rule))
    found = stored(groups.select("key", "ctx", "n", F.col("rep.ord").alias("least")).join(ranges, ["key", "ctx"], "left")
                   .filter("n > 1 or starts is not null"), "found")
    whole = F.col("n") > 1 if rule.any_repeat else F.col("ord") > F.col("least")
    shifted = lambda name: F.transform(name, lambda p: p + F.col("first"))
    spans = kept.join(found, ["key", "ctx"]).select(
        "ord", "thash",
        F.when(whole, F.array("first")).otherwise(shifted("starts")).alias("starts"),
        F.when(whole, F.array(F.col("first") + F.col("windows") - 1 + rule.width)).otherwise(shifted("ends")).alias("ends"))
    return stored(spans.filter("starts is not null").groupBy("ord", "thash").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")), "covers")


def identity() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"), F.xxhash64(text_of()).alias("thash")]


def with_covers(docs: DataFrame, rule: Rule) -> DataFrame:
    """Every row's doc_id and text with the starts and ends of its covered stretches (null: none)."""
    found = covers(docs, rule)
    # two rows of one id and text have the same stretches, so the join adds no rows
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *identity()).join(
        found, ["ord", "thash"], "left").select(
        "doc_id", "text", "starts", "ends")


def mask(length: int, starts, ends) -> np.ndarray:
    """True for every token that some stretch covers."""
    change = np.zeros(length + 1, np.int64)
    if starts is not None:
        np.add.at(change, np.asarray(starts), 1)
        np.add.at(change, np.asarray(ends), -1)
    return np.cumsum(change)[:length] > 0
