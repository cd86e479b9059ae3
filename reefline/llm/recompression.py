"""Substring dedup by recompression.

Rounds rename a document's words: runs of one symbol become one symbol, then neighbouring pairs of a
left and a right symbol become one (a hash of the symbol says which it is).  Names are hashes of
what they replace, so all executors give the same name to the same run or pair without asking each
other.  Each symbol carries its support: the words that fix it whatever stands around them.  Two
equal windows hold the same symbols with support inside the window, so the window's anchor is one
of these, and Spark groups windows by anchors.  Symbols shared between documents reveal candidates;
the windows are then compared by 128-bit hashes of their words' 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reefline.llm.common import WordHashes, buffers, lean, mix64
from reefline.llm.repeats import BASES, Rolling, Rule, mask, with_covers

WINDOW = 13
ROUNDS = 2
# Supports shorter than this serve only windows that have no other.
LEAST_SUPPORT = 4
FAR = 1 << 40
_WORDS: list[WordHashes] = []


def _tokens(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not _WORDS:
        _WORDS.append(WordHashes())
    data, ends = body.tobytes(), offsets.tolist()
    lists = [data[a:b].split() for a, b in zip(ends[:-1], ends[1:])]
    return _WORDS[0].of([w for words in lists for w in words]), np.array([len(x) for x in lists], np.int64)


def _named(kind: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix64(mix64(one + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) + two)


def _neighbours(values: np.ndarray, text: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The value before and after each place inside its text."""
    before, after = np.full(len(values), none), np.full(len(values), none)
    same = text[1:] == text[:-1]
    before[1:][same] = values[:-1][same]
    after[:-1][same] = values[1:][same]
    return before, after


def _round(level: int, name, low, high, text):
    """One round: names, supports (low to high) and texts of the symbols after runs and after pairs."""
    # runs: a symbol must differ from both neighbours, so their supports belong to it
    first = np.ones(len(name), bool)
    first[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(name)) - 1
    size = last - at + 1
    before = _neighbours(low, text, -FAR)[0][at]
    after = _neighbours(high, text, FAR)[1][last]
    low, high = np.minimum(before, low[at]), np.maximum(after, high[last])
    name, text = np.where(size > 1, _named(2 * level, name[at], size.astype(np.uint64)), name[at]), text[at]
    # pairs: a left symbol takes the right one behind it
    right = (mix64(name + np.uint64(level + 77)) >> np.uint64(63)).astype(bool)
    joins = np.zeros(len(name), bool)
    joins[:-1] = ~right[:-1] & right[1:] & (text[1:] == text[:-1])
    taken = np.zeros(len(name), bool)
    taken[1:] = joins[:-1]
    before, after = _neighbours(low, text, -FAR)[0], _neighbours(high, text, FAR)[1]
    # a left symbol alone shows that the next is left too; a right one that the one before is right
    high = np.where(~right, np.maximum(high, after), high)
    low = np.where(right & ~taken, np.minimum(low, before), low)
    keep = ~taken
    partner = np.flatnonzero(joins)
    high[partner] = np.maximum(high[partner], high[partner + 1])
    low[partner] = np.minimum(low[partner], low[partner + 1])
    name = name.copy()
    name[partner] = _named(2 * level + 1, name[partner], name[partner + 1])
    return name[keep], low[keep], high[keep], text[keep]


def symbols(tokens: np.ndarray, lengths: np.ndarray, rounds: int = ROUNDS):
    """Name, support and level of every symbol of every round; level 0 are the words."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(tokens))
    state = (tokens, place, place + 1, text)
    out = [(*state[:3], np.zeros(len(tokens), np.int64))]
    for level in range(1, rounds + 1):
        state = _round(level, *state)
        out.append((*state[:3], np.full(len(state[0]), level)))
    return [np.concatenate(x) for x in zip(*out)]


def _anchors(tokens: np.ndarray, lengths: np.ndarray, width: int):
    n = len(tokens)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    fits = left >= width
    none = np.iinfo(np.uint64).max
    if not fits.any():
        return np.zeros(n, np.uint64), np.zeros(n, np.int64), fits
    name, low, high, level = symbols(tokens, lengths)
    inside = high - low <= width
    name, low, high, level = name[inside], low[inside], high[inside], level[inside]
    key = mix64(Rolling(tokens, BASES[0]).of(low, high) + mix64(name + level.astype(np.uint64)))
    # the upper half orders, the lower half is the symbol's number
    order = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)

    def least(some: np.ndarray) -> np.ndarray:
        """For every window the least of these symbols with support inside it."""
        found, here = np.full(n, none, np.uint64), np.full(n, none, np.uint64)
        size = (high - low)[some]
        for k in range(1, width + 1):
            # the least symbol of at most k words that begins at each place, seen from k words before a window's end
            now = some[size == k]
            np.minimum.at(here, low[now], order[now])
            np.minimum(found[:n - width + k], here[width - k:], out=found[:n - width + k])
        return found
    best = least(np.flatnonzero(high - low >= LEAST_SUPPORT))
    bare = fits & (best == none)
    if bare.any():
        best[bare] = least(np.flatnonzero(high - low < LEAST_SUPPORT))[bare]
    chosen = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    chosen[~fits] = 0
    return key[chosen], chosen, fits


def rule(width: int = WINDOW) -> Rule:
    return Rule(width, _tokens, _anchors, False, False)


@lean
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, body = buffers(batch.column("text"))
        data = body.tobytes()
        starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
        total, removed, kept = [], [], []
        for i in range(batch.num_rows):
            words = data[offsets[i]:offsets[i + 1]].split()
            total.append(len(words))
            gone = 0
            if starts[i]:
                covered = mask(len(words), starts[i], ends[i])
                gone = int(covered.sum())
                words = [w for w, c in zip(words, covered.tolist()) if not c]
            removed.append(gone)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()),
             pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])


def remove_repeated_words(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (words joined by blanks, UTF-8), kept_sha256.

    A word goes if a window of `width` words over it also starts in a document with a smaller doc_id.
    Rows with a null id come after all others and not before each other; rows of one id do not
    affect each other.  A null text has no words; texts shorter than the window keep all.  No rows
    give no rows.
    """
    return with_covers(docs, rule(width)).mapInArrow(
        _remove, "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string")
