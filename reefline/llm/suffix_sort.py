"""Repeated windows of bytes, found in passes that split groups of equal windows further and further.

Sorting every suffix of a corpus would shuffle one row per byte.  Equal windows agree on every
fixed choice of their bytes, so the first pass groups them by a sample, the DIGIT bytes inside a
window whose hash is least.  Neighbouring windows share their sample, so one row stands for all of
them (about one row for 60 bytes).  Samples that occur once leave; the next pass splits the others by
everything around the sample that their windows span; the last compares windows that are still in
mixed groups by 128-bit hashes of all their bytes.  No order of suffixes is made.  Each byte that a
window of a group of two or more covers goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reefline.llm.common import buffers, lean, mix64
from reefline.llm.repeats import BASES, Rolling, Rule, mask, with_covers

WINDOW = 200
DIGIT = 64


def _tokens(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))
    return values[body], np.diff(offsets)


def _samples(tokens: np.ndarray, lengths: np.ndarray, width: int):
    """Of each window: the hash of its sample, the sample's place, and whether the window fits its text."""
    n = len(tokens)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    fits = left >= width
    digit = min(DIGIT, width)
    key, place = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    if n < width:
        return key, place, fits
    starts = np.arange(n - digit + 1)
    hashes = Rolling(tokens, BASES[0]).of(starts, starts + digit)
    # the upper half orders, the lower half tells the place; of equal digits the first one counts
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | starts.astype(np.uint64)
    span, reach = width - digit + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[:len(least) - (span - reach)], least[span - reach:])
    count = n - width + 1
    place[:count] = (least[:count] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    key[:count] = hashes[place[:count]]
    return key, place, fits


def rule(width: int = WINDOW) -> Rule:
    return Rule(width, _tokens, _samples, True, True)


@lean
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, body = buffers(batch.column("text"))
        out: list[tuple] = []
        starts, ends = batch.column("starts").to_pylist(), batch.column("ends").to_pylist()
        kept = []
        for i in range(batch.num_rows):
            data = body[offsets[i]:offsets[i + 1]]
            if not starts[i]:
                kept.append(data.tobytes())
                out.append((len(data), 0, 0))
                continue
            gone = mask(len(data), starts[i], ends[i])
            kept.append(data[~gone].tobytes())
            out.append((len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])))
        n, removed, spans = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def remove_repeated_bytes(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256.

    A byte goes if a string of `width` bytes over it also starts anywhere else, in the same document
    or another.  Reads `doc_id` and `text`; a null text is empty, texts shorter than the window keep
    all bytes, repeated rows are copies like any others, and no rows give no rows.
    """
    return with_covers(docs, rule(width)).mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
