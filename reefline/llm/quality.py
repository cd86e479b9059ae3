"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Training reads a bounded sample of labelled documents (`sample` rows, chosen by a hash of doc_id);
the model is one weight for each of `2 ** bits` slots, so its size is fixed.  Scoring reads every
document whole and is a sparse dot product of the document's n-gram counts and the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from reefline.llm.common import CACHE_WORD_BYTES, WordHashes, buffers, lean, mix64, small_batches, text_of

BITS = 18
SAMPLE = 12_000
THRESHOLD = 0.3
EPOCHS = 3
LEAST_UPDATES, MOST_EPOCHS = 20_000, 30
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.1, 1.0
# Length of the shapes' block of features; that of words and pairs has length one.
SHAPE_LENGTH = 3.0
HOLD_OUT_MOD = 5


class Shapes(WordHashes):
    """Hashes of words' shapes: letters as a or A, digits as 0, marks kept, repeats drawn together.

    They say how an unseen word is written.
    """

    TABLE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
                  for b in range(256))

    def hash(self, word: bytes) -> int:
        shape = word[:CACHE_WORD_BYTES].translate(self.TABLE)
        return super().hash(b"\0" + bytes(b for i, b in enumerate(shape) if i == 0 or b != shape[i - 1]))


def features(data: bytes, words: WordHashes, shapes: Shapes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of words, word pairs and word shapes with their values; slot 0 is the bias.

    Beside the shapes stands, for each word, whether it repeats the one before.  Both blocks have
    a fixed length; the shapes' values are roots of their shares, so that they say how much of a text
    is written in a way, however long it is.
    """
    parts = data.split()
    slots, values = [np.zeros(1, np.int32)], [np.ones(1, np.float32)]
    if parts:
        one = words.of(parts)
        pairs = mix64(one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:])
        again = np.append(np.uint64(1), np.where(one[1:] == one[:-1], np.uint64(2), np.uint64(1)))
        for block, root in ((np.concatenate([mix64(one), pairs]), False),
                            (mix64(np.concatenate([shapes.of(parts), again])), True)):
            found, counts = np.unique(block >> np.uint64(64 - bits), return_counts=True)
            scaled = np.sqrt(counts) if root else 1.0 + np.log(counts)
            slots.append(found.astype(np.int32))
            length = SHAPE_LENGTH if root else 1.0
            values.append((length * scaled / np.sqrt((scaled * scaled).sum())).astype(np.float32))
    return np.concatenate(slots), np.concatenate(values)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    free = np.sign(z) * L1 - z
    return np.where(np.abs(z) <= L1, 0.0, free / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(rows: list[tuple[bytes, int]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over the rows in the given order; float32 weights.

    `epochs` passes, and more where rows are few, up to LEAST_UPDATES updates or MOST_EPOCHS passes.

    No rows give weights of zero, hence scores of one half.
    """
    words, shapes = WordHashes(), Shapes()
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    held = [(*features(data, words, shapes, bits), label) for data, label in rows]
    for _ in range(max(epochs, min(MOST_EPOCHS, LEAST_UPDATES // max(1, len(held))))):
        for slots, values, label in held:
            zs, ns = z[slots], n[slots]
            w = _weights(zs, ns)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -30, 30)))
            g = (p - label) * values
            sigma = (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA
            # a slot may come from both blocks; add up its parts
            np.add.at(z, slots, g - sigma * w)
            np.add.at(n, slots, g * g)
    return _weights(z, n).astype(np.float32)


@lean
def _train_task(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        rows += zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(),
                    batch.column("label").to_pylist())
    rows.sort()
    weights = train([((text or "").encode(), label) for _, text, label in rows], bits)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()])], ["weights"])


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from `labels` (doc_id, label 0 or 1) on the texts of `docs`.

    At most `sample` labelled documents, those with the least hash of doc_id, are read by the one
    training task.  Rows without id, label or document take no part; a null text counts as empty.
    """
    ranked = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select(
        "doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("key"))
    chosen = ranked.orderBy("key", "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    model = rows.select("key", "text", "label").repartition(1).mapInArrow(
        partial(_train_task, bits=bits), "weights binary").first()
    return np.frombuffer(model[0], np.float32) if model else np.zeros(1 << bits, np.float32)


def _scores(column: pa.Array, weights: np.ndarray, words: WordHashes, shapes: Shapes, bits: int) -> np.ndarray:
    offsets, body = buffers(column)
    data = body.tobytes()
    out = np.zeros(len(column))
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        slots, values = features(data[a:b], words, shapes, bits)
        out[i] = weights[slots] @ values
    return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


@lean
def _score(batches: Iterator[pa.RecordBatch], shared, bits: int, least: float | None) -> Iterator[pa.RecordBatch]:
    """Scores in place of the last column, or with `least` the rows that reach it, without that column."""
    weights = np.frombuffer(shared.value, np.float32).astype(np.float64)
    words, shapes = WordHashes(), Shapes()
    for batch in batches:
        last = batch.num_columns - 1
        found = _scores(batch.column(last), weights, words, shapes, bits)
        kept, names = [batch.column(i) for i in range(last)], batch.schema.names[:last]
        if least is None:
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], [*names, "score"])
        else:
            yield pa.RecordBatch.from_arrays(kept, names).filter(pa.array(found >= least))


def _apply(docs: DataFrame, weights: np.ndarray, least: float | None, schema) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights.tobytes())
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if least is not None or c != "text"]
    bits = int(np.log2(len(weights)))
    return small_batches(docs).select(*own, text_of().alias("scored")).mapInArrow(
        partial(_score, shared=shared, bits=bits, least=least), schema)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Every row's columns but the text, with `score` (0 to 1); null and empty texts get the bias' score."""
    return _apply(docs, weights, None, T.StructType(
        [f for f in docs.schema.fields if f.name != "text"]).add("score", "double"))


def accept(docs: DataFrame, weights: np.ndarray, least: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that score `least` or more, all columns as they are."""
    return _apply(docs, weights, least, docs.schema)
