"""Concatenate and cut: documents become token ids, one long row of ids, then fixed windows.

Two passes.  The first tokenizes and writes each partition's ids with the ids before each document
inside its partition.  Prefix sums over the partitions' totals (one row a partition) give every
partition its place in the whole.  The second pass cuts each document at the window borders; a
window that spans documents or partitions gets one boundary record (piece) from each of them, and
the pieces' offsets put it together again.  No ids are shuffled.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from reefline.llm.common import bounded, chunks, lean, ragged, running_totals, small_batches, stored, text_of

WINDOW = 4096
END_ID = 2
PAD_ID = 0
# Strings that each of a worker's two caches holds, and bytes of text it encodes at once.
CACHE_ROWS, ENCODE_BYTES = 240_000, 1_000_000


# How the tokenizer of word_bpe_49k.json splits lower-cased chunks of these characters.
PLAIN_CHUNK = r"[\x21-\x7EÀ-ÖØ-öø-ÿ]+"
CHUNK_PIECES = r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+"


class IdTable:
    """Strings and their ids: row numbers by string, and each row's place in one long array."""

    def __init__(self):
        self.rows: dict[str | None, int] = {}
        self.starts, self.lengths, self.flat = array("q"), array("q"), array("i")
        self.held, self.uses = 0, np.zeros(0, np.int64)

    def add(self, keys: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.starts)
        self.rows.update(zip(keys, range(first, first + len(keys))))
        self.starts.frombytes((len(self.flat) + np.cumsum(lengths) - lengths).astype(np.int64).tobytes())
        self.lengths.frombytes(lengths.astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.int32).tobytes())
        self.held += sum(map(len, filter(None, keys)))

    def find(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.rows.get, keys, repeat(-1)), np.int64, len(keys))

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # views of the arrays, not copies
        lengths = np.asarray(self.lengths)[rows]
        return np.asarray(self.flat)[ragged(np.asarray(self.starts)[rows], lengths)], lengths

    def count(self, rows: np.ndarray) -> None:
        """Remember how often rows were asked for."""
        asked = np.bincount(rows, minlength=len(self.starts))
        asked[:len(self.uses)] += self.uses
        self.uses = asked

    def trim(self, limit: int, fixed: int) -> None:
        """Beyond `limit` rows keep the first `fixed` and the third of the limit that is asked for most."""
        if len(self.starts) <= limit and self.held <= 16 << 20:
            return
        keys, uses = list(self.rows), self.uses
        often = fixed + np.argsort(-uses[fixed:], kind="stable")[:limit // 3]
        often = np.concatenate([np.arange(fixed), np.sort(often[uses[often] > 1])])
        ids, lengths = self.ids(often)
        self.__init__()
        self.add([keys[i] for i in often.tolist()], ids, lengths)
        # older counts weigh less, so that words no longer seen give way
        self.uses = uses[often] // 2 + 1


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values that end before the given places."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])


class ChunkTokens:
    """Token ids of texts, through the ids of their blank-separated chunks.

    For tokenizers that drop white space and never join tokens across it: the ids of a text are
    those of its chunks, in order.  Each chunk is tokenized once while the cache lasts.  `pieces`
    is the pattern by which the tokenizer splits a lower-cased chunk of PLAIN_CHUNK's characters;
    the model then codes each piece once.  Other chunks go through the tokenizer whole; without
    `pieces` all do.
    """

    def __init__(self, path: str, end_id: int, pieces: str | None = CHUNK_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.split = re.compile(pieces).findall if pieces else None
        self.plain = re.compile(PLAIN_CHUNK).fullmatch
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the model reads each byte of a letter beyond ASCII as a character of its own
        self.bytes_of = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.chunks, self.pieces = IdTable(), IdTable()
        # None stands for the end of a document, "" for blanks at the end of a text
        self.chunks.add([None, ""], np.array([end_id]), np.array([1, 0]))
        self.pieces.add(["\n"], np.zeros(0), np.array([0]))

    def _piece_rows(self, pieces: list[str]) -> np.ndarray:
        rows = self.pieces.find(pieces)
        missing = np.flatnonzero(rows < 0).tolist()
        if missing:
            new = list({pieces[i] for i in missing})
            code = self.tokenizer.model.tokenize
            coded = [code(p if p.isascii() else p.translate(self.bytes_of)) for p in new]
            self.pieces.add(new, np.fromiter(map(attrgetter("id"), chain.from_iterable(coded)), np.int32),
                            np.fromiter(map(len, coded), np.int64, len(coded)))
            rows[missing] = self.pieces.find([pieces[i] for i in missing])
        return rows

    def _learn(self, words: list[str]) -> None:
        simple, whole = [], words
        if self.split:
            simple = [w for w in words if "<|" not in w and self.plain(w)]
            known = set(simple)
            whole = [w for w in words if w not in known]
        if simple:
            self.pieces.trim(CACHE_ROWS, 1)
            pieces = self.split("\n".join(simple).lower() + "\n")
            rows = self._piece_rows(pieces)
            self.pieces.count(rows)
            ids, lengths = self.pieces.ids(rows)
            self.chunks.add(simple, ids, _sums(lengths, np.flatnonzero(rows == 0) + 1))
        if whole:
            coded = [c.ids for c in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
            self.chunks.add(whole, np.fromiter(chain.from_iterable(coded), np.int32),
                            np.fromiter(map(len, coded), np.int64, len(coded)))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id behind, and the count for each text."""
        self.chunks.trim(CACHE_ROWS, 2)
        words = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = words.flatten().dictionary_encode()
        # Python looks up each distinct chunk of the batch once
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.chunks.find(distinct)
        missing = np.flatnonzero(known < 0)
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            self._learn(new)
            known[missing] = self.chunks.find(new)
        ends = np.cumsum(pc.list_value_length(words).to_numpy())
        # row 0 is the end of a document
        rows = np.insert(known[coded.indices.to_numpy()], ends, 0)
        self.chunks.count(rows)
        ids, lengths = self.chunks.ids(rows)
        return ids, _sums(lengths, ends + np.arange(1, len(ends) + 1))


@lean
def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    coder = ChunkTokens(path, end_id)
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy()
        for start, stop in chunks(sizes, ENCODE_BYTES):
            rows = batch.slice(start, stop - start)
            ids, counts = coder.encode(rows.column("text"))
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), pa.array(np.full(len(counts), part, np.int32)),
                pa.array(before + ends - counts), pa.array(counts),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)),
            ], ["doc_id", "part", "before", "doc_tokens", "ids"])
            before += int(ends[-1])


@lean
def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("ids")
        count = batch.column("doc_tokens").to_numpy()
        first = batch.column("base").to_numpy() + batch.column("before").to_numpy()
        pieces = (first + count - 1) // window - first // window + 1
        row = np.repeat(np.arange(len(count)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        sequence = first[row] // window + nth
        begin = np.maximum(first[row], sequence * window)
        end = np.minimum(first[row] + count[row], (sequence + 1) * window)
        # the pieces cut the ids in order, so only the list borders change
        borders = pa.array(np.concatenate([[0], np.cumsum(end - begin)]), pa.int32())
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id").take(pa.array(row)), pa.array(begin - first[row]), pa.array(end - begin),
            pa.array(count[row]), pa.array(sequence), pa.array(begin - sequence * window),
            pa.ListArray.from_arrays(borders, lists.flatten()),
        ], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


@lean
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = lists.flatten().to_numpy().astype("<u4")
        borders = np.concatenate([[0], np.cumsum(batch.column("length").to_numpy())])
        view = memoryview(values.tobytes())
        sums = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
        kept = [c for c in batch.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in kept] + [pa.array(sums, pa.int64())], [*kept, "ids_crc32"])


PLACE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID,
         digests: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    With `digests` a piece has `ids_crc32`, the CRC-32 of its ids as little-endian 32-bit values, in
    place of the ids.
    Only `doc_id` and `text` of `docs` are read.  A null or empty text gives the end id alone.
    Repeated rows and null ids are packed like any other row.  A text of any length is cut over as
    many windows as it needs.  No documents give no pieces.  All windows but the last are full.
    """
    tokens = stored(
        small_batches(docs).select("doc_id", text_of().alias("text")).mapInArrow(
            partial(_tokenize, path=tokenizer_path, end_id=end_id),
            "doc_id long, part int, before long, doc_tokens long, ids array<int>"), "tokens")
    totals = stored(running_totals(
        tokens.groupBy("part").agg(F.sum("doc_tokens").alias("_tokens")), "part", "_tokens", "base"), "places")
    # at most one row for each partition of the first pass
    places = bounded(totals, totals.count(), 32)
    placed = tokens.join(places, "part")
    if digests:
        return placed.mapInArrow(lambda batches: _digest(_cut(batches, window)), f"{PLACE}, ids_crc32 long")
    return placed.mapInArrow(partial(_cut, window=window), f"{PLACE}, ids array<int>")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = PAD_ID) -> DataFrame:
    """One row per sequence: its ids put together from its pieces, padded to the window.

    A sequence whose length is a power of two is left as it is.  A group never exceeds a window.
    """
    joined = pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_pieces"))
    ids = F.flatten(F.transform("_pieces", lambda p: p["ids"]))
    n = F.size("_ids")
    padded = F.when(F.bit_count(n) == 1, F.col("_ids")).otherwise(
        F.concat("_ids", F.array_repeat(F.lit(pad_id), F.lit(window) - n)))
    return joined.select("sequence_id", ids.alias("_ids")).select(
        "sequence_id", n.cast("long").alias("tokens"), padded.alias("ids"))
