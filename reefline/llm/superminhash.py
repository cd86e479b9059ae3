"""SuperMinHash signatures of many sets at once, level by level."""

from __future__ import annotations

import numpy as np

from reefline.llm.common import mix64, ragged

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _draws(elements: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each element's value in [0, 1) (as 32 bits) and its random place among the slots level .. size - 1."""
    random = mix64(elements + np.uint64((level + 1) * int(GOLDEN) % (1 << 64)))
    place = ((random & np.uint64(0xFFFFFFFF)) * np.uint64(size - level)) >> np.uint64(32)
    return random >> np.uint64(32), place.astype(np.int64) + level


def signatures(elements: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """One line of `size` 64-bit values per set; sets follow each other in `elements`, none empty.

    Every element deals out the slots in an order of its own (a Fisher-Yates shuffle, one step a
    level) and offers `level + value` to the slot it reaches.  A slot keeps its least offer, so
    what one level fills no later level can change, and a set ends at the level that fills its last
    slot.  Large sets end after one or two levels; the orders of all slots are kept only for sets
    that are still open.
    """
    count = len(lengths)
    result = np.full((count, size), np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(count), lengths)
    order = None
    for level in range(size):
        value, place = _draws(elements, level, size)
        if level == 0:
            slot = place
        else:
            if order is None:
                # replay the swap of the first level: slot 0 went where the first draw came from
                order = np.tile(np.arange(size, dtype=np.int16), (len(elements), 1))
                first = _draws(elements, 0, size)[1]
                order[np.arange(len(elements)), first] = 0
                order[:, 0] = first
            rows = np.arange(len(elements))
            slot = order[rows, place].astype(np.int64)
            order[rows, place] = order[:, level]
        offer = (np.uint64(level) << np.uint64(32)) + value
        np.minimum.at(result.reshape(-1), owner * size + slot, offer)
        open_sets = (result == np.iinfo(np.uint64).max).any(1)
        if not open_sets.any():
            break
        stay = open_sets[owner]
        if not stay.all():
            elements, owner = elements[stay], owner[stay]
            order = None if order is None else order[stay]
    return result


def shingles(words: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each word sequence, sorted, and their count.

    A sequence shorter than `width` is one shingle as a whole; an empty one has none.
    """
    starts = np.cumsum(lengths) - lengths
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    at = ragged(starts, counts)
    short = np.repeat(lengths, counts) < width
    hashed = np.full(len(at), 0x51ED270B, np.uint64)
    available = np.repeat(starts + lengths, counts)
    for step in range(width):
        inside = at + step < available
        word = np.where(inside, words[np.minimum(at + step, max(len(words) - 1, 0))], np.uint64(0)) if len(words) else hashed
        hashed = mix64(hashed * GOLDEN + word + np.uint64(step))
    hashed[short] ^= np.uint64(1)
    owner = np.repeat(np.arange(len(lengths)), counts)
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    return hashed[new], np.bincount(owner[new], minlength=len(lengths))
