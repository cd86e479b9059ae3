"""Static binary-fuse filters (three-wise) over 64-bit keys: built once, never changed."""

from __future__ import annotations

import numpy as np

from reefline.llm.common import mix64

ARITY = 3
MAX_SEEDS = 100


def _layout(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and the number of segments a key may start in.

    The growth of segments and the room for each key follow the paper on binary fuse filters.
    """
    if n < 2:
        return 4, 1
    length = 1 << int(np.floor(np.log(n) / np.log(3.33) + 2.25))
    room = round(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n)))
    return length, max(1, -(-room // length) - (ARITY - 1))


def _slots(hashes: np.ndarray, length: int, starts: int) -> np.ndarray:
    """The three slots of each hash, one in each of three neighbouring segments."""
    mask = np.uint64(length - 1)
    first = ((hashes >> np.uint64(32)) * np.uint64(starts * length)) >> np.uint64(32)
    second = (first + np.uint64(length)) ^ ((hashes >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * length)) ^ (hashes & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(hashes: np.ndarray) -> np.ndarray:
    return (hashes ^ (hashes >> np.uint64(32))).astype(np.uint8)


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot that each key has alone); None if some keys stay."""
    n = slots.shape[1]
    flat = slots.ravel()
    degree = np.bincount(flat, minlength=size)
    owner = np.zeros(size, np.int64)
    np.add.at(owner, flat, np.tile(np.arange(n), ARITY))
    rounds, left, look = [], n, np.flatnonzero(degree == 1)
    while len(look):
        keys, at = np.unique(owner[look], return_index=True)
        rounds.append((keys, look[at]))
        gone = slots[:, keys].ravel()
        np.subtract.at(degree, gone, 1)
        np.subtract.at(owner, gone, np.tile(keys, ARITY))
        left -= len(keys)
        touched = np.unique(gone)
        look = touched[degree[touched] == 1]
    return None if left else rounds


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, starting segments, fingerprints) for any keys; repeats count once."""
    keys = np.unique(keys.astype(np.uint64))
    length, starts = _layout(len(keys))
    size = (starts + ARITY - 1) * length
    for seed in range(MAX_SEEDS):
        hashes = mix64(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
        slots = _slots(hashes, length, starts)
        rounds = _peel(slots, size)
        if rounds is not None:
            break
    else:
        raise RuntimeError("no seed gives a filter that can be solved")
    prints, table = _prints(hashes), np.zeros(size, np.uint8)
    for some, own in reversed(rounds):
        # the own slot is still zero, so all three give what the other two hold
        held = table[slots[0, some]] ^ table[slots[1, some]] ^ table[slots[2, some]]
        table[own] = prints[some] ^ held
    return seed, length, starts, table.tobytes()


def contains(keys: np.ndarray, seed: int, length: int, starts: int, table: bytes) -> np.ndarray:
    """True for every key the filter was built from, and for about one other in 256."""
    cells = np.frombuffer(table, np.uint8)
    hashes = mix64(keys.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    slots = _slots(hashes, length, starts)
    return (cells[slots[0]] ^ cells[slots[1]] ^ cells[slots[2]]) == _prints(hashes)
