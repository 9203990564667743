"""Binary fuse filters (three-wise, 8-bit fingerprints) built and probed with numpy.

A filter is static: it is built once from the distinct 64-bit keys of a shard. Keys are
peeled in rounds of all cells that hold a single key, and fingerprints are set in the
reverse order of the rounds.
"""

from __future__ import annotations

import math

import numpy as np

MAX_SEEDS = 100


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of starting segments."""
    if n <= 1:
        return 4, 1
    length = min(1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    return length, max(1, math.ceil(n * factor / length) - 2)


def _cells(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells and the fingerprint of each key."""
    h = mix(keys.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    first = ((h >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * length)) ^ (h & mask)
    prints = (mix(h) & np.uint64(0xFF)).astype(np.uint8)
    return np.stack([first, second, third]).astype(np.int64), prints


def _peel(cells: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    n = cells.shape[1]
    count = np.bincount(cells.ravel(), minlength=size)
    total = np.zeros(size, np.int64)  # sum of the positions of the keys in a cell
    np.add.at(total, cells, np.arange(n)[None, :])
    rounds, left = [], n
    single = np.flatnonzero(count == 1)
    while len(single):
        keys, at = np.unique(total[single], return_index=True)
        rounds.append((keys, single[at]))
        touched = cells[:, keys]
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, keys[None, :])
        left -= len(keys)
        touched = np.unique(touched)
        single = touched[count[touched] == 1]
    return rounds if left == 0 else None


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, cells) of the filter of 64-bit keys; repeats count once."""
    keys = np.unique(keys.astype(np.uint64))
    length, segments = _shape(len(keys))
    size = (segments + 2) * length
    for seed in range(MAX_SEEDS):
        cells, prints = _cells(keys, seed, length, segments)
        rounds = _peel(cells, size)
        if rounds is not None:
            table = np.zeros(size, np.uint8)
            for which, chosen in reversed(rounds):
                three = cells[:, which]
                table[chosen] = 0
                table[chosen] = prints[which] ^ table[three[0]] ^ table[three[1]] ^ table[three[2]]
            return seed, length, segments, table.tobytes()
    raise RuntimeError(f"no seed of {MAX_SEEDS} peels {len(keys)} keys")


def contains(keys: np.ndarray, seed: int, length: int, segments: int, table: bytes) -> np.ndarray:
    """False means certainly absent; an absent key gives True once in 256."""
    cells, prints = _cells(keys, seed, length, segments)
    held = np.frombuffer(table, np.uint8)
    return (held[cells[0]] ^ held[cells[1]] ^ held[cells[2]]) == prints
