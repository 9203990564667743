"""Words of a column of texts as byte spans and as one Arrow array, exact strings, no hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LETTERS = np.zeros(256, bool)  # ASCII letters and every byte of other characters
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True; no run goes on over an edge of a text."""
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends - starts


def strings(data: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The runs of `inside` as an array of strings."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    small = ends[-1] < 1 << 31
    kind = pa.string() if small else pa.large_string()
    ends = ends.astype(np.int32) if small else ends
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
