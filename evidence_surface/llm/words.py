"""Words and their hashes for a column of texts at once, with numpy over the Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from evidence_surface.llm.fuse import mix

SLICE_BYTES = 1 << 20

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
SEPARATORS = {"space": _ASCII_SPACE, "not_alnum": _NOT_ALNUM}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """hashes, and byte starts and ends from the start of `data`; document d has the words
    first[d] to first[d + 1] and the bytes offsets[d] to offsets[d + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text; a longer text is a run of its own."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        upto = min(max(upto, at + 1), batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null text has none."""
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def run_hashes(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values; every run has one value at least."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    weights = powers(_BASE, int(lengths.max()))[ragged(lengths)]
    with np.errstate(over="ignore"):
        sums = np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * weights, np.cumsum(lengths) - lengths)
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(texts: pa.Array, separators: str = "space") -> Words:
    """Words between separators, ASCII letters in lower case."""
    data, offsets = buffers(texts)
    inside = ~SEPARATORS[separators][data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before &= ~edge  # a word never goes on over the edge of a text
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after &= ~edge
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    hashes = run_hashes(_LOWER[data[inside]], ends - starts)
    return Words(data, offsets, hashes, starts, ends, np.searchsorted(starts, offsets))


def shingle_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and the first one of each document (with the end).

    A text of fewer words has one shingle of all its words; without words it has none.
    """
    total = len(w.hashes)
    counts = np.diff(w.first)
    each = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    at = np.repeat(w.first[:-1], each) + ragged(each)
    last = np.repeat(w.first[1:], each)
    padded = np.concatenate([w.hashes, np.zeros(n, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            inside = at + i < last
            out += np.where(inside, padded[np.minimum(at + i, total)], 0) * powers(_BASE, n + 1)[i + 1]
    return mix(out), np.concatenate([[0], np.cumsum(each)])
