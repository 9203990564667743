"""Numpy steps of suffix-array dedup: ranks of byte strings by doubling, sampled positions, and
the streaming of rows that Spark has sorted by rank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from evidence_surface.llm.fuse import mix

BASE = 16  # bytes of the ranks that all longer ones are paired from
_LEFT = np.uint64(0x9E3779B97F4A7C15)
_RIGHT = np.uint64(0xC2B2AE3D27D4EB4F)


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of a string from the ranks of its start and of its end; ranks are 64-bit names."""
    with np.errstate(over="ignore"):
        x = left * _LEFT + (right ^ _RIGHT) * _RIGHT
        x ^= x >> np.uint64(29)
        return x * _LEFT


def base_ranks(values: np.ndarray) -> np.ndarray:
    """Rank of BASE values from each position: ranks at 1, 2, 4, 8 are paired with those an
    offset of as many further on. The last axis is the position."""
    with np.errstate(over="ignore"):
        ranks, have = (values.astype(np.uint64) + np.uint64(1)) * _RIGHT, 1
    while have < BASE and ranks.shape[-1] > have:
        ranks = paired(ranks[..., :-have], ranks[..., have:])
        have *= 2
    return ranks if have == BASE else ranks[..., :0]


def longer(ranks: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Rank of `length` (at least BASE) values from positions `at` of the last axis."""
    have, out = BASE, ranks[..., at]
    while have < length:
        step = min(BASE, length - have)
        out = paired(out, ranks[..., at + have + step - BASE])
        have += step
    return out


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least (or largest) of `width` values from each position, by doubling."""
    have = 1
    while have < width and len(values):
        step = min(have, width - have)
        values = pick(values[: max(len(values) - step, 0)], values[step:])
        have += step
    return values


@dataclass
class Padded:
    """Texts in one array of byte + 1, each after and before `pad` zeros. Text d has the
    positions first[d] to first[d] + sizes[d]."""

    values: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    ranks: np.ndarray


def padded(data: np.ndarray, offsets: np.ndarray, pad: int) -> Padded:
    sizes = np.diff(offsets)
    first = offsets[:-1] + pad * (1 + np.arange(len(sizes)))
    values = np.zeros(len(data) + pad * (len(sizes) + 1), np.uint16)
    values[np.repeat(first - offsets[:-1], sizes) + np.arange(len(data))] = data.astype(np.uint16) + 1
    return Padded(values, first, sizes, base_ranks(values))


def anchors(texts: Padded, threshold: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in `values`, rank at `length`) of the sampled positions.

    Of the strings of `length` inside every string of `threshold` bytes the least in hash order
    is sampled, so equal strings of `threshold` bytes have an equal sample at equal distance.
    """
    n, width = len(texts.values), threshold - length + 1
    if len(texts.ranks) < threshold:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    ranks = longer(texts.ranks, np.arange(n - length + 1), length)
    low = _sliding(mix(ranks), width, np.minimum)  # of the string of `threshold` from each position
    inside = np.zeros(len(low) + 1, np.int32)  # +1 where strings inside a text begin, -1 after
    held = texts.sizes >= threshold
    inside[texts.first[held]] += 1
    inside[texts.first[held] + texts.sizes[held] - threshold + 1] -= 1
    low[np.cumsum(inside[:-1]) == 0] = 0
    edge = np.zeros(width - 1, np.uint64)
    around = _sliding(np.concatenate([edge, low, edge]), width, np.maximum)
    at = np.flatnonzero((around == mix(ranks)) & (around > 0))
    return np.searchsorted(texts.first, at, "right") - 1, at, ranks[at]


class ContextStream:
    """Rows sorted by (rank, context, doc) in any number of batches. `feed` says of each row
    whether its context is in a document before its own, and returns the rows that are first
    with their context though their rank has other contexts."""

    def __init__(self):
        self.last = None  # (rank, context, first doc, whether the rank has had other contexts)
        self.waiting: list[np.ndarray] | None = None  # first rows of the last rank's only context

    def feed(self, rank, context, doc, part, at):
        """-> covered (mask of the batch), open rows as columns rank, doc, part, at."""
        n = len(rank)
        given = [rank, context, doc, part, at]
        carried = 0
        if self.last is not None:
            r, c, d, many = self.last
            given = [np.concatenate([[v], x]).astype(x.dtype) for v, x in zip((r, c, d, 0, -1), given)]
            carried = 1
        rank_, context_, doc_, part_, at_ = given
        new_rank = np.ones(len(rank_), bool)
        new_rank[1:] = rank_[1:] != rank_[:-1]
        new_context = new_rank.copy()
        new_context[1:] |= context_[1:] != context_[:-1]
        index = np.arange(len(rank_))
        first_doc = doc_[np.maximum.accumulate(np.where(new_context, index, 0))]
        covered = doc_ > first_doc
        group = np.cumsum(new_rank) - 1
        contexts = np.bincount(group[new_context])
        if carried and self.last[3]:
            contexts[0] += 1
        several = contexts[group] > 1
        out = ~covered & several
        out[:carried] = False
        rows = [x[out] for x in (rank_, doc_, part_, at_)]
        if self.waiting is not None and contexts[0] > 1:
            rows = [np.concatenate([w, x]) for w, x in zip(self.waiting, rows)]
        last_group = group == group[-1]
        if group[-1] > 0 or contexts[-1] > 1:
            self.waiting = None
        if contexts[-1] == 1:
            kept = last_group & ~covered
            kept[:carried] = False
            new = [x[kept] for x in (rank_, doc_, part_, at_)]
            self.waiting = new if self.waiting is None else [np.concatenate([w, x]) for w, x in zip(self.waiting, new)]
        self.last = (rank_[-1], context_[-1], first_doc[-1], contexts[-1] > 1)
        return covered[carried:], rows


class WindowStream:
    """Rows sorted by (key, doc), each with the ranks of some windows; `feed` says which windows
    are in a row of the same key of an earlier document."""

    def __init__(self):
        self.key, self.windows, self.docs = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def feed(self, key: np.ndarray, doc: np.ndarray, windows: np.ndarray, real: np.ndarray) -> np.ndarray:
        """`windows` and `real` (rows, places) -> mask of the covered ones."""
        row, place = np.nonzero(real)
        keys, names, docs = key[row], windows[row, place], doc[row]
        old = len(self.windows)
        if old:
            keys = np.concatenate([np.full(old, self.key, key.dtype), keys])
            names, docs = np.concatenate([self.windows, names]), np.concatenate([self.docs, docs])
        order = np.lexsort((docs, names, keys))
        keys_, names_, docs_ = keys[order], names[order], docs[order]
        start = np.ones(len(order), bool)
        start[1:] = (keys_[1:] != keys_[:-1]) | (names_[1:] != names_[:-1])
        first = docs_[np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
        earlier = np.zeros(len(order), bool)
        earlier[order] = docs_ > first
        covered = np.zeros(real.shape, bool)
        covered[row, place] = earlier[old:]
        if len(key):
            kept = start & (keys_ == key[-1])
            self.key, self.windows, self.docs = key[-1], names_[kept], docs_[kept]
        return covered


def later(one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows, in any order, share (one, two) with a row of an earlier document."""
    order = np.lexsort((doc, two, one))
    out = np.zeros(len(order), bool)
    out[order] = FirstStream().feed(one[order], two[order], doc[order])
    return out


class FirstStream:
    """Rows sorted by (one, two, doc) in any number of batches; `feed` says which share (one, two)
    with a row of an earlier document. The state is a single row, however many rows a group has."""

    def __init__(self):
        self.last = None

    def feed(self, one: np.ndarray, two: np.ndarray, doc: np.ndarray) -> np.ndarray:
        if not len(doc):
            return np.zeros(0, bool)
        carried = 0
        if self.last is not None:
            one, two, doc = (np.concatenate([np.array([v], x.dtype), x]) for v, x in zip(self.last, (one, two, doc)))
            carried = 1
        start = np.ones(len(doc), bool)
        start[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = doc[np.maximum.accumulate(np.where(start, np.arange(len(doc)), 0))]
        self.last = (one[-1], two[-1], first[-1])
        return (doc > first)[carried:]


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true places in each row."""
    padded_ = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded_[:, 1:-1] = mask
    step = np.diff(padded_, axis=1)
    row, first = np.nonzero(step == 1)
    _, after = np.nonzero(step == -1)
    return row, first, after - 1


def joined(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return starts[at], reach[np.append(at[1:], len(starts)) - 1]
