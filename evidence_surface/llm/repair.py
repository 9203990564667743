"""Re-Pair grammars over the words of many documents at once, and the periodic runs they give.

A grammar is built in rounds. In each, adjacent symbols of a document that occur as a pair
twice or more are candidates; of overlapping candidates the more frequent pair is taken, and
what is taken at least twice becomes a nonterminal. The symbols left are joined two by two
into a tree of single occurrences, so each document is one symbol at the end.

A run of a period, if it is at least four periods long, lies in a smallest node of the
derivation and crosses the boundary between that node's two children, with two periods or
more on one side. So each node's boundary is searched once, on its first occurrence, for the
periods that fit into it. What is found is carried to every place the node is derived to;
pieces that a node's edge cut off are merged into the interval that holds them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from evidence_surface.llm.fuse import mix
from evidence_surface.llm.words import ragged

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
_CANDIDATES = 1 << 20
_SLOTS = 8  # of the table of counts, per pair


@dataclass
class Nodes:
    """Per node the word where its first occurrence starts and the lengths of its children;
    per occurrence the node and the word where it starts, sorted by node."""

    start: np.ndarray
    left: np.ndarray
    right: np.ndarray
    occurrence: np.ndarray
    at: np.ndarray


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which keys can occur twice: those that share a slot of a table of counts."""
    if len(key) < 4096:
        return np.ones(len(key), bool)
    slot = (mix(key.view(np.uint64)) % np.uint64(_SLOTS * len(key))).astype(np.int64)
    return np.bincount(slot)[slot] > 1


def _taken(place: np.ndarray, key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of the pairs at ascending places those to replace: no two overlap, frequent ones first."""
    rank = (count.astype(np.uint64) << np.uint64(40)) | (mix(key.view(np.uint64)) >> np.uint64(24))
    touching = np.diff(place) == 1
    new = np.concatenate([[True], ~touching | (rank[1:] != rank[:-1])])
    head = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    joined = np.append(touching[head[1:] - 1], False)  # whether the next stretch touches this one
    higher = rank[head[1:]] > rank[head[:-1]]
    beaten = np.zeros(len(head), bool)
    beaten[:-1] |= joined[:-1] & higher
    beaten[1:] |= joined[:-1] & ~higher
    return ~beaten[of] & ((np.arange(len(place)) - head[of]) % 2 == 0)


def grammar(words: np.ndarray, first: np.ndarray) -> Nodes:
    """Nodes of the documents, whose words are `words[first[d]:first[d + 1]]`, small integers."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    seq, at = words.astype(np.int64), np.arange(len(words))
    size = np.ones(len(words), np.int64)
    live = np.ones(len(words), bool)
    names = int(seq.max()) + 1 if len(seq) else 1
    found, nodes = [], 0
    while len(seq) > 1:
        place = np.flatnonzero(live[:-1] & (doc[:-1] == doc[1:]))
        key = (doc[place] * names + seq[place]) * names + seq[place + 1]
        some = _repeated(key)
        place, key = place[some], key[some]
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.diff(key[order], prepend=-1))
        count = np.empty(len(key), np.int64)
        count[order] = np.repeat(np.diff(edge, append=len(key)), np.diff(edge, append=len(key)))
        place, key, count = place[count > 1], key[count > 1], count[count > 1]
        live[:] = False
        live[place] = True
        if not len(place):
            break
        chosen = _taken(place, key, count)
        place, key = place[chosen], key[chosen]
        _, one, of, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        often = times > 1
        if not often.any():
            break
        new = np.cumsum(often) - 1
        kept = often[of]
        place, of = place[kept], new[of[kept]]
        one = one[often]
        one = np.searchsorted(np.flatnonzero(kept), one)
        found.append((at[place[one]], size[place[one]], size[place[one] + 1], nodes + of, at[place]))
        nodes += len(one)
        seq[place] = names + of
        names += len(one)
        size[place] += size[place + 1]
        live[place] = True
        live[place[place > 0] - 1] = True
        live[place] |= live[place + 1]
        stays = np.ones(len(seq), bool)
        stays[place + 1] = False
        # the pair that began at a removed symbol now begins at the new one, which is live
        seq, at, size, doc, live = seq[stays], at[stays], size[stays], doc[stays], live[stays]
    while len(doc) > 1:
        begin = np.concatenate([[True], doc[1:] != doc[:-1]])
        inner = np.arange(len(doc)) - np.maximum.accumulate(np.where(begin, np.arange(len(doc)), 0))
        place = np.flatnonzero((inner[:-1] % 2 == 0) & ~begin[1:])
        if not len(place):
            break
        found.append((at[place], size[place], size[place + 1], nodes + np.arange(len(place)), at[place]))
        nodes += len(place)
        size[place] += size[place + 1]
        stays = np.ones(len(doc), bool)
        stays[place + 1] = False
        at, size, doc = at[stays], size[stays], doc[stays]
    if not found:
        return Nodes(*[np.zeros(0, np.int64)] * 5)
    start, left, right, occurrence, where = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(occurrence, kind="stable")
    return Nodes(start, left, right, occurrence[order], where[order])


def _same_ahead(w: np.ndarray, x: int, y: int, stop: int) -> int:
    """How many words from x and from y on are equal, y's before `stop`."""
    done, step = 0, 64
    while y + done < stop:
        n = min(step, stop - y - done)
        differ = np.flatnonzero(w[x + done : x + done + n] != w[y + done : y + done + n])
        if len(differ):
            return done + int(differ[0])
        done, step = done + n, step * 4
    return done


def _same_behind(w: np.ndarray, x: int, y: int, stop: int) -> int:
    """How many words before x and before y are equal, x's from `stop` on."""
    done, step = 0, 64
    while x - done > stop:
        n = min(step, x - done - stop)
        differ = np.flatnonzero(w[x - done - n : x - done] != w[y - done - n : y - done])
        if len(differ):
            return done + n - 1 - int(differ[-1])
        done, step = done + n, step * 4
    return done


def _candidates(w, low, middle, high, to_right: bool):
    """(node, period) whose words beside the boundary allow the period: at least
    max(LEAST_LENGTH, LEAST_EXPONENT periods) / 2 words on that side, probed at five places."""
    room = (high - middle) if to_right else (middle - low)
    most = np.where(room >= 3, np.minimum((high - low) // LEAST_EXPONENT, room // 2), 0)
    for node0, node1 in _chunks(most):
        node = np.repeat(np.arange(node0, node1), most[node0:node1])
        q = ragged(most[node0:node1]) + 1
        need = np.maximum(2 * q, 3) - q  # that many words equal those a period on
        x = middle[node]
        for probe in (0, 1, 0.5, 0.25, 0.75):
            k = (probe * (need - 1)).astype(np.int64)
            equal = w[x + k] == w[x + k + q] if to_right else w[x - 1 - k] == w[x - 1 - k - q]
            node, q, need, x = node[equal], q[equal], need[equal], x[equal]
        yield node, q


def _chunks(sizes: np.ndarray):
    """Ranges of consecutive items of about _CANDIDATES in all; a larger item is a range of its own."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        upto = max(int(np.searchsorted(total, total[at] + _CANDIDATES, "right")) - 1, at + 1)
        yield at, upto
        at = upto


def _crossing(w: np.ndarray, low: int, middle: int, high: int, tries: list[tuple[int, bool]]):
    """Runs in [low, high) over `middle`, of (period, side) in ascending periods."""
    found: list[tuple[int, int, int]] = []
    for q, to_right in tries:
        need = max(2 * q, 3)
        x0, x1 = (middle, middle + need) if to_right else (middle - need, middle)
        if any(s <= x0 and x1 <= e for s, e, _ in found):
            continue  # a shorter period holds there
        if _same_ahead(w, x0, x0 + q, x1) < need - q:
            continue
        s = x0 - _same_behind(w, x0, x0 + q, low)
        e = x1 + _same_ahead(w, x1 - q, x1, high)
        if e - s >= max(LEAST_LENGTH, LEAST_EXPONENT * q):
            found.append((s, e, q))
    return found


def runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, stop, period of all maximal runs, by start, then period; places count through `words`."""
    g = grammar(words, first)
    wide = np.flatnonzero(g.left + g.right >= LEAST_LENGTH)
    low, middle, high = g.start[wide], (g.start + g.left)[wide], (g.start + g.left + g.right)[wide]
    node, period, side = [], [], []
    for to_right in (True, False):
        for n, q in _candidates(words, low, middle, high, to_right):
            node.append(n)
            period.append(q)
            side.append(np.full(len(n), to_right))
    none = np.zeros(0, np.int64)
    if not node:
        return none, none, none
    node, period, side = np.concatenate(node), np.concatenate(period), np.concatenate(side)
    order = np.lexsort((~side, period, node))
    node, period, side = node[order], period[order], side[order]
    found = []
    edge = np.flatnonzero(np.diff(node, prepend=-1))
    for a, b in zip(edge, np.append(edge[1:], len(node))):
        i = int(node[a])
        tries = zip(period[a:b].tolist(), side[a:b].tolist())
        for s, e, q in _crossing(words, int(low[i]), int(middle[i]), int(high[i]), tries):
            found.append((int(wide[i]), s - int(low[i]), e - int(low[i]), q))
    if not found:
        return none, none, none
    of, s, e, q = np.array(found, np.int64).T
    begin, upto = np.searchsorted(g.occurrence, of), np.searchsorted(g.occurrence, of, "right")
    times = upto - begin
    where = g.at[np.repeat(begin, times) + ragged(times)]
    return _merged(where + np.repeat(s, times), where + np.repeat(e, times), np.repeat(q, times))


def _merged(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that share a period or more are pieces of one run."""
    order = np.lexsort((s, q))
    s, e, q = s[order], e[order], q[order]
    span = int(e.max()) + 1
    group = np.cumsum(np.diff(q, prepend=q[0]) != 0)
    reach = np.maximum.accumulate(e + group * span) - group * span
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] > reach[:-1] - q[1:])])
    head = np.flatnonzero(new)
    s, e, q = s[head], np.maximum.reduceat(e, head), q[head]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]
