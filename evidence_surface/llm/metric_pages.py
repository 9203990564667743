"""Pages of an M-tree in numpy: vectors lifted to a metric, pages cut, pages searched best first.

A larger inner product with a query is a smaller distance once every vector x gets one more
component sqrt(m2 - |x|^2), m2 the largest |x|^2, and the query's is 0: the squared distance is
|q|^2 + m2 - 2 <q, x>. Distances are floats and only bound; scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PAGE = 64
NO_SCORE = -(1 << 62)
NO_ID = (1 << 63) - 1
_EXACT = float(1 << 53)


def matrix(lists: pa.ChunkedArray | pa.Array, dims: int = 0) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.asarray(lists.value_lengths(), dtype=np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    dims = max(dims, int(lengths.max()) if len(lengths) else 0)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = values
    return out


def lifted(vectors: np.ndarray, m2: float) -> np.ndarray:
    x = vectors.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(m2 - np.einsum("ij,ij->i", x, x), 0.0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def slack(m2: float, norms: np.ndarray) -> np.ndarray:
    """More than the rounding of any distance: the root of a rounded square near zero is off by 1e-8 of the norms."""
    return 1e-6 * (np.sqrt(m2) + norms) + 1e-9


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    if q.size and x.size and np.abs(q).max() * float(np.abs(x).max()) * q.shape[1] < _EXACT:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def cut(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Indices of `x` in pages of at most `most`: halved between two far points, again and again."""
    todo, done = [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        if len(part) <= most:
            done.append(part)
            continue
        own = x[part]
        one = own[np.argmax(distances(own, own[:1]))][None, :]
        two = own[np.argmax(distances(own, one))][None, :]
        order = np.argsort((distances(own, one) - distances(own, two))[:, 0], kind="stable")
        half = len(part) // 2
        todo += [part[order[half:]], part[order[:half]]]
    return done


def centre(x: np.ndarray, reach: np.ndarray) -> tuple[int, np.ndarray, float]:
    """Of entries with radii the one nearest the mean, all distances to it, and the radius that covers all."""
    middle = int(np.argmin(distances(x, x.mean(axis=0, keepdims=True))))
    gap = distances(x, x[middle : middle + 1])[:, 0]
    return middle, gap, float((gap + reach).max())


class Best:
    """The k best (score, id, row) of each query; ties by id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), NO_SCORE)
        self.id = np.full((n, k), NO_ID)
        self.row = np.full((n, k), -1)

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores (queries `of` by objects), NO_SCORE where there is none."""
        better = score.max(axis=1) >= self.score[of, -1]
        of, score = of[better], score[better]
        if not len(of):
            return
        some = score > NO_SCORE
        ids = np.concatenate([self.id[of], np.where(some, ids[None, :], NO_ID)], axis=1)
        rows = np.concatenate([self.row[of], np.where(some, rows[None, :], -1)], axis=1)
        score = np.concatenate([self.score[of], score], axis=1)
        order = np.lexsort((ids, -score), axis=1)[:, : self.score.shape[1]]
        for kept, new in ((self.score, score), (self.id, ids), (self.row, rows)):
            kept[of] = np.take_along_axis(new, order, axis=1)


def search(part: dict, query: dict, k: int, m2: float) -> tuple[Best, int]:
    """The k best of a part's objects for each query, and how many scores were computed.

    part: vectors, ids, rows, gap (distance to the page's centre), page of the objects, by page;
    centres, radius, centre_gap (distance to the part's centre) of the pages. query: vectors,
    rows, gap (distance to the part's centre), least (a score that is known to be reached).
    """
    q = query["vectors"]
    norms = np.linalg.norm(q.astype(np.float64), axis=1)
    more = slack(m2, norms)
    best, computed = Best(len(q), k), 0

    def within(of: np.ndarray) -> np.ndarray:
        """Distance up to which an object can still be among the best."""
        least = np.maximum(query["least"][of], best.score[of, -1])
        reached = np.sqrt(np.maximum(norms[of] ** 2 + m2 - 2.0 * least, 0.0)) + more[of]
        return np.where(least > NO_SCORE, reached, np.inf)

    everyone = np.arange(len(q))
    # the part's centre stands between: a page is out if the two stored distances differ too much
    beside = np.abs(query["gap"][:, None] - part["centre_gap"][None, :]) - part["radius"][None, :]
    open_ = beside <= within(everyone)[:, None]
    some, pages = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(some):
        return best, computed
    flat = np.column_stack([q[some].astype(np.float64), np.zeros(len(some))])
    away = distances(flat, part["centres"][pages])
    bound = np.where(open_[np.ix_(some, pages)], away - part["radius"][pages][None, :], np.inf)
    order = np.argsort(bound, axis=1, kind="stable")
    edges = np.searchsorted(part["page"], np.arange(len(part["radius"]) + 1))
    at, step = 0, 1
    while at < len(pages):  # each query's nearest page, then the next two, four, ...
        turn = order[:, at : at + step]
        close = np.take_along_axis(bound, turn, axis=1) <= within(some)[:, None]
        if not close.any():
            break
        asked, pos = np.nonzero(close)
        column = turn[asked, pos]
        by_page = np.argsort(column, kind="stable")
        asked, column = asked[by_page], column[by_page]
        head = np.flatnonzero(np.diff(column, prepend=-1))
        for a, b in zip(head, np.append(head[1:], len(column))):
            c, who = int(column[a]), asked[a:b]
            of, lo, hi = some[who], edges[pages[c]], edges[pages[c] + 1]
            limit = within(of)
            near = np.abs(away[who, c][:, None] - part["gap"][None, lo:hi]) <= limit[:, None]
            near &= (bound[who, c] <= limit)[:, None]
            rows, objects = near.any(axis=1), np.flatnonzero(near.any(axis=0))
            if not len(objects):
                continue
            of, near, objects = of[rows], near[rows][:, objects], objects + lo
            computed += len(of) * len(objects)
            score = products(q[of], part["vectors"][objects])
            own = part["rows"][objects][None, :] == query["rows"][of][:, None]
            score = np.where(near & ~own & (score >= query["least"][of][:, None]), score, NO_SCORE)
            best.add(of, score, part["ids"][objects], part["rows"][objects])
        at, step = at + step, step * 2
    return best, computed
