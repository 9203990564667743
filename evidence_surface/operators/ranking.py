"""Ranking inside one group: numpy over Arrow batches.

Spark has placed each group with its short candidate list in one row; here
the distances of all places of a group to all its candidates are one small
matrix. Groups of one place, of which dense maps have many, are ranked for a
whole batch at once. The same in SQL functions takes several times as long (a
row per pair to sort, or interpreted lambdas over arrays).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CELLS_PER_BATCH = 65_536
PAIRS_AT_ONCE = 500_000


@dataclass(frozen=True)
class Mean:
    """A column `name`: the mean of `value` over the k nearest, weighted by distance to the power
    of -`power`; strictly within `radius` of the nearest point that point's value."""

    name: str
    value: str
    k: int
    power: float
    radius: float | None = None


class Lists:
    """A list<struct> column as one array per field, with each row's part of it."""

    def __init__(self, column: pa.ListArray, by: str | None = None):
        offsets = column.offsets.to_numpy()
        flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
        names = [f.name for f in flat.type]
        self._offsets = offsets - offsets[0]
        self._fields = dict(zip(names, (c.to_numpy(zero_copy_only=False) for c in flat.flatten())))
        if by is not None:
            row = np.repeat(np.arange(len(column)), np.diff(self._offsets))
            order = np.lexsort((self._fields[by], row))
            self._fields = {c: f[order] for c, f in self._fields.items()}

    def lengths(self) -> np.ndarray:
        return np.diff(self._offsets)

    def flat(self, rows: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The elements of some rows: which of the rows each is of, and its fields."""
        many = self.lengths()[rows]
        ends = np.cumsum(many)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
        at = np.repeat(self._offsets[:-1][rows], many) + step
        return np.repeat(np.arange(len(rows)), many), {c: f[at] for c, f in self._fields.items()}

    def of(self, row: int) -> dict[str, np.ndarray]:
        part = slice(self._offsets[row], self._offsets[row + 1])
        return {c: f[part] for c, f in self._fields.items()}


def near_box(found: dict[str, np.ndarray], lon: np.ndarray, lat: np.ndarray, need: int):
    """The candidates that can be among the `need` nearest of any place."""
    if len(found["lon"]) <= need:
        return found
    x0, x1, y0, y1 = lon.min(), lon.max(), lat.min(), lat.max()
    x, y = found["lon"], found["lat"]
    reach = np.hypot(np.maximum(x - x0, x1 - x), np.maximum(y - y0, y1 - y))
    radius = np.partition(reach, need - 1)[need - 1] * (1 + 1e-9) + 1e-9
    gap = np.hypot(
        np.maximum(np.maximum(x0 - x, x - x1), 0.0), np.maximum(np.maximum(y0 - y, y - y1), 0.0)
    )
    keep = gap <= radius
    return {c: f[keep] for c, f in found.items()}


def distances(found: dict[str, np.ndarray], lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    dx = lon[:, None] - found["lon"]
    dy = lat[:, None] - found["lat"]
    return np.sqrt(dx * dx + dy * dy)


def nearest(found: dict[str, np.ndarray], lon, lat, k: int, but: np.ndarray | None = None):
    """Candidate numbers and distances of each place's k nearest, by
    (distance, point_id). `but` names a candidate each place leaves out."""
    d = distances(found, lon, lat)
    count = d.shape[1]
    if but is not None:
        d[found["point_id"] == but[:, None]] = np.inf
        count -= 1
    order = np.argsort(d, axis=1, kind="stable")[:, : min(k, count)]
    return order, np.take_along_axis(d, order, axis=1)


def nearest_set(d: np.ndarray, k: int) -> np.ndarray:
    """As `nearest`, in any order: a selection, and a full sort only for places
    with a tie at their k-th distance."""
    if d.shape[1] <= k:
        return np.broadcast_to(np.arange(d.shape[1]), d.shape)
    order = np.argpartition(d, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(d, order[:, k - 1 :], axis=1)
    tied = np.flatnonzero((d <= last).sum(axis=1) > k)
    if len(tied):
        order[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :k]
    return order


def nearest_sets(d: np.ndarray, ks: Sequence[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """`nearest_set` and its distances for several k, each taken from the next greater one's."""
    sets = {}
    order, near = np.broadcast_to(np.arange(d.shape[1]), d.shape), d
    for k in sorted(set(ks), reverse=True):
        if sets:
            # in the candidates' order again, which decides ties
            order = np.sort(order, axis=1)
            near = np.take_along_axis(d, order, axis=1)
        inner = nearest_set(near, k)
        order, near = np.take_along_axis(order, inner, axis=1), np.take_along_axis(near, inner, axis=1)
        sets[k] = order, near
    return sets


def weighted_means(d: np.ndarray, values: np.ndarray, power: float, zero: float) -> np.ndarray:
    """Weights are 1 / d ** power, divided by that of the nearest: the same mean,
    and no power leaves the range of doubles."""
    d = np.where(d == 0, zero, d)
    weights = (d.min(axis=1, keepdims=True) / d) ** power
    return (weights * values).sum(axis=1) / weights.sum(axis=1)


def _by_pairs(rows: np.ndarray, many: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in runs of about PAIRS_AT_ONCE candidates; a fuller row is a run of its own."""
    total, at = np.cumsum(many), 0
    while at < len(rows):
        before = total[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(total, before + PAIRS_AT_ONCE, "right")))
        yield np.arange(at, upto)
        at = upto


def nearest_of_each(place: np.ndarray, found: dict[str, np.ndarray], lon, lat, k: int, but: np.ndarray | None = None):
    """`nearest` for many places, each with candidates of its own: `place` is the place
    of each candidate. Returns the places, candidate numbers, ranks from 0 and distances."""
    at = np.arange(len(place)) if but is None else np.flatnonzero(found["point_id"] != but[place])
    place = place[at]
    dx, dy = lon[place] - found["lon"][at], lat[place] - found["lat"][at]
    d = np.sqrt(dx * dx + dy * dy)
    order = np.lexsort((found["point_id"][at], d, place))
    place, at, d = place[order], at[order], d[order]
    fresh = np.ones(len(place), bool)
    fresh[1:] = place[1:] != place[:-1]
    rank = np.arange(len(place)) - np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
    kept = rank < k
    return place[kept], at[kept], rank[kept], d[kept]


def means_of_each(rank: np.ndarray, d: np.ndarray, values: np.ndarray, power: float, zero: float):
    """`weighted_means` of the places that have neighbours, in their order."""
    d = np.where(d == 0, zero, d)
    first = np.flatnonzero(rank == 0)
    nearest_d = np.repeat(d[first], np.diff(np.append(first, len(d))))
    weights = (nearest_d / d) ** power
    return np.add.reduceat(weights * values, first) / np.add.reduceat(weights, first) if len(first) else d[:0]


def _cells_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(row["i0"], min(row["i0"] + row["side"], row["ny"]), dtype=np.int32)
    j = np.arange(row["j0"], min(row["j0"] + row["side"], row["nx"]), dtype=np.int32)
    return np.repeat(i, len(j)), np.tile(j, len(i))


_BLOCK_COLUMNS = ("i0", "j0", "side", "nx", "ny", "min_lon", "min_lat", "resolution")


def _single_cells(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Groups of one cell: their rows in the batch, i, j, lon, lat."""
    c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in _BLOCK_COLUMNS}
    rows = np.flatnonzero(c["side"] == 1)
    i, j = c["i0"][rows].astype(np.int32), c["j0"][rows].astype(np.int32)
    step = c["resolution"][rows]
    return rows, i, j, c["min_lon"][rows] + j * step, c["min_lat"][rows] + i * step


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of several cells."""
    columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _BLOCK_COLUMNS}
    for n in np.flatnonzero(columns["side"] > 1):
        row = {c: v[n] for c, v in columns.items()}
        i, j = _cells_of(row)
        yield n, i, j, row["min_lon"] + j * row["resolution"], row["min_lat"] + i * row["resolution"]


def _in_parts(parts: Iterator[tuple[int | np.ndarray, dict[str, np.ndarray]]], batch: pa.RecordBatch, keep: Sequence[str]):
    """Batches of the parts' columns, led by the columns in `keep` of their groups: the
    number of a group, or one for each row of the part."""
    rows, columns, size = [], [], 0

    def flush():
        owner = pa.array(np.concatenate(rows))
        names = [*keep, *columns[0]]
        arrays = [batch.column(c).take(owner) for c in keep]
        for name in columns[0]:
            joined = np.concatenate([c[name] for c in columns])
            arrays.append(pa.array(joined, from_pandas=joined.dtype.kind == "f" and name.startswith("over_")))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for n, part in parts:
        length = len(next(iter(part.values())))
        if not length:
            continue
        rows.append(np.broadcast_to(n, length))
        columns.append(part)
        size += length
        if size >= CELLS_PER_BATCH:
            yield flush()
            rows, columns, size = [], [], 0
    if rows:
        yield flush()


def cell_rows(k: int, values: Sequence[str]) -> Callable:
    """Groups -> one row per cell and neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = Lists(batch.column("cands"), by="point_id")

            def parts():
                for n, i, j, lon, lat in _blocks(batch):
                    found = near_box(lists.of(n), lon, lat, k)
                    order, d = nearest(found, lon, lat, k)
                    many = order.shape[1]
                    yield n, {
                        "i": np.repeat(i, many),
                        "j": np.repeat(j, many),
                        "rn": np.tile(np.arange(1, many + 1, dtype=np.int32), len(i)),
                        "point_id": found["point_id"][order].ravel(),
                        "d": d.ravel(),
                        **{v: found[v][order].ravel() for v in values},
                    }
                rows, i, j, lon, lat = _single_cells(batch)
                for part in _by_pairs(rows, lists.lengths()[rows]):
                    owner, found = lists.flat(rows[part])
                    place, at, rank, d = nearest_of_each(owner, found, lon[part], lat[part], k)
                    yield rows[part][place], {
                        "i": i[part][place],
                        "j": j[part][place],
                        "rn": (rank + 1).astype(np.int32),
                        "point_id": found["point_id"][at],
                        "d": d,
                        **{v: found[v][at] for v in values},
                    }

            yield from _in_parts(parts(), batch, ["map_id"])

    return run


def _override(given: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, values: Sequence[str]):
    """The given cells' values at their place in the block, NaN elsewhere."""
    inside = (given["i"] >= i[0]) & (given["i"] <= i[-1]) & (given["j"] >= j[0]) & (given["j"] <= j[-1])
    at = (given["i"][inside] - i[0]) * (j[-1] - j[0] + 1) + given["j"][inside] - j[0]
    columns = {}
    for v in values:
        columns[f"over_{v}"] = np.full(len(i), np.nan)
        columns[f"over_{v}"][at] = given[v][inside]
    return columns


def _override_single(over: Lists, rows: np.ndarray, i: np.ndarray, j: np.ndarray, values: Sequence[str]):
    """As `_override`, for groups of one cell each."""
    owner, given = over.flat(rows)
    same = (given["i"] == i[owner]) & (given["j"] == j[owner])
    columns = {f"over_{v}": np.full(len(rows), np.nan) for v in values}
    for v in values:
        columns[f"over_{v}"][owner[same]] = given[v][same]
    return columns


def cell_surface(means: Sequence[Mean], values: Sequence[str], zero: float, override: bool) -> Callable:
    """Groups -> one row per cell with its interpolated values, all from one list of candidates.

    With `override`, the group's `over` list gives cells further `values`.
    """
    ks = [m.k for m in means]
    most = max(ks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = Lists(batch.column("cands"), by="point_id")
            over = Lists(batch.column("over")) if override else None

            def parts():
                for n, i, j, lon, lat in _blocks(batch):
                    found = near_box(lists.of(n), lon, lat, most)
                    d = distances(found, lon, lat)
                    sets = nearest_sets(d, ks)
                    first = d.argmin(axis=1)
                    least = d[np.arange(len(d)), first]
                    part = {"i": i, "j": j, "lon": lon, "lat": lat}
                    for m in means:
                        order, near = sets[m.k]
                        mean = weighted_means(near, found[m.value][order], m.power, zero)
                        if m.radius is not None:
                            mean = np.where(least < m.radius, found[m.value][first], mean)
                        part[m.name] = mean
                    if over is not None:
                        part.update(_override(over.of(n), i, j, values))
                    yield n, part
                rows, i, j, lon, lat = _single_cells(batch)
                for some in _by_pairs(rows, lists.lengths()[rows]):
                    owner, found = lists.flat(rows[some])
                    _, at, rank, d = nearest_of_each(owner, found, lon[some], lat[some], most)
                    part = {"i": i[some], "j": j[some], "lon": lon[some], "lat": lat[some]}
                    first = rank == 0
                    for m in means:
                        own = rank < m.k
                        mean = means_of_each(rank[own], d[own], found[m.value][at[own]], m.power, zero)
                        if m.radius is not None:
                            mean = np.where(d[first] < m.radius, found[m.value][at][first], mean)
                        part[m.name] = mean
                    if over is not None:
                        part.update(_override_single(over, rows[some], i[some], j[some], values))
                    yield rows[some], part

            yield from _in_parts(parts(), batch, ["map_id"])

    return run


def _members(batch: pa.RecordBatch, lists: Lists, mates: Lists, need: int):
    """The sites of each group of a whole page, and their candidates."""
    only = batch.column("member").to_numpy()
    for n in np.flatnonzero(only < 0):
        own = mates.of(n)
        yield n, own, near_box(lists.of(n), own["lon"], own["lat"], need)


def _single_members(batch: pa.RecordBatch, lists: Lists, mates: Lists):
    """Runs of groups of one site: their rows in the batch, the sites, and the site and
    fields of each candidate."""
    only = batch.column("member").to_numpy()
    rows = np.flatnonzero(only >= 0)
    for part in _by_pairs(rows, lists.lengths()[rows]):
        some = rows[part]
        owner, mate = mates.flat(some)
        one = mate["point_id"] == only[some][owner]
        yield some, {c: f[one] for c, f in mate.items()}, *lists.flat(some)


def site_rows(k: int, exclude_self: bool) -> Callable:
    """Groups of sites -> one row per site and neighbour."""
    need = k + 1 if exclude_self else k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = Lists(batch.column("cands"), by="point_id")
            mates = Lists(batch.column("places"))

            def parts():
                for n, own, found in _members(batch, lists, mates, need):
                    but = own["point_id"] if exclude_self else None
                    order, d = nearest(found, own["lon"], own["lat"], k, but)
                    many = order.shape[1]
                    yield n, {
                        "point_id": np.repeat(own["point_id"], many),
                        "rn": np.tile(np.arange(1, many + 1, dtype=np.int32), len(own["lon"])),
                        "neighbour_id": found["point_id"][order].ravel(),
                        "d": d.ravel(),
                        "value": found["value"][order].ravel(),
                    }
                for rows, own, owner, found in _single_members(batch, lists, mates):
                    but = own["point_id"] if exclude_self else None
                    place, at, rank, d = nearest_of_each(owner, found, own["lon"], own["lat"], k, but)
                    yield rows[place], {
                        "point_id": own["point_id"][place],
                        "rn": (rank + 1).astype(np.int32),
                        "neighbour_id": found["point_id"][at],
                        "d": d,
                        "value": found["value"][at],
                    }

            yield from _in_parts(parts(), batch, ["map_id"])

    return run


def site_means(means: Sequence[Mean], exclude_self: bool, zero: float) -> Callable:
    """Groups of sites -> the sites with the columns of `means`, all from one list of candidates;
    without neighbours a site keeps its value."""
    most = max(m.k for m in means)
    need = most + 1 if exclude_self else most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = Lists(batch.column("cands"), by="point_id")
            mates = Lists(batch.column("places"))

            def parts():
                for n, own, found in _members(batch, lists, mates, need):
                    but = own["point_id"] if exclude_self else None
                    order, d = nearest(found, own["lon"], own["lat"], most, but)
                    part = dict(own)
                    for m in means:
                        near = found[m.value][order[:, : m.k]]
                        part[m.name] = weighted_means(d[:, : m.k], near, m.power, zero) if near.shape[1] else own["value"]
                    yield n, part
                for rows, own, owner, found in _single_members(batch, lists, mates):
                    but = own["point_id"] if exclude_self else None
                    place, at, rank, d = nearest_of_each(owner, found, own["lon"], own["lat"], most, but)
                    part = dict(own)
                    for m in means:
                        near = rank < m.k
                        mean = own["value"].astype(float)
                        mean[place[rank == 0]] = means_of_each(
                            rank[near], d[near], found[m.value][at[near]], m.power, zero
                        )
                        part[m.name] = mean
                    yield rows, part

            yield from _in_parts(parts(), batch, ["map_id", "page"])

    return run
