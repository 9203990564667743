"""Exact nearest-neighbour joins over a `SiteIndex`.

Queries come in groups that lie close together: a block of grid cells, or a
page of points. Per group the index is walked from its top level down. At
each level the boxes' greatest distances give a radius that surely holds
enough sites, and boxes that start beyond it are left out. A group that still
sees too many boxes is split. What remains is a short candidate list per
group, exact for each of its members, and each member ranks only that list
(`ranking`). Groups, not points or cells, are what is shuffled.

Distance is planar, on degrees. Rank is by (distance, point_id).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import BROADCAST_ROWS, shuffle_partitions, shuffled_side, small_side
from . import ranking
from .ranking import Mean
from .sites import SiteIndex

# executors need not have the package: the helper travels with its tasks
cloudpickle.register_pickle_by_value(ranking)

BLOCK = 16  # cells per side of a block; a power of SPLIT
SPLIT = 4  # a block splits into SPLIT x SPLIT
BLOCK_SPLITS = 2  # after so many splits a block is one cell
SPLIT_ABOVE = 64  # boxes of a level a group may see before it is split
JOIN_SALTS = 16

_BOX = ("x0", "x1", "y0", "y1")


def _norm(dx: str, dy: str) -> str:
    return f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))"


# least and greatest distance between a place in the group's box and one in
# the node's box
_DMIN = _norm("greatest(x0 - n_x1, n_x0 - x1, 0D)", "greatest(y0 - n_y1, n_y0 - y1, 0D)")
_DMAX = _norm("greatest(n_x1 - x0, x1 - n_x0)", "greatest(n_y1 - y0, y1 - n_y0)")
_SITE_DMIN = _norm("greatest(x0 - lon, lon - x1, 0D)", "greatest(y0 - lat, lat - y1, 0D)")


def _prune(pairs: DataFrame, keys: Sequence[str], need: int) -> DataFrame:
    """Keep the boxes that can hold one of the `need` nearest sites of any
    place in the group, with the `radius` that says so. It is infinite if the
    map has fewer sites than that."""
    group = f"PARTITION BY {', '.join(keys)}"
    enough = f"min(CASE WHEN seen >= {need} THEN dmax END) OVER ({group})"
    return (
        pairs.selectExpr("*", f"{_DMIN} AS dmin", f"{_DMAX} AS dmax")
        .selectExpr("*", f"sum(n_cnt) OVER ({group} ORDER BY dmax ROWS UNBOUNDED PRECEDING) AS seen")
        # a little wider than exact, to cover the rounding of distances
        .selectExpr("*", f"coalesce({enough} * (1 + 1e-9D) + 1e-9D, double('infinity')) AS radius")
        .where("dmin <= radius")
        .drop("seen", "dmin", "dmax")
    )


def _as_boxes(level: DataFrame, *extra: str) -> DataFrame:
    box = [f"{c} AS n_{c}" for c in (*_BOX, "cnt")]
    return level.selectExpr("map_id", "node AS n_node", *box, *extra)


def _join_top(groups: DataFrame, index: SiteIndex, limit: int) -> DataFrame:
    top = _as_boxes(index.levels[-1])
    if index.level_rows[-1] <= limit:
        return groups.join(F.broadcast(top), "map_id")
    # a map has few top boxes, but may have most of the groups: spread them
    return _salted_join(groups, top, ["map_id"], groups.columns)


def _salted_join(groups: DataFrame, boxes: DataFrame, on: list[str], by: Sequence[str]) -> DataFrame:
    """Join of groups with boxes; a box that many groups see is copied, and the
    groups are dealt to its copies by a hash of their columns `by`."""
    salted = groups.selectExpr("*", f"pmod(xxhash64({', '.join(by)}), {JOIN_SALTS}) AS salt")
    copies = boxes.selectExpr("*", f"explode(sequence(0L, {JOIN_SALTS - 1}L)) AS salt")
    return salted.join(shuffled_side(copies), [*on, "salt"]).drop("salt")


def _join_boxes(
    groups: DataFrame, boxes: DataFrame, on: list[str], by: Sequence[str], rows: int, limit: int
) -> DataFrame:
    if rows <= limit:
        return groups.join(F.broadcast(boxes), on)
    return _salted_join(groups, boxes, on, by)


def candidates(
    groups: DataFrame,
    keys: Sequence[str],
    placed_by: Sequence[str],
    index: SiteIndex,
    need: int,
    split: Callable[[DataFrame], DataFrame] | None = None,
    values: Sequence[str] = ("value",),
    sites: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    splits: int = 1,
) -> DataFrame:
    """One row per group with `cands`, its candidate sites.

    `groups` has map_id, `keys`, the box x0, x1, y0, y1 and whatever else is
    to be carried; it is partitioned by `placed_by`, a subset of the keys.
    `split` turns rows whose `crowded` is true into rows of smaller groups; after
    `splits` times a group is a single place.
    """
    n = shuffle_partitions(groups.sparkSession)
    carried = groups.columns
    pairs = _join_top(groups, index, broadcast_rows)
    if index.level_rows[-1] > broadcast_rows:
        pairs = pairs.repartition(n, *placed_by)
    visible = f"count(*) OVER (PARTITION BY {', '.join(keys)}) > {SPLIT_ABOVE} AS crowded"

    def refine(df: DataFrame, last: bool) -> DataFrame:
        df = _prune(df, keys, need)
        if split is None:
            return df
        # over the pages, until a group is not crowded or cannot be split
        for _ in range(splits if last else 1):
            df = _prune(split(df.drop("radius").selectExpr("*", visible)), keys, need)
        return df

    pairs = refine(pairs, len(index.levels) == 1)
    for at, (level, rows) in reversed(list(enumerate(zip(index.levels[:-1], index.level_rows[:-1])))):
        children = _as_boxes(level, "parent AS above")
        # the radius of the level above holds for its parts too
        pairs = (
            pairs.selectExpr(*carried, "radius", "n_node AS above")
            .transform(_join_boxes, children, ["map_id", "above"], keys, rows, broadcast_rows)
            .where(f"{_DMIN} <= radius")
            .drop("above", "radius")
        )
        if rows > broadcast_rows:
            pairs = pairs.repartition(n, *placed_by)
        pairs = refine(pairs, at == 0)

    members = (index.sites if sites is None else sites).selectExpr(
        "map_id", "page", "point_id", "lon", "lat", *[f"{v} AS v_{v}" for v in values]
    )
    pairs = (
        pairs.selectExpr(*carried, "radius", "n_node AS page")
        .transform(_join_boxes, members, ["map_id", "page"], keys, index.n_sites, broadcast_rows)
        .where(f"{_SITE_DMIN} <= radius")
    )
    if index.n_sites > broadcast_rows:
        pairs = pairs.repartition(n, *placed_by)
    site = ", ".join(f"'{v}', v_{v}" for v in values)
    rest = [f"first({c}) AS {c}" for c in carried if c not in keys]
    found = f"collect_list(named_struct('point_id', point_id, 'lon', lon, 'lat', lat, {site})) AS cands"
    return pairs.groupBy(*keys).agg(*[F.expr(e) for e in (*rest, found)])


def page_lists(sites: DataFrame, columns: Sequence[str]) -> DataFrame:
    """map_id, page, places: the sites of each page, at most a page's worth."""
    return sites.groupBy("map_id", "page").agg(F.collect_list(F.struct(*columns)).alias("places"))


# --- grid cells ------------------------------------------------------------

GRID_COLUMNS = ("min_lon", "min_lat", "nx", "ny", "resolution")
CELL_KEYS = ("map_id", "bi", "bj", "i0", "j0", "side")


_BLOCK_BOX = (
    "min_lon + j0 * resolution AS x0",
    "min_lon + (least(j0 + side, nx) - 1) * resolution AS x1",
    "min_lat + i0 * resolution AS y0",
    "min_lat + (least(i0 + side, ny) - 1) * resolution AS y1",
)


def _split_blocks(pairs: DataFrame) -> DataFrame:
    step = f"(side div {SPLIT})"
    corners = f"sequence(0L, {SPLIT * SPLIT - 1}L)"
    parts = f"explode(CASE WHEN crowded AND side > 1 THEN {corners} ELSE array(-1L) END) AS corner"
    kept = [c for c in pairs.columns if c not in ("i0", "j0", "side", "crowded", *_BOX)]
    return (
        pairs.selectExpr("*", parts)
        .selectExpr(
            *kept,
            f"int(CASE WHEN corner < 0 THEN i0 ELSE i0 + corner div {SPLIT} * {step} END) AS i0",
            f"int(CASE WHEN corner < 0 THEN j0 ELSE j0 + corner % {SPLIT} * {step} END) AS j0",
            f"int(CASE WHEN corner < 0 THEN side ELSE {step} END) AS side",
        )
        .where("i0 < ny AND j0 < nx")
        .selectExpr("*", *_BLOCK_BOX)
    )


def grid_blocks(meta: DataFrame) -> DataFrame:
    """Blocks of BLOCK x BLOCK cells, spread over all tasks.

    The grids come from few rows: the rows of blocks are dealt out before their
    columns come into being, so no task makes all blocks of a map.
    """
    n = shuffle_partitions(meta.sparkSession)
    return (
        meta.selectExpr("map_id", *GRID_COLUMNS, f"explode(sequence(0, int((ny - 1) div {BLOCK}))) AS bi")
        .repartition(n, "map_id", "bi")
        .selectExpr("*", f"explode(sequence(0, int((nx - 1) div {BLOCK}))) AS bj")
        .repartition(n, "map_id", "bi", "bj")
        .selectExpr("*", f"bi * {BLOCK} AS i0", f"bj * {BLOCK} AS j0", f"{BLOCK} AS side")
        .selectExpr("*", *_BLOCK_BOX)
    )


def cell_groups(
    meta: DataFrame,
    index: SiteIndex,
    k: int,
    values: Sequence[str] = ("value",),
    sites: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Groups of grid cells with their candidate sites."""
    if index.per_location < k:
        raise ValueError(f"the index keeps {index.per_location} points per location, {k} are needed")
    return candidates(
        grid_blocks(meta),
        CELL_KEYS,
        ("map_id", "bi", "bj"),
        index,
        k,
        split=_split_blocks,
        values=values,
        sites=sites,
        broadcast_rows=broadcast_rows,
        splits=BLOCK_SPLITS,
    )


def _ranking_input(groups: DataFrame, *extra: str) -> DataFrame:
    return groups.select("map_id", "i0", "j0", "side", *GRID_COLUMNS, "cands", *extra)


def cell_neighbours(groups: DataFrame, k: int, values: Sequence[str] = ("value",)) -> DataFrame:
    """The k nearest sites of each cell: map_id, i, j, rn, point_id, d, values."""
    key = groups.schema["map_id"].dataType.simpleString()
    schema = f"map_id {key}, i int, j int, rn int, point_id bigint, d double"
    schema += "".join(f", {v} double" for v in values)
    return _ranking_input(groups).mapInArrow(ranking.cell_rows(k, list(values)), schema)


def cell_means(
    groups: DataFrame, means: Sequence[Mean], zero_distance: float, values: Sequence[str] = ("value",)
) -> DataFrame:
    """The columns of `means` of each cell: map_id, i, j, lon, lat, means; and over_<value> if the
    groups carry `over`, given values of single cells."""
    override = "over" in groups.columns
    key = groups.schema["map_id"].dataType.simpleString()
    columns = [*(m.name for m in means), *(f"over_{v}" for v in values if override)]
    schema = f"map_id {key}, i int, j int, lon double, lat double"
    schema += "".join(f", {c} double" for c in columns)
    run = ranking.cell_surface(list(means), list(values), zero_distance, override)
    return _ranking_input(groups, *(["over"] if override else [])).mapInArrow(run, schema)


def cell_values(groups: DataFrame, k: int, power: float, radius: float | None, zero_distance: float) -> DataFrame:
    """Interpolated value of each cell: map_id, i, j, lon, lat, value."""
    return cell_means(groups, [Mean("value", "value", k, power, radius)], zero_distance)


# --- the sites themselves --------------------------------------------------

PAGE_KEYS = ("map_id", "zone", "qpage", "member")
_WHOLE_PAGE = -1


def _page_splitter(index: SiteIndex, broadcast_rows: int) -> Callable[[DataFrame], DataFrame]:
    lists = page_lists(index.sites, ("point_id", "lon", "lat"))
    places = small_side(lists, index.n_sites, broadcast_rows).toDF("of_map", "of_page", "places")

    def split(pairs: DataFrame) -> DataFrame:
        kept = [c for c in pairs.columns if c not in ("member", "crowded", *_BOX)]
        matching = F.expr(
            f"map_id = of_map AND qpage = of_page AND crowded AND member = {_WHOLE_PAGE}"
        )
        return (
            pairs.join(places, matching, "left")
            .selectExpr("*", "explode_outer(places) AS place")
            .selectExpr(
                *kept,
                "coalesce(place.point_id, member) AS member",
                "coalesce(place.lon, x0) AS x0",
                "coalesce(place.lon, x1) AS x1",
                "coalesce(place.lat, y0) AS y0",
                "coalesce(place.lat, y1) AS y1",
            )
        )

    return split


def site_groups(
    index: SiteIndex, k: int, exclude_self: bool = True, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Pages of sites, or single sites, with `places` (the page) and `cands`."""
    need = k + 1 if exclude_self else k
    if index.per_location < need:
        raise ValueError(f"the index keeps {index.per_location} points per location, {need} are needed")
    n = shuffle_partitions(index.sites.sparkSession)
    # placed by pairs of pages: an explicit placement equal to the one the
    # pages were grouped by would be dropped, and its partition count with it
    pages = (
        index.levels[0]
        .selectExpr(
            "map_id", "shiftright(node, 1) AS zone", "node AS qpage", f"{_WHOLE_PAGE}L AS member", *_BOX
        )
        .repartition(n, "map_id", "zone")
    )
    # one level: a map has few pages, so no page can see too many
    split = _page_splitter(index, broadcast_rows) if len(index.levels) > 1 else None
    groups = candidates(
        pages, PAGE_KEYS, ("map_id", "zone"), index, need, split, broadcast_rows=broadcast_rows
    ).select("map_id", F.col("qpage").alias("page"), "member", "cands")
    lists = page_lists(index.sites, ("point_id", "lon", "lat", "value", "loc_rank"))
    return groups.join(small_side(lists, index.n_sites, broadcast_rows), ["map_id", "page"])


def site_neighbours(groups: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """The k nearest sites of each site: map_id, point_id, rn, neighbour_id, d, value."""
    key = groups.schema["map_id"].dataType.simpleString()
    schema = f"map_id {key}, point_id bigint, rn int, neighbour_id bigint, d double, value double"
    return groups.select("map_id", "member", "places", "cands").mapInArrow(
        ranking.site_rows(k, exclude_self), schema
    )


def site_smoothed(
    groups: DataFrame, means: Sequence[Mean], zero_distance: float, exclude_self: bool = True
) -> DataFrame:
    """The sites with the columns of `means`, weighted means of their nearest."""
    key = groups.schema["map_id"].dataType.simpleString()
    schema = (
        f"map_id {key}, page bigint, point_id bigint, lon double, lat double, value double, loc_rank int"
    )
    schema += "".join(f", {m.name} double" for m in means)
    return groups.select("map_id", "page", "member", "places", "cands").mapInArrow(
        ranking.site_means(list(means), exclude_self, zero_distance), schema
    )
