"""Spatial index of evidence points: small pages of neighbouring points and
the pages' bounding boxes, rolled up into levels.

Pages hold at most `2**page_bits` points whatever the density, because they
are cut from the points' sort order along a Hilbert curve, not from fixed
areas. So a map, or a spot on it, that holds most of the data gives more
pages, not fuller ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise, shuffle_partitions

PAGE_BITS = 5
FANOUT_BITS = 5

# The curve's cell size (1/65536 degree) and origin. Coordinates beyond the
# range share the outermost cells: they are indexed less finely, never lost.
CURVE_BITS = 26
CURVE_SCALE = float(1 << 16)
CURVE_ORIGIN = 512.0


@dataclass(frozen=True)
class SiteIndex:
    """`sites`: map_id, point_id, lon, lat, value, page, loc_rank.

    `levels`: finest first, each with map_id, node, its bounding box x0, x1, y0,
    y1, the number of sites cnt and, below the top, its parent; `level_rows` bound their sizes.
    `per_location` is the number of points kept per exact location.
    """

    sites: DataFrame
    n_sites: int
    levels: tuple[DataFrame, ...]
    level_rows: tuple[int, ...]
    per_location: int
    full_locations: int
    n_maps: int


def with_curve(points: DataFrame) -> DataFrame:
    """Adds z, the place along the Hilbert curve, two bits per step from the
    quadrant the point is in; the quadrant is turned for the next step. Points
    that follow each other lie together, so runs of them have small boxes."""
    last = (1 << CURVE_BITS) - 1

    def cell(c: str) -> str:
        return f"bigint(least(greatest(floor(({c} + {CURVE_ORIGIN}D) * {CURVE_SCALE}D), 0), {last}))"

    right, upper = "(shiftright(a.x, b) & 1)", "(shiftright(a.y, b) & 1)"

    def turned(own: str, other: str) -> str:
        return f"CASE WHEN {upper} = 1 THEN {own} WHEN {right} = 1 THEN {last}L - {other} ELSE {other} END"

    step = (
        f"named_struct('x', {turned('a.x', 'a.y')}, 'y', {turned('a.y', 'a.x')}, "
        f"'d', shiftleft(a.d, 2) | ((3 * {right}) ^ {upper}))"
    )
    start = f"named_struct('x', {cell('lon')}, 'y', {cell('lat')}, 'd', 0L)"
    bits = f"sequence({CURVE_BITS - 1}, 0, -1)"
    return points.selectExpr("*", f"aggregate({bits}, {start}, (a, b) -> {step}, a -> a.d) AS z")


def first_per_location(points: DataFrame, keep: int) -> DataFrame:
    """The `keep` lowest point_id of every exact location.

    Neighbours are ranked by (distance, point_id), so a later point of a
    location can never be among the `keep` nearest of anything. The limit is
    applied before the shuffle too, so a crowded location stays small.
    """
    w = Window.partitionBy("map_id", "lon", "lat").orderBy("point_id")
    return points.withColumn("loc_rank", F.row_number().over(w)).where(F.col("loc_rank") <= keep)


def _stats(stored: DataFrame, per_location: int):
    """Sites and full locations in all, and of the largest map the sites and
    the partitions it spans: scalars that bound the levels' sizes."""
    part = "shiftright(pos, 33)"
    per_map = {
        "cnt": "count(*)",
        "full": f"count_if(loc_rank = {per_location})",
        "parts": f"max({part}) - min({part}) + 1",
    }
    totals = {
        "sites": "sum(cnt)",
        "full": "sum(full)",
        "parts": "sum(parts)",
        "maps": "count(*)",
        "map_sites": "max(cnt)",
        "map_parts": "max(parts)",
    }
    maps = stored.groupBy("map_id").agg(*[F.expr(e).alias(n) for n, e in per_map.items()])
    return maps.agg(*[F.expr(f"coalesce({e}, 0L)").alias(n) for n, e in totals.items()]).first()


def _nodes_at_most(sites: int, parts: int, maps: int, shift: int) -> int:
    """A run of r positions meets at most (r >> shift) + 2 nodes; a map has one
    run per partition it spans. Above that, nodes are groups of partitions."""
    if shift <= 33:
        return (sites >> shift) + 2 * parts
    return (parts >> (shift - 33)) + 2 * maps


def _bounds_of(df: DataFrame, node: str) -> DataFrame:
    ends = ("min(x0) AS x0", "max(x1) AS x1", "min(y0) AS y0", "max(y1) AS y1", "sum(cnt) AS cnt")
    return df.groupBy("map_id", F.expr(node).alias("node")).agg(*[F.expr(e) for e in ends])


def build_site_index(
    points: DataFrame,
    per_location: int,
    page_bits: int = PAGE_BITS,
    fanout_bits: int = FANOUT_BITS,
) -> SiteIndex:
    """Sort the points along the curve once, write them with their position,
    and derive pages and levels from that position.

    `points` needs map_id, point_id, lon, lat, value.
    """
    spark = points.sparkSession
    order = ("map_id", "z", "lon", "lat", "point_id")
    # z goes through the first shuffle: the range partitioning reads its input
    # twice, once to sample it
    placed_on = with_curve(points.select("map_id", "point_id", "lon", "lat", "value"))
    kept = first_per_location(placed_on, per_location)
    ranged = kept.repartitionByRange(shuffle_partitions(spark), *order)
    placed = (
        ranged.sortWithinPartitions(*order)
        .withColumn("pos", F.monotonically_increasing_id())
        .drop("z")
    )
    # pos = partition << 33 | row: written before use, as every consumer must
    # see the same positions
    stored = materialise(placed, "sites")

    stats = _stats(stored, per_location)

    def in_all(shift: int) -> int:
        return _nodes_at_most(stats["sites"], stats["parts"], stats["maps"], shift)

    def in_largest_map(shift: int) -> int:
        return _nodes_at_most(stats["map_sites"], stats["map_parts"], 1, shift)

    chosen = [page_bits]
    for shift in range(page_bits + fanout_bits, 62, fanout_bits):
        if in_largest_map(chosen[-1]) <= (1 << fanout_bits):
            break
        if 2 * in_largest_map(shift) <= in_largest_map(chosen[-1]):
            chosen.append(shift)

    sites = stored.withColumn("page", F.shiftright("pos", page_bits)).drop("pos")
    boxes = sites.selectExpr("map_id", "page", "lon AS x0", "lon AS x1", "lat AS y0", "lat AS y1", "1L AS cnt")
    level = _bounds_of(boxes, "page")
    if len(chosen) > 1:
        level = materialise(level, "pages")
    levels = []
    for here, above in zip(chosen, chosen[1:] + [None]):
        if above is None:
            levels.append(level)
        else:
            parent = f"shiftright(node, {above - here})"
            levels.append(level.selectExpr("*", f"{parent} AS parent"))
            level = _bounds_of(level, parent)
    return SiteIndex(
        sites=sites,
        n_sites=stats["sites"],
        levels=tuple(levels),
        level_rows=tuple(in_all(shift) for shift in chosen),
        per_location=per_location,
        full_locations=stats["full"],
        n_maps=stats["maps"],
    )
