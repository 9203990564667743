"""Inverse-distance weighting: grid surfaces and smoothed points."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..session import BROADCAST_ROWS, shuffled_side
from .grid import RESOLUTION, grid_meta
from .neighbours import cell_groups, cell_values, site_groups, site_neighbours, site_smoothed
from .ranking import Mean
from .sites import SiteIndex, build_site_index

POWER = 2.0
NEIGHBOURS = 12
SMOOTHING_K = 8
POINT_RADIUS = 0.15
ZERO_DISTANCE = 1e-10
HOT_SALTS = 32


def idw_surface(
    points: DataFrame,
    resolution: float = RESOLUTION,
    power: float = POWER,
    n_neighbors: int = NEIGHBOURS,
    preserve_points: bool = True,
    point_radius: float = POINT_RADIUS,
    index: SiteIndex | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Surface of every map: map_id, i, j, lon, lat, value."""
    if n_neighbors < 1:
        raise ValueError("n_neighbors must be at least 1")
    index = index or build_site_index(points, n_neighbors)
    # every location is among the sites, so they give the same extent
    meta = grid_meta(index.sites, resolution)
    groups = cell_groups(meta, index, n_neighbors, broadcast_rows=broadcast_rows)
    radius = point_radius if preserve_points else None
    return cell_values(groups, n_neighbors, power, radius, ZERO_DISTANCE)


def point_neighbours(
    points: DataFrame,
    index: SiteIndex,
    k: int = SMOOTHING_K,
    exclude_self: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The k nearest (other) points of every point: map_id, point_id, rn,
    neighbour_id, d, value."""
    groups = site_groups(index, k, exclude_self, broadcast_rows)
    near = site_neighbours(groups, k, exclude_self)
    crowd = crowd_members(points, index, _first_of_crowds(index, k), broadcast_rows)
    if crowd is None:
        return near
    listed = crowd.select("map_id", "point_id", F.posexplode("first").alias("pos", "n")).select(
        "map_id",
        "point_id",
        (F.col("pos") + 1).alias("rn"),
        F.col("n.point_id").alias("neighbour_id"),
        F.lit(0.0).alias("d"),
        F.col("n.value").alias("value"),
    )
    return near.unionByName(listed)


def smooth_sites(
    index: SiteIndex,
    k: int = SMOOTHING_K,
    power: float = POWER,
    exclude_self: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The index's sites with `smoothed`; alone on its map a site keeps its value."""
    return smooth_sites_by(index, {"smoothed": (k, power)}, exclude_self, broadcast_rows)


def smooth_sites_by(
    index: SiteIndex,
    columns: Mapping[str, tuple[int, float]],
    exclude_self: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """As `smooth_sites` for several (k, power), a column each, by one search for the greatest k.
    With a k of 0 a column holds the values as they are."""
    means = [Mean(name, "value", k, float(power)) for name, (k, power) in columns.items() if k > 0]
    sites = index.sites
    if means:
        groups = site_groups(index, max(m.k for m in means), exclude_self, broadcast_rows)
        sites = site_smoothed(groups, means, ZERO_DISTANCE, exclude_self)
    return sites.withColumns({name: F.col("value") for name, (k, _) in columns.items() if k <= 0})


def _first_of_crowds(index: SiteIndex, k: int) -> DataFrame:
    """Locations with points beyond those the index keeps, and their first k."""
    kept = F.when(F.col("loc_rank") <= k, F.struct("point_id", "value"))
    return (
        index.sites.groupBy("map_id", "lon", "lat")
        .agg(
            F.max("loc_rank").alias("kept"),
            F.max("point_id").alias("last_id"),
            F.array_sort(F.collect_list(kept)).alias("first"),
        )
        .where(F.col("kept") == index.per_location)
        .drop("kept")
    )


def crowd_members(
    points: DataFrame, index: SiteIndex, crowds: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame | None:
    """The points the index left out, with their location's columns of `crowds`.

    Each lies on a location with more than k points before it, so its k nearest
    are the location's first k, all at distance zero.
    """
    if index.full_locations == 0:
        return None
    at = ["map_id", "lon", "lat"]
    left_out = points.select("map_id", "point_id", "lon", "lat", "value")
    # a row of `crowds` holds up to as many points as the index keeps per location
    if index.full_locations * index.per_location <= broadcast_rows:
        joined = left_out.join(F.broadcast(crowds), at)
    else:
        # a location may hold a large share of all points: spread it
        salted = left_out.withColumn("salt", F.pmod(F.xxhash64("point_id"), F.lit(HOT_SALTS)))
        salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(HOT_SALTS - 1).cast("bigint")))
        joined = salted.join(shuffled_side(crowds.withColumn("salt", salts)), [*at, "salt"]).drop("salt")
    return joined.where(F.col("point_id") > F.col("last_id")).drop("last_id")


def smooth_crowd(
    points: DataFrame, index: SiteIndex, k: int, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame | None:
    """`smoothed` of the points the index left out."""
    return smooth_crowd_by(points, index, {"smoothed": k}, broadcast_rows)


def smooth_crowd_by(
    points: DataFrame, index: SiteIndex, columns: Mapping[str, int], broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame | None:
    """The points the index left out, with a column for each k: their neighbours are at distance
    zero and have equal weights, whatever the power is."""
    most = max(columns.values())
    means = {}
    for name, k in columns.items():
        near = F.slice("first", 1, max(k, 1))
        mean = F.aggregate(near, F.lit(0.0), lambda acc, n: acc + n["value"]) / F.size(near)
        means[name] = mean if k > 0 else F.lit(None).cast("double")
    crowds = _first_of_crowds(index, max(most, 1)).withColumns(means).drop("first")
    members = crowd_members(points, index, crowds, broadcast_rows)
    if members is None:
        return None
    return members.withColumns({name: F.col("value") for name, k in columns.items() if k <= 0})


def knn_smooth(
    points: DataFrame,
    k: int = SMOOTHING_K,
    power: float = POWER,
    exclude_self: bool = True,
    index: SiteIndex | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Every point with the weighted mean of its k nearest others of the map:
    map_id, point_id, lon, lat, value, smoothed."""
    if k <= 0:
        return points.select("map_id", "point_id", "lon", "lat", "value").withColumn("smoothed", F.col("value"))
    index = index or build_site_index(points, k + 1)
    columns = ["map_id", "point_id", "lon", "lat", "value", "smoothed"]
    smoothed = smooth_sites(index, k, power, exclude_self, broadcast_rows).select(*columns)
    crowd = smooth_crowd(points, index, k, broadcast_rows)
    return smoothed if crowd is None else smoothed.unionByName(crowd.select(*columns))
