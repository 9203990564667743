"""Whole maps: from points to coloured cells and class shares, all maps at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.colour import with_colour, with_pixel_class
from ..operators.grid import RESOLUTION, grid_meta
from ..operators.idw import (
    NEIGHBOURS,
    POINT_RADIUS,
    SMOOTHING_K,
    ZERO_DISTANCE,
    smooth_crowd_by,
    smooth_sites_by,
)
from ..operators.neighbours import cell_groups, cell_means
from ..operators.pixels import over_lists, override_cells, point_pixels
from ..operators.ranking import Mean
from ..operators.sites import build_site_index
from ..operators.summary import class_stats
from ..session import BROADCAST_ROWS, materialise, small_side

GRADIENT_SHARP = 2.5
METHODS = ("idw", "knn_idw")


@dataclass(frozen=True)
class Setting:
    """What cells depend on besides the points and the grid."""

    power: float
    n_neighbors: int = NEIGHBOURS
    k: int = SMOOTHING_K
    point_radius: float = POINT_RADIUS


def map_cells(
    points: DataFrame,
    power: float,
    methods: Sequence[str] = METHODS,
    resolution: float = RESOLUTION,
    n_neighbors: int = NEIGHBOURS,
    k: int = SMOOTHING_K,
    point_radius: float = POINT_RADIUS,
    mirror_rows: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Final cells of every map and method: map_id, method, i, j, lon, lat, value."""
    only = {"": Setting(power, n_neighbors, k, point_radius)}
    return map_cells_by(points, only, methods, resolution, mirror_rows, broadcast_rows).drop("setting")


def map_cells_by(
    points: DataFrame,
    settings: Mapping[str, Setting],
    methods: Sequence[str] = METHODS,
    resolution: float = RESOLUTION,
    mirror_rows: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """As `map_cells` for several settings: map_id, setting (its name), method, i, j, lon, lat, value.

    The methods differ in the points' values only: the class numbers, or those
    smoothed over the k nearest points. The settings differ in how many of the nearest sites count,
    and how much. So one index and one search for the greatest number serve all of them, the sites
    are smoothed by one search too, and a cell's row is never shuffled: the overriding values come
    to its block.
    """
    if not settings or any(s.n_neighbors < 1 for s in settings.values()):
        raise ValueError("at least one setting is needed, and n_neighbors of at least 1 in each")
    unknown = set(methods) - set(METHODS)
    if unknown or not methods:
        raise ValueError(f"methods are some of {METHODS}, not {tuple(methods)}")
    smoothing = {(s.k, float(s.power)): "" for s in settings.values()} if "knn_idw" in methods else {}
    smoothing = {by: f"smoothed{n}" for n, by in enumerate(smoothing)}
    values = [*(["value"] if "idw" in methods else []), *smoothing.values()]
    means, finals = {}, []
    for name, s in settings.items():
        for method in methods:
            value = "value" if method == "idw" else smoothing[s.k, float(s.power)]
            drawn_by = (value, s.n_neighbors, float(s.power), s.point_radius)
            mean = means.setdefault(drawn_by, Mean(f"mean{len(means)}", *drawn_by))
            final = F.coalesce(f"over_{value}", mean.name)
            finals.append(F.struct(F.lit(name).alias("setting"), F.lit(method).alias("method"), final.alias("value")))
    most = max(s.n_neighbors for s in settings.values())
    # of smoothed sites one is left out: the site itself
    index = build_site_index(points, max(most, *(s.k + 1 for s in settings.values())))
    sites, placed = index.sites, points
    if smoothing:
        # read by the interpolation and by the override
        columns = {name: by for by, name in smoothing.items()}
        sites = placed = materialise(smooth_sites_by(index, columns, broadcast_rows=broadcast_rows), "smoothed")
        crowd = smooth_crowd_by(points, index, {name: k for name, (k, _) in columns.items()}, broadcast_rows)
        if crowd is not None:
            kept = ["map_id", "lon", "lat", "value", *columns]
            placed = sites.select(*kept).unionByName(crowd.select(*kept))
    # every location is among the sites, so they give the same extent
    extents = grid_meta(index.sites, resolution)
    meta = small_side(extents, index.n_maps, broadcast_rows)
    groups = cell_groups(meta, index, most, values, sites, broadcast_rows)
    pixels = point_pixels(placed, extents, values, mirror_rows, index.n_maps)
    nothing = F.array().cast(f"array<struct<i:int,j:int,{','.join(f'{v}:double' for v in values)}>>")
    groups = groups.join(over_lists(pixels, values), ["map_id", "bi", "bj"], "left").withColumn(
        "over", F.coalesce("over", nothing)
    )
    cells = cell_means(groups, list(means.values()), ZERO_DISTANCE, values)
    return cells.withColumn("final", F.explode(F.array(*finals))).select(
        "map_id", "final.setting", "final.method", "i", "j", "lon", "lat", "final.value"
    )


def map_pixels(cells: DataFrame, gradient_sharp: float = GRADIENT_SHARP) -> DataFrame:
    """Cells with their colour."""
    return with_colour(cells, gradient_sharp)


def map_stats(
    points: DataFrame,
    power: float,
    gradient_sharp: float = GRADIENT_SHARP,
    methods: Sequence[str] = METHODS,
    **options,
) -> DataFrame:
    """Class shares per map and method, with the run's parameters."""
    cells = map_cells(points, power, methods, **options)
    pixels = with_pixel_class(map_pixels(cells, gradient_sharp))
    return class_stats(pixels, ("map_id", "method")).withColumns(
        {"power": F.lit(float(power)), "gradient_sharp": F.lit(float(gradient_sharp))}
    )


def map_stats_by(
    points: DataFrame,
    settings: Mapping[str, Setting],
    gradient_sharp: float = GRADIENT_SHARP,
    methods: Sequence[str] = METHODS,
    **options,
) -> DataFrame:
    """Class shares per map, setting and method, by one search for all settings; with each
    setting's parameters."""
    pixels = with_pixel_class(map_pixels(map_cells_by(points, settings, methods, **options), gradient_sharp))
    stats = class_stats(pixels, ("map_id", "setting", "method"))
    return with_parameters(stats, settings).withColumn("gradient_sharp", F.lit(float(gradient_sharp)))


def with_parameters(stats: DataFrame, settings: Mapping[str, Setting]) -> DataFrame:
    """Rows with a `setting` and what it stands for."""
    parameters = {}
    for field, kind in (("power", "double"), ("n_neighbors", "int"), ("k", "int"), ("point_radius", "double")):
        given = [F.when(F.col("setting") == name, F.lit(getattr(s, field))) for name, s in settings.items()]
        parameters[field] = F.coalesce(*given).cast(kind)
    return stats.withColumns(parameters)


def map_original(
    cells: DataFrame,
    points: DataFrame,
    meta: DataFrame,
    gradient_sharp: float = GRADIENT_SHARP,
    mirror_rows: bool = False,
) -> DataFrame:
    """Pixels of a delivered raster with the points' class values on it.

    `meta` describes the raster; `mirror_rows` is for one whose rows start in
    the north.
    """
    pixels = point_pixels(points, meta, mirror_rows=mirror_rows)
    return map_pixels(override_cells(cells, pixels), gradient_sharp)
