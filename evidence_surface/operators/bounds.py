"""Extents of features and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The centre of a map without any coordinates.
DEFAULT_CENTRE = {"center_lat": -20.0, "center_lon": -20.0}

BOUNDS = ("min_lat", "min_lon", "max_lat", "max_lon")


def feature_bounds(vertices: DataFrame) -> DataFrame:
    """Extent per map of points or line vertices; no row without coordinates."""
    return vertices.groupBy("map_id").agg(
        F.min("lat").alias("min_lat"),
        F.min("lon").alias("min_lon"),
        F.max("lat").alias("max_lat"),
        F.max("lon").alias("max_lon"),
    )


def combined_bounds(
    maps: DataFrame, points: DataFrame, coast: DataFrame, raster: DataFrame | None = None
) -> DataFrame:
    """Extent and centre over points, coast and raster, and the view's extent:
    the raster's if there is one.

    The inputs are bounds per map; `maps` lists the maps to report.
    """
    inputs = [points, coast] if raster is None else [points, coast, raster]
    every = inputs[0].select("map_id", *BOUNDS)
    for more in inputs[1:]:
        every = every.unionByName(more.select("map_id", *BOUNDS))
    combined = every.groupBy("map_id").agg(
        *[(F.min if b.startswith("min") else F.max)(b).alias(b) for b in BOUNDS]
    )
    result = maps.join(combined, "map_id", "left").withColumns(
        {
            f"center_{c}": F.coalesce(
                (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2, F.lit(DEFAULT_CENTRE[f"center_{c}"])
            )
            for c in ("lat", "lon")
        }
    )
    if raster is None:
        return result.withColumns({f"view_{b}": F.col(b) for b in BOUNDS})
    own = raster.select("map_id", *[F.col(b).alias(f"r_{b}") for b in BOUNDS])
    return (
        result.join(own, "map_id", "left")
        .withColumns({f"view_{b}": F.coalesce(f"r_{b}", b) for b in BOUNDS})
        .drop(*[f"r_{b}" for b in BOUNDS])
    )
