"""Points on the raster: pixel addresses, their surroundings, overrides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import counted_side, small_side
from .neighbours import BLOCK

REACH = 1  # pixels around a point's own that it overrides too


def _per_map(meta: DataFrame, n_maps: int | None) -> DataFrame:
    """A row per map as a side of a join; it is written only if nobody knows how many there are."""
    return counted_side(meta, "raster_meta") if n_maps is None else small_side(meta, n_maps)


def pixel_address(
    points: DataFrame, meta: DataFrame, mirror_rows: bool = False, n_maps: int | None = None
) -> DataFrame:
    """Points inside their raster with `row`, `col`, nx and ny.

    Rows count from the south edge as the grid's do. With `mirror_rows` they
    count from the north edge: right for a raster whose first row is north,
    and the mirrored placement if used on a grid. `n_maps` bounds the rows of `meta`,
    which are counted if it is not given.
    """
    raster = meta.select(
        "map_id", "min_lon", "max_lon", "min_lat", "max_lat", "nx", "ny", "pixel_x", "pixel_y"
    )
    down = F.col("max_lat") - F.col("lat") if mirror_rows else F.col("lat") - F.col("min_lat")
    col = ((F.col("lon") - F.col("min_lon")) / F.col("pixel_x")).cast("int")
    row = (down / F.col("pixel_y")).cast("int")
    on_raster = F.col("lon").between(F.col("min_lon"), F.col("max_lon")) & F.col("lat").between(
        F.col("min_lat"), F.col("max_lat")
    )
    return (
        points.join(_per_map(raster, n_maps), "map_id")
        .where(on_raster)
        .withColumns({"row": row, "col": col})
        .where((F.col("row") < F.col("ny")) & (F.col("col") < F.col("nx")))
        .drop("min_lon", "max_lon", "min_lat", "max_lat", "pixel_x", "pixel_y")
    )


def _greatest(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    valid = {v: F.nanvl(F.col(v), F.lit(None).cast("double")) for v in values}
    return df.withColumns(valid).groupBy(*keys).agg(*[F.max(v).alias(v) for v in values])


def dilate(pixels: DataFrame, values: Sequence[str] = ("value",), reach: int = REACH) -> DataFrame:
    """Each pixel's surroundings within the raster; the greatest value wins.
    Needs map_id, row, col, nx, ny."""
    around = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    spread = (
        pixels.withColumn("dr", around)
        .withColumn("dc", around)
        .withColumns({"i": F.col("row") + F.col("dr"), "j": F.col("col") + F.col("dc")})
        .where((F.col("i") >= 0) & (F.col("i") < F.col("ny")) & (F.col("j") >= 0) & (F.col("j") < F.col("nx")))
    )
    return _greatest(spread, ("map_id", "i", "j"), values)


def point_pixels(
    points: DataFrame,
    meta: DataFrame,
    values: Sequence[str] = ("value",),
    mirror_rows: bool = False,
    n_maps: int | None = None,
) -> DataFrame:
    """Overridden pixels: map_id, i, j and the greatest value of the points
    around. Points of one pixel are reduced before they are spread."""
    placed = pixel_address(points, meta, mirror_rows, n_maps)
    own = _greatest(placed, ("map_id", "row", "col", "nx", "ny"), values)
    return dilate(own, values)


def override_cells(cells: DataFrame, pixels: DataFrame, value: str = "value") -> DataFrame:
    """Cells with the pixels' values where there are any."""
    given = pixels.select("map_id", "i", "j", F.col(value).alias("given"))
    return (
        cells.join(counted_side(given, "given_pixels"), ["map_id", "i", "j"], "left")
        .withColumn("value", F.coalesce("given", "value"))
        .drop("given")
    )


def override_values(points: DataFrame, smoothed: DataFrame) -> DataFrame:
    """Points with the smoothed value, or the class value where there is none."""
    given = smoothed.select("map_id", "point_id", F.col("smoothed").alias("given"))
    return (
        points.join(given, ["map_id", "point_id"], "left")
        .withColumn("value", F.coalesce("given", "value"))
        .drop("given")
    )


def override_count(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("map_id").agg(F.count("*").alias("overridden"))


def over_lists(pixels: DataFrame, values: Sequence[str]) -> DataFrame:
    """map_id, bi, bj, over: the overridden cells of each block of cells."""
    return (
        pixels.withColumns(
            {"bi": F.floor(F.col("i") / BLOCK).cast("int"), "bj": F.floor(F.col("j") / BLOCK).cast("int")}
        )
        .groupBy("map_id", "bi", "bj")
        .agg(F.collect_list(F.struct("i", "j", *values)).alias("over"))
    )


def flip_rows(cells: DataFrame, meta: DataFrame, n_maps: int | None = None) -> DataFrame:
    """Rows counted from the other edge."""
    return (
        cells.join(_per_map(meta.select("map_id", "ny"), n_maps), "map_id")
        .withColumn("i", F.col("ny") - 1 - F.col("i"))
        .drop("ny")
    )
