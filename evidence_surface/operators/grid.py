"""Grid extents and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .neighbours import BLOCK, grid_blocks

PADDING = 1.0  # degrees around the outermost points
RESOLUTION = 0.1


def grid_meta(points: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """One row per map: padded extent, number of nodes and pixel size.

    Nodes are `resolution` apart and the last may lie beyond the extent;
    pixels divide the extent evenly.
    """
    if resolution <= 0:
        raise ValueError("resolution must be positive")

    def nodes(low: str, high: str) -> Column:
        return F.ceil((F.col(high) + resolution - F.col(low)) / resolution).cast("int")

    return (
        points.groupBy("map_id")
        .agg(
            (F.min("lon") - PADDING).alias("min_lon"),
            (F.max("lon") + PADDING).alias("max_lon"),
            (F.min("lat") - PADDING).alias("min_lat"),
            (F.max("lat") + PADDING).alias("max_lat"),
        )
        .withColumns({"nx": nodes("min_lon", "max_lon"), "ny": nodes("min_lat", "max_lat")})
        .withColumns(
            {
                "pixel_x": (F.col("max_lon") - F.col("min_lon")) / F.col("nx"),
                "pixel_y": (F.col("max_lat") - F.col("min_lat")) / F.col("ny"),
                "resolution": F.lit(float(resolution)),
            }
        )
    )


def grid_cells(meta: DataFrame) -> DataFrame:
    """All cells of all maps: row i from the south edge, column j from the west."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(BLOCK * BLOCK - 1)))
    return (
        grid_blocks(meta)
        .withColumn("c", cell)
        .withColumns(
            {
                "i": F.col("i0") + F.floor(F.col("c") / BLOCK).cast("int"),
                "j": F.col("j0") + F.col("c") % BLOCK,
            }
        )
        .where((F.col("i") < F.col("ny")) & (F.col("j") < F.col("nx")))
        .select(
            "map_id",
            "i",
            "j",
            (F.col("min_lon") + F.col("j") * F.col("resolution")).alias("lon"),
            (F.col("min_lat") + F.col("i") * F.col("resolution")).alias("lat"),
        )
    )
