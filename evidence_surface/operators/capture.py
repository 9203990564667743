"""Grid cells that take the value of a point close by as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import counted_side, small_side


def captured_cells(
    points: DataFrame, meta: DataFrame, radius: float, n_maps: int | None = None
) -> DataFrame:
    """map_id, i, j, point_id, value, d: the cells nearer than `radius` to a point, with the nearest
    one; the smaller point_id of equally near ones.

    Cells come from the points, so the work follows the points and the radius, not the grid. Points
    of one location are reduced to the first before they are spread. `n_maps` bounds the rows of
    `meta`, which are counted if it is not given.
    """
    grids = meta.select("map_id", "min_lon", "min_lat", "nx", "ny", "resolution")
    grids = counted_side(grids, "grids") if n_maps is None else small_side(grids, n_maps)
    first = points.groupBy("map_id", "lon", "lat").agg(
        F.min("point_id").alias("point_id"), F.min_by("value", "point_id").alias("value")
    )

    def around(at: str, low: str, n: str) -> Column:
        # one cell more on either side: the distance decides
        begin = F.floor((F.col(at) - radius - F.col(low)) / F.col("resolution"))
        end = F.ceil((F.col(at) + radius - F.col(low)) / F.col("resolution"))
        begin, end = F.greatest(begin, F.lit(0)).cast("int"), F.least(end, F.col(n) - 1).cast("int")
        return F.explode(F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<int>")))

    dx = F.col("lon") - (F.col("min_lon") + F.col("j") * F.col("resolution"))
    dy = F.col("lat") - (F.col("min_lat") + F.col("i") * F.col("resolution"))
    near = (
        first.join(grids, "map_id")
        .withColumn("i", around("lat", "min_lat", "ny"))
        .withColumn("j", around("lon", "min_lon", "nx"))
        .withColumn("d", F.sqrt(dx * dx + dy * dy))
        .where(F.col("d") < radius)
    )
    found = F.min(F.struct("d", "point_id", "value")).alias("found")
    return near.groupBy("map_id", "i", "j").agg(found).select(
        "map_id", "i", "j", "found.point_id", "found.value", "found.d"
    )
