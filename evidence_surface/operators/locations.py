"""Points that share a coordinate, and the basins they belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.climate import age_or_default, climate_code, climate_colour, code_colour, or_default
from ..session import materialise, shuffle_partitions

_AT = ("map_id", "lon", "lat")


def _distinct_in_order(name: str) -> Column:
    return F.array_distinct(F.transform(F.array_sort("seen"), lambda s: s[name]))


def location_groups(points: DataFrame) -> DataFrame:
    """One row per exact location: number of points, colour of the first one,
    distinct basins and formations in the order first seen, and the tooltip.

    Points are reduced to the distinct (basin, formation) pairs of a location
    before they meet, so what one row gathers is names, not points.
    """
    named = points.select(
        *_AT,
        "point_id",
        "climate",
        or_default(F.col("basin")).alias("basin"),
        or_default(F.col("formation")).alias("formation"),
    )
    pairs = named.groupBy(*_AT, "basin", "formation").agg(
        F.count("*").alias("n"),
        F.min("point_id").alias("first_id"),
        F.min_by(climate_code(F.col("climate")), "point_id").alias("first"),
    )
    places = pairs.groupBy(*_AT).agg(
        F.sum("n").alias("n_points"),
        F.min_by("first", "first_id").alias("code"),
        F.collect_list(F.struct("first_id", "basin", "formation")).alias("seen"),
    )
    several = F.concat(
        F.col("n_points").cast("string"), F.lit(" points: "), F.array_join("formations", ", ")
    )
    single = F.concat(F.col("formations")[0], F.lit(" ("), F.col("basins")[0], F.lit(")"))
    return (
        places.withColumns(
            {
                "colour": code_colour(F.col("code")),
                "basins": _distinct_in_order("basin"),
                "formations": _distinct_in_order("formation"),
            }
        )
        .withColumn("tooltip", F.when(F.col("n_points") == 1, single).otherwise(several))
        .drop("seen", "code")
    )


def location_details(points: DataFrame) -> DataFrame:
    """One row per point with its number at its location, from 1, and the
    texts shown for it.

    Points are sorted once, in ranges of location and id, so a crowded location is a run through
    several ranges, whatever its ids are. A point's number is its place in its range's
    part of the run plus the points in the ranges before; a location has one row per range to add up.
    """
    order = (*_AT, "point_id")
    ranged = points.repartitionByRange(shuffle_partitions(points.sparkSession), *order)
    ranged = ranged.sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    # place = range << 33 | row: written before use, as both sides of the join must see the same
    placed = materialise(ranged, "by_location").withColumn("part", F.shiftright("place", 33))
    runs = placed.groupBy(*_AT, "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    of_place = runs.groupBy(*_AT).agg(
        F.sum("n").alias("n_points"), F.array_sort(F.collect_list(F.struct("part", "n", "first"))).alias("runs")
    )
    earlier = F.aggregate(
        F.filter("runs", lambda r: r["part"] < F.col("run.part")), F.lit(0).cast("bigint"), lambda sum_, r: sum_ + r["n"]
    )
    counts = of_place.withColumn("run", F.explode("runs")).select(
        *_AT, F.col("run.part").alias("part"), F.col("run.first").alias("first"), earlier.alias("earlier"), "n_points"
    )
    numbered = placed.join(counts, [*_AT, "part"]).withColumn(
        "idx", F.col("earlier") + F.col("place") - F.col("first") + 1
    )
    no_climate = F.when(F.col("n_points") == 1, F.lit("N/A")).otherwise(F.lit(""))
    climate = F.col("climate")
    return numbered.select(
        *_AT,
        "point_id",
        "idx",
        "n_points",
        or_default(F.col("formation")).alias("formation"),
        or_default(F.col("basin")).alias("basin"),
        or_default(F.col("country")).alias("country"),
        F.when(climate.isNull() | (climate == ""), no_climate).otherwise(climate).alias("climate"),
        age_or_default(F.col("time")).alias("age"),
        climate_colour(climate).alias("colour"),
    )


def basin_list(points: DataFrame) -> DataFrame:
    """Distinct basins per map, sorted."""
    named = points.select("map_id", or_default(F.col("basin")).alias("basin"))
    return named.distinct().orderBy("map_id", "basin")


def filter_basins(locations: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """Locations with any selected basin; None selects all, an empty list none."""
    if names is None:
        return locations
    chosen = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return locations.where(F.arrays_overlap("basins", chosen))
