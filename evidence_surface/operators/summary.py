"""Counts and shares per map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.colour import is_valid
from ..functions.naming import fmt_pct

# The hue class that stands for each climate class.
SHARES = {"dry": "yellow", "semi_arid": "green", "humid": "blue"}


def class_stats(pixels: DataFrame, keys: Sequence[str] = ("map_id",)) -> DataFrame:
    """Pixels and percentages per class; `other` is the unclassified rest,
    invalid pixels included."""
    counts = [
        F.count_if(F.col("pixel_class") == hue).alias(name) for name, hue in SHARES.items()
    ]
    classified = sum((F.col(name) for name in SHARES), F.lit(0).cast("bigint"))

    def pct(count: str) -> Column:
        share = F.try_divide(F.col(count).cast("double"), F.col("total"))
        return F.coalesce(share * 100, F.lit(0.0))

    names = [*SHARES, "classified", "other"]
    return (
        pixels.groupBy(*keys)
        .agg(F.count("*").alias("total"), *counts)
        .withColumn("classified", classified)
        .withColumn("other", F.col("total") - F.col("classified"))
        .withColumns({f"pct_{n}": pct(n) for n in names})
    )


def class_stats_text(stats: DataFrame, digits: int = 2) -> DataFrame:
    texts = {f"{n}_text": fmt_pct(F.col(f"pct_{n}"), digits) for n in (*SHARES, "other")}
    return stats.withColumns(texts)


def raster_stats(cells: DataFrame, keys: Sequence[str] = ("map_id",)) -> DataFrame:
    """Shape, valid cells, their value range and the range of each colour.
    `cells` needs i, j, value, r, g, b."""
    valid = is_valid(F.col("value"))

    def of_valid(c: str) -> Column:
        return F.when(valid, F.col(c))

    channels = []
    for c in "rgb":
        channels += [F.min(of_valid(c)).alias(f"min_{c}"), F.max(of_valid(c)).alias(f"max_{c}")]
    return cells.groupBy(*keys).agg(
        (F.max("i") + 1).alias("n_rows"),
        (F.max("j") + 1).alias("n_cols"),
        F.count("*").alias("total"),
        F.count_if(valid).alias("valid"),
        F.min(of_valid("value")).alias("min_value"),
        F.max(of_valid("value")).alias("max_value"),
        *channels,
    )


def run_summary(datasets: DataFrame, points: DataFrame, coast: DataFrame) -> DataFrame:
    """Features per data set and whether it was processed.

    `datasets` names the maps; `points` and `coast` have a row per feature. A
    data set without point features is skipped.
    """
    n_points = points.groupBy("map_id").agg(F.count("*").alias("n_points"))
    n_coast = coast.groupBy("map_id").agg(F.count("*").alias("n_coast"))
    zero = F.lit(0).cast("bigint")
    return (
        datasets.join(n_points, "map_id", "left")
        .join(n_coast, "map_id", "left")
        .withColumns({c: F.coalesce(F.col(c), zero) for c in ("n_points", "n_coast")})
        .withColumn("status", F.when(F.col("n_points") > 0, "processed").otherwise("skipped"))
    )
