"""Which maps a run has to draw again: digests of their points, kept beside the output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

STATE = "map string, n long, one decimal(30,0), two decimal(30,0), parameters string, gradient_sharp double"
DIGEST = ("n", "one", "two", "parameters")


def point_digests(points: DataFrame, parameters: str) -> DataFrame:
    """map_id, n, one, two, parameters: the number of points and two sums of hashes, whatever the
    order of the points. Cells of a map depend on its points and the parameters alone."""
    columns = ("point_id", "lon", "lat", "value")

    def total(seed: int):
        return F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")).cast("decimal(30,0)")

    sums = points.groupBy("map_id").agg(F.count(F.lit(1)).alias("n"), total(1).alias("one"), total(2).alias("two"))
    return sums.withColumn("parameters", F.lit(parameters))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The digests of the maps that lie finished beside `path`; none before the first run."""
    try:
        return spark.read.schema(f"{STATE}, map_id string").parquet(path).drop("map_id")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATE)


def write_state(digests: DataFrame, path: str, gradient_sharp: float | None) -> None:
    """Replaces the maps of `digests`; without `gradient_sharp` they are marked as unfinished."""
    rows = digests.select(
        "map_id", F.col("map_id").alias("map"), *DIGEST, F.lit(gradient_sharp).cast("double").alias("gradient_sharp")
    )
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(  # a row per map
        "map_id"
    ).parquet(path)


def outdated(digests: DataFrame, state: DataFrame, gradient_sharp: float) -> DataFrame:
    """`digests` of the maps to draw, with `cells`: whether their cells are to be computed, too,
    and not only their shares. A map that a run left unfinished is computed."""
    known = state.select(
        F.col("map").alias("map_id"), F.col("gradient_sharp").alias("drawn"), *[F.col(c).alias(f"old_{c}") for c in DIGEST]
    )
    same = F.col("drawn").isNotNull()
    for c in DIGEST:
        same &= F.col(c) == F.col(f"old_{c}")
    joined = digests.join(known, "map_id", "left").withColumn("cells", ~F.coalesce(same, F.lit(False)))
    return joined.where(F.col("cells") | (F.col("drawn") != gradient_sharp)).select("map_id", *DIGEST, "cells")
