"""Cell and pixel tables as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROWS_PER_FILE = 4_000_000
CODEC = "zstd"
# cells per side of the squares that files hold one after the other, and about their bytes: a row group
SQUARE = 256
ROW_GROUP_BYTES = 1 << 20

# Names of rasters delivered with the points.
RASTER_SUFFIX = "_idw"
AGE_SUFFIX = "_ma"


def write_cells(cells: DataFrame, path: str, by: tuple[str, ...] = ("method", "map_id")) -> None:
    """One directory per method and map. Only the directories written to are
    replaced. Rows are gathered by directory, small directories together and
    large ones over as many writers as their size asks for. A file holds its cells square by square,
    so the least and greatest values of its row groups tell places apart."""
    squares = [F.floor(F.col(c) / SQUARE) for c in ("i", "j")]
    (
        cells.hint("rebalance", *by)
        .sortWithinPartitions(*by, *squares, "i", "j")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", CODEC)
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(*by)
        .parquet(path)
    )


def write_pixels(pixels: DataFrame, path: str, by: tuple[str, ...] = ("method", "map_id")) -> None:
    """Coloured pixels: the keys, i, j, r, g, b."""
    write_cells(pixels.select(*by, "i", "j", "r", "g", "b"), path, by)


def read_cells(
    spark: SparkSession, path: str, within: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """All maps' cells; a filter on method or map_id reads those directories only.

    `within` limits columns that say where a cell is, such as lon and lat, or i and j, to closed
    ranges. Row groups whose squares lie outside are not read.
    """
    cells = spark.read.parquet(path)
    for column, (low, high) in (within or {}).items():
        cells = cells.where(F.col(column).between(low, high))
    return cells


# what describes a raster besides its cells: extent, shape and pixel size
RASTER_META = ("min_lon", "max_lon", "min_lat", "max_lat", "nx", "ny", "pixel_x", "pixel_y")


def write_rasters(cells: DataFrame, meta: DataFrame, path: str, by: tuple[str, ...] = ("raster",)) -> None:
    """Cells and, beside them, a row per raster of `meta` with its own extent and shape."""
    write_cells(cells, f"{path}/cells", by)
    (
        meta.select(*by, *RASTER_META)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(f"{path}/meta")
    )


def read_rasters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The cells and the metadata that `write_rasters` stored."""
    return read_cells(spark, f"{path}/cells"), spark.read.parquet(f"{path}/meta")


def stored_rasters(spark: SparkSession, path: str, key: str = "raster") -> DataFrame:
    """Names of the rasters stored under `path`, from the listing alone."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", rf"/{key}=([^/]+)/", 1)
    return listing.select(name.alias(key)).where(F.col(key) != "").distinct()


def raster_names(base: Column) -> tuple[Column, Column]:
    """The name a map's raster should have, and the one it may have instead."""
    other = F.when(base.endswith(AGE_SUFFIX), F.replace(base, F.lit(AGE_SUFFIX), F.lit("")))
    return F.concat(base, F.lit(RASTER_SUFFIX)), F.concat(other, F.lit(RASTER_SUFFIX))


def original_rasters(bases: DataFrame, rasters: DataFrame) -> DataFrame:
    """map_id, raster for the maps (column `base`) that have a stored raster."""
    first, second = raster_names(F.col("base"))
    named = bases.withColumns({"first": first, "second": second})
    has = rasters.select(F.col("raster").alias("first"), F.col("raster").alias("as_first"))
    or_has = rasters.select(F.col("raster").alias("second"), F.col("raster").alias("as_second"))
    return (
        named.join(has, "first", "left")
        .join(or_has, "second", "left")
        .withColumn("raster", F.coalesce("as_first", "as_second"))
        .where(F.col("raster").isNotNull())
        .select("map_id", "raster")
    )
