"""The derived points and lines as files, for the queries that read files.

Documents are cut by ranges of ids, so no task gathers a whole map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidence_surface.session import scratch_path

IDS_PER_DOCUMENT = 50_000  # so a data set becomes several documents, however large


def _write_documents(features: DataFrame, path: str, mode: str, per_document: int | None = None) -> None:
    """`features` has dataset, id and feature, a JSON text."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("id", "feature"))), lambda x: x["feature"]
    )
    document = F.concat(
        F.lit('{"type": "FeatureCollection",\n "features": [\n'),
        F.array_join(ordered, ",\n"),
        F.lit("\n]}"),
    )
    (
        features.withColumn("document", F.floor(F.col("id") / (per_document or IDS_PER_DOCUMENT)))
        .groupBy("dataset", "document")
        .agg(document.alias("value"))
        .write.mode(mode)
        .partitionBy("dataset", "document")
        .text(path)
    )


def _feature(geometry: Column, properties: Column) -> Column:
    return F.concat(
        F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}")
    )


def _dataset(suffix: str = "") -> Column:
    return F.concat(F.col("map_id").cast("string"), F.lit(f"_ma{suffix}.geojson"))


def write_points(
    points: DataFrame, path: str, mode: str = "errorifexists", per_document: int | None = None
) -> None:
    geometry = F.to_json(F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    properties = F.to_json(
        F.struct(
            F.col("climate").alias("Climate_Cl"),
            F.col("formation").alias("Formation"),
            F.col("basin").alias("Basin_Sub_"),
            F.col("country").alias("Country"),
            F.col("time").alias("TIME"),
        )
    )
    features = points.select(
        _dataset().alias("dataset"), F.col("point_id").alias("id"), _feature(geometry, properties).alias("feature")
    )
    _write_documents(features, path, mode, per_document)


def write_coast(coast: DataFrame, path: str, mode: str = "errorifexists", suffix: str = "_costa") -> None:
    """Every third line as a LineString, the others as MultiLineString."""
    vertices = F.array_sort(F.collect_list(F.struct("part", "seq", F.array("lon", "lat").alias("at"))))
    lines = coast.groupBy("map_id", "line_id").agg(vertices.alias("v"))

    def part(n: int) -> Column:
        return F.transform(F.filter("v", lambda x: x["part"] == n), lambda x: x["at"])

    parts = F.filter(F.array(part(0), part(1)), lambda line: F.size(line) > 0)
    several = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), parts.alias("coordinates")))
    whole = F.transform("v", lambda x: x["at"])
    single = F.to_json(F.struct(F.lit("LineString").alias("type"), whole.alias("coordinates")))
    geometry = F.when(F.col("line_id") % 3 == 0, single).otherwise(several)
    properties = F.to_json(
        F.struct(F.col("line_id").cast("string").alias("NAME"), F.col("map_id").cast("string").alias("TIME"))
    )
    features = lines.select(
        _dataset(suffix).alias("dataset"), F.col("line_id").alias("id"), _feature(geometry, properties).alias("feature")
    )
    _write_documents(features, path, mode)


def new_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
