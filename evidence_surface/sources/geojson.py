"""GeoJSON FeatureCollections as tables."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import BROADCAST_ROWS, materialise, small_side
from . import json_scan
from .json_scan import HEAD, MIDDLE, SUMMARY, TAIL, WHOLE

# executors need not have the package: the helper travels with its tasks
cloudpickle.register_pickle_by_value(json_scan)

FEATURE = """
type STRING,
properties STRUCT<Formation: STRING, Basin_Sub_: STRING, Country: STRING,
                  Climate_Cl: STRING, TIME: STRING, NAME: STRING>,
geometry STRUCT<type: STRING, coordinates: STRING>
"""
CHUNK_BYTES = 1 << 20
# Names of a data set's two files.
COAST_SUFFIX = "_costa"
EXTENSION = ".geojson"

# The data set's name is the file's name, or that of the directory Spark wrote, after the
# `key=` that such a directory may begin with
_NAME = rf"/(?:dataset=)?([^/]+?)({COAST_SUFFIX})?\{EXTENSION}(/|$)"
_DOCUMENT = r"/document=(\d+)/"
_LINES = "array<array<double>>"


def _decoded(path: str) -> Column:
    """A path of file metadata, in which all but plain signs are percent-encoded, as it is."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _chunks(spark: SparkSession, path: str | list[str], chunk_bytes: int, broadcast_rows: int) -> DataFrame:
    """The text of all files in chunks, with the depth and whether a string is open where each begins.

    The reader cuts at `}`, so files are read in byte ranges, by many tasks, and only once. What
    chunks change is added up through their file, a narrow row per chunk.
    """
    rows = spark.read.option("lineSep", "}").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    chunks = materialise(rows.mapInArrow(json_scan.summarise(chunk_bytes), json_scan.SUMMARY_COLUMNS), "chunks")
    in_file = Window.partitionBy("file").orderBy("block", "chunk")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    states = (
        chunks.drop("body")
        .withColumn("in_string", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
        .withColumn("deeper", F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside")))
        .withColumn("depth", F.coalesce(F.sum("deeper").over(before), F.lit(0)))
    )
    states = materialise(states, "states")
    whole = states.groupBy("file").agg(
        F.sum("odd").alias("quotes"),
        F.sum("deeper").alias("left_open"),
        F.min_by("first", F.struct("block", "chunk")).alias("first"),
    )
    # after the last brace the reader may give one more row, of white space
    broken = whole.where("quotes % 2 = 1 OR left_open NOT IN (0, -1) OR first != '{'").head(1)
    if broken:
        raise ValueError(f"{broken[0]['file']} is no complete JSON object")
    begins = states.select("file", "block", "chunk", "in_string", "depth")
    begins = small_side(begins, begins.count(), broadcast_rows)
    return chunks.select("file", "block", "chunk", "body").join(begins, ["file", "block", "chunk"])


def _elements(parts: DataFrame, broadcast_rows: int) -> DataFrame:
    """file, pos, text: the objects of each document's `features`, those cut by chunks put together."""
    in_file = Window.partitionBy("file").orderBy("block", "chunk")
    summary = (
        parts.where(F.col("kind") == SUMMARY)
        .select("file", "block", "chunk", "member", "at")
        .withColumn("array", F.count("member").over(in_file))
        .withColumn("passed", F.sum("at").over(Window.partitionBy("file", "array").orderBy("block", "chunk")))
        .withColumn("open", F.last("member", ignorenulls=True).over(in_file))
        .select(
            "file", "block", "chunk",
            F.lag("open").over(in_file).alias("open"),
            F.lag("passed", 1, 0).over(in_file).alias("passed"),
        )
    )
    summary = materialise(summary, "open_arrays")
    begins = small_side(summary, summary.count(), broadcast_rows)
    cut = F.col("kind").isin(HEAD, TAIL, MIDDLE)
    of_file = Window.partitionBy("file").orderBy("block", "chunk", "kind")
    number = (
        parts.where(cut)
        .select("file", "block", "chunk", "kind", "member", "at")
        .withColumns({"object": F.count_if(F.col("kind") == TAIL).over(of_file), "ended": F.count_if(F.col("kind") == HEAD).over(of_file)})
        # what lies deep in other members is in no object of an array
        .where((F.col("kind") != MIDDLE) | (F.col("object") == F.col("ended") + 1))
        .select("file", "block", "chunk", "kind", "object")
    )
    pieces = F.array_sort(F.collect_list(F.struct("block", "chunk", "text")))
    joined = (
        parts.where(cut)
        .join(number, ["file", "block", "chunk", "kind"])
        .groupBy("file", "object")
        .agg(
            F.first(F.when(F.col("kind") == TAIL, F.struct("block", "chunk", "member", "at")), ignorenulls=True).alias("start"),
            F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
        )
        .select("file", "start.*", "text")
    )
    objects = parts.where(F.col("kind") == WHOLE).select("file", "block", "chunk", "member", "at", "text").unionByName(joined)
    return (
        objects.join(begins, ["file", "block", "chunk"])
        .where(F.coalesce("member", "open") == "features")
        .select("file", F.when(F.col("member").isNull(), F.col("passed") + F.col("at")).otherwise(F.col("at")).alias("pos"), "text")
    )


def read_features(
    spark: SparkSession,
    path: str | list[str],
    broadcast_rows: int = BROADCAST_ROWS,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per feature of all files: map_id (file name without extension
    and coast suffix), is_coast, point_id (position in its data set), the
    geometry's type and coordinates as text, and the properties.

    A file is one JSON object in UTF-8. Its bytes are read once, in ranges, by as many
    tasks as its size asks for; features that a range cuts are put together again, and
    positions are prefix sums. Each feature is parsed once and written; a feature is
    the least that one task handles.
    A data set of several documents (`<name>.geojson/document=<n>/`) counts
    positions through them in the order of n. Two files of one data set's name in different
    folders are an error, and so is a file that ends inside its object. Elements of
    `features` that are no objects have no row; they are counted if an object follows.
    """
    chunks = _chunks(spark, path, chunk_bytes, broadcast_rows)
    parts = materialise(chunks.mapInArrow(json_scan.cut, json_scan.PARTS_COLUMNS), "parts")
    feature = F.from_json("text", FEATURE, {"mode": "FAILFAST"})
    features = _elements(parts, broadcast_rows).select("file", "pos", feature.alias("f"))
    features = materialise(features.select("file", "pos", "f.geometry", "f.properties"), "features")

    document = parts.where(F.col("kind") == SUMMARY).select("file").distinct()
    counts = document.join(features.groupBy("file").agg((F.max("pos") + 1).alias("n")), "file", "left")
    file = _decoded("file")
    counts = materialise(
        counts.select(
            "file",
            F.regexp_extract(file, rf"^(.*\{EXTENSION})(/|$)", 1).alias("dataset"),
            F.concat(F.regexp_extract(file, _NAME, 1), F.lit("/"), F.regexp_extract(file, _NAME, 2)).alias("name"),
            F.coalesce(F.regexp_extract(file, _DOCUMENT, 1).try_cast("long"), F.lit(0)).alias("document"),
            F.coalesce("n", F.lit(0)).alias("n"),
        ),
        "documents",
    )
    twice = counts.groupBy("name").agg(F.count_distinct("dataset").alias("n")).where("n > 1").head(1)
    if twice:
        raise ValueError(f"files of several folders are named {twice[0]['name'].rstrip('/')}")
    earlier = Window.partitionBy("dataset").orderBy("document", "file").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        F.col("file").alias("of"),
        F.split("name", "/")[0].alias("map_id"),
        (F.split("name", "/")[1] != "").alias("is_coast"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"),
    )
    side = small_side(first, counts.count(), broadcast_rows)
    return features.join(side, F.col("file") == F.col("of")).select(
        "map_id",
        "is_coast",
        (F.col("first") + F.col("pos")).alias("point_id"),
        F.col("geometry.type").alias("type"),
        F.col("geometry.coordinates").alias("coordinates"),
        F.col("properties.Climate_Cl").alias("climate"),
        F.col("properties.Formation").alias("formation"),
        F.col("properties.Basin_Sub_").alias("basin"),
        F.col("properties.Country").alias("country"),
        F.col("properties.TIME").alias("time"),
        F.col("properties.NAME").alias("name"),
    )


def points_from_features(features: DataFrame) -> DataFrame:
    """Point features with coordinates; ordinates beyond two are ignored."""
    at = F.from_json("coordinates", "array<double>")
    return (
        features.where(F.col("type") == "Point")
        .withColumn("at", at)
        .withColumns(
            {"lon": F.try_element_at("at", F.lit(1)), "lat": F.try_element_at("at", F.lit(2))}
        )
        .where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .select(
            "map_id", "point_id", "lon", "lat", "climate", "formation", "basin", "country", "time"
        )
    )


def coast_vertices(features: DataFrame) -> DataFrame:
    """Vertices of all lines: map_id, feature_id, name, time, part, seq, lon, lat.

    One or several parts are told apart by the depth of the coordinates.
    """
    text = F.col("coordinates")
    several = text.rlike(r"^\s*\[\s*\[\s*\[")
    parts = F.when(several, F.from_json(text, f"array<{_LINES}>")).otherwise(
        F.array(F.from_json(text, _LINES))
    )
    return (
        features.where(F.col("type").isin("LineString", "MultiLineString"))
        .select(
            "map_id", F.col("point_id").alias("feature_id"), "name", "time",
            F.posexplode(parts).alias("part", "line"),
        )
        .select(
            "map_id", "feature_id", "name", "time", "part",
            F.posexplode("line").alias("seq", "at"),
        )
        .withColumns(
            {"lon": F.try_element_at("at", F.lit(1)), "lat": F.try_element_at("at", F.lit(2))}
        )
        .where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
        .drop("at")
    )


def discover_datasets(spark: SparkSession, directory: str, nested: bool = False) -> DataFrame:
    """Data sets with both files: map_id, points_path, coast_path, by name.

    Only the listing is used, no content is read. `nested` also looks into the
    directories a Spark job wrote in place of files.
    """
    reader = spark.read.format("binaryFile")
    if nested:
        reader = reader.option("recursiveFileLookup", True)
    else:
        reader = reader.option("pathGlobFilter", f"*{EXTENSION}")
    path = F.regexp_extract("path", rf"^(.*\{EXTENSION})(/|$)", 1)
    listed = reader.load(directory).select(
        F.regexp_extract("path", _NAME, 1).alias("map_id"),
        (F.regexp_extract("path", _NAME, 2) != "").alias("is_coast"),
        path.alias("file"),
    ).where(F.col("file") != "").distinct()
    points = listed.where(~F.col("is_coast")).select("map_id", F.col("file").alias("points_path"))
    coast = listed.where(F.col("is_coast")).select("map_id", F.col("file").alias("coast_path"))
    return points.join(coast, "map_id").orderBy("map_id")
