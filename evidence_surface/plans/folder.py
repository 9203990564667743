"""One run from a folder of data sets to stored cells, class shares, catalog and summary."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.climate import climate_value
from ..functions.colour import with_pixel_class
from ..functions.naming import output_path, params_suffix, title_label
from ..operators.summary import class_stats, run_summary
from ..session import counted_side, materialise
from ..sources import catalog, cells as cell_store, geojson
from .changes import STATE, outdated, point_digests, read_state, write_state
from .maps import GRADIENT_SHARP, METHODS, Setting, map_cells, map_cells_by, map_pixels, with_parameters


@dataclass(frozen=True)
class FolderRun:
    """summary: map_id, n_points, n_coast, status. stats: class shares per map and method with
    title, path and the run's parameters. catalog: as `map_catalog`, read back from its sink.
    drawn: map_id and cells of the maps this run drew; without `cells` only their shares."""

    summary: DataFrame
    stats: DataFrame
    catalog: DataFrame
    drawn: DataFrame


def _read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The data sets of `folder`, their points with class numbers, and the run's summary."""
    found = materialise(geojson.discover_datasets(spark, folder, nested=True), "datasets")
    reader = geojson.read_features(spark, folder)
    features = materialise(
        reader.join(counted_side(found.select("map_id"), "found"), "map_id", "left_semi"), "features"
    )
    points = geojson.points_from_features(features.where(~F.col("is_coast"))).withColumn(
        "value", climate_value(F.col("climate"))
    )
    lines = features.where(F.col("is_coast") & F.col("type").isin("LineString", "MultiLineString"))
    summary = run_summary(found.select("map_id"), points, lines)
    return found, points, summary


def run_folder(
    spark: SparkSession,
    folder: str,
    out: str,
    power: float,
    gradient_sharp: float = GRADIENT_SHARP,
    methods: Sequence[str] = METHODS,
    listed_method: str = "knn_idw",
    pdfs: DataFrame | None = None,
    changed_only: bool = False,
    **options,
) -> FolderRun:
    """Maps all data sets of `folder` that have both files and any point; the others are
    `skipped` in the summary.

    Writes `out`/cells and `out`/stats by method and map, replacing only the maps of this run,
    and `out`/catalog. `options` are those of `map_cells`; `pdfs` lists the PDF paths that exist.

    `changed_only` leaves the files of maps alone whose points and parameters are those that `out`
    was drawn from (a point added, moved, deleted or of another class number counts as a change); a new
    `gradient_sharp` draws their shares anew from the stored cells. What `out` holds is taken as
    these runs wrote it.
    """
    found, points, summary = _read_folder(spark, folder)

    drawn_by = {"power": float(power), "methods": sorted(methods), **options}
    drawn_by.pop("broadcast_rows", None)
    digests = materialise(point_digests(points, json.dumps(drawn_by, sort_keys=True)), "digests")
    state = read_state(spark, f"{out}/state") if changed_only else spark.createDataFrame([], STATE)
    drawn = materialise(outdated(digests, state, float(gradient_sharp)), "outdated")
    # until its shares are written, a map counts as unfinished
    write_state(drawn, f"{out}/state", None)
    due = drawn.where("cells").select("map_id")
    if due.head(1):
        placed = points.join(counted_side(due, "due"), "map_id", "left_semi") if changed_only else points
        cell_store.write_cells(map_cells(placed, power, methods, **options), f"{out}/cells")
    done = counted_side(summary.where("status = 'processed'").select("map_id"), "processed")
    to_draw = counted_side(drawn.select("map_id"), "drawn")
    stored = cell_store.read_cells(spark, f"{out}/cells").where(F.col("method").isin(*methods))
    stored = stored.withColumn("map_id", F.col("map_id").cast("string")).join(to_draw, "map_id", "left_semi")
    suffix = params_suffix(power, gradient_sharp)
    paths = {m: output_path(out, F.col("map_id"), m, suffix) for m in methods}
    path = F.coalesce(*[F.when(F.col("method") == m, p) for m, p in paths.items()])
    stats = class_stats(with_pixel_class(map_pixels(stored, gradient_sharp)), ("map_id", "method")).withColumns(
        {
            "title": title_label(F.col("map_id")),
            "path": path,
            "power": F.lit(float(power)),
            "gradient_sharp": F.lit(float(gradient_sharp)),
        }
    )
    stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "map_id").parquet(
        f"{out}/stats"
    )
    write_state(drawn, f"{out}/state", float(gradient_sharp))

    name = F.regexp_extract(output_path("", F.col("map_id"), listed_method, suffix), r"([^/]+)$", 1)
    pdfs = found.select(F.lit("").alias("pdf")).limit(0) if pdfs is None else pdfs
    listing = catalog.map_catalog(done.select(name.alias("name")), pdfs, out)
    catalog.write_catalog(listing, f"{out}/catalog")
    written = spark.read.parquet(f"{out}/stats").withColumn("map_id", F.col("map_id").cast("string"))
    listed = catalog.read_catalog(spark, f"{out}/catalog")
    return FolderRun(summary, written, listed, drawn.select("map_id", "cells"))


def sweep_folder(
    spark: SparkSession,
    folder: str,
    out: str,
    settings: Mapping[str, Setting],
    gradient_sharp: float = GRADIENT_SHARP,
    methods: Sequence[str] = METHODS,
    **options,
) -> DataFrame:
    """All data sets of `folder` by several settings, read once and drawn by one search: class shares per map,
    setting and method, with title, path and parameters, as they lie in `out`/stats.

    Writes `out`/cells and `out`/stats by setting, method and map, and replaces only those of this
    run. A setting's name is the folder of its paths, below `out`. `options` are those of `map_cells_by`.
    """
    by = ("setting", "method", "map_id")
    _, points, _ = _read_folder(spark, folder)
    cells = map_cells_by(points, settings, methods, **options).withColumn("map_id", F.col("map_id").cast("string"))
    cell_store.write_cells(cells, f"{out}/cells", by)
    drawn = counted_side(points.select(F.col("map_id").cast("string").alias("map_id")).distinct(), "drawn")
    # names stay texts, those of digits too
    stored = spark.read.schema(cells.schema).parquet(f"{out}/cells")
    stored = stored.where(F.col("setting").isin(*settings) & F.col("method").isin(*methods)).join(drawn, "map_id", "left_semi")
    paths = [
        F.when(
            (F.col("setting") == name) & (F.col("method") == m),
            output_path(f"{out}/{name}", F.col("map_id"), m, params_suffix(s.power, gradient_sharp)),
        )
        for name, s in settings.items()
        for m in methods
    ]
    shares = class_stats(with_pixel_class(map_pixels(stored, gradient_sharp)), by)
    stats = with_parameters(shares, settings).withColumns(
        {
            "title": title_label(F.col("map_id")),
            "path": F.coalesce(*paths),
            "gradient_sharp": F.lit(float(gradient_sharp)),
        }
    )
    stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{out}/stats")
    return spark.read.schema(stats.schema).parquet(f"{out}/stats")
