"""One query per operator, over the tables of a scale-factor directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_surface.functions.climate import age_or_default, climate_colour, or_default
from evidence_surface.functions.colour import (
    hue_class,
    normalise,
    sharpen,
    with_colour,
    with_hsv,
    with_pixel_class,
)
from evidence_surface.functions.naming import params_suffix
from evidence_surface.operators import basins, bounds, capture, grid, idw, locations, neighbours, pixels, summary
from evidence_surface.operators.sites import build_site_index
from evidence_surface.plans import folder, maps
from evidence_surface.sources import catalog, cells as cell_store, geojson

from . import files, views

POWER = 4.0
SHARP = 18.0
K = 8
NEIGHBOURS = 12
RADIUS = 0.15
FINE = 2.0
COARSE = 5.0
NODATA_FROM = 50.0  # latitude
STORED_AGE = 100
CATALOG_FOLDER = "MAPS"
CHOSEN_BASINS = ("BRAZIL", "CHINA", "N/A")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def by_age(df: DataFrame, *columns: str) -> DataFrame:
    """Named columns, keyed by age_ma; doubles among them at 6 decimals."""
    df = df.withColumnRenamed("map_id", "age_ma") if "map_id" in df.columns else df
    kinds = dict(df.dtypes)
    exact = ("lon", "lat")
    return df.select(
        *[
            F.round(c, 6).alias(c) if kinds[c] == "double" and c not in exact else F.col(c)
            for c in columns
        ]
    )


def surface(spark, sf_dir, resolution=COARSE, of: str = "true") -> DataFrame:
    """Surfaces of the maps that `of` is true of."""
    points = views.points(spark, sf_dir).where(of)
    return idw.idw_surface(points, resolution, POWER, NEIGHBOURS, True, RADIUS)


def age_of_base(df: DataFrame) -> DataFrame:
    """`65_ma` -> age_ma 65."""
    return df.withColumn("age_ma", F.split("map_id", "_")[0].cast("int")).drop("map_id")


# --- sources and sinks -----------------------------------------------------


@query
def geojson_points(spark, sf_dir):
    path = files.new_folder(spark, "geojson")
    files.write_points(views.points(spark, sf_dir), path)
    read = geojson.points_from_features(geojson.read_features(spark, path))
    return age_of_base(read)


@query
def coast_vertices(spark, sf_dir):
    path = files.new_folder(spark, "geojson")
    files.write_coast(views.coast(spark, sf_dir), path)
    read = geojson.coast_vertices(geojson.read_features(spark, path))
    return age_of_base(read).select("age_ma", "feature_id", "name", "part", "seq", "lon", "lat")


@query
def discover_datasets(spark, sf_dir):
    path = files.new_folder(spark, "geojson")
    has_coast = views.files(spark, sf_dir).where("has_coast").select("map_id")
    files.write_points(views.points(spark, sf_dir), path)
    files.write_coast(views.coast(spark, sf_dir).join(has_coast, "map_id"), path, "append")
    found = geojson.discover_datasets(spark, path, nested=True)
    return age_of_base(found.withColumn("base", F.col("map_id"))).select("age_ma", "base")


def _stored_originals(spark, sf_dir) -> str:
    """Surfaces stored under the first name, the second name, or not at all."""
    path = files.new_folder(spark, "originals")
    age = F.col("map_id")
    name = F.when(age % 15 == 5, F.concat(age.cast("string"), F.lit("_ma_idw"))).when(
        age % 15 == 10, F.concat(age.cast("string"), F.lit("_idw"))
    )
    stored = surface(spark, sf_dir, of="map_id % 15 <> 0").withColumn("raster", name)
    cell_store.write_cells(stored.select("raster", "i", "j", "lon", "lat", "value"), path, ("raster",))
    return path


def _originals(spark, sf_dir) -> DataFrame:
    path = _stored_originals(spark, sf_dir)
    bases = views.points(spark, sf_dir).select("map_id").distinct().withColumn(
        "base", F.concat(F.col("map_id").cast("string"), F.lit("_ma"))
    )
    chosen = cell_store.original_rasters(bases, cell_store.stored_rasters(spark, path))
    return cell_store.read_cells(spark, path).join(chosen, "raster")


@query
def original_raster(spark, sf_dir):
    return by_age(_originals(spark, sf_dir), "age_ma", "raster", "i", "j", "value")


def _stored_cells(spark, sf_dir) -> DataFrame:
    path = files.new_folder(spark, "cells")
    cells = surface(spark, sf_dir).withColumn("method", F.lit("idw"))
    cell_store.write_cells(cells, path)
    return cell_store.read_cells(spark, path)


@query
def cells_roundtrip(spark, sf_dir):
    return by_age(_stored_cells(spark, sf_dir), "age_ma", "method", "i", "j", "value")


@query
def cells_by_age(spark, sf_dir):
    stored = _stored_cells(spark, sf_dir).where(F.col("map_id") == STORED_AGE)
    return by_age(stored, "age_ma", "method", "i", "j", "value")


@query
def colour_ramp(spark, sf_dir):
    path = files.new_folder(spark, "pixels")
    coloured = with_colour(surface(spark, sf_dir), SHARP).withColumn("method", F.lit("idw"))
    cell_store.write_pixels(coloured, path)
    return by_age(cell_store.read_cells(spark, path), "age_ma", "i", "j", "r", "g", "b")


@query
def map_catalog(spark, sf_dir):
    ages = views.points(spark, sf_dir).select("map_id").distinct()
    base = F.concat(F.col("map_id").cast("string"), F.lit("_ma"))
    name = F.concat(F.lit("map_"), base, F.lit(f"_knn_idw{params_suffix(POWER, SHARP)}.html"))
    with_pdf = views.files(spark, sf_dir).where("has_pdf")
    pdf = F.concat(F.lit(f"{CATALOG_FOLDER}/"), F.col("stem"), F.lit(".pdf"))
    return catalog.map_catalog(ages.select(name.alias("name")), with_pdf.select(pdf.alias("pdf")), CATALOG_FOLDER)


# --- scalar functions ------------------------------------------------------


@query
def climate_encode(spark, sf_dir):
    coloured = views.points(spark, sf_dir).withColumn("colour", climate_colour(F.col("climate")))
    return by_age(coloured, "age_ma", "point_id", "climate", "value", "colour")


@query
def or_na(spark, sf_dir):
    number = F.col("point_id") % 5
    time = F.when(F.col("point_id") % 2 == 0, F.concat(number.cast("string"), F.lit(".0"))).otherwise(
        number.cast("string")
    )
    texts = {c: or_default(F.col(c)) for c in ("climate", "formation", "basin", "country")}
    named = views.points(spark, sf_dir).withColumns({**texts, "age": age_or_default(time)})
    return by_age(named, "age_ma", "point_id", "climate", "formation", "basin", "country", "age")


@query
def gradient_sharpen(spark, sf_dir):
    shares = surface(spark, sf_dir).withColumn("share", normalise(F.col("value")))
    sharp = shares.withColumn("sharp", sharpen(F.col("share"), SHARP))
    return by_age(sharp, "age_ma", "i", "j", "share", "sharp")


@query
def pixel_class(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rgb = orders.select(
        "o_orderkey",
        (F.col("o_orderkey") % 256).cast("int").alias("r"),
        ((F.col("o_orderkey") * 7) % 251).cast("int").alias("g"),
        (F.col("o_custkey") % 256).cast("int").alias("b"),
    )
    named = hue_class(F.col("h8"), F.col("s8"), F.col("v8"))
    return with_hsv(rgb).withColumn("pixel_class", named)


# --- points on the raster --------------------------------------------------


def _point_pixels(spark, sf_dir, mirror_rows):
    points = views.points(spark, sf_dir)
    return pixels.point_pixels(points, grid.grid_meta(points, FINE), mirror_rows=mirror_rows)


@query
def point_pixels(spark, sf_dir):
    return by_age(_point_pixels(spark, sf_dir, False), "age_ma", "i", "j", "value")


@query
def point_pixels_mirrored(spark, sf_dir):
    return by_age(_point_pixels(spark, sf_dir, True), "age_ma", "i", "j", "value")


@query
def override_count(spark, sf_dir):
    return by_age(pixels.override_count(_point_pixels(spark, sf_dir, False)), "age_ma", "overridden")


def _point_override(spark, sf_dir, mirror_rows):
    points = views.points(spark, sf_dir)
    marked = pixels.point_pixels(points, grid.grid_meta(points, COARSE), mirror_rows=mirror_rows)
    return by_age(pixels.override_cells(surface(spark, sf_dir), marked), "age_ma", "i", "j", "value")


@query
def point_override(spark, sf_dir):
    return _point_override(spark, sf_dir, False)


@query
def point_override_mirrored(spark, sf_dir):
    return _point_override(spark, sf_dir, True)


@query
def override_values(spark, sf_dir):
    """Smoothed values exist for the odd ids only; the others keep theirs."""
    points = views.points(spark, sf_dir)
    smoothed = idw.knn_smooth(points, K, POWER).where(F.col("point_id") % 2 == 1)
    return by_age(pixels.override_values(points, smoothed), "age_ma", "point_id", "value")


@query
def flip_rows(spark, sf_dir):
    meta = grid.grid_meta(views.points(spark, sf_dir), COARSE)
    return by_age(pixels.flip_rows(surface(spark, sf_dir), meta), "age_ma", "i", "j", "value")


# --- grids and neighbours --------------------------------------------------


@query
def grid_meta(spark, sf_dir):
    meta = grid.grid_meta(views.points(spark, sf_dir), FINE)
    return by_age(
        meta, "age_ma", "min_lon", "max_lon", "min_lat", "max_lat", "nx", "ny", "pixel_x", "pixel_y"
    )


@query
def grid_cells(spark, sf_dir):
    cells = grid.grid_cells(grid.grid_meta(views.points(spark, sf_dir), FINE))
    return by_age(cells, "age_ma", "i", "j", "lon", "lat")


@query
def knn_neighbours(spark, sf_dir):
    index = build_site_index(views.points(spark, sf_dir), K + 1)
    near = idw.point_neighbours(views.points(spark, sf_dir), index, K)
    return by_age(near, "age_ma", "point_id", "rn", "neighbour_id", "d")


def _cell_neighbours(spark, sf_dir, resolution, k):
    points = views.points(spark, sf_dir)
    index = build_site_index(points, k)
    return neighbours.cell_neighbours(neighbours.cell_groups(grid.grid_meta(points, resolution), index, k), k)


@query
def idw_neighbours(spark, sf_dir):
    near = _cell_neighbours(spark, sf_dir, COARSE, NEIGHBOURS)
    return by_age(near, "age_ma", "i", "j", "rn", "point_id", "d", "value")


@query
def nearest_point(spark, sf_dir):
    return by_age(_cell_neighbours(spark, sf_dir, FINE, 1), "age_ma", "i", "j", "point_id", "d")


@query
def preserve_points(spark, sf_dir):
    """Cells that take a point's value as it is."""
    near = _cell_neighbours(spark, sf_dir, FINE, 1).where(F.col("d") < RADIUS)
    return by_age(near, "age_ma", "i", "j", "point_id", "value")


@query
def preserve_points_tenth(spark, sf_dir):
    """The same on the grid that maps are drawn on, 0.1 degree."""
    points = views.points(spark, sf_dir)
    near = capture.captured_cells(points, grid.grid_meta(points), RADIUS)
    return by_age(near, "age_ma", "i", "j", "point_id", "value")


# --- surfaces and maps -----------------------------------------------------


@query
def knn_smooth(spark, sf_dir):
    smoothed = idw.knn_smooth(views.points(spark, sf_dir), K, POWER)
    return by_age(smoothed, "age_ma", "point_id", "value", "smoothed")


@query
def idw_surface(spark, sf_dir):
    return by_age(surface(spark, sf_dir, FINE), "age_ma", "i", "j", "lon", "lat", "value")


STATS = ("total", "dry", "semi_arid", "humid", "classified", "other")
PERCENTS = tuple(f"pct_{c}" for c in STATS[1:])


def _coarse_stats(spark, sf_dir):
    return summary.class_stats(with_pixel_class(with_colour(_with_gaps(spark, sf_dir), SHARP)))


def _with_gaps(spark, sf_dir):
    """The coarse surface without values in the north."""
    value = F.when(F.col("lat") > NODATA_FROM, F.lit(float("nan"))).otherwise(F.col("value"))
    return surface(spark, sf_dir).withColumn("value", value)


@query
def class_stats(spark, sf_dir):
    return by_age(_coarse_stats(spark, sf_dir), "age_ma", *STATS, *PERCENTS)


@query
def class_stats_text(spark, sf_dir):
    stats = summary.class_stats_text(_coarse_stats(spark, sf_dir), 2)
    texts = [f"{c}_text" for c in ("dry", "semi_arid", "humid", "other")]
    one = {f"{c}_1": F.col(c) for c in texts}
    short = summary.class_stats_text(stats.withColumns({f"{c}_2": F.col(c) for c in texts}), 1).withColumns(one)
    return by_age(short, "age_ma", *[f"{c}_{n}" for c in texts for n in (1, 2)])


@query
def raster_stats(spark, sf_dir):
    stats = summary.raster_stats(with_colour(_with_gaps(spark, sf_dir), SHARP))
    channels = [f"{m}_{c}" for c in "rgb" for m in ("min", "max")]
    return by_age(
        stats, "age_ma", "n_rows", "n_cols", "total", "valid", "min_value", "max_value", *channels
    )


def _map_stats(spark, sf_dir, methods, **options):
    options = {"resolution": FINE} | options
    stats = maps.map_stats(views.points(spark, sf_dir), POWER, SHARP, methods, n_neighbors=NEIGHBOURS, k=K, **options)
    return by_age(stats, "age_ma", "method", *STATS, *PERCENTS, "power", "gradient_sharp")


@query
def map_stats_tenth(spark, sf_dir):
    """Both methods on the grid that maps are drawn on, 0.1 degree: some four million cells a map."""
    return _map_stats(spark, sf_dir, maps.METHODS, resolution=grid.RESOLUTION)


@query
def map_idw_stats(spark, sf_dir):
    return _map_stats(spark, sf_dir, ("idw",))


@query
def map_knn_idw_stats(spark, sf_dir):
    return _map_stats(spark, sf_dir, ("knn_idw",))


@query
def map_sweep_stats(spark, sf_dir):
    """Both methods for all maps in one run."""
    return _map_stats(spark, sf_dir, ("idw", "knn_idw"))


# drawn by one search
SETTINGS = {
    "usual": maps.Setting(POWER, NEIGHBOURS, K, RADIUS),
    "soft": maps.Setting(1.0, NEIGHBOURS, 3, RADIUS),
    "wide": maps.Setting(2.0, 5, K, 1.5),
    "nearest": maps.Setting(POWER, 1, K, RADIUS),
}


@query
def map_settings_stats(spark, sf_dir):
    """Both methods for all maps by several parameters in one run, on the grid that maps are drawn on."""
    stats = maps.map_stats_by(views.points(spark, sf_dir), SETTINGS, SHARP, resolution=grid.RESOLUTION)
    parameters = ("power", "n_neighbors", "k", "point_radius")
    return by_age(stats, "age_ma", "setting", "method", *STATS, *PERCENTS, *parameters)


@query
def map_sweep_stats_mirrored(spark, sf_dir):
    return _map_stats(spark, sf_dir, ("idw", "knn_idw"), mirror_rows=True)


@query
def map_original(spark, sf_dir):
    points = views.points(spark, sf_dir)
    cells = _originals(spark, sf_dir).select("map_id", "i", "j", "value")
    drawn = maps.map_original(cells, points, grid.grid_meta(points, COARSE), SHARP)
    return by_age(drawn, "age_ma", "i", "j", "value", "r", "g", "b")


CROP_I, CROP_J = 2, 3  # rows and columns a delivered raster lacks in the south and west


def _delivered(spark, sf_dir, north_up):
    """Cells and metadata, read back, of rasters with an extent of their own."""
    path = files.new_folder(spark, "delivered")
    meta = grid.grid_meta(views.points(spark, sf_dir), COARSE)
    name = F.concat(F.col("map_id").cast("string"), F.lit("_ma_idw"))
    own = meta.withColumns(
        {
            "min_lon": F.col("min_lon") + CROP_J * F.col("pixel_x"),
            "min_lat": F.col("min_lat") + CROP_I * F.col("pixel_y"),
            "nx": F.col("nx") - CROP_J,
            "ny": F.col("ny") - CROP_I,
        }
    )
    cells = surface(spark, sf_dir).where((F.col("i") >= CROP_I) & (F.col("j") >= CROP_J))
    cells = cells.withColumns({"i": F.col("i") - CROP_I, "j": F.col("j") - CROP_J})
    if north_up:
        cells = pixels.flip_rows(cells, own)
    cells = cells.withColumn("raster", name).select("raster", "i", "j", "value")
    cell_store.write_rasters(cells, own.withColumn("raster", name), path)
    read = [df.withColumn("map_id", F.split("raster", "_")[0].cast("int")) for df in cell_store.read_rasters(spark, path)]
    return read[0].drop("raster"), read[1].drop("raster")


def _map_delivered(spark, sf_dir, north_up):
    cells, meta = _delivered(spark, sf_dir, north_up)
    drawn = maps.map_original(cells, views.points(spark, sf_dir), meta, SHARP, mirror_rows=north_up)
    return by_age(drawn, "age_ma", "i", "j", "value", "r", "g", "b")


@query
def map_original_own_extent(spark, sf_dir):
    return _map_delivered(spark, sf_dir, False)


@query
def map_original_north_up(spark, sf_dir):
    return _map_delivered(spark, sf_dir, True)


@query
def combined_bounds_stored(spark, sf_dir):
    """Every map has a stored raster, whose extent is the view's."""
    points = views.points(spark, sf_dir)
    _, meta = _delivered(spark, sf_dir, False)
    result = bounds.combined_bounds(
        points.select("map_id").distinct(),
        bounds.feature_bounds(points),
        bounds.feature_bounds(views.coast(spark, sf_dir)),
        meta,
    )
    return by_age(result, "age_ma", *bounds.BOUNDS, *(f"view_{b}" for b in bounds.BOUNDS))


LINES_ONLY_AGE = 150


@query
def run_folder_stats(spark, sf_dir):
    """From a folder of files to the stored shares; one data set has lines only, and a second
    run replaces its own maps."""
    path, out = files.new_folder(spark, "geojson"), files.new_folder(spark, "maps")
    points, coast = views.points(spark, sf_dir), views.coast(spark, sf_dir)
    files.write_points(points, path)
    files.write_coast(coast, path, "append")
    lines_only = coast.where(F.col("map_id") == 65).withColumn("map_id", F.lit(LINES_ONLY_AGE))
    for suffix in ("", "_costa"):
        files.write_coast(lines_only, path, "append", suffix)
    for power in (2.0, POWER):
        run = folder.run_folder(spark, path, out, power, SHARP, resolution=COARSE, n_neighbors=NEIGHBOURS, k=K)
    listed = run.catalog.select(F.col("age_ma").alias("listed_age"), "label", F.col("pdf"))
    shown = age_of_base(run.summary.join(run.stats, "map_id", "left")).join(
        listed, F.col("age_ma") == F.col("listed_age"), "left"
    )
    shown = shown.withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))
    return by_age(
        shown, "age_ma", "method", "status", "n_points", "n_coast", "title", "path", "label", *STATS, *PERCENTS, "power",
    )


# --- locations, bounds, summaries ------------------------------------------


@query
def location_groups(spark, sf_dir):
    groups = locations.location_groups(views.points(spark, sf_dir))
    joined = groups.withColumns({c: F.array_join(c, "|") for c in ("basins", "formations")})
    return by_age(joined, "age_ma", "lon", "lat", "n_points", "colour", "basins", "formations", "tooltip")


@query
def location_details(spark, sf_dir):
    details = locations.location_details(views.points(spark, sf_dir))
    return by_age(
        details, "age_ma", "lon", "lat", "point_id", "idx", "n_points", "formation", "basin",
        "country", "climate", "age", "colour",
    )


@query
def basin_list(spark, sf_dir):
    return by_age(locations.basin_list(views.points(spark, sf_dir)), "age_ma", "basin")


@query
def basin_filter(spark, sf_dir):
    groups = locations.location_groups(views.points(spark, sf_dir))
    shown = locations.filter_basins(groups, CHOSEN_BASINS)
    return by_age(shown, "age_ma", "lon", "lat", "n_points", "tooltip")


@query
def basin_bitmap_filter(spark, sf_dir):
    """Locations of the chosen basins, found by bitmaps, with all their basins."""
    index = basins.basin_index(views.points(spark, sf_dir))
    shown = basins.named_locations(index, basins.with_any(index, CHOSEN_BASINS))
    joined = shown.withColumn("basins", F.array_join("basins", "|"))
    return by_age(joined, "age_ma", "lon", "lat", "n_points", "basins")


@query
def basins_beside_chosen(spark, sf_dir):
    """The basins at locations of the chosen ones, per map."""
    index = basins.basin_index(views.points(spark, sf_dir))
    return by_age(basins.basins_of_maps(index, basins.with_any(index, CHOSEN_BASINS)), "age_ma", "basin")


@query
def feature_bounds(spark, sf_dir):
    points = bounds.feature_bounds(views.points(spark, sf_dir)).withColumn("kind", F.lit("points"))
    coast = bounds.feature_bounds(views.coast(spark, sf_dir)).withColumn("kind", F.lit("coast"))
    return by_age(points.unionByName(coast), "age_ma", "kind", *bounds.BOUNDS)


@query
def combined_bounds(spark, sf_dir):
    """Maps from 105 on have a raster; one map has no features at all."""
    points = views.points(spark, sf_dir)
    raster = grid.grid_meta(points, COARSE).where(F.col("map_id") >= 105)
    listed = points.select("map_id").distinct()
    missing = listed.agg((F.max("map_id") + 5).alias("map_id"))
    result = bounds.combined_bounds(
        listed.unionByName(missing),
        bounds.feature_bounds(points),
        bounds.feature_bounds(views.coast(spark, sf_dir)),
        raster,
    )
    columns = [*bounds.BOUNDS, "center_lat", "center_lon", *(f"view_{b}" for b in bounds.BOUNDS)]
    return by_age(result, "age_ma", *columns)


@query
def run_summary(spark, sf_dir):
    """As above, one listed map has no features and is skipped."""
    points = views.points(spark, sf_dir)
    listed = points.select("map_id").distinct()
    missing = listed.agg((F.max("map_id") + 5).alias("map_id"))
    lines = views.coast(spark, sf_dir).select("map_id", "line_id").distinct()
    result = summary.run_summary(listed.unionByName(missing), points, lines)
    return by_age(result, "age_ma", "n_points", "n_coast", "status")
