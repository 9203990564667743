import glob
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evidence_surface.operators.bounds import feature_bounds
from evidence_surface.sources import catalog, cells, geojson


def feature(kind, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": kind, "coordinates": coordinates}}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("geojson")
    points = [
        feature("Point", [10.5, -3.25, 7.0], Climate_Cl="H", Basin_Sub_="", Country=None, TIME=110.0, Formation="F"),
        feature("Point", []),
        {"type": "Feature", "properties": {}, "geometry": None},
        feature("Polygon", [[[0, 0], [90, 0], [90, 90], [0, 0]]]),
    ]
    coast = [
        feature("MultiLineString", [[[1, 2], [3, 4]], [[5, 6], [-7, 8], [9, 1]]], NAME="m", TIME=110.0),
        feature("LineString", [[20, 21], [22, 23]], NAME="l", TIME="110"),
        feature("LineString", []),
    ]
    for name, features in (("110_ma", points), ("110_ma_costa", coast), ("65_ma", points)):
        text = json.dumps({"type": "FeatureCollection", "features": features}, indent=1)
        (path / f"{name}.geojson").write_text(text)
    (path / "notes.txt").write_text("not a data set")
    return path


def test_points(spark, folder):
    features = geojson.read_features(spark, f"{folder}/110_ma.geojson")
    rows = geojson.points_from_features(features).collect()
    assert len(rows) == 1
    p = rows[0]
    assert (p.map_id, p.point_id, p.lon, p.lat) == ("110_ma", 0, 10.5, -3.25)
    assert (p.climate, p.basin, p.country, p.time) == ("H", "", None, "110.0")


def test_ids_go_on_through_the_documents_of_a_data_set(spark, tmp_path):
    import os

    base = tmp_path / "late crétacé+1_ma.geojson"
    for n, count in ((0, 3), (2, 0), (10, 4), (9, 2)):
        features = [feature("Point", [n, i], NAME=f"{n}-{i}") for i in range(count)]
        os.makedirs(base / f"document={n}")
        (base / f"document={n}" / "part-0.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    for limit in (100, 0):  # broadcast counts, shuffled counts
        rows = geojson.read_features(spark, f"{tmp_path}/*/*", broadcast_rows=limit).collect()
        assert {r.name: r.point_id for r in rows} == {
            f"{n}-{i}": first + i for n, count, first in ((0, 3, 0), (9, 2, 3), (10, 4, 5)) for i in range(count)
        }
        assert {r.map_id for r in rows} == {"late crétacé+1_ma"}


def test_one_name_in_two_folders_is_an_error(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1_ma.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    with pytest.raises(ValueError):
        geojson.read_features(spark, f"{tmp_path}/*")


def test_names_agree_with_discovery(spark, tmp_path):
    text = json.dumps({"type": "FeatureCollection", "features": [feature("Point", [1, 2])]})
    for suffix in ("", "_costa"):
        (tmp_path / f"late crétacé a=b+c_ma{suffix}.geojson").write_text(text)
    read = {r.map_id for r in geojson.read_features(spark, str(tmp_path)).collect()}
    assert read == {r.map_id for r in geojson.discover_datasets(spark, str(tmp_path)).collect()} == {"late crétacé a=b+c_ma"}


def test_coast_and_bounds(spark, folder):
    features = geojson.read_features(spark, str(folder / "*.geojson"))
    coast = geojson.coast_vertices(features)
    got = [(r.map_id, r.feature_id, r.part, r.seq, r.lon, r.lat) for r in coast.orderBy("feature_id", "part", "seq").collect()]
    assert got == [
        ("110_ma", 0, 0, 0, 1.0, 2.0),
        ("110_ma", 0, 0, 1, 3.0, 4.0),
        ("110_ma", 0, 1, 0, 5.0, 6.0),
        ("110_ma", 0, 1, 1, -7.0, 8.0),
        ("110_ma", 0, 1, 2, 9.0, 1.0),
        ("110_ma", 1, 0, 0, 20.0, 21.0),
        ("110_ma", 1, 0, 1, 22.0, 23.0),
    ]
    points = geojson.points_from_features(features.where(~F.col("is_coast")))
    every = points.select("map_id", "lon", "lat").unionByName(coast.select("map_id", "lon", "lat"))
    b = feature_bounds(every).where("map_id = '110_ma'").first()
    assert (b.min_lat, b.min_lon, b.max_lat, b.max_lon) == (-3.25, -7.0, 23.0, 22.0)


def test_discovery_needs_both_files(spark, folder):
    found = geojson.discover_datasets(spark, str(folder)).collect()
    assert [r.map_id for r in found] == ["110_ma"]
    assert found[0].points_path.endswith("/110_ma.geojson")
    assert found[0].coast_path.endswith("/110_ma_costa.geojson")


def test_broken_document_is_an_error(spark, tmp_path):
    (tmp_path / "1_ma.geojson").write_text('{"type": "FeatureCollection", "features": [')
    with pytest.raises(Exception):
        geojson.read_features(spark, str(tmp_path)).collect()


HARD = {
    "type": "FeatureCollection",
    "name": 'a } brace, a \\ and a " quote } features": [',
    "crs": {"type": "name", "properties": {"name": "x}", "more": {"deep": [{"a": [{"b": 1}]}]}}},
    "bbox": [1, 2, 3, 4],
    "others": [{"type": "Feature", "properties": {"NAME": "not one"}}, [[{"x": {"y": 2}}], 3], {}],
    "features": [
        feature("Point", [i / 4, -i], NAME=f'{{"n": "é}}{i}\\\\"', Formation='"features": [', TIME=i)
        | {"id": {"of": [{"k": i}, {"k": "}" * (i % 5)}]}}
        for i in range(30)
    ],
    "after": [{"type": "Feature"}, {"features": [{"type": "Feature"}]}],
}


def plain_rows(folder):
    """map_id, is_coast, position, type, coordinates, name of every feature, by a whole parse."""
    out = []
    for file in folder.glob("*.geojson"):
        stem = file.name.removesuffix(".geojson")
        for i, f in enumerate(json.loads(file.read_text())["features"]):
            g = f.get("geometry") or {}
            at = json.dumps(g["coordinates"], separators=(",", ":")) if "coordinates" in g else None
            out.append((stem.removesuffix("_costa"), stem.endswith("_costa"), i, g.get("type"), at, f["properties"].get("NAME")))
    return sorted(out, key=str)


@pytest.mark.parametrize("split, chunk", [("3000b", 1), ("16m", 300), ("16m", 1 << 20)])
def test_ranges_and_chunks_do_not_matter(spark, tmp_path, split, chunk):
    long = feature("LineString", [[i % 180, i % 90] for i in range(2000)], NAME="long")
    (tmp_path / "5_ma.geojson").write_text(json.dumps(HARD, indent=2, ensure_ascii=False))
    (tmp_path / "6_ma.geojson").write_text(json.dumps(HARD, separators=(",", ":")) + "  \n\n")
    (tmp_path / "5_ma_costa.geojson").write_text(json.dumps({"features": [long, long | {"bbox": [1, 2]}]}) + "\n")
    (tmp_path / "7_ma.geojson").write_text('{"features": []}')
    (tmp_path / "8_ma.geojson").write_text('{"type": "FeatureCollection", "crs": null}')
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = geojson.read_features(spark, str(tmp_path), chunk_bytes=chunk).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    got = sorted(((r.map_id, r.is_coast, r.point_id, r.type, r.coordinates, r.name) for r in rows), key=str)
    (tmp_path / "8_ma.geojson").unlink()  # it has no features to list
    assert got == plain_rows(tmp_path)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    document = {"features": [feature("Point", [i, 0], NAME=str(i)) for i in range(5000)]}
    (tmp_path / "9_ma.geojson").write_text(json.dumps(document))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        chunks = geojson._chunks(spark, str(tmp_path), 1 << 20, 100)
        assert chunks.select("block").distinct().count() >= 8
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_elements_that_are_no_objects(spark, tmp_path):
    one = json.dumps(feature("Point", [1, 2], NAME="a"))
    (tmp_path / "1_ma.geojson").write_text(f'{{"features": [null, {one}, 3, "x, {{", [4, 5], {one}]}}')
    assert sorted(r.point_id for r in geojson.read_features(spark, str(tmp_path)).collect()) == [1, 5]


@pytest.mark.parametrize("text", ['[{"features": []}]', '{"features": [{"a": "}', '{"features": [{"properties": {}}', "null"])
def test_no_complete_object(spark, tmp_path, text):
    (tmp_path / "1_ma.geojson").write_text(text)
    with pytest.raises(ValueError):
        geojson.read_features(spark, str(tmp_path))


def test_cells_by_map_and_replacement(spark, tmp_path):
    path = str(tmp_path / "cells")
    schema = "method string, map_id int, i int, j int, value double"
    cells.write_cells(spark.createDataFrame([("idw", 65, 0, 0, 1.0), ("idw", 70, 0, 0, 2.0)], schema), path)
    cells.write_cells(spark.createDataFrame([("idw", 70, 0, 1, 3.0)], schema), path)
    got = {(r.map_id, r.j): r.value for r in cells.read_cells(spark, path).collect()}
    assert got == {(65, 0): 1.0, (70, 1): 3.0}
    one = cells.read_cells(spark, path).where("map_id = 70")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(map_id" in plan


def test_cells_by_place(spark, tmp_path):
    """A box of a map is read from few of its row groups, and equals the box of a full read."""
    path = str(tmp_path / "cells")
    grid = spark.range(1200).selectExpr("int(id) AS i").crossJoin(spark.range(1500).selectExpr("int(id) AS j"))
    grid = grid.selectExpr("'idw' AS method", "65 AS map_id", "i", "j", "j * 0.1D - 75 AS lon", "i * 0.1D - 60 AS lat", "rand(3) AS value")
    cells.write_cells(grid.repartition(6), path)
    box = {"lon": (-20.0, -10.0), "lat": (5.0, 12.0)}
    some = cells.read_cells(spark, path, box).where("map_id = 65")
    rows = {(r.i, r.j, r.value) for r in some.collect()}
    want = spark.read.parquet(path).where("lon BETWEEN -20 AND -10 AND lat BETWEEN 5 AND 12").collect()
    assert rows == {(r.i, r.j, r.value) for r in want} and len(rows) > 6000
    scan = some._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numOutputRows").value() < 0.25 * 1200 * 1500
    inside = total = 0
    for file in glob.glob(f"{path}/**/*.parquet", recursive=True):
        meta = pq.ParquetFile(file).metadata
        names = [meta.schema.column(c).name for c in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            of = {c: meta.row_group(g).column(names.index(c)).statistics for c in box}
            inside += all(of[c].max >= low and of[c].min <= high for c, (low, high) in box.items())
            total += 1
    assert total >= 10 and inside <= 0.3 * total, (inside, total)
    assert cells.read_cells(spark, path, {"i": (3, 4), "j": (7, 7)}).count() == 2


def test_pixels_keep_colours_only(spark, tmp_path):
    path = str(tmp_path / "pixels")
    schema = "method string, map_id int, i int, j int, value double, r int, g int, b int"
    cells.write_pixels(spark.createDataFrame([("idw", 65, 0, 0, 1.0, 1, 2, 3)], schema), path)
    assert sorted(cells.read_cells(spark, path).columns) == ["b", "g", "i", "j", "map_id", "method", "r"]


def test_original_raster_names(spark, tmp_path):
    path = str(tmp_path / "rasters")
    rows = [("65_ma_idw", 0, 0, 1.0), ("65_idw", 0, 0, 9.0), ("70_idw", 0, 0, 2.0), ("late_idw", 0, 0, 3.0)]
    cells.write_cells(spark.createDataFrame(rows, "raster string, i int, j int, value double"), path, ("raster",))
    bases = spark.createDataFrame([("65_ma",), ("70_ma",), ("75_ma",), ("late",)], "base string")
    chosen = cells.original_rasters(bases.withColumn("map_id", F.col("base")), cells.stored_rasters(spark, path))
    got = {r.map_id: r.raster for r in chosen.collect()}
    assert got == {"65_ma": "65_ma_idw", "70_ma": "70_idw", "late": "late_idw"}


def test_catalog(spark, tmp_path):
    names = spark.createDataFrame([("map_110_ma_x.html",), ("map_65_ma_x.html",), ("plain.html",), ("map_65_ma_x.pdf",)], "name string")
    pdfs = spark.createDataFrame([("OUT/map_65_ma_x.pdf",)], "pdf string")
    made = catalog.map_catalog(names, pdfs, "OUT")
    got = [(r.age_ma, r.label, r.path, r.pdf) for r in made.collect()]
    assert got == [
        (0, "0 Ma", "OUT/plain.html", ""),
        (65, "65 Ma", "OUT/map_65_ma_x.html", "OUT/map_65_ma_x.pdf"),
        (110, "110 Ma", "OUT/map_110_ma_x.html", ""),
    ]
    catalog.write_catalog(made, str(tmp_path / "catalog"))
    assert spark.read.json(str(tmp_path / "catalog")).count() == 3
