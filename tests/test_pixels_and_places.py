import pytest
from brute import COLUMNS, mean, nearest, random_points
from pyspark.sql import functions as F

from evidence_surface import session
from evidence_surface.operators import bounds, capture, grid, idw, locations, neighbours, pixels
from evidence_surface.operators.grid import grid_meta
from evidence_surface.operators.neighbours import cell_groups, cell_neighbours
from evidence_surface.operators.pixels import (
    flip_rows,
    override_cells,
    override_count,
    override_values,
    pixel_address,
    point_pixels,
)
from evidence_surface.operators.sites import build_site_index
from evidence_surface.operators.summary import run_summary
from evidence_surface.plans import maps
from evidence_surface.plans.maps import map_cells, map_cells_by, map_stats

RASTER = "map_id int, min_lon double, max_lon double, min_lat double, max_lat double, nx int, ny int, pixel_x double, pixel_y double"


@pytest.fixture(scope="module")
def raster(spark):
    return spark.createDataFrame([(0, 0.0, 10.0, 0.0, 10.0, 10, 10, 1.0, 1.0)], RASTER)


def test_addresses_and_edges(spark, raster):
    rows = [(0, 1, 2.5, 7.9, 1.0), (0, 2, 10.0, 5.0, 1.0), (0, 3, 0.0, 0.0, 1.0), (0, 4, -0.1, 5.0, 1.0)]
    points = spark.createDataFrame(rows, COLUMNS)
    got = {r.point_id: (r.row, r.col) for r in pixel_address(points, raster).collect()}
    # the right edge is in the box but not on a pixel, beyond the box is out
    assert got == {1: (7, 2), 3: (0, 0)}
    north = {r.point_id: (r.row, r.col) for r in pixel_address(points, raster, mirror_rows=True).collect()}
    assert north == {1: (2, 2)}  # the south edge is the end of the last row


def test_overrides_take_the_greatest_value(spark, raster):
    rows = [(0, 1, 0.5, 0.5, 1.0), (0, 2, 1.5, 0.5, 3.0), (0, 3, 1.5, 0.5, float("nan"))]
    pixels = point_pixels(spark.createDataFrame(rows, COLUMNS), raster)
    got = {(r.i, r.j): r.value for r in pixels.collect()}
    assert got == {(i, j): 3.0 for i in (0, 1) for j in (0, 1, 2)}
    assert override_count(pixels).first().overridden == 6
    cells = spark.createDataFrame([(0, 0, 0, 2.0), (0, 5, 5, None)], "map_id int, i int, j int, value double")
    drawn = {(r.i, r.j): r.value for r in override_cells(cells, pixels).collect()}
    assert drawn == {(0, 0): 3.0, (5, 5): None}
    assert [r.i for r in flip_rows(cells, raster).orderBy("i").collect()] == [4, 9]


def test_missing_smoothed_value_keeps_the_class_value(spark):
    points = spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0), (0, 2, 0.0, 1.0, 3.0)], COLUMNS)
    smoothed = spark.createDataFrame([(0, 2, 1.5)], "map_id int, point_id bigint, smoothed double")
    got = {r.point_id: r.value for r in override_values(points, smoothed).collect()}
    assert got == {1: 1.0, 2: 1.5}


@pytest.mark.parametrize("mirror_rows", [False, True])
def test_map_cells_match_brute_force(spark, mirror_rows):
    """Both methods, with a location most points share."""
    rows = random_points(8, maps=2, n=50) + [(0, 1000 + n, 3.0, 4.0, float(1 + n % 3)) for n in range(60)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = map_cells(df, 4.0, resolution=4.3, mirror_rows=mirror_rows).collect()
    meta = {m.map_id: m for m in grid_meta(df, 4.3).collect()}
    assert len(got) == 2 * sum(m.nx * m.ny for m in meta.values())
    for map_id, m in meta.items():
        own = [r for r in rows if r[0] == map_id]
        smooth = [(*r[:4], mean(nearest(own, r[2], r[3], 8, but=r[1]), 4.0)) for r in own]
        for method, points in (("idw", own), ("knn_idw", smooth)):
            over = {}
            for r in points:
                row = int(((m.max_lat - r[3]) if mirror_rows else (r[3] - m.min_lat)) / m.pixel_y)
                col = int((r[2] - m.min_lon) / m.pixel_x)
                for i in range(row - 1, row + 2):
                    for j in range(col - 1, col + 2):
                        over[i, j] = max(r[4], over.get((i, j), 0))
            for c in got:
                if (c.map_id, c.method) != (map_id, method):
                    continue
                near = nearest(points, c.lon, c.lat, 12)
                want = near[0][2] if near[0][0] < 0.15 else mean(near, 4.0)
                assert c.value == pytest.approx(over.get((c.i, c.j), want), abs=1e-9)


SETTINGS = {
    "a": maps.Setting(4.0),
    "b": maps.Setting(1.0, 12, 3, 0.15),
    "c": maps.Setting(4.0, 3, 8, 2.5),
    "d": maps.Setting(2.0, 1, 0, 0.0),
    "e": maps.Setting(4.0, 30, 1, 0.15),
}


@pytest.mark.parametrize("dense", [False, True])
@pytest.mark.parametrize("methods", [("idw", "knn_idw"), ("knn_idw",), ("idw",)])
def test_settings_together_equal_one_after_the_other(spark, monkeypatch, dense, methods):
    """With ties, a location most points share, and groups of single cells and sites."""
    if dense:
        monkeypatch.setattr(neighbours, "SPLIT_ABOVE", 2)
    rows = random_points(8, maps=2, n=60, copies=0.3) + [(0, 1000 + n, 3.0, 4.0, float(1 + n % 3)) for n in range(90)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {
        (r.setting, r.map_id, r.method, r.i, r.j): (r.lon, r.lat, r.value)
        for r in map_cells_by(df, SETTINGS, methods, resolution=4.3).collect()
    }
    want = {}
    for name, s in SETTINGS.items():
        one = map_cells(df, s.power, methods, 4.3, s.n_neighbors, s.k, s.point_radius)
        want |= {(name, r.map_id, r.method, r.i, r.j): (r.lon, r.lat, r.value) for r in one.collect()}
    assert set(got) == set(want)
    for key, cell in want.items():
        assert got[key] == pytest.approx(cell, abs=1e-9)


def test_settings_share_one_search(spark, monkeypatch):
    df = spark.createDataFrame(random_points(9, maps=2, n=40), COLUMNS)
    searches = []
    for module, name in ((idw, "site_groups"), (maps, "cell_groups")):
        search = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, search=search, name=name, **o: (searches.append(name), search(*a, **o))[1])
    plan = map_cells_by(df, SETTINGS, resolution=4.3)._jdf.queryExecution().executedPlan().toString()
    assert sorted(searches) == ["cell_groups", "site_groups"] and plan.count("MapInArrow") == 1


def test_settings_that_draw_nothing_are_refused(spark):
    df = spark.createDataFrame(random_points(9, maps=1, n=5), COLUMNS)
    for settings, methods in (({}, ("idw",)), ({"a": maps.Setting(1.0, 0)}, ("idw",)), (SETTINGS, ()), (SETTINGS, ("spline",))):
        with pytest.raises(ValueError):
            map_cells_by(df, settings, methods)
    assert map_cells_by(df.limit(0), SETTINGS).count() == 0


def test_map_stats_carry_the_parameters(spark):
    df = spark.createDataFrame(random_points(9, maps=2, n=30), COLUMNS)
    got = map_stats(df, 2.0, resolution=5.0).collect()
    assert {(r.map_id, r.method) for r in got} == {(m, n) for m in (0, 1) for n in ("idw", "knn_idw")}
    for r in got:
        assert (r.power, r.gradient_sharp) == (2.0, 2.5)
        assert r.dry + r.semi_arid + r.humid == r.total and r.other == 0


POINTS = "map_id int, point_id bigint, lon double, lat double, climate string, formation string, basin string, country string, time string"


@pytest.fixture(scope="module")
def places(spark):
    rows = [
        (0, 5, 1.0, 1.0, "H", "F2", "B", "X", "110.0"),
        (0, 2, 1.0, 1.0, None, "F1", "", None, "0"),
        (0, 9, 1.0, 1.0, "D", "F1", "B", "", None),
        (0, 7, 2.0, 1.0, "", None, None, "Y", "90"),
    ]
    return spark.createDataFrame(rows, POINTS)


def test_location_groups(places):
    many, one = locations.location_groups(places).orderBy("lon").collect()
    assert (many.n_points, many.colour) == (3, "gray")  # the first one has no class
    assert (many.basins, many.formations) == (["N/A", "B"], ["F1", "F2"])
    assert many.tooltip == "3 points: F1, F2"
    assert (one.n_points, one.tooltip) == (1, "N/A (N/A)")


def test_location_details(places):
    got = {r.point_id: r for r in locations.location_details(places).collect()}
    assert {p: r.idx for p, r in got.items()} == {2: 1, 5: 2, 9: 3, 7: 1}
    assert [got[p].climate for p in (2, 5, 9, 7)] == ["", "H", "D", "N/A"]
    assert [got[p].age for p in (2, 5, 9, 7)] == ["N/A", "110.0", "N/A", "90"]
    assert got[9].country == "N/A" and got[9].colour == "#eaf51d"


def test_numbers_on_a_crowded_spot(spark):
    """Sparse, unordered ids; most points on one spot, which goes through all ranges of the sort."""
    ids = [(i * 7_919_000_003) % 1_000_000_000_039 for i in range(4000)]
    rows = [(i % 7 // 6, p, 1.5, -2.5 if i % 10 else float(i), None, None, None, None, None) for i, p in enumerate(ids)]
    schema = "map_id int, point_id long, lon double, lat double, climate string, formation string, basin string, country string, time string"
    got = locations.location_details(spark.createDataFrame(rows, schema).repartition(5))
    places = {}
    for r in sorted(rows, key=lambda r: r[1]):
        places.setdefault((r[0], r[2], r[3]), []).append(r[1])
    want = {(*at, p): (n + 1, len(found)) for at, found in places.items() for n, p in enumerate(found)}
    assert {(r.map_id, r.lon, r.lat, r.point_id): (r.idx, r.n_points) for r in got.collect()} == want
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_metadata_of_a_known_number_is_not_written(spark, monkeypatch):
    points = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0), (2, 1, 5.0, 6.0, 1.0)], "map_id int, point_id long, lon double, lat double, value double")
    meta = grid.grid_meta(points, 0.5)
    counted = pixels.point_pixels(points, meta).collect()
    monkeypatch.setattr(pixels, "counted_side", None)
    assert sorted(pixels.point_pixels(points, meta, n_maps=2).collect()) == sorted(counted)


def test_rows_are_counted_by_the_write(spark):
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    for rows in (0, 3):
        before = jobs()
        side = session.counted_side(spark.range(100).where(f"id < {rows}").repartition(2), "few", limit=2)
        assert jobs() - before <= 2  # the shuffle and the write
        assert side.count() == rows
        assert ("broadcast" in side._jdf.queryExecution().analyzed().toString()) == (rows <= 2)


def test_basins(places):
    assert [r.basin for r in locations.basin_list(places).collect()] == ["B", "N/A"]
    groups = locations.location_groups(places)
    assert locations.filter_basins(groups, None).count() == 2
    assert locations.filter_basins(groups, []).count() == 0
    assert locations.filter_basins(groups, ["B"]).first().n_points == 3


def test_bounds(spark):
    def of(rows):
        return bounds.feature_bounds(spark.createDataFrame(rows, "map_id int, lon double, lat double"))

    points, coast = of([(1, 0.0, 5.0), (1, 2.0, 1.0)]), of([(1, -4.0, 3.0)])
    maps = spark.createDataFrame([(1,), (2,)], "map_id int")
    raster = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0)], "map_id int, " + ", ".join(f"{b} double" for b in bounds.BOUNDS))
    one, two = bounds.combined_bounds(maps, points, coast, raster).orderBy("map_id").collect()
    assert (one.min_lat, one.min_lon, one.max_lat, one.max_lon) == (0.0, -4.0, 9.0, 9.0)
    assert (one.center_lat, one.center_lon) == (4.5, 2.5)
    assert (one.view_min_lon, one.view_max_lat) == (0.0, 9.0)
    assert (two.min_lat, two.center_lat, two.center_lon) == (None, -20.0, -20.0)
    plain = bounds.combined_bounds(maps, points, coast).where("map_id = 1").first()
    assert (plain.view_min_lon, plain.view_max_lon) == (-4.0, 2.0)


def test_run_summary(spark):
    maps = spark.createDataFrame([("a",), ("b",)], "map_id string")
    one = spark.createDataFrame([("a",), ("a",)], "map_id string")
    two = spark.createDataFrame([("a",), ("b",)], "map_id string")
    a, b = run_summary(maps, one, two).orderBy("map_id").collect()
    assert (a.n_points, a.n_coast, a.status) == (2, 1, "processed")
    assert (b.n_points, b.n_coast, b.status) == (0, 1, "skipped")


def test_metadata_goes_to_points_and_cells_not_they_to_it(spark):
    """No exchange on the few map keys, whatever the sizes the planner assumes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points = spark.createDataFrame([(1, 1, 10.0, 5.0, 2.0), (1, 2, 12.0, 6.0, 3.0)], "map_id int, point_id long, lon double, lat double, value double")
        meta = grid_meta(points, 1.0)
        cells = spark.createDataFrame([(1, 0, 0, 1.0)], "map_id int, i int, j int, value double")
        for df in (pixel_address(points, meta), flip_rows(cells, meta), override_cells(cells, point_pixels(points, meta))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning(map_id" not in plan.split("BroadcastExchange")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_captured_cells_are_those_of_the_search(spark):
    rows = random_points(8, maps=2, n=300, copies=0.2)
    points = spark.createDataFrame(rows, COLUMNS)
    meta = grid.grid_meta(points, 0.9)
    index = build_site_index(points, 1)
    near = cell_neighbours(cell_groups(meta, index, 1), 1).where("d < 1.3")
    want = {(r.map_id, r.i, r.j): (r.point_id, r.value) for r in near.collect()}
    for maps in (None, 2):
        got = capture.captured_cells(points, meta, 1.3, maps).collect()
        assert {(r.map_id, r.i, r.j): (r.point_id, r.value) for r in got} == want and len(got) == len(want) > 300


def test_default_grid(spark):
    """A map at 0.1 degree: sampled cells against all points, and the captured ones."""
    rows = random_points(9, maps=1, n=60)
    points = spark.createDataFrame(rows, COLUMNS)
    cells = map_cells(points, 4.0, ("idw",))
    meta = grid_meta(points).first()
    assert cells.count() == meta.nx * meta.ny > 300_000
    some = cells.where("pmod(xxhash64(i, j), 6007) = 0").collect()
    assert len(some) > 40
    for c in some:
        near = nearest(rows, c.lon, c.lat, 12)
        assert c.value == pytest.approx(near[0][2] if near[0][0] < 0.15 else mean(near, 4.0), abs=1e-9)
