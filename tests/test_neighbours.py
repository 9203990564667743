import collections

import pytest
from brute import COLUMNS, mean, nearest, random_points
from pyspark.sql import functions as F

from evidence_surface.operators import neighbours
from evidence_surface.operators.grid import grid_cells, grid_meta
from evidence_surface.operators.idw import idw_surface, knn_smooth, point_neighbours
from evidence_surface.operators.neighbours import cell_groups, cell_neighbours
from evidence_surface.operators.sites import build_site_index

# the usual tree, and one deep enough on small data to be walked and split
SHAPES = [dict(page_bits=5, fanout_bits=5), dict(page_bits=2, fanout_bits=2)]


def by_map(rows):
    maps = collections.defaultdict(list)
    for r in rows:
        maps[r[0]].append(r)
    return maps


def lists(rows, *key):
    found = collections.defaultdict(list)
    for r in rows:
        found[tuple(r[k] for k in key)].append((r.rn, r.neighbour))
    return {k: [p for _, p in sorted(v)] for k, v in found.items()}


@pytest.mark.parametrize("clustered", [False, True])
@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_sites_match_brute_force(spark, shape, clustered, broadcast_rows):
    rows = random_points(1, clustered=clustered)
    df = spark.createDataFrame(rows, COLUMNS)
    index = build_site_index(df, 9, **shape)
    assert len(index.levels) > 1 or shape["page_bits"] == 5
    got = point_neighbours(df, index, 8, broadcast_rows=broadcast_rows)
    found = lists(got.withColumnRenamed("neighbour_id", "neighbour").collect(), "map_id", "point_id")
    maps = by_map(rows)
    assert len(found) == len(rows)
    for r in rows:
        want = nearest(maps[r[0]], r[2], r[3], 8, but=r[1])
        assert found[r[0], r[1]] == [w[1] for w in want]


@pytest.mark.parametrize("clustered", [False, True])
@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_cells_match_brute_force(spark, shape, clustered, broadcast_rows):
    rows = random_points(2, maps=2, clustered=clustered)
    df = spark.createDataFrame(rows, COLUMNS)
    index = build_site_index(df, 12, **shape)
    meta = grid_meta(df, 3.7)
    groups = cell_groups(meta, index, 12, broadcast_rows=broadcast_rows)
    got = cell_neighbours(groups, 12).withColumnRenamed("point_id", "neighbour").collect()
    found = lists(got, "map_id", "i", "j")
    cells = grid_cells(meta).collect()
    maps = by_map(rows)
    assert len(found) == len(cells)
    for c in cells:
        want = nearest(maps[c.map_id], c.lon, c.lat, 12)
        assert found[c.map_id, c.i, c.j] == [w[1] for w in want]


def test_dense_points_split_groups(spark, monkeypatch):
    """Far more points than cells: blocks are split down to single cells, and
    pages that see too many boxes into single points."""
    monkeypatch.setattr(neighbours, "SPLIT_ABOVE", 16)
    rows = random_points(5, maps=1, n=3000, clustered=True, copies=0)
    df = spark.createDataFrame(rows, COLUMNS)
    index = build_site_index(df, 12, page_bits=3, fanout_bits=3)
    meta = grid_meta(df, 6.0)
    groups = cell_groups(meta, index, 12)
    assert groups.where("side = 1").count() > 0
    assert groups.selectExpr("max(size(cands)) AS n").first().n < 1000
    got = cell_neighbours(groups, 12).withColumnRenamed("point_id", "neighbour").collect()
    found = lists(got, "map_id", "i", "j")
    for c in grid_cells(meta).collect():
        want = nearest(rows, c.lon, c.lat, 12)
        assert found[c.map_id, c.i, c.j] == [w[1] for w in want]
    assert neighbours.site_groups(index, 8).where("member >= 0").count() > 0
    near = point_neighbours(df, index, 8).withColumnRenamed("neighbour_id", "neighbour").collect()
    found = lists(near, "map_id", "point_id")
    assert len(found) == len(rows)
    for r in rows[::7]:
        want = nearest(rows, r[2], r[3], 8, but=r[1])
        assert found[r[0], r[1]] == [w[1] for w in want]


def test_crowded_location(spark):
    """Most of a map on one spot: all of it is smoothed, the index stays small."""
    rows = [(0, i, 5.0, 5.0, float(1 + i % 3)) for i in range(300)]
    rows += [(0, 300 + i, float(i), 2.0 * i, 3.0) for i in range(20)]
    df = spark.createDataFrame(rows, COLUMNS)
    index = build_site_index(df, 9)
    assert index.n_sites == 29 and index.full_locations == 1
    for limit in (10_000, 0):
        got = knn_smooth(df, 8, 4.0, broadcast_rows=limit).collect()
        assert len({r.point_id for r in got}) == len(got) == 320
        for r in got:
            want = mean(nearest(rows, r.lon, r.lat, 8, but=r.point_id), 4.0)
            assert r.smoothed == pytest.approx(want, abs=1e-9)
        got = point_neighbours(df, index, 8, broadcast_rows=limit)
        found = lists(got.withColumnRenamed("neighbour_id", "neighbour").collect(), "point_id")
        for r in rows:
            want = nearest(rows, r[2], r[3], 8, but=r[1])
            assert found[(r[1],)] == [w[1] for w in want]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_fewer_points_than_neighbours(spark, n):
    rows = [(7, i, float(i), float(i * i), float(1 + i % 3)) for i in range(n)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r.point_id: r.smoothed for r in knn_smooth(df, 8, 2.0).collect()}
    assert len(got) == n
    for r in rows:
        others = nearest(rows, r[2], r[3], 8, but=r[1])
        assert got[r[1]] == pytest.approx(mean(others, 2.0) if others else r[4])
    for cell in idw_surface(df, 1.0, 2.0).collect():
        near = nearest(rows, cell.lon, cell.lat, 12)
        want = near[0][2] if near[0][0] < 0.15 else mean(near, 2.0)
        assert cell.value == pytest.approx(want)


def test_no_points(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert knn_smooth(empty).count() == 0
    assert idw_surface(empty, 1.0).count() == 0


def test_k_zero_keeps_values(spark):
    df = spark.createDataFrame(random_points(3, maps=1, n=10), COLUMNS)
    assert knn_smooth(df, k=0).where("smoothed <> value").count() == 0


def test_any_power_tends_to_the_nearest(spark):
    """At a very large power a cell has the value of its nearest point."""
    rows = random_points(3, maps=1, n=10)
    df = spark.createDataFrame(rows, COLUMNS)
    for power in (40.0, 3000.0):
        cells = idw_surface(df, 3.0, power=power, n_neighbors=5, preserve_points=False).collect()
        for c in cells:
            d = sorted((((p[2] - c.lon) ** 2 + (p[3] - c.lat) ** 2) ** 0.5, p[4]) for p in rows)
            if d[1][0] > 1.2 * d[0][0] and power > 1000:
                assert abs(c.value - d[0][1]) < 1e-9
            assert 1 <= c.value <= 3


def test_an_index_of_too_few_points_per_location_is_refused(spark):
    df = spark.createDataFrame(random_points(3, maps=1, n=10), COLUMNS)
    with pytest.raises(ValueError):
        idw_surface(df, 1.0, n_neighbors=20, index=build_site_index(df, 9))


def test_surface_properties(spark):
    rows = random_points(4, maps=2, n=60)
    df = spark.createDataFrame(rows, COLUMNS)
    value = F.round("value", 9)
    one = idw_surface(df, 2.5, 4.0).withColumn("value", value)
    assert one.where("value < 1 or value > 3").count() == 0
    other = idw_surface(df.repartition(5, "lat"), 2.5, 4.0).withColumn("value", value)
    assert one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0
    same = idw_surface(df.withColumn("value", F.lit(2.0)), 2.5, 4.0)
    assert same.where("abs(value - 2) > 1e-12").count() == 0


def test_radius_is_strict(spark):
    """A cell exactly at the radius is interpolated, one inside takes the point's value."""
    rows = [(0, 0, 0.0, 0.0, 1.0), (0, 1, 2.0, 0.0, 3.0)]
    df = spark.createDataFrame(rows, COLUMNS)
    at = {(c.lon, c.lat): c.value for c in idw_surface(df, 0.5, 2.0, point_radius=0.5).collect()}
    assert at[0.0, 0.0] == 1.0
    assert at[0.5, 0.0] == pytest.approx((1 / 0.25 + 3 / 2.25) / (1 / 0.25 + 1 / 2.25))
    wider = {(c.lon, c.lat): c.value for c in idw_surface(df, 0.5, 2.0, point_radius=0.6).collect()}
    assert wider[0.5, 0.0] == 1.0


def test_nearest_ties_take_the_lower_id(spark):
    rows = [(0, 5, 1.0, 0.0, 3.0), (0, 2, -1.0, 0.0, 1.0), (0, 9, 0.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, COLUMNS)
    groups = cell_groups(grid_meta(df, 1.0), build_site_index(df, 12), 12)
    cells = grid_cells(grid_meta(df, 1.0)).where("lon = 0 and lat = 0").select("i", "j")
    found = cell_neighbours(groups, 12).join(cells, ["i", "j"]).orderBy("rn").collect()
    assert [n.point_id for n in found] == [2, 5, 9]
    # the k-th distance is tied: the value set takes the lower id too
    one = idw_surface(df, 1.0, 2.0, n_neighbors=1).join(cells, ["i", "j"]).first()
    assert one.value == 1.0


def executed_plan(df):
    """The plan that ran, with what Spark changed on the way."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_sides_beyond_the_limit_stay_off_the_driver(spark):
    """Spark takes a side's size from compressed files and does not count copies made by
    explode: left to it, the copies of all sites are built in the driver."""
    rows = random_points(3, maps=2, clustered=True)
    df = spark.createDataFrame(rows, COLUMNS)
    index = build_site_index(df, 4, page_bits=2, fanout_bits=2)
    assert len(index.levels) > 1 and index.full_locations
    cells = cell_groups(grid_meta(df, 20.0), index, 4, broadcast_rows=0)
    assert "BroadcastHashJoin" not in executed_plan(cells)
    near = point_neighbours(df, index, 3, broadcast_rows=0)
    assert "BroadcastHashJoin" not in executed_plan(near)
    cells = cell_groups(grid_meta(df, 20.0), index, 4)
    assert "BroadcastHashJoin" in executed_plan(cells)
