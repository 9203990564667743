"""`map_settings_stats` draws whole maps at 0.1 degree, and its SQL compares cells with the points near their block."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from check import differences
from evidence_surface.operators.grid import grid_meta
from sample_queries import oracles, views
from sample_queries.queries import SETTINGS

# of two maps: few points, and more than any setting counts; one place has several
FEW, MANY = 8, 3
SPOT = 61_200  # this much later comes the same place of the same map


def place(key):
    return (key * 7919) % 3600 / 10 - 180, (key * 104729) % 1200 / 10 - 60


def close(first, many, reach):
    x, y = place(first)
    near = (k for k in range(first, SPOT, 17) if k % 10 and max(abs(place(k)[0] - x), abs(place(k)[1] - y)) < reach)
    return [k for k, _ in zip(near, range(many))]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("close")
    keys = [*close(FEW, 4, 9), *close(MANY, 17, 9), MANY + SPOT, MANY + 2 * SPOT]
    kinds = ("AUTOMOBILE", "FURNITURE", "MACHINERY")
    rows = {
        "customer": ([(k, k % 2, kinds[k % 3]) for k in keys], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "nation": ([(0, "PERU", 0), (1, "CHINA", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "ALL")], "r_regionkey int, r_name string"),
    }
    con = duckdb.connect()
    for name, (some, schema) in rows.items():
        path = f"{folder}/{name}.parquet"
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    return str(folder), con


def test_settings_are_drawn_on_the_default_grid(spark, tables):
    folder, con = tables
    points = views.points(spark, folder)
    counted = {r.map_id: r["count"] for r in points.groupBy("map_id").count().collect()}
    assert counted == {65 + 5 * FEW: 4, 65 + 5 * MANY: 19}
    cells = {r.map_id: r.nx * r.ny for r in grid_meta(points).collect()}
    assert min(cells.values()) > 3_000
    got = entry.queries()["map_settings_stats"](spark, folder).toPandas()
    assert len(got) == 2 * len(SETTINGS) * 2
    assert all(r.total == cells[r.age_ma] for r in got.itertuples())
    assert differences(got, con.execute(entry.oracle_sql()["map_settings_stats"]).fetchdf()) == ""


def test_sql_by_blocks_equals_all_pairs(tables, resolution=0.7):
    _, con = tables
    want = [
        con.execute(
            f"""{oracles._map_parts(method, False, resolution, s.power, s.n_neighbors, s.k, s.point_radius)}
            SELECT {oracles.STATS_COLUMNS}, '{name}' AS setting, '{method}' AS method, CAST({s.power} AS DOUBLE) AS power,
            {s.n_neighbors} AS n_neighbors, {s.k} AS k, CAST({s.point_radius} AS DOUBLE) AS point_radius FROM st"""
        ).fetchdf()
        for name, s in SETTINGS.items()
        for method in ("idw", "knn_idw")
    ]
    got = con.execute(oracles._map_settings(resolution)).fetchdf()
    assert len(got) == 16 and differences(got, pd.concat(want, ignore_index=True)) == ""
