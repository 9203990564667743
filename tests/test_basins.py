"""Basins by bitmaps against the names themselves."""

import random

import pytest
from pyspark.sql import functions as F

from evidence_surface.operators import basins, locations

SCHEMA = "map_id int, point_id long, lon double, lat double, climate string, formation string, basin string"


def some_points(seed, n=900, names=200):
    """Few locations and many names: words beyond the first, the sign bit, nulls and empty names."""
    rng = random.Random(seed)
    pool = [f"b{i:03d}" for i in range(names)] + [None, "", "N/A"]
    return [
        (rng.randrange(3), i, float(rng.randrange(12)), float(rng.randrange(6)), "H", "f", rng.choice(pool)) for i in range(n)
    ]


@pytest.mark.parametrize("broadcast_rows", [10_000, 0])
def test_selections_equal_those_by_name(spark, broadcast_rows):
    points = spark.createDataFrame(some_points(3), SCHEMA).repartition(5)
    index = basins.basin_index(points, broadcast_rows)
    numbers = {r.basin: r.number for r in index.names.collect()}
    assert sorted(numbers.values()) == list(range(len(numbers))) and sorted(numbers, key=numbers.get) == sorted(numbers)
    assert len(numbers) == 201
    by_name = {
        (r.map_id, r.lon, r.lat): (r.n_points, sorted(r.basins)) for r in locations.location_groups(points).collect()
    }
    rng = random.Random(4)
    order = sorted(numbers)
    chosen = [rng.sample(order, rng.choice([1, 2, 5, 40])) for _ in range(4)]
    chosen += [[order[63]], ["N/A"], [order[5], order[5], "no such name"], ["no such name"], [], None, order]
    for names in chosen:
        found = basins.with_any(index, names)
        want = {at: row for at, row in by_name.items() if names is None or set(names) & set(row[1])}
        assert {(r.map_id, r.lon, r.lat): r.n_points for r in found.collect()} == {at: row[0] for at, row in want.items()}
    few = basins.with_any(index, chosen[1])
    want = {at: row for at, row in by_name.items() if set(chosen[1]) & set(row[1])}
    got = basins.named_locations(index, few).collect()
    assert {(r.map_id, r.lon, r.lat): (r.n_points, r.basins) for r in got} == want and len(got) == len(want)
    beside = sorted(tuple(r) for r in basins.basins_of_maps(index, few).collect())
    assert beside == sorted({(at[0], name) for at, (_, names) in want.items() for name in names})
    everywhere = sorted(tuple(r) for r in basins.basins_of_maps(index, index.locations).collect())
    assert everywhere == [tuple(r) for r in locations.basin_list(points).collect()]


def test_a_row_holds_the_words_of_its_own_names(spark):
    rows = [(0, i, 1.0, 1.0, "H", "f", f"b{i:04d}") for i in range(300)] * 2 + [(0, 900, 2.0, 2.0, "H", "f", "b0299")]
    index = basins.basin_index(spark.createDataFrame(rows, SCHEMA))
    words = {r.lon: (r.n_points, r.words) for r in index.locations.collect()}
    assert (words[1.0][0], len(words[1.0][1])) == (600, 5)  # no name twice
    assert words[2.0] == (1, [(4, 1 << 43)])


def test_a_selection_shuffles_nothing(spark):
    index = basins.basin_index(spark.createDataFrame(some_points(5, 50), SCHEMA))
    plan = basins.with_any(index, ["b001", "b150"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan


def test_no_points(spark):
    index = basins.basin_index(spark.createDataFrame([], SCHEMA))
    assert index.names.count() == 0 and basins.with_any(index, ["a"]).count() == 0 and basins.with_any(index, None).count() == 0
    assert basins.named_locations(index, index.locations).count() == 0
    assert basins.basins_of_maps(index, index.locations.where(F.lit(True))).count() == 0


def test_copies_of_names_stay_off_the_driver(spark):
    """Beyond the limit the dictionary's copies are joined by a shuffle, whatever Spark estimates."""
    rows = [(1, float(n % 7), 0.0, f"B{n % 11}") for n in range(60)]
    points = spark.createDataFrame(rows, "map_id int, lon double, lat double, basin string")
    plans = []
    kept = basins.materialise

    def noted(df, name):
        if name == "basin_bitmaps":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(basins, "materialise", noted)
        basins.basin_index(points, broadcast_rows=0)
    assert "BroadcastHashJoin" not in plans[0]
