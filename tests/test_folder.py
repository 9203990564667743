"""Runs over a folder again after some points have changed."""

import glob
import json
import os
import random

from evidence_surface.plans.folder import run_folder, sweep_folder
from evidence_surface.plans.maps import Setting

CLASSES = ["H", "S", "D"]


def write(folder, name, points):
    features = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [x, y]}, "properties": {"Climate_Cl": c, "Basin_Sub_": "b"}}
        for x, y, c in points
    ]
    (folder / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    line = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {}}
    (folder / f"{name}_costa.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [line]}))


def some(seed, n=25):
    rng = random.Random(seed)
    return [(round(rng.uniform(-20, 20), 2), round(rng.uniform(-10, 10), 2), rng.choice(CLASSES)) for _ in range(n)]


def files(out, kind):
    """The files of each map."""
    found = {}
    for path in glob.glob(f"{out}/{kind}/**/*.parquet", recursive=True):
        found.setdefault(path.split("map_id=")[1].split("/")[0], set()).add(os.path.basename(path))
    return found


def contents(spark, out):
    cells = spark.read.parquet(f"{out}/cells").selectExpr("method", "map_id", "i", "j", "lon", "lat", "value")
    stats = spark.read.parquet(f"{out}/stats").drop("path")  # names the folder
    return [sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in (cells, stats)]


def test_only_changed_maps_are_drawn(spark, tmp_path):
    folder, out, plain = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "plain")
    folder.mkdir()
    maps = {f"{10 * i}_ma": some(i) for i in range(1, 8)}
    for name, points in maps.items():
        write(folder, name, points)
    options = dict(power=3.0, gradient_sharp=4.0, resolution=4.0, n_neighbors=5, k=3)
    first = run_folder(spark, str(folder), out, changed_only=True, **options)
    assert sorted(tuple(r) for r in first.drawn.collect()) == [(m, True) for m in sorted(maps)]
    before = files(out, "cells"), files(out, "stats")
    x, y, c = maps["20_ma"][3]
    changed = {
        "10_ma": [*maps["10_ma"], (1.5, 2.5, "H")],
        "20_ma": [*maps["20_ma"][:3], (x + 0.5, y, c), *maps["20_ma"][4:]],
        "30_ma": maps["30_ma"][1:],
        "40_ma": [(x, y, {"H": "D", "S": "H", "D": "S"}[c] if i == 5 else c) for i, (x, y, c) in enumerate(maps["40_ma"])],
        "50_ma": maps["50_ma"][::-1],  # ids are places in the file, and ids break ties
    }
    for name, points in changed.items():
        write(folder, name, points)
    again = run_folder(spark, str(folder), out, changed_only=True, **options)
    assert sorted(tuple(r) for r in again.drawn.collect()) == [(m, True) for m in sorted(changed)]
    run_folder(spark, str(folder), plain, **options)
    assert contents(spark, out) == contents(spark, plain)
    for old, new in zip(before, (files(out, "cells"), files(out, "stats"))):
        assert {m for m in new if new[m] != old[m]} == set(changed)
    assert again.catalog.count() == 7 and again.stats.count() == 14


def test_parameters_and_unfinished_runs(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for i in (1, 2):
        write(folder, f"{i}_ma", some(i))
    options = dict(resolution=5.0, n_neighbors=4, k=2)

    def drawn(sharp, power=2.0, **more):
        run = run_folder(spark, str(folder), out, power, sharp, **options, **more)
        return sorted(tuple(r) for r in run.drawn.collect())

    assert drawn(2.0) == [("1_ma", True), ("2_ma", True)]
    assert drawn(2.0, changed_only=True) == []
    cells = files(out, "cells")
    assert drawn(3.0, changed_only=True) == [("1_ma", False), ("2_ma", False)]
    assert files(out, "cells") == cells
    assert drawn(3.0, power=5.0, changed_only=True) == [("1_ma", True), ("2_ma", True)]
    assert files(out, "cells") != cells
    from evidence_surface.plans import changes

    state = changes.read_state(spark, f"{out}/state").withColumnRenamed("map", "map_id")
    state = spark.createDataFrame(state.where("map_id = '1_ma'").collect(), state.schema)
    changes.write_state(state, f"{out}/state", None)  # as if the run had ended before the shares
    assert drawn(3.0, power=5.0, changed_only=True) == [("1_ma", True)]
    assert drawn(3.0, power=5.0) == [("1_ma", True), ("2_ma", True)]  # all, unless asked for
    write(folder, "1_ma", [])
    write(folder, "3_ma", some(3))
    run = run_folder(spark, str(folder), out, 5.0, 3.0, changed_only=True, **options)
    assert [tuple(r) for r in run.drawn.collect()] == [("3_ma", True)]
    assert {r["map_id"]: r["status"] for r in run.summary.collect()} == {"1_ma": "skipped", "2_ma": "processed", "3_ma": "processed"}


def test_a_sweep_equals_runs_one_after_the_other(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for i in (1, 2):
        write(folder, f"{i}_ma", some(i))
    settings = {"01": Setting(3.0, 5, 3), "wide": Setting(1.0, 4, 2, 2.5), "3": Setting(3.0, 1, 3)}
    got = {(r.setting, r.map_id, r.method): r for r in sweep_folder(spark, str(folder), out, settings, 4.0, resolution=4.0).collect()}
    assert len(got) == 12
    for name, s in settings.items():
        one = run_folder(
            spark, str(folder), f"{out}/{name}", s.power, 4.0, resolution=4.0, n_neighbors=s.n_neighbors, k=s.k, point_radius=s.point_radius
        )
        rows = one.stats.collect()
        assert len(rows) == 4
        for r in rows:
            same = got[name, r.map_id, r.method]
            assert {c: same[c] for c in r.asDict()} == r.asDict()
            assert (same.n_neighbors, same.k, same.point_radius) == (s.n_neighbors, s.k, s.point_radius)
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{out}/cells/**/*.parquet", recursive=True)}
    again = sweep_folder(spark, str(folder), out, {"wide": Setting(2.0, 4, 2)}, 4.0, resolution=4.0).collect()
    assert sorted({(r.setting, r.power) for r in again}) == [("01", 3.0), ("3", 3.0), ("wide", 2.0)] and len(again) == 12
    after = glob.glob(f"{out}/cells/**/*.parquet", recursive=True)
    assert {p for p in before if "setting=wide" not in p} == {p for p in after if "setting=wide" not in p}
