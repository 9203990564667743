import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_surface.llm.common import materialise
from evidence_surface.llm.metric_pages import NO_SCORE, Best, centre, cut, distances, lifted, products, search
from evidence_surface.llm.metric_tree import build, top_k, whole_numbers
from evidence_surface.llm.queries import op13_exact_top_k

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, v int, row string, rank int"


def plain(rows, asks, k):
    """rows: (id, list of floats or None); scores of Python's whole numbers."""
    ok = []
    for i, (key, x) in enumerate(rows):
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            ok.append((i, key, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for i, key, q in ok:
        if key is None or not asks(key):
            continue
        found = sorted((-sum(a * b for a, b in zip(q, x)), other is None, other or 0) for j, other, x in ok if j != i)
        out += [(key, r + 1, None if null else other, -s) for r, (s, null, other) in enumerate(found[:k])]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 7, "a", 1) for i, x in rows], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clustered(n, dims=8, seed=2, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, n)] + rng.normal(scale=spread, size=(n, dims))
    x[: n // 3] = x[0]  # a third of all are equal
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("part, fan, group", [(4096, 256, 4096), (20, 4, 7), (1, 2, 3)])
def test_against_plain(spark, part, fan, group):
    rows = clustered(240 if part > 1 else 60)
    df = top_k(frame(spark, rows), F.col("vec_id") % 4 == 0, k=5, part=part, fan=fan, group=group)
    assert got(df) == plain(rows, lambda i: i % 4 == 0, 5)


def test_lengths_far_apart(spark):
    """The best products are not the nearest vectors."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * 10.0 ** rng.integers(-3, 4)]) for i in range(150)]
    df = top_k(frame(spark, rows), F.col("vec_id") % 3 == 0, k=4, part=16, fan=3)
    assert got(df) == plain(rows, lambda i: i % 3 == 0, 4)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, []), (6, [0.0, 0.0])]
    rows += [(0, [1.0, 0.5]), (0, [-1.0, 2.0, 3.0]), (None, [1.0, 0.5]), (None, [2.0]), (7, [-0.001, 0.001]), (8, [1.0, 0.5])]
    df = top_k(frame(spark, rows), F.col("vec_id") % 2 == 0, k=50, part=3, fan=2)
    assert got(df) == plain(rows, lambda i: i % 2 == 0, 50)


def test_few_rows_and_empty_tables(spark):
    one = frame(spark, [(0, [1.0])])
    assert top_k(one, F.col("vec_id") == 0).count() == 0
    assert top_k(one, F.col("vec_id") == 1).count() == 0
    assert top_k(one.limit(0), F.col("vec_id") == 0).columns == ["query_id", "rank", "vec_id", "score"]
    assert top_k(frame(spark, [(0, None)]), F.col("vec_id") == 0).count() == 0
    assert got(top_k(frame(spark, [(0, [1.0]), (1, [2.0])]), F.lit(True))) == [(0, 1, 1, 131072), (1, 1, 0, 131072)]


def test_query_against_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(op13_exact_top_k(spark, DATA)) == plain(rows, lambda i: i % 50 == 0, 5)


def test_tree_covers_its_objects(spark):
    """Each stored distance and radius holds, on every level, and every object is in one page."""
    rows = clustered(500)
    objects = frame(spark, rows).select(F.col("vec_id").alias("row"), F.col("vec_id").alias("id"), whole_numbers(F.col("embedding")).alias("v"))
    objects = materialise(objects, "objects")
    v = {r["row"]: r["v"] for r in objects.collect()}
    m2 = float(max(sum(c * c for c in x) for x in v.values()))
    tree = build(objects, 500, m2, part=40, fan=5)
    assert len(tree.levels) > 1
    far = lambda a, b: distances(*(lifted(np.array([x]), m2) for x in (a, b)))[0, 0]
    parts = tree.parts.collect()
    heads = {r["node"]: r for r in parts if r["page"] == -1}
    pages = {(r["node"], r["page"]): r for r in parts if r["row"] is None and r["page"] >= 0}
    assert sorted(r["row"] for r in parts if r["row"] is not None) == list(range(500))
    below = {}
    for r in parts:
        if r["row"] is not None:
            page, head = pages[r["node"], r["page"]], heads[r["node"]]
            assert abs(far(r["v"], page["v"]) - r["gap"]) < 1e-3 and r["gap"] <= page["radius"] + 1e-6
            assert page["gap"] + page["radius"] <= head["radius"] + 1e-6
            below.setdefault(r["node"], []).append(r["v"])
    for level in tree.levels[::-1]:
        above = {}
        for r in level.collect():
            assert all(far(x, r["v"]) <= r["radius"] + 1e-2 for x in below[r["child"]])
            above.setdefault(r["node"], []).extend(below[r["child"]])
        below = above
    assert list(below) == [0] and len(below[0]) == 500


def test_bounds_avoid_computations():
    """On clustered vectors most scores are never computed, and the result is that of all scores."""
    x = np.array([r[1] for r in clustered(2000, spread=0.02)])
    v = np.floor(256 * x).astype(np.int64)[np.random.default_rng(1).permutation(2000)]
    m2 = float((v * v).sum(axis=1).max())
    pages = cut(lifted(v, m2), 64)
    at = np.concatenate(pages)
    made = [centre(lifted(v[p], m2), np.zeros(len(p))) for p in pages]
    middle = [int(p[m[0]]) for p, m in zip(pages, made)]
    top, between, _ = centre(lifted(v[middle], m2), np.array([m[2] for m in made]))
    part = {
        "vectors": v[at], "rows": at, "ids": at, "page": np.repeat(np.arange(len(pages)), [len(p) for p in pages]),
        "gap": np.concatenate([m[1] for m in made]), "centres": lifted(v[middle], m2),
        "radius": np.array([m[2] for m in made]), "centre_gap": between,
    }
    asked = np.arange(0, 2000, 20)
    flat = np.column_stack([v[asked].astype(float), np.zeros(len(asked))])
    query = {
        "vectors": v[asked], "rows": asked, "gap": distances(flat, lifted(v[[middle[top]]], m2))[:, 0],
        "least": np.full(len(asked), NO_SCORE),
    }
    best, computed = search(part, query, 5, m2)
    scores = v[asked] @ v.T
    for i, row in enumerate(asked):
        order = [j for j in np.lexsort((np.arange(2000), -scores[i])) if j != row][:5]
        assert best.row[i].tolist() == order
    assert computed < 0.6 * len(asked) * 2000


def test_products_beyond_floats():
    q, x = np.array([[3_000_000_001, 1]]), np.array([[2_000_000_001, 7]])
    assert products(q, x)[0, 0] == 3_000_000_001 * 2_000_000_001 + 7


def test_best_keeps_the_smaller_id():
    best = Best(1, 2)
    best.add(np.array([0]), np.array([[5, 5, 4]]), np.array([9, 8, 1]), np.array([0, 1, 2]))
    best.add(np.array([0]), np.array([[5, NO_SCORE]]), np.array([3, 2]), np.array([3, 4]))
    assert best.id.tolist() == [[3, 8]] and best.row.tolist() == [[3, 1]]
