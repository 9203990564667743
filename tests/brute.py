"""Plain numpy brute force on small fixtures."""

import numpy as np

COLUMNS = "map_id int, point_id bigint, lon double, lat double, value double"


def random_points(seed, maps=3, n=120, clustered=False, copies=0.1):
    """Points of several maps, some on the coordinates of others."""
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(maps):
        if clustered:
            centre = rng.uniform(-20, 20, (3, 2))
            xy = np.concatenate([
                centre[rng.integers(0, 3, n // 2)] + rng.normal(0, 0.01, (n // 2, 2)),
                rng.uniform(-40, 40, (n - n // 2, 2)),
            ])
        else:
            xy = np.round(rng.uniform(-30, 30, (n, 2)), 1)
        for i in range(n):
            if i and rng.random() < copies:
                xy[i] = xy[rng.integers(0, i)]
        values = rng.choice([1.0, 2.0, 3.0], n)
        rows += [(m, int(i * 3 + m), float(x), float(y), float(v)) for i, ((x, y), v) in enumerate(zip(xy, values))]
    return rows


def nearest(rows, lon, lat, k, but=None):
    """[(d, point_id, value)] of one map's rows, by (d, point_id)."""
    ranked = sorted(
        (float(np.sqrt((r[2] - lon) ** 2 + (r[3] - lat) ** 2)), r[1], r[4])
        for r in rows
        if r[1] != but
    )
    return ranked[:k]


def mean(near, power):
    d = np.array([max(n[0], 0.0) or 1e-10 for n in near])
    w = 1.0 / d**power
    return float(np.sum(w * np.array([n[2] for n in near])) / np.sum(w))
