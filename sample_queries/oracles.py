"""The same results in plain SQL, by brute force over all pairs of a map."""

from __future__ import annotations

from .queries import (
    CATALOG_FOLDER,
    CHOSEN_BASINS,
    COARSE,
    CROP_I,
    CROP_J,
    FINE,
    K,
    LINES_ONLY_AGE,
    NEIGHBOURS,
    NODATA_FROM,
    POWER,
    RADIUS,
    SETTINGS,
    SHARP,
    STORED_AGE,
)
from .views import COAST, FILES, POINTS

# --- building blocks: common table expressions -----------------------------

COLOUR = "CASE climate WHEN 'H' THEN '#0798db' WHEN 'S' THEN '#0a7a18' WHEN 'D' THEN '#eaf51d' ELSE 'gray' END"


def _na(c: str, default: str = "N/A") -> str:
    return f"COALESCE(NULLIF({c}, ''), '{default}')"


def _ctes(*parts: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in parts)


PTS = (
    "pts",
    f"""SELECT *, CASE climate WHEN 'H' THEN 3e0 WHEN 'S' THEN 2e0 WHEN 'D' THEN 1e0
        ELSE 2e0 END AS value FROM ({POINTS}) q""",
)


def _meta(res: float) -> list[tuple[str, str]]:
    return [
        (
            "ext",
            """SELECT age_ma, MIN(lon) - 1 AS min_lon, MAX(lon) + 1 AS max_lon,
               MIN(lat) - 1 AS min_lat, MAX(lat) + 1 AS max_lat FROM pts GROUP BY age_ma""",
        ),
        (
            "shape",
            f"""SELECT *, CAST(CEIL((max_lon + {res}e0 - min_lon) / {res}e0) AS INT) AS nx,
                CAST(CEIL((max_lat + {res}e0 - min_lat) / {res}e0) AS INT) AS ny FROM ext""",
        ),
        (
            "meta",
            "SELECT *, (max_lon - min_lon) / nx AS pixel_x, (max_lat - min_lat) / ny AS pixel_y FROM shape",
        ),
    ]


def _cells(res: float) -> list[tuple[str, str]]:
    return [
        PTS,
        *_meta(res),
        ("rws", "SELECT age_ma, min_lon, min_lat, nx, CAST(unnest(range(ny)) AS INT) AS i FROM meta"),
        ("rc", "SELECT *, CAST(unnest(range(nx)) AS INT) AS j FROM rws"),
        (
            "cells",
            f"""SELECT age_ma, i, j, min_lon + j * {res}e0 AS lon, min_lat + i * {res}e0 AS lat
                FROM rc""",
        ),
    ]


TENTH = 0.1


def _around(name: str, axis: str, at: str, n: str, source: str) -> tuple[str, str]:
    """Rows or columns of the fine grid within the capture radius and one more."""
    low = f"CAST(floor(({at} - {RADIUS}e0 - min_{at}) / {TENTH}e0) AS BIGINT) - 1"
    high = f"CAST(ceil(({at} + {RADIUS}e0 - min_{at}) / {TENTH}e0) AS BIGINT) + 2"
    return name, f"SELECT *, CAST(unnest(range(greatest(0, {low}), least({n}, {high}))) AS INT) AS {axis} FROM {source}"


def _near(res: float, n: int = NEIGHBOURS, pts: str = "pts") -> list[tuple[str, str]]:
    return [
        (
            "pairs",
            f"""SELECT c.age_ma, c.i, c.j, c.lon, c.lat, p.point_id, p.value,
                sqrt((c.lon - p.lon) * (c.lon - p.lon) + (c.lat - p.lat) * (c.lat - p.lat)) AS d
                FROM cells c JOIN {pts} p ON c.age_ma = p.age_ma""",
        ),
        (
            "near",
            f"""SELECT *, CAST(row_number() OVER (PARTITION BY age_ma, i, j ORDER BY d, point_id)
                AS INT) AS rn FROM pairs QUALIFY rn <= {n}""",
        ),
    ]


def _weight(d: str, power: float = POWER) -> str:
    return f"1e0 / pow(CASE WHEN {d} = 0 THEN 1e-10 ELSE {d} END, {power}e0)"


def _surf(power: float = POWER, radius: float = RADIUS) -> tuple[str, str]:
    return (
        "surf",
        f"""SELECT age_ma, i, j, MIN(lon) AS lon, MIN(lat) AS lat,
            CASE WHEN MIN(d) < {radius}e0 THEN MIN(CASE WHEN rn = 1 THEN value END)
                 ELSE SUM({_weight('d', power)} * value) / SUM({_weight('d', power)}) END AS value
            FROM near GROUP BY age_ma, i, j""",
    )


def _surface(res: float) -> list[tuple[str, str]]:
    return [*_cells(res), *_near(res), _surf()]


def _smooth(power: float = POWER, k: int = K) -> list[tuple[str, str]]:
    return [
        (
            "knn",
            f"""SELECT q.age_ma, q.point_id, p.point_id AS neighbour_id, p.value,
                sqrt((q.lon - p.lon) * (q.lon - p.lon) + (q.lat - p.lat) * (q.lat - p.lat)) AS d,
                CAST(row_number() OVER (PARTITION BY q.age_ma, q.point_id ORDER BY
                  sqrt((q.lon - p.lon) * (q.lon - p.lon) + (q.lat - p.lat) * (q.lat - p.lat)),
                  p.point_id) AS INT) AS rn
                FROM pts q JOIN pts p ON q.age_ma = p.age_ma AND q.point_id <> p.point_id
                QUALIFY rn <= {k}""",
        ),
        (
            "means",
            f"""SELECT age_ma, point_id, SUM({_weight('d', power)} * value) / SUM({_weight('d', power)}) AS mean
                FROM knn GROUP BY age_ma, point_id""",
        ),
        (
            "smooth",
            """SELECT p.age_ma, p.point_id, p.lon, p.lat, p.value AS class_value,
               COALESCE(m.mean, p.value) AS value
               FROM pts p LEFT JOIN means m ON p.age_ma = m.age_ma AND p.point_id = m.point_id""",
        ),
    ]


def _pixels(pts: str = "pts", mirror: bool = False, meta: str = "meta") -> list[tuple[str, str]]:
    down = "max_lat - lat" if mirror else "lat - min_lat"
    return [
        (
            "addr",
            f"""SELECT p.age_ma, p.value, m.nx, m.ny,
                CAST(trunc((lon - min_lon) / pixel_x) AS INT) AS c,
                CAST(trunc(({down}) / pixel_y) AS INT) AS r
                FROM {pts} p JOIN {meta} m ON p.age_ma = m.age_ma
                WHERE lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat""",
        ),
        (
            "spread",
            """SELECT age_ma, r + dr AS i, c + dc AS j, nx, ny, value
               FROM addr, (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc)
               WHERE r < ny AND c < nx""",
        ),
        (
            "pix",
            """SELECT age_ma, CAST(i AS INT) AS i, CAST(j AS INT) AS j, MAX(value) AS value
               FROM spread WHERE i >= 0 AND i < ny AND j >= 0 AND j < nx GROUP BY age_ma, i, j""",
        ),
    ]


def _overridden(cells: str = "surf") -> tuple[str, str]:
    return (
        "final",
        f"""SELECT s.age_ma, s.i, s.j, COALESCE(p.value, s.value) AS value FROM {cells} s
            LEFT JOIN pix p ON s.age_ma = p.age_ma AND s.i = p.i AND s.j = p.j""",
    )


def _coloured(cells: str, keep: str = "age_ma, i, j, value") -> list[tuple[str, str]]:
    def channel(dry: int, mid: int, humid: int) -> str:
        return f"""COALESCE(CAST(trunc(CAST(CASE WHEN s <= 0.5e0 THEN {dry}e0 + s * 2e0 * ({mid - dry}e0)
            ELSE {mid}e0 + (s - 0.5e0) * 2e0 * ({humid - mid}e0) END AS FLOAT)) AS INT), 0)"""

    share = """CASE WHEN value IS NOT NULL AND NOT isnan(value)
               THEN (least(greatest(value, 1e0), 3e0) - 1e0) / 2e0 END"""
    return [
        (
            "shares",
            f"""SELECT {keep}, least(greatest(({share} - 0.5e0) * {SHARP}e0 + 0.5e0, 0e0), 1e0) AS s0,
                {share} AS n0 FROM {cells}""",
        ),
        ("sharp", f"SELECT {keep}, n0, CASE WHEN n0 IS NOT NULL THEN s0 END AS s FROM shares"),
        (
            "rgb",
            f"""SELECT {keep}, n0, s, {channel(234, 10, 7)} AS r, {channel(245, 122, 152)} AS g,
                {channel(29, 24, 219)} AS b FROM sharp""",
        ),
    ]


def _classed(rgb: str, keep: str) -> list[tuple[str, str]]:
    return [
        (
            "hs",
            f"""SELECT {keep}, r, g, b, greatest(r, g, b) AS v8,
                greatest(r, g, b) - least(r, g, b) AS spread FROM {rgb}""",
        ),
        (
            "hue",
            # fixed point: reciprocals are whole numbers of 1/4096
            """SELECT *, CASE WHEN spread = 0 THEN 0 ELSE CAST(floor((
                 (CASE WHEN v8 = r THEN g - b WHEN v8 = g THEN b - r + 2 * spread
                   ELSE r - g + 4 * spread END) * round(122880e0 / spread) + 2048) / 4096e0) AS INT) END AS h0,
               CASE WHEN v8 = 0 THEN 0
                 ELSE CAST(floor((spread * round(1044480e0 / v8) + 2048) / 4096e0) AS INT) END AS s8 FROM hs""",
        ),
        (
            "hsv",
            f"SELECT {keep}, r, g, b, CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS h8, s8, v8 FROM hue",
        ),
        (
            "cls",
            """SELECT *, CASE WHEN s8 >= 50 AND v8 >= 50 AND h8 BETWEEN 20 AND 34 THEN 'yellow'
                 WHEN s8 >= 50 AND v8 >= 50 AND h8 BETWEEN 35 AND 89 THEN 'green'
                 WHEN s8 >= 50 AND v8 >= 50 AND h8 BETWEEN 90 AND 130 THEN 'blue'
                 ELSE 'other' END AS pixel_class FROM hsv""",
        ),
    ]


STATS = [
    (
        "cnt",
        """SELECT age_ma, COUNT(*) AS total,
           COUNT(CASE WHEN pixel_class = 'yellow' THEN 1 END) AS dry,
           COUNT(CASE WHEN pixel_class = 'green' THEN 1 END) AS semi_arid,
           COUNT(CASE WHEN pixel_class = 'blue' THEN 1 END) AS humid
           FROM cls GROUP BY age_ma""",
    ),
    ("st", "SELECT *, dry + semi_arid + humid AS classified, total - (dry + semi_arid + humid) AS other FROM cnt"),
]
_SHARES = ("dry", "semi_arid", "humid", "classified", "other")
STATS_COLUMNS = "age_ma, total, dry, semi_arid, humid, classified, other, " + ", ".join(
    f"round(CAST({c} AS DOUBLE) / total * 100, 6) AS pct_{c}" for c in _SHARES
)

GAPS = (
    "gaps",
    f"""SELECT age_ma, i, j, CASE WHEN lat > {NODATA_FROM}e0 THEN CAST('NaN' AS DOUBLE)
        ELSE value END AS value FROM surf""",
)


def _map_parts(method: str, mirror: bool, res: float, power: float, n: int, k: int, radius: float) -> str:
    pts = "pts" if method == "idw" else "smooth"
    return _ctes(
        *_cells(res),
        *(_smooth(power, k) if method == "knn_idw" else []),
        *_near(res, n, pts),
        _surf(power, radius),
        *_pixels(pts, mirror),
        _overridden(),
        *_coloured("final"),
        *_classed("rgb", "age_ma, i, j"),
        *STATS,
    )


def _map(method: str, mirror: bool = False, res: float = FINE) -> str:
    """One method's class shares."""
    return f"""{_map_parts(method, mirror, res, POWER, NEIGHBOURS, K, RADIUS)}
        SELECT {STATS_COLUMNS}, '{method}' AS method,
        CAST({POWER} AS DOUBLE) AS power, CAST({SHARP} AS DOUBLE) AS gradient_sharp FROM st"""


SIDE = 16  # cells per side of a block of `_settings_cells`
MOST = max(s.n_neighbors for s in SETTINGS.values())
SMOOTHED = list(dict.fromkeys((s.power, s.k) for s in SETTINGS.values()))
# a point's class value, and those smoothed as the settings want it
VALUES = ["v", *(f"v{n}" for n in range(len(SMOOTHED)))]


def _settings_points() -> list[tuple[str, str]]:
    """Points with all VALUES, and the pixels that they override."""
    smoothed = ", ".join(
        f"SUM({_weight('d', power)} * value) FILTER (rn <= {k}) / SUM({_weight('d', power)}) FILTER (rn <= {k}) AS {v}"
        for v, (power, k) in zip(VALUES[1:], SMOOTHED)
    )
    both = ", ".join(f"COALESCE(m.{v}, p.value) AS {v}" for v in VALUES[1:])
    most = ", ".join(f"MAX({v}) AS {v}" for v in VALUES)
    kept = ", ".join(VALUES)
    return [
        _smooth(k=max(k for _, k in SMOOTHED))[0],
        ("means", f"SELECT age_ma, point_id, {smoothed} FROM knn GROUP BY age_ma, point_id"),
        (
            "placed",
            f"""SELECT p.age_ma, p.point_id, p.lon, p.lat, p.value AS v, {both}
                FROM pts p LEFT JOIN means m ON p.age_ma = m.age_ma AND p.point_id = m.point_id""",
        ),
        *[
            (name, sql.replace("MAX(value) AS value", most).replace("p.value", kept).replace(", value", f", {kept}"))
            for name, sql in _pixels("placed")
        ],
    ]


def _settings_cells(res: float) -> list[tuple[str, str]]:
    """Every cell with `near`, its MOST nearest points, and `over`, the pixels of its block.

    Of a block's cells, a point can be among them only if it is no farther from the block than
    the MOST-th least of the points' greatest distances from it.
    """
    sides = (("x", "lon"), ("y", "lat"))
    gap = [f"greatest({c}0 - p.{at}, p.{at} - {c}1, 0e0)" for c, at in sides]
    span = [f"greatest(p.{at} - {c}0, {c}1 - p.{at})" for c, at in sides]
    norm = "sqrt({0} * {0} + {1} * {1})"
    d = norm.format("(lon - c.lon)", "(lat - c.lat)")
    fields = ", ".join(f"{c} := p.{c}" for c in ("point_id", "lon", "lat", *VALUES))
    kept = ", ".join(f"{v} := c.{v}" for v in VALUES)
    given = ", ".join(f"{c} := {c}" for c in ("i", "j", *VALUES))
    return [
        (
            "blocks",
            f"""SELECT *, min_lon + bj * {SIDE} * {res}e0 AS x0, min_lon + (least(bj * {SIDE} + {SIDE}, nx) - 1) * {res}e0 AS x1,
                min_lat + bi * {SIDE} * {res}e0 AS y0, min_lat + (least(bi * {SIDE} + {SIDE}, ny) - 1) * {res}e0 AS y1
                FROM (SELECT *, unnest(range((nx - 1) // {SIDE} + 1)) AS bj
                  FROM (SELECT *, unnest(range((ny - 1) // {SIDE} + 1)) AS bi FROM meta) r) b""",
        ),
        (
            "reaches",
            f"""SELECT b.age_ma, bi, bj, CASE WHEN COUNT(*) >= {MOST}
                THEN list_max(min({norm.format(*span)}, {MOST})) * (1 + 1e-9) + 1e-9 END AS reach
                FROM blocks b JOIN pts p ON b.age_ma = p.age_ma GROUP BY b.age_ma, bi, bj""",
        ),
        (
            "on_block",
            f"""SELECT age_ma, i // {SIDE} AS bi, j // {SIDE} AS bj, list(struct_pack({given})) AS over
                FROM pix GROUP BY 1, 2, 3""",
        ),
        (
            "near_block",
            f"""SELECT b.age_ma, bi, bj, list(struct_pack({fields})) AS around, any_value(over) AS over
                FROM blocks b JOIN reaches r USING (age_ma, bi, bj) LEFT JOIN on_block o USING (age_ma, bi, bj)
                JOIN placed p ON b.age_ma = p.age_ma
                WHERE reach IS NULL OR {norm.format(*gap)} <= reach GROUP BY b.age_ma, bi, bj""",
        ),
        (
            "near",
            f"""SELECT age_ma, i, j, list_sort(list_transform(around, lambda c:
                struct_pack(d := {d}, point_id := c.point_id, {kept})))[1:{MOST}] AS near, over
                FROM cells JOIN near_block USING (age_ma) WHERE i // {SIDE} = bi AND j // {SIDE} = bj""",
        ),
    ]


def _settings_surfaces() -> list[tuple[str, str]]:
    """Every cell's value by each setting and method, a row each."""
    lists = ", ".join(f"list_transform(near, lambda c: c.{c}) AS {c}" for c in ("d", *VALUES))
    weights = list(dict.fromkeys((s.n_neighbors, s.power) for s in SETTINGS.values()))
    weighed = ", ".join(
        f"list_transform(d[1:{n}], lambda c: {_weight('c', power)}) AS w{m}" for m, (n, power) in enumerate(weights)
    )
    drawn = []
    for name, s in SETTINGS.items():
        w = f"w{weights.index((s.n_neighbors, s.power))}"
        for method in ("idw", "knn_idw"):
            v = "v" if method == "idw" else VALUES[1 + SMOOTHED.index((s.power, s.k))]
            drawn.append(
                f"""struct_pack(setting := '{name}', method := '{method}', value := COALESCE(given.{v},
                CASE WHEN d[1] < {s.point_radius}e0 THEN {v}[1]
                ELSE list_inner_product({w}, {v}[1:{s.n_neighbors}]) / list_sum({w}) END))"""
            )
    return [
        ("lists", f"SELECT age_ma, {lists}, list_filter(over, lambda c: c.i = i AND c.j = j)[1] AS given FROM near"),
        ("weights", f"SELECT *, {weighed} FROM lists"),
        ("surf", f"SELECT age_ma, unnest([{', '.join(drawn)}]) AS drawn FROM weights"),
        ("final", "SELECT age_ma, drawn.setting, drawn.method, drawn.value FROM surf"),
    ]


def _map_settings(res: float = TENTH) -> str:
    """Both methods' class shares by each setting, on the grid that maps are drawn on: a cell is
    compared with the points near its block, as comparing it with every point takes too long."""
    given = ", ".join(
        f"('{name}', {s.power}e0, {s.n_neighbors}, {s.k}, {s.point_radius}e0)" for name, s in SETTINGS.items()
    )
    key = "age_ma, setting, method"
    # rows that DuckDB deals to its threads
    cells = [(name, sql.replace("SELECT", "SELECT DISTINCT") if name == "rws" else sql) for name, sql in _cells(res)]
    return f"""{_ctes(
        *cells,
        *_settings_points(),
        *_settings_cells(res),
        *_settings_surfaces(),
        *_coloured("final", f"{key}, value"),
        *_classed("rgb", key),
        (STATS[0][0], STATS[0][1].replace("age_ma", key)),
        STATS[1],
    )}
        SELECT {STATS_COLUMNS}, setting, method, power, CAST(n_neighbors AS INT) AS n_neighbors, CAST(k AS INT) AS k,
        point_radius FROM st JOIN (VALUES {given}) g(setting, power, n_neighbors, k, point_radius) USING (setting)"""


ORIGINAL = (
    "orig",
    """SELECT age_ma, i, j, value, CASE age_ma % 15
         WHEN 5 THEN concat(CAST(age_ma AS VARCHAR), '_ma_idw')
         WHEN 10 THEN concat(CAST(age_ma AS VARCHAR), '_idw') END AS raster
       FROM surf WHERE age_ma % 15 <> 0""",
)

# --- locations -------------------------------------------------------------

NAMED = (
    "named",
    f"""SELECT age_ma, lon, lat, point_id, climate, {_na('basin')} AS basin,
        {_na('formation')} AS formation, {COLOUR} AS colour,
        row_number() OVER (PARTITION BY age_ma, lon, lat ORDER BY point_id) AS idx,
        count(*) OVER (PARTITION BY age_ma, lon, lat) AS n_points FROM pts""",
)


def _names(c: str) -> list[tuple[str, str]]:
    return [
        (
            f"first_{c}",
            f"""SELECT age_ma, lon, lat, {c}, MIN(point_id) AS first_id FROM named
                GROUP BY age_ma, lon, lat, {c}""",
        ),
        (
            f"all_{c}s",
            f"""SELECT age_ma, lon, lat, string_agg({c}, '|' ORDER BY first_id) AS {c}s
                FROM first_{c} GROUP BY age_ma, lon, lat""",
        ),
    ]


GROUPS = [
    PTS,
    NAMED,
    *_names("basin"),
    *_names("formation"),
    (
        "places",
        """SELECT n.age_ma, n.lon, n.lat, n.n_points, n.colour, b.basins, f.formations,
           CASE WHEN n.n_points = 1 THEN concat(n.formation, ' (', n.basin, ')')
             ELSE concat(CAST(n.n_points AS VARCHAR), ' points: ', replace(f.formations, '|', ', '))
             END AS tooltip
           FROM named n
           JOIN all_basins b ON n.age_ma = b.age_ma AND n.lon = b.lon AND n.lat = b.lat
           JOIN all_formations f ON n.age_ma = f.age_ma AND n.lon = f.lon AND n.lat = f.lat
           WHERE n.idx = 1""",
    ),
]

BOUNDS = "MIN(lat) AS min_lat, MIN(lon) AS min_lon, MAX(lat) AS max_lat, MAX(lon) AS max_lon"
ROUNDED_BOUNDS = ", ".join(f"round({b}, 6) AS {b}" for b in ("min_lat", "min_lon", "max_lat", "max_lon"))
_CHOSEN = ", ".join(f"'{b}'" for b in CHOSEN_BASINS)
COARSE_STATS = [*_surface(COARSE), GAPS, *_coloured("gaps"), *_classed("rgb", "age_ma, i, j"), *STATS]


def _texts() -> str:
    columns = []
    for c in ("dry", "semi_arid", "humid", "other"):
        for n in (1, 2):
            columns.append(f"format('{{:.{n}f}}%', CAST({c} AS DOUBLE) / total * 100) AS {c}_text_{n}")
    return ", ".join(columns)


OWN = (
    "own",
    f"""SELECT age_ma, min_lon + {CROP_J} * pixel_x AS min_lon, max_lon,
        min_lat + {CROP_I} * pixel_y AS min_lat, max_lat, nx - {CROP_J} AS nx, ny - {CROP_I} AS ny,
        pixel_x, pixel_y FROM meta""",
)


def _delivered(north_up: bool) -> str:
    """A raster of its own extent, its rows from the south or from the north."""
    row = f"ny - 1 - (i - {CROP_I})" if north_up else f"i - {CROP_I}"
    raster = f"""SELECT s.age_ma, CAST({row} AS INT) AS i, j - {CROP_J} AS j, value
        FROM surf s JOIN own o ON s.age_ma = o.age_ma WHERE i >= {CROP_I} AND j >= {CROP_J}"""
    return f"""{_ctes(*_surface(COARSE), OWN, ('raster', raster), *_pixels(mirror=north_up, meta='own'),
        _overridden('raster'), *_coloured('final'))}
        SELECT age_ma, i, j, round(value, 6) AS value, r, g, b FROM rgb"""


ORACLES: dict[str, str] = {
    "geojson_points": f"""SELECT age_ma, CAST(row_number() OVER (PARTITION BY age_ma
        ORDER BY point_id) - 1 AS BIGINT) AS point_id, lon, lat, climate,
        formation, basin, country, time FROM ({POINTS}) q""",
    "coast_vertices": f"""SELECT age_ma, CAST(dense_rank() OVER (PARTITION BY age_ma
        ORDER BY line_id) - 1 AS BIGINT) AS feature_id, CAST(line_id AS VARCHAR) AS name,
        CASE WHEN line_id % 3 = 0 THEN 0 ELSE part END AS part,
        CASE WHEN line_id % 3 = 0 THEN CAST(part * 5 + seq AS INT) ELSE seq END AS seq, lon, lat
        FROM ({COAST}) q""",
    "discover_datasets": f"""SELECT DISTINCT p.age_ma, concat(CAST(p.age_ma AS VARCHAR), '_ma') AS base
        FROM ({POINTS}) p JOIN ({FILES}) f ON p.age_ma = f.age_ma JOIN ({COAST}) c ON p.age_ma = c.age_ma
        WHERE has_coast""",
    "original_raster": f"""{_ctes(*_surface(COARSE), ORIGINAL)}
        SELECT age_ma, raster, i, j, round(value, 6) AS value FROM orig""",
    "cells_roundtrip": f"""{_ctes(*_surface(COARSE))}
        SELECT age_ma, 'idw' AS method, i, j, round(value, 6) AS value FROM surf""",
    "cells_by_age": f"""{_ctes(*_surface(COARSE))}
        SELECT age_ma, 'idw' AS method, i, j, round(value, 6) AS value FROM surf
        WHERE age_ma = {STORED_AGE}""",
    "colour_ramp": f"""{_ctes(*_surface(COARSE), *_coloured('surf'))}
        SELECT age_ma, i, j, r, g, b FROM rgb""",
    "map_catalog": f"""SELECT DISTINCT p.age_ma, concat(CAST(p.age_ma AS VARCHAR), ' Ma') AS label,
        concat('{CATALOG_FOLDER}/map_', CAST(p.age_ma AS VARCHAR),
          '_ma_knn_idw_power4.0_gradient_sharp18.0.html') AS path,
        CASE WHEN has_pdf THEN concat('{CATALOG_FOLDER}/', stem, '.pdf') ELSE '' END AS pdf
        FROM ({POINTS}) p LEFT JOIN ({FILES}) f ON p.age_ma = f.age_ma""",
    "climate_encode": f"{_ctes(PTS)} SELECT age_ma, point_id, climate, value, {COLOUR} AS colour FROM pts",
    "or_na": f"""{_ctes(PTS)} SELECT age_ma, point_id, {_na('climate')} AS climate,
        {_na('formation')} AS formation, {_na('basin')} AS basin, {_na('country')} AS country,
        CASE WHEN point_id % 5 = 0 THEN 'N/A' WHEN point_id % 2 = 0
          THEN concat(CAST(point_id % 5 AS VARCHAR), '.0') ELSE CAST(point_id % 5 AS VARCHAR) END AS age
        FROM pts""",
    "gradient_sharpen": f"""{_ctes(*_surface(COARSE), *_coloured('surf'))}
        SELECT age_ma, i, j, round(n0, 6) AS share, round(s, 6) AS sharp FROM rgb""",
    "pixel_class": f"""{_ctes(("given", '''SELECT o_orderkey, CAST(o_orderkey % 256 AS INT) AS r,
        CAST((o_orderkey * 7) % 251 AS INT) AS g, CAST(o_custkey % 256 AS INT) AS b FROM orders'''),
        *_classed('given', 'o_orderkey'))} SELECT * FROM cls""",
    "point_pixels": f"{_ctes(PTS, *_meta(FINE), *_pixels())} SELECT * FROM pix",
    "point_pixels_mirrored": f"{_ctes(PTS, *_meta(FINE), *_pixels(mirror=True))} SELECT * FROM pix",
    "override_count": f"""{_ctes(PTS, *_meta(FINE), *_pixels())}
        SELECT age_ma, COUNT(*) AS overridden FROM pix GROUP BY age_ma""",
    "point_override": f"""{_ctes(*_surface(COARSE), *_pixels(), _overridden())}
        SELECT age_ma, i, j, round(value, 6) AS value FROM final""",
    "point_override_mirrored": f"""{_ctes(*_surface(COARSE), *_pixels(mirror=True), _overridden())}
        SELECT age_ma, i, j, round(value, 6) AS value FROM final""",
    "override_values": f"""{_ctes(PTS, *_smooth())} SELECT age_ma, point_id,
        round(CASE WHEN point_id % 2 = 1 THEN value ELSE class_value END, 6) AS value FROM smooth""",
    "flip_rows": f"""{_ctes(*_surface(COARSE))} SELECT s.age_ma, m.ny - 1 - s.i AS i, s.j,
        round(s.value, 6) AS value FROM surf s JOIN meta m ON s.age_ma = m.age_ma""",
    "grid_meta": f"""{_ctes(PTS, *_meta(FINE))} SELECT age_ma, round(min_lon, 6) AS min_lon,
        round(max_lon, 6) AS max_lon, round(min_lat, 6) AS min_lat, round(max_lat, 6) AS max_lat,
        nx, ny, round(pixel_x, 6) AS pixel_x, round(pixel_y, 6) AS pixel_y FROM meta""",
    "grid_cells": f"{_ctes(*_cells(FINE))} SELECT age_ma, i, j, lon, lat FROM cells",
    "knn_neighbours": f"""{_ctes(PTS, *_smooth())}
        SELECT age_ma, point_id, rn, neighbour_id, round(d, 6) AS d FROM knn""",
    "idw_neighbours": f"""{_ctes(*_cells(COARSE), *_near(COARSE))}
        SELECT age_ma, i, j, rn, point_id, round(d, 6) AS d, value FROM near""",
    "nearest_point": f"""{_ctes(*_cells(FINE), *_near(FINE, 1))}
        SELECT age_ma, i, j, point_id, round(d, 6) AS d FROM near""",
    "preserve_points": f"""{_ctes(*_cells(FINE), *_near(FINE, 1))}
        SELECT age_ma, i, j, point_id, value FROM near WHERE d < {RADIUS}e0""",
    "preserve_points_tenth": f"""{_ctes(PTS, *_meta(TENTH), _around('rws', 'i', 'lat', 'ny', 'pts JOIN meta USING (age_ma)'),
        _around('rc', 'j', 'lon', 'nx', 'rws'),
        ('pairs', f"""SELECT *, sqrt((min_lon + j * {TENTH}e0 - lon) * (min_lon + j * {TENTH}e0 - lon)
          + (min_lat + i * {TENTH}e0 - lat) * (min_lat + i * {TENTH}e0 - lat)) AS d FROM rc"""),
        ('near', f"""SELECT *, row_number() OVER (PARTITION BY age_ma, i, j ORDER BY d, point_id) AS rn
          FROM pairs WHERE d < {RADIUS}e0"""))}
        SELECT age_ma, i, j, point_id, value FROM near WHERE rn = 1""",
    "knn_smooth": f"""{_ctes(PTS, *_smooth())} SELECT age_ma, point_id, class_value AS value,
        round(value, 6) AS smoothed FROM smooth""",
    "idw_surface": f"""{_ctes(*_surface(FINE))}
        SELECT age_ma, i, j, lon, lat, round(value, 6) AS value FROM surf""",
    "class_stats": f"{_ctes(*COARSE_STATS)} SELECT {STATS_COLUMNS} FROM st",
    "class_stats_text": f"{_ctes(*COARSE_STATS)} SELECT age_ma, {_texts()} FROM st",
    "raster_stats": f"""{_ctes(*_surface(COARSE), GAPS, *_coloured('gaps'))}
        SELECT age_ma, MAX(i) + 1 AS n_rows, MAX(j) + 1 AS n_cols, COUNT(*) AS total, COUNT(s) AS valid,
        round(MIN(CASE WHEN s IS NOT NULL THEN value END), 6) AS min_value,
        round(MAX(CASE WHEN s IS NOT NULL THEN value END), 6) AS max_value,
        {', '.join(f"{m}(CASE WHEN s IS NOT NULL THEN {c} END) AS {m.lower()}_{c}"
                   for c in 'rgb' for m in ('MIN', 'MAX'))} FROM rgb GROUP BY age_ma""",
    "map_idw_stats": _map("idw"),
    "map_knn_idw_stats": _map("knn_idw"),
    "map_sweep_stats": f"SELECT * FROM ({_map('idw')}) a UNION ALL SELECT * FROM ({_map('knn_idw')}) b",
    "map_settings_stats": _map_settings(),
    "map_sweep_stats_mirrored": f"""SELECT * FROM ({_map('idw', True)}) a
        UNION ALL SELECT * FROM ({_map('knn_idw', True)}) b""",
    "map_original": f"""{_ctes(*_surface(COARSE), ORIGINAL, *_pixels(), _overridden('orig'),
        *_coloured('final'))} SELECT age_ma, i, j, round(value, 6) AS value, r, g, b FROM rgb""",
    "map_original_own_extent": _delivered(False),
    "map_original_north_up": _delivered(True),
    "combined_bounds_stored": f"""{_ctes(PTS, *_meta(COARSE), OWN, ('cst', COAST),
          ('verts', f'''SELECT age_ma, lon, lat FROM pts UNION ALL SELECT age_ma, lon, lat FROM cst
            UNION ALL SELECT age_ma, min_lon, min_lat FROM own
            UNION ALL SELECT age_ma, max_lon, max_lat FROM own'''),
          ('comb', f'SELECT age_ma, {BOUNDS} FROM verts GROUP BY age_ma'),
          ('listed', 'SELECT DISTINCT age_ma FROM pts'))}
        SELECT l.age_ma, round(c.min_lat, 6) AS min_lat, round(c.min_lon, 6) AS min_lon,
        round(c.max_lat, 6) AS max_lat, round(c.max_lon, 6) AS max_lon,
        {', '.join(f"round(o.{b}, 6) AS view_{b}" for b in ('min_lat', 'min_lon', 'max_lat', 'max_lon'))}
        FROM listed l JOIN comb c ON l.age_ma = c.age_ma JOIN own o ON l.age_ma = o.age_ma""",
    "run_folder_stats": f"""WITH st AS (SELECT * FROM ({_map('idw', res=COARSE)}) a
          UNION ALL SELECT * FROM ({_map('knn_idw', res=COARSE)}) b),
        np AS (SELECT age_ma, COUNT(*) AS n FROM ({POINTS}) q GROUP BY age_ma),
        nc AS (SELECT age_ma, COUNT(DISTINCT line_id) AS n FROM ({COAST}) q GROUP BY age_ma)
        SELECT age_ma, method, 'processed' AS status, np.n AS n_points, nc.n AS n_coast,
        concat(age_ma, ' ma') AS title,
        concat('map_', age_ma, '_ma_', method, '_power4.0_gradient_sharp18.0.html') AS path,
        concat(age_ma, ' Ma') AS label,
        total, dry, semi_arid, humid, classified, other,
        pct_dry, pct_semi_arid, pct_humid, pct_classified, pct_other, power
        FROM st JOIN np USING (age_ma) JOIN nc USING (age_ma)
        UNION ALL SELECT {LINES_ONLY_AGE}, NULL, 'skipped', 0, n, NULL, NULL, NULL,
        NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nc WHERE age_ma = 65""",
    "location_groups": f"{_ctes(*GROUPS)} SELECT * FROM places",
    "location_details": f"""{_ctes(PTS, ('n', '''SELECT *,
          row_number() OVER (PARTITION BY age_ma, lon, lat ORDER BY point_id) AS idx,
          count(*) OVER (PARTITION BY age_ma, lon, lat) AS n_points FROM pts'''))}
        SELECT age_ma, lon, lat, point_id, idx, n_points, {_na('formation')} AS formation,
        {_na('basin')} AS basin, {_na('country')} AS country,
        CASE WHEN n_points = 1 THEN {_na('climate')} ELSE {_na('climate', '')} END AS climate,
        {_na('time')} AS age, {COLOUR} AS colour FROM n""",
    "basin_list": f"{_ctes(PTS)} SELECT DISTINCT age_ma, {_na('basin')} AS basin FROM pts",
    "basin_filter": f"""{_ctes(*GROUPS)} SELECT DISTINCT p.age_ma, p.lon, p.lat, p.n_points, p.tooltip
        FROM places p JOIN named n ON p.age_ma = n.age_ma AND p.lon = n.lon AND p.lat = n.lat
        WHERE n.basin IN ({_CHOSEN})""",
    "basin_bitmap_filter": f"""{_ctes(PTS, NAMED)} SELECT age_ma, lon, lat, count(*) AS n_points,
        string_agg(DISTINCT basin, '|' ORDER BY basin) AS basins FROM named GROUP BY age_ma, lon, lat
        HAVING bool_or(basin IN ({_CHOSEN}))""",
    "basins_beside_chosen": f"""{_ctes(PTS, NAMED)} SELECT DISTINCT n.age_ma, n.basin FROM named n
        SEMI JOIN named c ON n.age_ma = c.age_ma AND n.lon = c.lon AND n.lat = c.lat AND c.basin IN ({_CHOSEN})""",
    "feature_bounds": f"""{_ctes(PTS, ('cst', COAST))}
        SELECT age_ma, kind, {ROUNDED_BOUNDS} FROM (
          SELECT age_ma, 'points' AS kind, {BOUNDS} FROM pts GROUP BY age_ma
          UNION ALL SELECT age_ma, 'coast' AS kind, {BOUNDS} FROM cst GROUP BY age_ma) b""",
    "combined_bounds": f"""{_ctes(PTS, *_meta(COARSE), ('cst', COAST),
          ('rst', 'SELECT * FROM meta WHERE age_ma >= 105'),
          ('listed', 'SELECT DISTINCT age_ma FROM pts UNION ALL SELECT MAX(age_ma) + 5 FROM pts'),
          ('verts', '''SELECT age_ma, lon, lat FROM pts UNION ALL SELECT age_ma, lon, lat FROM cst
            UNION ALL SELECT age_ma, min_lon, min_lat FROM rst
            UNION ALL SELECT age_ma, max_lon, max_lat FROM rst'''),
          ('comb', f'SELECT age_ma, {BOUNDS} FROM verts GROUP BY age_ma'))}
        SELECT CAST(l.age_ma AS INT) AS age_ma, round(c.min_lat, 6) AS min_lat,
        round(c.min_lon, 6) AS min_lon, round(c.max_lat, 6) AS max_lat, round(c.max_lon, 6) AS max_lon,
        round(COALESCE((c.min_lat + c.max_lat) / 2, -20e0), 6) AS center_lat,
        round(COALESCE((c.min_lon + c.max_lon) / 2, -20e0), 6) AS center_lon,
        {', '.join(f"round(COALESCE(r.{b}, c.{b}), 6) AS view_{b}"
                   for b in ('min_lat', 'min_lon', 'max_lat', 'max_lon'))}
        FROM listed l LEFT JOIN comb c ON l.age_ma = c.age_ma LEFT JOIN rst r ON l.age_ma = r.age_ma""",
    "run_summary": f"""{_ctes(PTS,
          ('listed', 'SELECT DISTINCT age_ma FROM pts UNION ALL SELECT MAX(age_ma) + 5 FROM pts'),
          ('np', 'SELECT age_ma, COUNT(*) AS n FROM pts GROUP BY age_ma'),
          ('nc', f'SELECT age_ma, COUNT(DISTINCT line_id) AS n FROM ({COAST}) q GROUP BY age_ma'))}
        SELECT CAST(l.age_ma AS INT) AS age_ma, COALESCE(np.n, 0) AS n_points,
        COALESCE(nc.n, 0) AS n_coast,
        CASE WHEN np.n > 0 THEN 'processed' ELSE 'skipped' END AS status
        FROM listed l LEFT JOIN np ON l.age_ma = np.age_ma LEFT JOIN nc ON l.age_ma = nc.age_ma""",
}
