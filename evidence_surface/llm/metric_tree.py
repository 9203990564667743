"""Exact search for the largest inner products with an M-tree.

Vectors are lifted so that a larger inner product is a smaller distance (`metric_pages.py`).
The tree: pages of up to 64 objects under a centre, an object, with a covering radius; parts of
up to 4096 objects, cut into pages, which are what is shuffled; above them nodes of up to 256
children, level by level up to one root. Every entry stores its distance to its node's centre.

Building: each vector goes to the nearest of at most 256 pivots, chosen as far apart as a
bounded sample allows; the table is sorted by pivot, distance and row, and cut into parts, so
the vectors of a crowded pivot, equal ones too, are as many parts as they need. The same is
done with the parts' centres, up to the root. The sample shapes the tree, never the result.

Searching, best first: every query goes down to the part of the least bound, and is searched
there. Its k-th best score so far is then what closes nodes, parts and pages: first by
|d(query, node's centre) - d(entry, node's centre)| - radius, which needs no new distance, then by
d(query, entry) - radius. What is still open is searched, nearest pages first, and the best of
all parts are merged. A part meets its queries in groups of up to 4096 queries.

Defined results: vectors that are null or hold a null or non-finite component take no part, as
object or query. Every other row is an object; a query's own row, and no other, is left out, so
rows that repeat an id are objects and queries of their own. Ties go to the smaller id; null ids come
last. Vectors of fewer components than others are filled with zeros. Scores must fit 64 bits.
Fewer than k objects give fewer rows; an empty table or no query gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from evidence_surface.llm.common import bounded_sample, materialise
from evidence_surface.llm.metric_pages import NO_ID, NO_SCORE, PAGE, centre, cut, distances, lifted, matrix, search, slack
from evidence_surface.session import shuffle_partitions

SCALE = 256
PART = 4096
FAN = 256
PIVOTS = 256
SAMPLE = 2048
GROUP = 4096
_NODE = "node long, child long, v array<long>, radius double, gap double"
_PART = "node long, page int, row long, id long, v array<long>, radius double, gap double"


@dataclass
class Tree:
    """levels: entries of nodes, the root's first; parts: objects (row not null) and pages."""

    levels: list[DataFrame]
    parts: DataFrame
    m2: float


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, null if a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _pivots(entries: DataFrame, rows: int, capacity: int, m2: float) -> np.ndarray:
    """Far points of a bounded sample, as many as there will be nodes, PIVOTS at most."""
    sample = bounded_sample(entries.select("child", "v"), SAMPLE, "child")
    found = matrix(pa.array([r["v"] for r in sample.collect()], pa.list_(pa.int64())))
    x, chosen = lifted(found, m2), [0]
    away = distances(x, x[:1])[:, 0]
    while len(chosen) < min(PIVOTS, -(-rows // capacity)) and away.max() > 0:
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, distances(x, x[chosen[-1] :][:1])[:, 0])
    return found[chosen]


def _assigned(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, m2: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = matrix(batch.column("v"), pivots.shape[1])
        wide = np.zeros((len(pivots), v.shape[1]), np.int64)
        wide[:, : pivots.shape[1]] = pivots
        d = distances(lifted(v, m2), lifted(wide, m2))
        nearest = d.argmin(axis=1)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])],
            names=[*batch.schema.names, "region", "reach"],
        )


def _cut_runs(
    batches: Iterator[pa.RecordBatch], capacity: int, emit: Callable[[int, pa.Table], pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Sorted rows in nodes of up to `capacity`, none of two pivots."""
    base, made = TaskContext.get().partitionId() << 32, 0
    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        while held.num_rows:
            region = held.column("region").to_numpy()
            run = int(np.searchsorted(region, region[0], "right"))
            if run == held.num_rows and run < capacity:
                break  # it may go on in the next batch
            run = min(run, capacity)
            made += 1
            yield emit(base + made, held.slice(0, run))
            held = held.slice(run)
    if held is not None and held.num_rows:
        yield emit(base + made + 1, held)


def _part_rows(node: int, rows: pa.Table, m2: float) -> pa.RecordBatch:
    v = matrix(rows.column("v"))
    x = lifted(v, m2)
    pages = cut(x, PAGE)
    at = np.concatenate(pages)
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    middle, gap, radius = [], np.zeros(len(at)), []
    for number, own in enumerate(pages):
        m, g, r = centre(x[own], np.zeros(len(own)))
        middle.append(int(own[m]))
        gap[page == number] = g
        radius.append(r)
    top, between, reach = centre(x[middle], np.array(radius))
    lists = rows.column("v").combine_chunks()
    nothing = np.zeros(len(pages) + 1, bool)
    take = np.concatenate([at, middle, [middle[top]]])
    known = np.concatenate([np.ones(len(at), bool), nothing])
    take_ids = rows.column("id").combine_chunks().take(pa.array(take))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(take), node)),
            pa.array(np.concatenate([page, np.arange(len(pages)), [-1]]).astype(np.int32)),
            pa.array(rows.column("child").to_numpy()[take], mask=~known),
            pa.array(take_ids.to_pylist(), pa.int64()),
            lists.take(pa.array(take)),
            pa.array(np.concatenate([np.zeros(len(at)), radius, [reach]])),
            pa.array(np.concatenate([gap, between, [0.0]])),
        ],
        names=["node", "page", "row", "id", "v", "radius", "gap"],
    )


def _node_rows(node: int, rows: pa.Table, m2: float) -> pa.RecordBatch:
    """Entries of a node and, as its own entry without a child, its centre."""
    x = lifted(matrix(rows.column("v")), m2)
    middle, gap, radius = centre(x, rows.column("radius").to_numpy())
    take = np.append(np.arange(len(x)), [middle])
    children = np.ones(len(take), bool)
    children[-1] = False
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(take), node)),
            pa.array(rows.column("child").to_numpy()[take], mask=~children),
            rows.column("v").combine_chunks().take(pa.array(take)),
            pa.array(np.append(rows.column("radius").to_numpy(), [radius])),
            pa.array(np.append(gap, [0.0])),
        ],
        names=["node", "child", "v", "radius", "gap"],
    )


def _arranged(entries: DataFrame, rows: int, capacity: int, m2: float) -> DataFrame:
    """Entries by pivot, distance and number, in ranges; a crowded pivot is several ranges."""
    pivots = _pivots(entries, rows, capacity, m2)
    kinds = ", ".join(f"{c} {t}" for c, t in entries.dtypes)
    placed = entries.mapInArrow(lambda b: _assigned(b, pivots, m2), f"{kinds}, region int, reach double")
    placed = materialise(placed, "placed")
    n = min(shuffle_partitions(entries.sparkSession), -(-rows // capacity))
    order = ["region", "reach", "child"]
    return placed.repartitionByRange(n, *order).sortWithinPartitions(*order)


def build(objects: DataFrame, rows: int, m2: float, part: int = PART, fan: int = FAN) -> Tree:
    """The tree of `objects` (row long, id long, v array<long>), `rows` of them, one or more."""
    entries = objects.withColumnRenamed("row", "child")
    parts = _arranged(entries, rows, part, m2).mapInArrow(
        lambda b: _cut_runs(b, part, lambda node, t: _part_rows(node, t, m2)), _PART
    )
    parts = materialise(parts, "parts")
    entries = materialise(parts.where("page = -1").select(F.col("node").alias("child"), "v", "radius"), "centres")
    levels, n = [], entries.count()
    while n > fan:
        level = _arranged(entries, n, fan, m2).mapInArrow(
            lambda b: _cut_runs(b, fan, lambda node, t: _node_rows(node, t, m2)), _NODE
        )
        level = materialise(level, f"level_{len(levels)}")
        levels.append(level.where("child is not null"))
        entries = level.where("child is null").select(F.col("node").alias("child"), "v", "radius")
        n = entries.count()
    root = entries.withColumns({"node": F.lit(0).cast("long"), "gap": F.lit(0.0)})
    levels.append(root.select("node", "child", "v", "radius", "gap"))
    return Tree(levels[::-1], parts, m2)


def _flat(q: np.ndarray) -> np.ndarray:
    return np.column_stack([q.astype(np.float64), np.zeros(len(q))])


def _within(q: np.ndarray, least: np.ndarray, m2: float) -> np.ndarray:
    norms = np.linalg.norm(q.astype(np.float64), axis=1)
    reached = np.sqrt(np.maximum(norms**2 + m2 - 2.0 * least, 0.0)) + slack(m2, norms)
    return np.where(least > NO_SCORE, reached, np.inf)


def _down(entries: pa.Table, queries: pa.Table, m2: float, nearest: bool) -> pa.Table:
    """For each query the children to go on with: the one of the least bound, or all that are open."""
    if not (entries.num_rows and queries.num_rows):
        return queries.slice(0, 0)
    dims = max(matrix(t.column("v")).shape[1] for t in (entries, queries))
    v, q = matrix(entries.column("v"), dims), matrix(queries.column("v"), dims)
    radius, gap, least = (t.to_numpy() for t in (entries.column("radius"), entries.column("gap"), queries.column("least")))
    limit = _within(q, least, m2)[:, None]
    beside = np.abs(queries.column("gap").to_numpy()[:, None] - gap[None, :]) - radius[None, :]
    beside = np.where(np.isnan(beside), 0.0, beside)  # the root's centre has no distance
    open_ = beside <= limit
    some, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    away = distances(_flat(q[some]), lifted(v[columns], m2))
    bound = away - radius[columns][None, :]
    if nearest:
        pick = np.lexsort((away, np.maximum(bound, 0.0)), axis=1)[:, 0]
        of, to = np.arange(len(some)), pick
    else:
        of, to = np.nonzero(open_[np.ix_(some, columns)] & (bound <= limit[some]))
    out = queries.take(pa.array(some[of]))
    child = pa.array(entries.column("child").to_numpy()[columns[to]])
    for name, values in (("node", child), ("gap", pa.array(away[of, to]))):
        out = out.set_column(out.schema.get_field_index(name), name, values)
    return out


def _leaves(objects: pa.Table, queries: pa.Table, k: int, m2: float) -> pa.Table:
    kinds = {"row": pa.int64(), "query_id": pa.int64(), "object": pa.int64(), "id": pa.int64(), "score": pa.int64()}
    if not (objects.num_rows and queries.num_rows):
        return pa.schema(kinds).empty_table()
    pages = objects.filter(pa.compute.and_(pa.compute.is_null(objects.column("row")), pa.compute.greater_equal(objects.column("page"), 0)))
    objects = objects.filter(pa.compute.is_valid(objects.column("row"))).sort_by("page")
    pages = pages.sort_by("page")
    dims = max(matrix(t.column("v")).shape[1] for t in (objects, queries))
    part = {
        "vectors": matrix(objects.column("v"), dims),
        "rows": objects.column("row").to_numpy(),
        "ids": objects.column("id").fill_null(NO_ID).to_numpy(),
        "page": objects.column("page").to_numpy(),
        "gap": objects.column("gap").to_numpy(),
        "centres": lifted(matrix(pages.column("v"), dims), m2),
        "radius": pages.column("radius").to_numpy(),
        "centre_gap": pages.column("gap").to_numpy(),
    }
    query = {
        "vectors": matrix(queries.column("v"), dims),
        "rows": queries.column("row").to_numpy(),
        "gap": queries.column("gap").to_numpy(),
        "least": queries.column("least").to_numpy(),
    }
    best, _ = search(part, query, k, m2)
    of, at = np.nonzero(best.row >= 0)
    ids = best.id[of, at]
    return pa.table(
        {
            "row": query["rows"][of],
            "query_id": queries.column("query_id").combine_chunks().take(pa.array(of)),
            "object": best.row[of, at],
            "id": pa.array(ids, mask=ids == NO_ID),
            "score": best.score[of, at],
        },
        pa.schema(kinds),
    )


def _met(entries: DataFrame, queries: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`f` of each node with a group of the queries that have come to it."""
    wanted = queries.select(F.col("node").alias("to_node"), F.col("group").alias("to_group")).distinct()
    return (
        entries.join(wanted, F.col("node") == F.col("to_node"))
        .groupBy("to_node", "to_group")
        .cogroup(queries.groupBy("node", "group"))
        .applyInArrow(f, schema)
    )


def _open_parts(tree: Tree, queries: DataFrame, nearest: bool) -> DataFrame:
    """Queries with the parts they go on to."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in queries.dtypes)
    m2 = tree.m2
    for level in tree.levels:
        queries = materialise(_met(level, queries, lambda e, q: _down(e, q, m2, nearest), kinds), "open")
    return queries


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    part: int = PART,
    fan: int = FAN,
    group: int = GROUP,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `is_query` holds the k rows of the largest
    inner products of floor(scale * x)."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        whole_numbers(F.col(vector_col), scale).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where("v is not null")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, m2, asked = rows.agg(F.count("*"), F.max(square), F.count_if("asks")).first()
    if not asked:
        return rows.where("false").select(
            F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score")
        )
    tree = build(rows.select("row", "id", "v"), n, m2, part, fan)
    groups = F.pmod(F.xxhash64("row"), F.lit(-(-asked // group))).cast("int")
    queries = rows.where("asks").select(
        F.lit(0).cast("long").alias("node"), groups.alias("group"), "row", F.col("id").alias("query_id"), "v",
        F.lit(float("nan")).alias("gap"), F.lit(NO_SCORE).cast("long").alias("least"),
    )
    searched = lambda open_: materialise(
        _met(tree.parts, open_, lambda o, q: _leaves(o, q, k, m2), "row long, query_id long, object long, id long, score long"), "best"
    )
    nearest = _open_parts(tree, queries, nearest=True)
    first = searched(nearest)
    reached = first.groupBy("row").agg(F.count("*").alias("found"), F.min("score").alias("reached")).where(F.col("found") >= k)
    queries = queries.join(reached, "row", "left").withColumn("least", F.coalesce("reached", "least"))
    rest = _open_parts(tree, queries.select(nearest.columns), nearest=False)
    rest = rest.join(nearest.select("node", "row"), ["node", "row"], "left_anti").select(nearest.columns)
    both = first.unionByName(searched(rest))
    by_query = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "object")
    both = both.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return both.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
