"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidence_surface.llm.common import materialise

MOST_ROUNDS = 60
EDGES_PER_TASK = 100_000


def _written(df: DataFrame, tasks: int, name: str) -> DataFrame:
    """Written by tasks that follow the number of edges: rounds over few edges stay short."""
    return materialise(df.coalesce(tasks), name)


def _least(edges: DataFrame, tasks: int) -> DataFrame:
    """Least node around each u, itself included; written so that a hot u's edges can be split."""
    return _written(edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), tasks, "least")


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = both.join(_least(both, tasks), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _written(hung.distinct(), tasks, "large_star")


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges point from the larger to the smaller node."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, tasks)
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    stars = moved.union(least.where("u != m").select("u", F.col("m").alias("v"))).distinct()
    return _written(stars, tasks, "small_star")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge but the roots; root is its component's least node.

    `edges`: columns u and v of one ordered type. Each round is written to the shared folder.
    """
    state, before = materialise(edges.where("u != v").distinct(), "edges"), None
    tasks = 1 + state.count() // EDGES_PER_TASK
    for _ in range(MOST_ROUNDS):
        state = _small_star(_large_star(state, tasks), tasks)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
