"""Helpers the operators share: tables of a data folder, written intermediate tables, digests."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidence_surface import session

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a statement go when it ends, as its result is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives the
    loss of executors, is computed once, and its shuffle files are removed at once."""
    with _shuffles_removed(df.sparkSession):
        return session.materialise(df, name)


def bounded_side(df: DataFrame, rows: int) -> DataFrame:
    return session.small_side(df, rows)


def bounded_sample(df: DataFrame, most: int, *by: str, seed: int = 0) -> DataFrame:
    """At most `most` rows, those of the least hash of the columns `by`.

    Only about `most` rows leave the tasks, however many tasks there are: rows whose hash is
    beyond the share needed are dropped where they are read.
    """
    share = min(1.0, 1.2 * most / max(df.count(), 1) + 1e-4)
    spot = F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(1 << 40))
    near = df.withColumn("spot_", spot).where(F.col("spot_") <= int(share * (1 << 40)))
    return near.orderBy("spot_", *by).limit(most).drop("spot_")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many `_` behind it as no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """`docs` without the rows whose keys (null equals null) are in `gone`, written beforehand.

    Texts are shuffled only if `gone` has more rows than a broadcast side may.
    """
    names = [free_name(docs, f"gone_{k}") for k in keys]
    gone = gone.select(*[F.col(k).alias(name) for k, name in zip(keys, names)])
    same = [F.col(k).eqNullSafe(F.col(name)) for k, name in zip(keys, names)]
    return docs.join(bounded_side(gone, gone.count()), reduce(Column.__and__, same), "left_anti")


def normalised_space(text: Column) -> Column:
    """Null is empty; each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
