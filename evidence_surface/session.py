"""Session settings the operators read, and the shared folder for tables
that are written once and read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

# A side of a join is broadcast only if its row count, known before the join,
# is at most this. Rows here are narrow (below 100 bytes), so about 20 MB.
BROADCAST_ROWS = 200_000


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder.

    Only a local session without the setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="evidence-surface-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/evidence_surface/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage,
    survives the loss of executors and is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted_side(df: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A side of unknown size: written, its rows counted by the same job, then as `small_side`."""
    seen = Observation()
    written = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return small_side(written, seen.get["rows"], limit)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint if the known row count allows it, else a shuffle join."""
    return F.broadcast(df) if rows <= limit else shuffled_side(df)


def shuffled_side(df: DataFrame) -> DataFrame:
    """A side that is shuffled whatever Spark takes its size for: it goes by the bytes of compressed
    files, knows nothing of copies made by `explode`, and would build the whole side in the driver."""
    return df.hint("merge")
