"""Exact dedup of a new batch against an immutable snapshot, screened by binary fuse filters.

A snapshot is a table of exact buckets (digest, the document that stays, group size) and one
static filter per shard of its digests. Documents of a new batch are first grouped by digest
among themselves, so a text that fills a third of the batch is one row from there on. Only the
distinct digests are screened; those that pass meet the exact buckets, and their texts are
compared byte by byte before the batch's group joins the snapshot's.

Defined results: a null text is the empty text; the smallest id of a group stays (null ids
lose to any id); of repeated rows with that id one stays. Other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evidence_surface.llm import fuse
from evidence_surface.llm.common import bounded_side, materialise, normalised_space

KEYS_PER_SHARD = 50_000


@dataclass(frozen=True)
class Snapshot:
    """buckets: sha, keep_id, n. filters: shard, seed, length, segments, cells."""

    buckets: DataFrame
    filters: DataFrame
    shards: int


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sha, copies): one row for each id and normalised text."""
    sha = F.unhex(F.sha2(normalised_space(F.col(text_col)), 256))
    return docs.select(F.col(id_col).alias("doc_id"), sha.alias("sha")).groupBy("doc_id", "sha").agg(
        F.count("*").alias("copies")
    )


def grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("n"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("sha"), F.lit(shards)).cast("int")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, length, segments, cells = fuse.build(pdf["key"].to_numpy())
    return pd.DataFrame(
        {"shard": [pdf["shard"].iloc[0]], "seed": [seed], "length": [length], "segments": [segments], "cells": [cells]}
    )


def take_snapshot(rows: DataFrame, least_keys: int = 0) -> Snapshot:
    """Snapshot of `digests` rows. `least_keys`: size of the batch to be screened, if larger."""
    buckets = materialise(grouped(rows), "buckets")
    shards = max(1, -(-max(buckets.count(), least_keys) // KEYS_PER_SHARD))
    keys = buckets.select(_shard(shards).alias("shard"), F.xxhash64("sha", F.lit(1)).alias("key"))
    filters = keys.groupBy("shard").applyInPandas(
        _build, "shard int, seed int, length int, segments int, cells binary"
    )
    return Snapshot(buckets, materialise(filters, "filters"), shards)


def _probe(groups: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if groups.empty:
        hit = []
    elif filters.empty:
        hit = [False] * len(groups)
    else:
        f = filters.iloc[0]
        hit = fuse.contains(
            groups["key"].to_numpy(), int(f["seed"]), int(f["length"]), int(f["segments"]), f["cells"]
        )
    return groups[["sha", "keep_id", "n"]].assign(hit=hit)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """`groups` with a flag `hit`; false means that the snapshot certainly lacks the digest."""
    kind = dict(groups.dtypes)["keep_id"]
    left = groups.withColumn("shard", _shard(snapshot.shards)).withColumn("key", F.xxhash64("sha", F.lit(1)))
    return (
        left.groupBy("shard")
        .cogroup(snapshot.filters.groupBy("shard"))
        .applyInPandas(_probe, f"sha binary, keep_id {kind}, n long, hit boolean")
    )


def equal_bytes(pairs: DataFrame, rows: int, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests of `pairs` (sha, new_id, keep_id) whose two normalised texts are the same bytes."""
    wanted = pairs.select("sha", F.explode(F.array("new_id", "keep_id")).alias("doc_id"))
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised_space(F.col(text_col)).alias("body")).join(
        bounded_side(wanted, 2 * rows), "doc_id"
    )
    texts = texts.where(F.unhex(F.sha2("body", 256)) == F.col("sha"))
    return texts.groupBy("sha").agg((F.min("body") == F.max("body")).alias("same")).where("same").select("sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`, whose ids are numbers: doc_id, keep_id, group_size, kept,
    text_sha256. The lower half of the ids is the snapshot, the upper half the new batch.
    """
    rows = materialise(digests(docs, id_col, text_col), "digests")
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    rows = rows.withColumn("old", F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False)))
    batch = materialise(grouped(rows.where(~F.col("old"))), "batch_groups")
    snapshot = take_snapshot(rows.where("old"), batch.count())
    positive = screen(batch, snapshot).where("hit").select("sha", F.col("keep_id").alias("new_id"))
    pairs = materialise(positive.join(snapshot.buckets.select("sha", "keep_id"), "sha"), "pairs")
    same = materialise(equal_bytes(pairs, pairs.count(), docs, id_col, text_col), "same")

    joined = batch.join(same, "sha", "left_semi").select("sha", F.col("n").alias("more"))
    old = snapshot.buckets.join(joined, "sha", "left").select(
        "sha", "keep_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("group_size"), F.col("more").isNotNull().alias("both")
    )
    of_old = old.withColumn("old", F.lit(True)).drop("both")
    of_joined = old.where("both").withColumn("old", F.lit(False)).drop("both")
    of_new = batch.join(same, "sha", "left_anti").select(
        "sha", "keep_id", F.col("n").alias("group_size"), F.lit(False).alias("old")
    )
    groups = of_old.unionByName(of_joined).unionByName(of_new)
    each = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    return (
        rows.join(groups, ["sha", "old"])
        .select("doc_id", "keep_id", "group_size", "sha", each)
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
