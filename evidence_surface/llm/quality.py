"""Quality classifier by importance resampling.

Two hashed n-gram models are counted: one over the documents labelled good (the target) and
one over all documents (raw). A document's log weight is the mean over its n-grams of
log(p_target / p_raw), scaled to REFERENCE_GRAMS of them, so that long documents do not win
by length. Resampling is Gumbel top-k: each document's key is its log weight plus Gumbel noise
drawn from a hash of it, and the k largest keys stay.

k is the number of all documents whose weight reaches the cut that separates the labelled
documents best, so it grows with the data. The target and the cut use at most MOST_LABELLED
labelled documents of each quality (by hash order, the documented bound of the fit); raw
counts and weights cover every document.

n-grams, each counted into one of BUCKETS: a token; its shape; the shapes of it and the token
before. Tokens are runs of letters (ASCII or not), digits, or other signs. A shape says upper,
capital or lower case, digits, or which signs, and whether the token repeats the one before.

Defined results: a document without tokens (null, empty, white space) has no weight and is
rejected; without labels of both qualities nothing else is; equal keys share their fate, so
repeated rows do too; a null id has no label. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidence_surface.llm.common import bounded_sample, materialise
from evidence_surface.llm.fuse import mix
from evidence_surface.llm.words import buffers, run_hashes, slices

BUCKETS = 1 << 16
REFERENCE_GRAMS = 256.0
MOST_LABELLED = 20_000
BINS = 1024

_CLASS = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other sign
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the text that each is of."""
    data, offsets = buffers(texts)
    kind = _CLASS[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[offsets[:-1][np.diff(offsets) > 0]] = True
    edges = np.flatnonzero(fresh)
    lengths = np.diff(np.append(edges, len(data)))
    token = kind[edges] > 0
    inside = np.repeat(token, lengths)
    starts, lengths = edges[token], lengths[token]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    hashes = run_hashes(_LOWER[data[inside]], lengths)
    at = np.cumsum(lengths) - lengths
    small = np.add.reduceat((data[inside] >= 97) & (data[inside] < 123), at, dtype=np.int64)
    large = np.add.reduceat((data[inside] >= 65) & (data[inside] < 91), at, dtype=np.int64)
    first = data[starts]
    shape = np.where((first >= 65) & (first < 91), np.uint64(2), np.uint64(1))
    shape[(large > 1) & (small == 0)] = 3
    shape[kind[starts] == 2] = 4
    signs = kind[starts] == 3
    shape[signs] = hashes[signs] | np.uint64(8)
    same_doc = np.zeros(len(starts), bool)
    same_doc[1:] = doc[1:] == doc[:-1]
    again = np.zeros(len(starts), np.uint64)
    again[1:] = same_doc[1:] & (hashes[1:] == hashes[:-1])
    shape = mix(shape * np.uint64(2) + again)
    before = np.zeros(len(starts), np.uint64)
    before[1:] = np.where(same_doc[1:], shape[:-1], 0)
    grams = np.concatenate([hashes, shape, mix(before * np.uint64(3) + shape)])
    return (mix(grams) % np.uint64(BUCKETS)).astype(np.int64), np.tile(doc, 3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for whole in batches:
        for batch in slices(whole, "text"):
            grams, doc = gram_buckets(batch.column("text"))
            raw += np.bincount(grams, minlength=BUCKETS)
            good = np.asarray(batch.column("good").to_numpy(zero_copy_only=False), bool)
            target += np.bincount(grams[good[doc]], minlength=BUCKETS)
    held = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(held), pa.array(raw[held]), pa.array(target[held])], names=["bucket", "raw", "target"]
    )


def log_ratios(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, with one added to every count.

    `docs` has doc_id and text; `good` the distinct doc_id of at most MOST_LABELLED documents.
    """
    marked = docs.join(F.broadcast(good.withColumn("good", F.lit(True))), "doc_id", "left")  # bounded
    marked = marked.select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = marked.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket")
    rows = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # BUCKETS at most
    sums = np.ones((2, BUCKETS))
    sums[:, rows["bucket"].to_numpy(np.int64)] += rows[["target", "raw"]].to_numpy(float).T
    shares = np.log(sums / sums.sum(axis=1, keepdims=True))
    return shares[0] - shares[1]


def _weigh(batches: Iterator[pa.RecordBatch], ratios) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            grams, doc = gram_buckets(batch.column("text"))
            n = np.bincount(doc, minlength=batch.num_rows)
            total = np.bincount(doc, weights=ratios.value[grams], minlength=batch.num_rows)
            weight = REFERENCE_GRAMS * total / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), batch.column("noise"), pa.array(weight, mask=n == 0)],
                names=["doc_id", "text_key", "noise", "log_weight"],
            )


def best_cut(weights: np.ndarray, good: np.ndarray) -> float | None:
    """The cut with the best mean of both qualities' hit rates, amid its neighbours; None
    without both qualities."""
    if not good.any() or good.all():
        return None
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    below_bad = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    below_good = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    gain = below_bad - below_good
    gain[1:-1][weights[1:] == weights[:-1]] = -1  # equal weights are not parted
    at = int(np.argmax(gain))
    if at in (0, len(weights)):
        return float(weights[0]) if at == 0 else float(np.nextafter(weights[-1], np.inf))
    return float((weights[at - 1] + weights[at]) / 2)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of the column `key`, from counts in ever finer bins."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        width = (high - low) / BINS
        if low + width <= low:
            break
        inside = keys.where(F.col("key").between(low, high))
        bins = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        found = inside.groupBy(bins.alias("bin")).agg(F.count("*"), F.min("key"), F.max("key"))
        above = 0
        for _, n, least, most in sorted(found.collect(), reverse=True):  # BINS rows at most
            if above + n >= k:
                low, high, k = least, most, k - above
                break
            above += n
    return low


def quality_filter(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0
) -> DataFrame:
    """One row per row of `docs`: doc_id, text_key, log_weight, kept. `labels`: doc_id, quality (0 or 1)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    # a draw from (0, 1) that a recomputed task repeats
    draw = (F.pmod(F.xxhash64(F.col(id_col), text, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), (-F.log(-F.log(draw))).alias("noise")
    )
    # an id with contrary labels counts as good
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    marks = materialise(marks, "marks")
    sample = [bounded_sample(marks.where(F.col("good") == g), MOST_LABELLED, "doc_id", seed=seed) for g in (True, False)]
    sample = materialise(sample[0].unionByName(sample[1]), "labelled")
    ratios = spark.sparkContext.broadcast(log_ratios(rows.select("doc_id", "text"), sample.where("good").select("doc_id")))
    kind = dict(rows.dtypes)["doc_id"]
    weighed = materialise(
        rows.mapInArrow(lambda b: _weigh(b, ratios), f"doc_id {kind}, text_key long, noise double, log_weight double"), "weights"
    )
    seen = weighed.where("log_weight IS NOT NULL")
    known = seen.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "good").agg(F.min("log_weight")).toPandas()
    cut = best_cut(known.iloc[:, 2].to_numpy(float), known["good"].to_numpy(bool))
    keyed = seen.select((F.col("log_weight") + F.col("noise")).alias("key"))
    k = seen.where(F.col("log_weight") >= cut).count() if cut is not None else 0
    threshold = kth_largest(keyed, k) if k else None
    in_sample = F.lit(cut is None) if threshold is None else F.col("log_weight") + F.col("noise") >= threshold
    return weighed.select(
        "doc_id", "text_key", "log_weight", F.coalesce(F.col("log_weight").isNotNull() & in_sample, F.lit(False)).alias("kept")
    )
