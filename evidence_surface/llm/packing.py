"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

A document's ids (its tokens, then the end id) are cut into whole windows and pieces of at
most `piece` ids. Whole windows are sequences as they are. The other pieces are dealt to groups of about PIECES_PER_GROUP, by a hash
of each piece's place in a written table, so groups are even whatever the documents. Within a
group every piece starts as a partition of m windows with one filled; the two partitions with
the largest imbalance are merged, fullest windows against emptiest, until one is left. m
starts at the least number that could hold the group and rises by one while the fullest
window exceeds the capacity. Only lengths and checksums are shuffled, unless `with_ids`.

Defined results: a null text is empty, an empty document is the end id alone; each row is a
document of its own, repeated or not; null ids stay null. Other columns do not matter.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidence_surface.llm.common import materialise
from evidence_surface.llm.tokens import encoder_of
from evidence_surface.llm.words import slices

WINDOW = 2048
PIECE = 512
PIECES_PER_GROUP = 512
_TEXT_BYTES = 1 << 19


def differencing(lengths: np.ndarray, m: int) -> tuple[np.ndarray, int]:
    """(window of each length, fullest sum) of the Karmarkar-Karp partition into m windows."""
    n = len(lengths)
    left, right = np.full(2 * n + n * m, -1), np.full(2 * n + n * m, -1)
    heap = []
    for i, x in enumerate(lengths.tolist()):
        sums, nodes = np.zeros(m, np.int64), np.full(m, -1)
        sums[0], nodes[0] = x, i
        heap.append((-x, i, sums, nodes))
    heapq.heapify(heap)
    free, turn = n, n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)
        _, _, b, b_nodes = heapq.heappop(heap)
        sums, other = a + b[::-1], b_nodes[::-1]
        both = np.flatnonzero((a_nodes >= 0) & (other >= 0))
        nodes = np.maximum(a_nodes, other)
        if len(both):
            fresh = np.arange(free, free + len(both))
            left[fresh], right[fresh], nodes[both] = a_nodes[both], other[both], fresh
            free += len(both)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        turn += 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), turn, sums, nodes[order]))
    _, _, sums, nodes = heap[0]
    window = np.full(free, -1)
    window[nodes[nodes >= 0]] = np.flatnonzero(nodes >= 0)
    for node in range(free - 1, n - 1, -1):  # parents have higher numbers
        window[left[node]] = window[right[node]] = window[node]
    return window[:n], int(sums[0])


def windows_of(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; no window exceeds the capacity."""
    m = max(1, -(-int(lengths.sum()) // capacity))
    window, fullest = differencing(lengths, m)
    while fullest > capacity:
        m += 1
        window, fullest = differencing(lengths, m)
    order = np.argsort(window, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, window[order][1:] != window[order][:-1]]
    offset = np.empty(len(lengths), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    return window, offset


def _cuts(n: int, window: int, piece: int) -> list[int]:
    whole = n - n % window
    return [*range(0, whole, window), *range(whole, n, piece), n]


def _pieces(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int, window: int, piece: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(path)
    for whole in batches:
        for batch in slices(whole, "text", _TEXT_BYTES):
            ids, counts = encoder.encode(batch.column("text").to_pylist())
            rows, starts, lengths, crcs, raws, at = [], [], [], [], [], 0
            for row, count in enumerate(counts.tolist()):
                own = np.append(ids[at : at + count], end_id).astype("<u4")
                at += count
                cuts = _cuts(count + 1, window, piece)
                for a, b in zip(cuts, cuts[1:]):
                    raw = own[a:b].tobytes()
                    rows.append(row)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(raw))
                    if with_ids:
                        raws.append(raw)
            which = pa.array(rows, pa.int64())
            arrays = {
                "doc_id": batch.column("doc_id").take(which),
                "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(crcs, pa.int64()),
                "doc_tokens": pa.array((counts + 1)[rows], pa.int64()),
            }
            if with_ids:
                arrays["ids"] = pa.array(raws, pa.binary())
            yield pa.RecordBatch.from_pydict(arrays)


def _pack(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values("piece_id", ignore_index=True)
    window, offset = windows_of(pdf["length"].to_numpy(), capacity)
    sequence = (pdf["group"].to_numpy(np.int64) << 21) | (window << 1) | 1
    return pdf.drop(columns=["piece_id", "group"]).assign(sequence_id=sequence, offset=offset)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    window: int = WINDOW,
    piece: int = PIECE,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and with `with_ids` ids, the piece's ids as little-endian unsigned 32-bit numbers.

    `tokenizer`: path of a vocabulary file that every executor has.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    cut = rows.mapInArrow(lambda b: _pieces(b, tokenizer, end_id, window, piece, with_ids), schema)
    # a row's place in the written files: recomputed tasks give the same
    pieces = materialise(cut, "pieces").withColumn("piece_id", F.monotonically_increasing_id())
    loose = pieces.where(F.col("length") < window)
    groups = max(1, -(-loose.count() // PIECES_PER_GROUP))
    packed = (
        loose.withColumn("group", F.pmod(F.xxhash64("piece_id"), F.lit(groups)).cast("long"))
        .groupBy("group")
        .applyInPandas(lambda pdf: _pack(pdf, window), f"{schema}, sequence_id long, offset long")
    )
    whole = pieces.where(F.col("length") == window).select(
        *[c for c in pieces.columns if c != "piece_id"],
        (F.col("piece_id") * 2).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return whole.unionByName(packed)
