"""Benchmark decontamination with spaced seeds.

Tokens are runs of ASCII letters, digits and non-ASCII bytes, in lower case. A window of SPAN
tokens of a document overlaps a benchmark item if it equals a window of the item in all but
at most MOST_SUBSTITUTED places. The masks of `masks()` each ignore half of the places and
are laid out so that every such pair of windows agrees on all kept places of at least one
mask: hits of any mask are candidates, and each is verified token by token. Items shorter
than SPAN are one window with masks of their length and a tolerance in proportion: one
substitution from 6 tokens on, none below.

Test items are a query set that is met in blocks of about SEEDS_PER_BLOCK hashes, each
sent to the tasks that read the documents; documents are never shuffled. Every block is
scanned against all documents, so any number of items gives the same rows. One block after the
other: its overlaps are written and the block is released before the next one is read, so what
the driver and a task hold does not grow with the items.

Defined results: null texts have no tokens and overlap nothing; equal items are all named;
each row of the documents gives one row, repeated or not. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidence_surface.llm.common import materialise
from evidence_surface.llm.fuse import mix
from evidence_surface.llm.words import Words, ragged, slices, words

SPAN = 12
MOST_SUBSTITUTED = 2
SEEDS_PER_BLOCK = 2_000_000
PAIRS_AT_ONCE = 500_000
_TABLE_BITS = 22


def masks(span: int = SPAN, substituted: int = MOST_SUBSTITUTED) -> list[list[int]]:
    """Kept places of each mask: places fall into substituted + 2 classes by turns, and a mask
    ignores as many classes as there may be substitutions."""
    classes = substituted + 2
    return [
        [i for i in range(span) if i % classes not in ignored]
        for ignored in combinations(range(classes), substituted)
    ]


def most_substituted(length: int) -> int:
    return MOST_SUBSTITUTED * length // SPAN


def _weights(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def _window_starts(w: Words, length: int) -> np.ndarray:
    each = np.maximum(np.diff(w.first) - length + 1, 0)
    return np.repeat(w.first[:-1], each) + ragged(each)


def _seed_hashes(hashes: np.ndarray, starts: np.ndarray, kept: list[int]) -> np.ndarray:
    out, weights = np.zeros(len(starts), np.uint64), _weights(max(kept) + 1)
    with np.errstate(over="ignore"):
        for i in kept:
            out += hashes[starts + i] * weights[i]
    return mix(out)


class Seeds:
    """Sorted seed hashes of a block of items, for each window length and mask."""

    def __init__(self, texts: list[str]):
        self.words = words(pa.array(texts, pa.string()), "not_alnum")
        counts = np.diff(self.words.first)
        self.tables = []
        for kept in masks():
            self._add(SPAN, kept, _window_starts(self.words, SPAN))
        for short in sorted({int(c) for c in counts if 0 < c < SPAN}):
            for kept in masks(short, most_substituted(short)):
                self._add(short, kept, self.words.first[:-1][counts == short])

    def _add(self, length: int, kept: list[int], starts: np.ndarray) -> None:
        if len(starts):
            hashes = _seed_hashes(self.words.hashes, starts, kept)
            order = np.argsort(hashes, kind="stable")
            held = np.zeros(1 << _TABLE_BITS, bool)
            held[hashes >> np.uint64(64 - _TABLE_BITS)] = True
            self.tables.append((length, kept, hashes[order], starts[order], held))

    def overlaps(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, first token in the document) of all windows that overlap."""
        found = []
        for length, kept, hashes, places, held in self.tables:
            starts = _window_starts(w, length)
            if not len(starts):
                continue
            own = _seed_hashes(w.hashes, starts, kept)
            likely = np.flatnonzero(held[own >> np.uint64(64 - _TABLE_BITS)])
            low = np.searchsorted(hashes, own[likely], "left")
            many = np.searchsorted(hashes, own[likely], "right") - low
            likely, low, many = likely[many > 0], low[many > 0], many[many > 0]
            group = np.cumsum(many) // PAIRS_AT_ONCE
            for g in np.unique(group):
                which = group == g
                at = np.repeat(starts[likely[which]], many[which])
                place = places[np.repeat(low[which], many[which]) + ragged(many[which])]
                steps = np.arange(length)
                equal = (w.hashes[at[:, None] + steps] == self.words.hashes[place[:, None] + steps]).sum(axis=1)
                ok = equal >= length - most_substituted(length)
                found.append(np.unique(np.stack([at[ok], np.searchsorted(self.words.first, place[ok], "right") - 1]), axis=1))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        at, item = np.unique(np.concatenate(found, axis=1), axis=1)
        doc = np.searchsorted(w.first, at, "right") - 1
        return doc, item, at - w.first[doc]


def _scan(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """One row per document that any item of the block overlaps."""
    ids, texts = sent.value
    seeds, ids = Seeds(texts), pa.array(ids)
    for whole in batches:
        for batch in slices(whole, "text"):
            doc, item, at = seeds.overlaps(words(batch.column("text"), "not_alnum"))
            docs, first = np.unique(doc, return_index=True)
            if not len(docs):
                continue
            edges = [*first, len(doc)]
            rows = [slice(a, b) for a, b in zip(edges, edges[1:])]
            items = [np.unique(item[r]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(docs)),
                    batch.column("text_key").take(pa.array(docs)),
                    pa.ListArray.from_arrays(
                        np.cumsum([0, *map(len, items)]).astype(np.int32), ids.take(pa.array(np.concatenate(items)))
                    ),
                    pa.array([np.unique(at[r]) for r in rows], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "item_ids", "windows"],
            )


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, each pair once, a bounded block at a time."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = materialise(items.distinct(), "items")
    # a token and the gap after it take two bytes at least
    seeds = items.agg(F.sum(F.octet_length("text") / 2 * len(masks()))).first()[0] or 0
    blocks = int(seeds // SEEDS_PER_BLOCK) + 1
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def overlapping(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, text_key, item_ids, windows of the documents that overlap any item.

    item_ids: the items, in order. windows: first tokens of the windows that overlap.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col)
    kind, item_kind = dict(keyed.dtypes)["doc_id"], dict(benchmark.dtypes)[item_col]
    schema = f"doc_id {kind}, text_key long, item_ids array<{item_kind}>, windows array<long>"
    found = []
    for ids, texts in _blocks(benchmark, item_col, item_text_col):
        sent = spark.sparkContext.broadcast((ids, texts))
        scanned = keyed.mapInArrow(lambda batches, sent=sent: _scan(batches, sent), schema)
        found.append(materialise(scanned, "block_overlaps"))
        sent.destroy()
    both = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("item_ids", "windows")]
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "text_key").agg(*both)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text_key, contaminated, item_ids, windows, kept."""
    keyed = _keyed(docs, id_col, text_col).select("doc_id", "text_key")
    hits = materialise(overlapping(docs, benchmark, id_col, text_col), "overlaps")
    hits = hits.withColumnsRenamed({"doc_id": "hit_id", "text_key": "hit_key"})
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    return keyed.join(hits, same, "left").select(
        "doc_id",
        "text_key",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast(dict(hits.dtypes)["item_ids"])).alias("item_ids"),
        F.coalesce("windows", F.array().cast("array<long>")).alias("windows"),
        F.col("item_ids").isNull().alias("kept"),
    )
