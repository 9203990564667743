"""Substring dedup by hashing units of text: of equal units in the whole table the
earliest stays, in the order of document id, then place; the others are cut out.

Units are lines, paragraphs, or sentences of lines. A sentence ends with a word that ends in
`.`, `!` or `?`; sentences join the next one of their line until they have
`JOINED_WORDS` words together, and what is left at a line's end joins the unit before it. So
every word is in a unit, a short line is one, and a passage that begins or ends inside a line
is met by the sentences that it holds whole.

A unit is normalised before hashing: ASCII letters in lower case, white space runs as one
space. Every unit with a word counts, unless a larger `least_words` is given: units of fewer
words are then left alone. Spans are byte offsets in the original UTF-8 text and hold the unit
with the line ends after it.

Only (digest, id, place) rows are shuffled to find the first occurrences; a digest's rows are
reduced to one per task before that. The join back is an ordinary one on the digest, so a
line that a third of all documents hold is split by adaptive execution.

Defined results: null text is empty; null ids come first; rows that repeat an id and a text
are one document, so what is first in it stays in each of them. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidence_surface.llm.common import materialise
from evidence_surface.llm.fuse import mix
from evidence_surface.llm.words import Words, run_hashes, slices, words

LEAST_WORDS = 1
JOINED_WORDS = 8
UNITS = ("line", "paragraph", "sentence")
_NEWLINE = 10
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[*b".!?"]] = True


def _sentence_edges(w: Words, lines: np.ndarray) -> np.ndarray:
    """Starts of the sentences that begin units inside lines, which start at `lines`."""
    first = np.searchsorted(w.starts, lines)  # word that each line starts with
    ends = np.flatnonzero(_SENTENCE_END[w.data[w.ends - 1]]) + 1
    line = np.searchsorted(first, ends, "right") - 1
    inner = first[line] < ends  # the next word is in the same line
    ends, line = ends[inner], line[inner]
    ends, line = ends[ends < len(w.starts)], line[ends < len(w.starts)]
    chosen, held, of = [], 0, -1
    after = np.append(first[1:], len(w.starts))
    for word, own, begin, stop in zip(ends.tolist(), line.tolist(), first[line].tolist(), after[line].tolist()):
        if own != of:
            held, of = begin, own
        if word - held >= JOINED_WORDS and stop - word >= JOINED_WORDS:
            chosen.append(word)
            held = word
    return w.starts[chosen] if chosen else w.starts[:0]


def _unit_edges(w: Words, unit: str) -> np.ndarray:
    """Byte offsets where units start, with the end of the data."""
    newline = w.data == _NEWLINE
    if unit == "sentence":
        lines = np.unique(np.concatenate([w.offsets, np.flatnonzero(newline) + 1]))
        return np.union1d(lines, _sentence_edges(w, lines[:-1]))
    if unit == "paragraph":  # a unit ends after the last of two or more newlines
        two = np.zeros(len(newline), bool)
        two[1:] = newline[1:] & newline[:-1]
        following = np.append(newline[1:], False)
        newline = two & ~following
    return np.unique(np.concatenate([w.offsets, np.flatnonzero(newline) + 1]))


def _units(batches: Iterator[pa.RecordBatch], least_words: int, unit: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            w = words(batch.column("text"))
            edges = _unit_edges(w, unit)
            first = np.searchsorted(w.starts, edges)
            counts = np.diff(first)
            held = counts >= max(least_words, 1)
            inside = np.repeat(held, counts)
            low = run_hashes(w.hashes[first[0] : first[-1]][inside], counts[held])
            high = run_hashes(mix(w.hashes[first[0] : first[-1]][inside] + np.uint64(77)), counts[held])
            start, stop = edges[:-1][held], edges[1:][held]
            doc = np.searchsorted(w.offsets, start, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    batch.column("text_key").take(pa.array(doc)),
                    pa.array(start - w.offsets[doc]),
                    pa.array(stop - w.offsets[doc]),
                    pa.array(low.view(np.int64)),
                    pa.array(high.view(np.int64)),
                ],
                names=["doc_id", "text_key", "start", "stop", "low", "high"],
            )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def repeated_units(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "line",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """doc_id, text_key, spans: the units to cut from each document that has any, in order.
    `unit` is `line`, `paragraph` or `sentence`."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    keyed = _keyed(docs, id_col, text_col)
    kind = dict(keyed.dtypes)["doc_id"]
    units = materialise(
        keyed.mapInArrow(
            lambda batches: _units(batches, least_words, unit),
            f"doc_id {kind}, text_key long, start long, stop long, low long, high long",
        ),
        "units",
    )
    rank = F.struct("doc_id", "text_key", "start")
    firsts = units.groupBy("low", "high").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
    # written, so that the join deals both sides anew and a hot digest's rows can be split
    firsts = materialise(firsts.where(F.col("first") != F.col("last")).drop("last"), "firsts")
    again = units.join(firsts, ["low", "high"]).where(rank > F.col("first"))
    spans = F.array_sort(F.collect_set(F.struct("start", "stop")))  # repeated rows give a span twice
    return again.groupBy("doc_id", "text_key").agg(spans.alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed = [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw, at, parts = text.encode(), 0, []
            for s in spans or ():
                parts.append(raw[at : s["start"]])
                at = s["stop"]
            parts.append(raw[at:])
            kept.append(b"".join(parts))
            removed.append(len(raw) - len(kept[-1]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("spans"),
                pa.array(removed, pa.int64()),
                pa.array([k.decode() for k in kept], pa.string()),
            ],
            names=["doc_id", "spans", "n_removed", "kept_text"],
        )


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "line",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """One row per row of `docs`: doc_id, spans (cut, byte offsets), n_removed bytes, kept_text."""
    keyed = _keyed(docs, id_col, text_col)
    cuts = materialise(repeated_units(docs, id_col, text_col, unit, least_words), "cuts")
    cuts = cuts.withColumnRenamed("doc_id", "cut_id").withColumnRenamed("text_key", "cut_key")
    same = F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("text_key") == F.col("cut_key"))
    empty = F.array().cast("array<struct<start:long,stop:long>>")
    joined = keyed.join(cuts.hint("shuffle_hash"), same, "left").select(
        "doc_id", "text", F.coalesce("spans", empty).alias("spans")
    )
    kind = dict(joined.dtypes)["doc_id"]
    return joined.mapInArrow(
        _cut, f"doc_id {kind}, spans array<struct<start:long,stop:long>>, n_removed long, kept_text string"
    )
