"""Periodic runs of words in each document, found on a Re-Pair grammar of its word ids.

A run is a stretch of consecutive words with smallest period q (words q apart are identical)
and a length of at least max(6, 4 q), which no neighbouring word extends keeping the period.
Words are what stands between ASCII white space, compared byte by byte, case included. See
`repair.py` for the method.

Each task takes its documents in slices of about 1 MB of text; nothing is shuffled. A longer
text is a slice of its own, so memory is bounded by the longest text, not by the table.

Defined results: null and empty texts have no words, no runs and an empty collapsed text.
Null ids, repeated ids and repeated rows are rows like any other: one row out per row in.
Other columns do not matter, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from evidence_surface.llm.repair import runs
from evidence_surface.llm.spans import SPACES, spans, strings
from evidence_surface.llm.words import buffers, ragged, slices

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "array<struct<start:long,length:long,period:long>>"


def _slice_runs(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    data, offsets = buffers(texts)
    inside = ~SPACES[data]
    at, lengths = spans(inside, offsets)
    words = strings(data, inside, lengths)
    first = np.searchsorted(at, offsets)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start, stop, period = runs(codes.astype(np.int64), first)
    dropped = np.zeros(len(at) + 1, np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, stop, -1)
    kept = np.cumsum(dropped[:-1]) == 0
    if not kept.all():
        words = words.filter(pa.array(kept))
    edges = np.concatenate([[0], np.cumsum(kept)])[first]
    lists = pa.LargeListArray if pa.types.is_large_string(words.type) else pa.ListArray
    kind = pa.int64() if lists is pa.LargeListArray else pa.int32()
    collapsed = pc.binary_join(lists.from_arrays(pa.array(edges, kind), words), " ")
    of = np.searchsorted(start, first)
    doc = np.searchsorted(first, start, "right") - 1
    found = pa.StructArray.from_arrays(
        [pa.array(start - first[doc]), pa.array(stop - start), pa.array(period)], fields=list(_RUN)
    )
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(np.diff(first).astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(of, pa.int32()), found),
            collapsed.cast(pa.string()),
        ],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            yield _slice_runs(batch.column("doc_id"), batch.column("text"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (start and period in words, by start, then period) and the
    text collapsed: its words joined by one space, without those after a run's first period."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_found, f"doc_id {kind}, n_words long, runs {_RUNS}, collapsed string")


def greatest_run(found: Column) -> Column:
    """Of an array of runs the one of the greatest length / period; ties by start, then period."""
    empty = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def better(a: Column, b: Column) -> Column:
        more = b["length"] * a["period"] - a["length"] * b["period"]
        first = F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"])
        return F.when(a.isNull() | (more > 0) | ((more == 0) & first), b).otherwise(a)

    return F.aggregate(found, empty, better)


def run_lines(found: Column) -> Column:
    """Every run as `start,length,period` and a line feed."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(found, line), "")


def planted_repeats(id_col: Column, text: Column) -> Column:
    """Texts of which one in ten, by a hash of the id, goes round from some word on.

    With h the CRC-32 of the decimal id and n > 0 words: if h ends in 0, each word i >= a becomes
    the original word a + (i - a) mod p, for g = h div 10, a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8). A null id leaves the text alone.
    """
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        source = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, source(i))), " ")

    some = (h % 10 == 0) & (F.size(words) > 0)
    once = F.transform(F.array(words), repeated)[0]  # the words are split once
    return F.when(some, once).otherwise(text)
