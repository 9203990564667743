"""Terms of texts, counted inside tasks: numpy over the Arrow buffers, exact strings.

A term is a longest stretch of ASCII letters and characters beyond ASCII, A-Z in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evidence_surface.llm.fuse import mix
from evidence_surface.llm.spans import LETTERS, LOWER, spans, strings
from evidence_surface.llm.words import buffers, ragged, slices

END = b"\x00"  # after a complete term; no term holds it
SLICE_BYTES = 4 << 20
_HELD_ROWS = 800_000


def _pairs(batch: pa.RecordBatch, key: str) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Distinct (key, term) of a slice as codes key * terms + term with the number of times, by
    document: document, code, terms, times."""
    data, offsets = buffers(batch.column("text"))
    inside = LETTERS[data]
    at, lengths = spans(inside, offsets)
    coded = strings(LOWER[data], inside, lengths).dictionary_encode()
    doc = np.repeat(np.arange(batch.num_rows), np.diff(np.searchsorted(at, offsets)))
    n = max(len(coded.dictionary), 1)
    both, times = np.unique(doc * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    doc, term = both // n, both % n
    keys = batch.column(key).to_numpy(zero_copy_only=False)
    return doc, keys[doc] * n + term, coded.dictionary, times


def group_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """group, term, n: occurrences, added up over a task as long as few enough rows are held."""
    held: list[pa.Table] = []

    def added() -> pa.Table:
        whole = pa.concat_tables(held).group_by(["group_id", "term"]).aggregate([("n", "sum")])
        return whole.rename_columns({"n_sum": "n"}).select(["group_id", "term", "n"])

    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            _, code, terms, times = _pairs(batch, "group_id")
            if not len(code):
                continue
            code, of = np.unique(code, return_inverse=True)
            n = np.bincount(of, weights=times).astype(np.int64)
            term = terms.take(pa.array(code % len(terms)))
            held.append(pa.table({"group_id": code // len(terms), "term": term.cast(pa.string()), "n": n}))
            if sum(t.num_rows for t in held) > _HELD_ROWS:
                held = [added()]
                if held[0].num_rows > _HELD_ROWS // 2:
                    yield from held.pop().to_batches(1 << 16)
    if held:
        yield from added().to_batches(1 << 16)


def _first_documents(rows: pa.Table, most: int) -> pa.Table:
    """lang_id, term, doc: of each term of a language the first `most` rows, terms together."""
    coded = rows.column("term").combine_chunks().dictionary_encode()
    code = rows.column("lang_id").to_numpy() * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    size = np.diff(np.flatnonzero(np.diff(code[order], prepend=-1)), append=len(code))
    return rows.take(pa.array(order[ragged(size) < most]))


def _with_documents(rows: pa.Table) -> pa.RecordBatch:
    """A row per term of a language, from rows that hold its documents one after the other."""
    lang, number = rows.column("lang_id").to_numpy(), rows.column("doc").to_numpy()
    term = rows.column("term").combine_chunks()
    code = term.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new = np.ones(len(lang), bool)
    new[1:] = (lang[1:] != lang[:-1]) | (code[1:] != code[:-1])
    head = np.flatnonzero(new)
    bit = np.uint64(1) << (mix(number.view(np.uint64)) % np.uint64(64))
    ended = pc.binary_join_element_wise(term.take(pa.array(head)).cast(pa.binary()), pa.scalar(END), pa.scalar(b""))
    docs = pa.ListArray.from_arrays(pa.array(np.append(head, len(lang)), pa.int32()), pa.array(number))
    return pa.RecordBatch.from_arrays(
        [pa.array(lang[head]), ended, docs, pa.array(np.bitwise_or.reduceat(bit, head).view(np.int64))],
        names=["lang_id", "term", "docs", "seen"],
    )


def term_documents(batches: Iterator[pa.RecordBatch], partition: int, most: int) -> Iterator[pa.RecordBatch]:
    """lang_id, term with END, docs, seen: per term of a language up to `most` of the task's
    documents, numbered, and a word of 64 bits with the bit of each set. A task of very many
    terms gives a term more than once, with other documents."""
    before, held = 0, []

    def given(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = _with_documents(rows)
        for at in range(0, batch.num_rows, 1 << 16):
            yield batch.slice(at, 1 << 16)

    for whole in batches:
        for batch in slices(whole, "text", SLICE_BYTES):
            doc, code, terms, _ = _pairs(batch, "lang_id")
            if len(code):
                term = terms.take(pa.array(code % len(terms))).cast(pa.string())
                rows = {"lang_id": code // len(terms), "term": term, "doc": (partition << 40) + before + doc}
                held.append(_first_documents(pa.table(rows), most))
            before += batch.num_rows
            if sum(t.num_rows for t in held) > _HELD_ROWS:
                held = [_first_documents(pa.concat_tables(held), most)]
                if held[0].num_rows > _HELD_ROWS // 2:
                    yield from given(held.pop())
    if held:
        yield from given(_first_documents(pa.concat_tables(held), most))
