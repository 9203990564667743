"""The structure of JSON text read in pieces, by tasks that do not know what comes before.

Text comes in rows that end before a `}`, as the text reader cuts it. A few rows make a chunk.
A chunk begins after a `}`, so no escape reaches into it, but it may begin inside a string
and at any depth. `summarise` says how a chunk changes both, for either case; once these are
added up over a file, `cut` knows where each chunk begins and gives the objects in it that are
elements of the root's arrays, or the parts of those that go on into other chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

QUOTE, BACKSLASH, COMMA, COLON = b'"\\,:'
_OPEN, _CLOSE = np.zeros(256, np.int8), np.zeros(256, np.int8)
_OPEN[[*b"{["]] = 1
_CLOSE[[*b"}]"]] = 1
_STEP = _OPEN - _CLOSE
_STRUCTURE = (_OPEN | _CLOSE).astype(bool)
_STRUCTURE[[COMMA, COLON]] = True

# kinds of rows that `cut` gives
SUMMARY, WHOLE, HEAD, TAIL, MIDDLE = range(5)


def _structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes that begin or end strings; those of brackets, commas and colons, each
    with the number of quotes before it."""
    quotes = np.flatnonzero(data == QUOTE)
    slash = data == BACKSLASH
    if slash.any():
        plain = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
        before = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], -1)
        run = np.where(quotes > 0, quotes - 1 - before, 0)
        quotes = quotes[run % 2 == 0]
    marks = np.flatnonzero(_STRUCTURE[data])
    return quotes, marks, np.searchsorted(quotes, marks)


def _joined(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows with the `}` that the reader took off, one after the other, and where each ends."""
    values = values.cast(pa.large_string())
    edges = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = values.buffers()[2]
    text = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    text = text[edges[0] : edges[-1]]
    ends = edges[1:] - edges[0] + np.arange(1, len(values) + 1)
    out = np.full(len(text) + len(values), ord("}"), np.uint8)
    kept = np.ones(len(out), bool)
    kept[ends - 1] = False
    out[kept] = text
    return out, ends


def summarise(chunk_bytes: int):
    """Rows (value, file, block) to chunks of about `chunk_bytes`: file, block, chunk, body, whether
    it has an odd number of quotes, by how much it deepens if it begins outside or inside of a
    string, and the first sign that is no white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = (None, None), 0
        for batch in batches:
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            data, ends = _joined(batch.column("value"))
            at = begin = 0
            rows = []
            while at < len(ends):
                key = (files[at], blocks[at])
                number = number if key == held else 0
                held, upto = key, at + 1
                while upto < len(ends) and (files[upto], blocks[upto]) == key and ends[upto] - begin <= chunk_bytes:
                    upto += 1
                body = data[begin : ends[upto - 1]]
                quotes, marks, seen = _structure(body)
                step = _STEP[body[marks]]
                text = body.tobytes()
                rows.append(
                    {
                        "file": key[0],
                        "block": key[1],
                        "chunk": number,
                        "body": text.decode(),
                        "odd": len(quotes) % 2,
                        "outside": int(step[seen % 2 == 0].sum()),
                        "inside": int(step[seen % 2 == 1].sum()),
                        "first": text.removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1"),
                    }
                )
                number += 1
                at, begin = upto, int(ends[upto - 1])
            yield pa.RecordBatch.from_pylist(rows, SUMMARY_SCHEMA)

    return run


SUMMARY_SCHEMA = pa.schema(
    [
        ("file", pa.string()),
        ("block", pa.int64()),
        ("chunk", pa.int32()),
        ("body", pa.string()),
        ("odd", pa.int32()),
        ("outside", pa.int64()),
        ("inside", pa.int64()),
        ("first", pa.string()),
    ]
)
SUMMARY_COLUMNS = "file string, block long, chunk int, body string, odd int, outside long, inside long, first string"
PARTS_SCHEMA = pa.schema(
    [
        ("file", pa.string()),
        ("block", pa.int64()),
        ("chunk", pa.int32()),
        ("kind", pa.int32()),
        ("member", pa.string()),
        ("at", pa.int64()),
        ("text", pa.string()),
    ]
)
PARTS_COLUMNS = "file string, block long, chunk int, kind int, member string, at long, text string"


def _member(body: bytes, quotes: np.ndarray, colon: int, in_string: int) -> str:
    """The key before a colon, if the chunk holds all of it."""
    before = int(np.searchsorted(quotes, colon))
    if before < 2 or (before + in_string) % 2:
        return ""
    return body[quotes[before - 2] + 1 : quotes[before - 1]].decode()


def _cut_chunk(body: bytes, in_string: int, depth: int) -> list[tuple]:
    """(kind, member, at, text): see `cut`."""
    data = np.frombuffer(body, np.uint8)
    quotes, marks, seen = _structure(data)
    marks = marks[(seen + in_string) % 2 == 0]
    sign = data[marks]
    step = _STEP[sign].astype(np.int64)
    after = depth + np.cumsum(step)
    opens = np.flatnonzero((step == 1) & (after == 2))
    members = []
    for i in opens.tolist():
        named = sign[i] == ord("[") and i > 0 and sign[i - 1] == COLON
        members.append(_member(body, quotes, int(marks[i - 1]), in_string) if named else "")
    comma = np.concatenate([[0], np.cumsum((sign == COMMA) & (after == 2))])  # before each mark
    starts = np.flatnonzero((sign == ord("{")) & (after == 3))
    ends = np.flatnonzero((sign == ord("}")) & (after == 2))
    within = np.searchsorted(opens, starts)  # arrays that the chunk has opened before each start
    base = np.concatenate([[0], comma[opens]])[within]
    member = [members[w - 1] if w else None for w in within.tolist()]
    at = (comma[starts] - base).tolist()
    rows = [(SUMMARY, members[-1] if members else None, int(comma[-1] - (comma[opens[-1]] if members else 0)), None)]
    begin, end = marks[starts].tolist(), (marks[ends] + 1).tolist()
    if end and (not begin or end[0] <= begin[0]):
        rows.append((HEAD, None, None, body[: end.pop(0)].decode()))
    elif depth >= 3 and not begin:
        rows.append((MIDDLE, None, None, body.decode()))
    for i, e in enumerate(end):
        rows.append((WHOLE, member[i], at[i], body[begin[i] : e].decode()))
    if len(begin) > len(end):
        rows.append((TAIL, member[-1], at[-1], body[begin[-1] :].decode()))
    return rows


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (file, block, chunk, body, in_string, depth) to rows of these kinds.

    WHOLE: an object that is an element of one of the root's arrays, with the array's member name
    and its place in the array. TAIL: the begin of such an object, HEAD the end, MIDDLE a chunk
    inside of one. If the array was opened before the chunk, member is null and the place is
    counted from the chunk's start. SUMMARY: the array open at the chunk's end, null if it was open
    at the start, and the places passed in it.
    """
    for batch in batches:
        for row in batch.to_pylist():
            parts = _cut_chunk(row["body"].encode(), row["in_string"], row["depth"])
            kind, member, at, text = zip(*parts)
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["file"]] * n),
                    pa.array([row["block"]] * n),
                    pa.array([row["chunk"]] * n, pa.int32()),
                    pa.array(kind, pa.int32()),
                    pa.array(member, pa.string()),
                    pa.array(at, pa.int64()),
                    pa.array(text, pa.string()),
                ],
                schema=PARTS_SCHEMA,
            )
