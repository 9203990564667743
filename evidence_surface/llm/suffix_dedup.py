"""Suffix-array dedup: cuts every byte covered by a string of `threshold` bytes that also starts
in a document with a smaller id.

Spark doubles no ranks here. A string's 64-bit fingerprint is paired with that of what follows, at
growing offsets of 1, 2, 4, 8, 16 and LENGTH bytes, in numpy inside the task; it is called its
rank below. Ranking every byte position through Spark would shuffle some 20 times the input in
each round, so positions are sampled, and Spark makes two fixed passes over them: of the strings of LENGTH bytes inside each string of `threshold` bytes
the least in hash order, about one position in 15. Equal strings of `threshold` bytes hold an
equal sample at an equal distance, so no match is lost. Passes:

1. Spark sorts (rank, rank of the context, id) of all samples, the context being the sample and
   all bytes that a string of `threshold` bytes around it can reach. Samples of unique rank end;
   those whose whole context is in an earlier document are covered; those that are first
   with their context, though others share their rank, go on.
2. The latter are ranked again, paired with the bytes before and with the bytes after them;
   Spark sorts (rank, id), and the strings of `threshold` bytes around each are compared.

Whole copies of a text take no part beyond their first. Rows with a context that is also in an
earlier document of the same batch skip the sort, so the inner samples of a passage of a third of
all documents do not meet in one task. Samples near its edges have contexts of their own in each
document, so ranks of more than HOT_ROWS rows are dealt otherwise: in round 1 (where a share of
the documents tells which they are) by rank and context, all of the first with a context going
on; in round 2 (where they are counted) as a row per string of `threshold` bytes, dealt by key
and string, without those that an earlier document of the same batch has. No task gets more of
such a string than a row per batch, and none keeps the strings of a key. Which ranks are dealt so
does not change the result.

Defined results: null text is empty; texts shorter than `threshold` bytes are kept whole; null
ids come after all others; documents of equal id do not cut each other. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from evidence_surface.llm.common import bounded_side, materialise
from evidence_surface.llm.suffix_ranks import (
    BASE,
    ContextStream,
    FirstStream,
    WindowStream,
    anchors,
    base_ranks,
    joined,
    later,
    longer,
    padded,
    paired,
    runs,
)
from evidence_surface.llm.words import buffers, slices

THRESHOLD = 50
LENGTH = 20
HOT_ROWS = 10_000
HOT_SHARE = 64  # one document in so many is read for ranks of more than HOT_ROWS rows
_SLICE = 2 << 20
_PLAIN, _SETTLED, _HOT = range(3)
_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"),
        body.alias("body"),
        F.unhex(F.sha2(body, 256)).alias("sha"),
    )


def _texts(keyed: DataFrame) -> DataFrame:
    """doc, sha, part (numbers the texts of an id that has several), copy (whether an earlier
    document has the whole text)."""
    texts = materialise(keyed.select("doc", "sha").distinct(), "texts")
    firsts = materialise(texts.groupBy("sha").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"), "shared")
    part = F.row_number().over(Window.partitionBy("doc").orderBy("sha")) - 1
    return materialise(
        texts.withColumn("part", part).join(firsts, "sha", "left").select(
            "doc", "sha", "part", F.coalesce(F.col("first") < F.col("doc"), F.lit(False)).alias("copy")
        ),
        "parts",
    )


def _with_part(keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """`keyed` with part; only texts that are not alone with their id are looked up."""
    several = texts.where("part > 0").select("doc", "sha", "part")
    n = several.count()
    if not n:
        return keyed.withColumn("part", F.lit(0))
    return keyed.join(bounded_side(several, n), ["doc", "sha"], "left").withColumn("part", F.coalesce("part", F.lit(0)))


def _column(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


def _samples(batches: Iterator[pa.RecordBatch], threshold: int, length: int, hot=None) -> Iterator[pa.RecordBatch]:
    hot_ranks = np.zeros(0, np.uint64) if hot is None else hot.value
    reach = threshold - length
    for whole in batches:
        for batch in slices(whole, "body", _SLICE):
            texts = padded(*buffers(batch.column("body")), reach)
            row, at, rank = anchors(texts, threshold, length)
            context = longer(texts.ranks, at - reach, threshold + reach)
            doc = batch.column("doc").to_numpy()[row]
            part = batch.column("part").to_numpy()[row]
            # in an earlier document of the batch: settled; its row is dealt out by itself
            settled = later(rank, context, doc)
            place = at - texts.first[row]
            kind = np.where(settled, _SETTLED, np.where(np.isin(rank, hot_ranks), _HOT, _PLAIN))
            rank = np.where(settled, paired(doc.astype(np.uint64), place.astype(np.uint64)), rank)
            yield pa.RecordBatch.from_arrays(
                [_column(rank), _column(context), pa.array(doc), pa.array(part, pa.int32()), pa.array(place, pa.int32()), pa.array(kind, pa.int8())],
                names=["rank", "context", "doc", "part", "at", "kind"],
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted samples: covered ones, and open ones with their rank."""
    stream, hot_stream = ContextStream(), FirstStream()
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        settled, hot, free = kind == _SETTLED, kind == _HOT, kind == _PLAIN
        rank, context, doc, part, at = (batch.column(c).to_numpy() for c in ("rank", "context", "doc", "part", "at"))
        out = [(np.zeros(settled.sum(), np.int64), doc[settled], part[settled], at[settled], np.zeros(settled.sum(), bool))]
        if hot.any():
            behind = hot_stream.feed(rank[hot], context[hot], doc[hot])
            out.append((rank[hot], doc[hot], part[hot], at[hot], ~behind))
        if free.any():
            rank, context, doc, part, at = (x[free] for x in (rank, context, doc, part, at))
            covered, rows = stream.feed(rank, context, doc, part, at)
            out.append((np.zeros(covered.sum(), np.int64), doc[covered], part[covered], at[covered], np.zeros(covered.sum(), bool)))
            out.append((*rows, np.ones(len(rows[0]), bool)))
        columns = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int32, np.int32, bool))],
            names=["rank", "doc", "part", "at", "open"],
        )


def _sides(batches: Iterator[pa.RecordBatch], threshold: int, length: int) -> Iterator[pa.RecordBatch]:
    """Of each open sample two rows: its rank paired with the bytes before it, and with those
    after it, each with the bytes of the strings that hold them, zeros beyond the text."""
    reach = threshold - length
    half = reach // 2  # strings that start more than half before the sample go with the left row
    for whole in batches:
        for batch in slices(whole, "body", _SLICE):
            texts = padded(*buffers(batch.column("body")), threshold + reach)
            lists = batch.column("open")
            many = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), many)
            flat = lists.flatten()
            at = flat.field("at").to_numpy().astype(np.int64)
            rank = flat.field("rank").to_numpy().view(np.uint64)
            base = texts.first[row] + at
            doc, part = batch.column("doc").to_numpy()[row], batch.column("part").to_numpy()[row]
            for side, (lo, hi) in enumerate(((reach, half + 1), (half, 0))):
                # strings that start hi to lo bytes before the sample all hold the bytes [base - hi, base - lo + threshold)
                shared = longer(texts.ranks, base - hi, threshold - lo + hi)
                key = paired(paired(rank, shared), np.full(len(rank), side, np.uint64))
                bytes_of = texts.values[(base - lo)[:, None] + np.arange(threshold + lo - hi)]
                yield pa.RecordBatch.from_arrays(
                    [
                        _column(key),
                        pa.array(doc),
                        pa.array(part, pa.int32()),
                        pa.array(at - lo, pa.int64()),
                        pa.array([x.tobytes() for x in bytes_of.astype("<u2")], pa.binary()),
                    ],
                    names=["key", "doc", "part", "start", "around"],
                )


def _windows(batch: pa.RecordBatch, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places): rank of the string of `threshold` bytes at each place of the rows of `_sides`,
    and whether it is inside the text."""
    raw, offsets = buffers(batch.column("around"))
    sizes = np.diff(offsets) // 2
    width = int(sizes.max())
    values = np.zeros((len(sizes), width), np.uint16)
    filled = np.arange(width) < sizes[:, None]
    values[filled] = raw.view("<u2")
    ranks = base_ranks(values)
    places = width - threshold + 1
    windows = np.stack([longer(ranks, np.array([p]), threshold)[:, 0] for p in range(places)], axis=1)
    gaps = np.concatenate([np.zeros((len(sizes), 1), np.int64), np.cumsum(values == 0, axis=1)], axis=1)
    return windows, gaps[:, threshold:] == gaps[:, :places]


def _matches(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and id: spans of strings that an earlier document holds."""
    stream = WindowStream()
    for whole in batches:
        for batch in slices(whole, "around", _SLICE):
            windows, real = _windows(batch, threshold)
            key, doc, part, start = (batch.column(c).to_numpy() for c in ("key", "doc", "part", "start"))
            row, first, last = runs(stream.feed(key, doc, windows, real))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[row]), pa.array(part[row]), pa.array(start[row] + first), pa.array(start[row] + last + threshold)],
                names=["doc", "part", "start", "stop"],
            )


def _strings(batches: Iterator[pa.RecordBatch], threshold: int, length: int) -> Iterator[pa.RecordBatch]:
    """Of each side of open samples a row per string of `threshold` bytes around it. Strings that
    an earlier document of the batch has are settled: runs of them are a row, dealt out by itself."""
    for whole in _sides(batches, threshold, length):
        for batch in slices(whole, "around", _SLICE):
            windows, real = _windows(batch, threshold)
            key, doc, part, start = (batch.column(c).to_numpy() for c in ("key", "doc", "part", "start"))
            row, place = np.nonzero(real)
            behind = later(key[row], windows[row, place], doc[row])
            mask = np.zeros(real.shape, bool)
            mask[row, place] = behind
            done, first, last = runs(mask)
            row, place = row[~behind], place[~behind]
            lone = paired(doc[done].astype(np.uint64), (start[done] + first).astype(np.uint64)).view(np.int64)
            both = np.concatenate([row, done])
            begin = start[both] + np.concatenate([place, first])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([key[row], lone])),
                    _column(np.concatenate([windows[row, place], np.zeros(len(done), np.uint64)])),
                    pa.array(doc[both]),
                    pa.array(part[both]),
                    pa.array(begin),
                    pa.array(begin + np.concatenate([np.zeros(len(row), np.int64), last - first]) + threshold),
                    pa.array(np.arange(len(both)) >= len(row)),
                ],
                names=["key", "name", "doc", "part", "start", "stop", "settled"],
            )


def _later_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From strings sorted by key, name and id: the spans of those that an earlier document holds."""
    stream = FirstStream()
    for batch in batches:
        out = batch.column("settled").to_numpy(zero_copy_only=False).copy()
        free = ~out
        out[free] = stream.feed(*(batch.column(c).to_numpy()[free] for c in ("key", "name", "doc")))
        yield batch.select(["doc", "part", "start", "stop"]).filter(pa.array(out))


_SPANS = "array<struct<start:long,stop:long>>"


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their part, their distinct texts, spans to cut by doc and part); spans
    may overlap and reach beyond a text's ends, and whole copies have none."""
    if threshold < 2 * BASE:
        raise ValueError(f"the ranks are planned for {2 * BASE} bytes or more")
    length = min(LENGTH, threshold - BASE // 2)
    keyed = _keyed(docs, id_col, text_col)
    texts = _texts(keyed)
    copies = texts.where("copy").select("doc", "sha")
    numbered = _with_part(keyed, texts)
    alone = numbered.join(bounded_side(copies, copies.count()), ["doc", "sha"], "left_anti")
    bodies, kind = alone.select("doc", "part", "body"), "rank long, context long, doc long, part int, at int, kind byte"
    few = bodies.where(F.pmod(F.xxhash64("doc", F.lit(9)), F.lit(HOT_SHARE)) == 0)
    counts = few.mapInArrow(lambda b: _samples(b, threshold, length), kind).where(F.col("kind") == _PLAIN).groupBy("rank").count()
    crowded = counts.where(F.col("count") * HOT_SHARE > HOT_ROWS).select("rank").collect()
    hot = docs.sparkSession.sparkContext.broadcast(np.array([r["rank"] for r in crowded], np.int64).view(np.uint64))
    samples = bodies.mapInArrow(lambda b: _samples(b, threshold, length, hot), kind)
    deal = F.when(F.col("kind") == _HOT, F.xxhash64("rank", "context")).otherwise(F.col("rank"))
    ranked = materialise(
        samples.repartition(deal)
        .sortWithinPartitions("rank", "context", "doc")
        .mapInArrow(_contexts, "rank long, doc long, part int, at int, open boolean"),
        "ranked",
    )
    opened = ranked.where("open").drop("open")
    crowds = materialise(opened.groupBy("rank").count().where(F.col("count") > HOT_ROWS).select("rank"), "crowds")
    n = crowds.count()

    def waiting(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("doc", "part").agg(F.collect_list(F.struct("rank", "at")).alias("open"))
        return numbered.select("doc", "part", "body").join(lists.hint("shuffle_hash"), ["doc", "part"])

    plain = opened.join(bounded_side(crowds, n), "rank", "left_anti") if n else opened
    found = materialise(
        waiting(plain)
        .mapInArrow(lambda b: _sides(b, threshold, length), "key long, doc long, part int, start long, around binary")
        .repartition("key")
        .sortWithinPartitions("key", "doc")
        .mapInArrow(lambda b: _matches(b, threshold), "doc long, part int, start long, stop long"),
        "matches",
    )
    if n:
        strings = waiting(opened.join(bounded_side(crowds, n), "rank", "left_semi")).mapInArrow(
            lambda b: _strings(b, threshold, length),
            "key long, name long, doc long, part int, start long, stop long, settled boolean",
        )
        more = (
            strings.repartition("key", "name")
            .sortWithinPartitions("key", "name", "doc")
            .mapInArrow(_later_strings, "doc long, part int, start long, stop long")
        )
        found = found.unionByName(materialise(more, "crowded_matches"))
    reach = threshold - length
    covered = ranked.where("NOT open").select(
        "doc", "part", (F.col("at") - reach).cast("long").alias("start"), (F.col("at") + threshold).cast("long").alias("stop")
    )
    return numbered, texts, covered.unionByName(found)


def _kept(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {"spans": [], "kept": []}
        copies = batch.column("copy").to_pylist()
        bodies, spans = batch.column("body"), batch.column("spans")
        for i in range(batch.num_rows):
            body = bodies[i].as_py()
            if copies[i]:
                starts, stops = (np.array([0]), np.array([len(body)])) if len(body) >= threshold else (np.zeros(0, int),) * 2
            else:
                own = spans[i].values
                given = (own.field("start").to_numpy(), own.field("stop").to_numpy()) if own is not None else (np.zeros(0, int),) * 2
                starts, stops = joined(np.maximum(given[0], 0), np.minimum(given[1], len(body)))
            edges = [0, *np.stack([starts, stops], axis=1).ravel().tolist(), len(body)]
            rows["kept"].append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])))
            rows["spans"].append([{"start": int(a), "stop": int(b)} for a, b in zip(starts, stops)])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.compute.binary_length(bodies).cast(pa.int64()),
                pa.array(rows["spans"], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                pa.array(rows["kept"], pa.binary()),
            ],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, spans (maximal runs of cut bytes), kept (bytes)."""
    numbered, texts, found = repeated_spans(docs, id_col, text_col, threshold)
    spans = found.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    copies = texts.where("copy").select("doc", "part", F.lit(True).alias("copy"))
    marks = spans.join(copies, ["doc", "part"], "full").select("doc", "part", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    marks = materialise(marks, "marks")
    rows = numbered.select("doc_id", "doc", "part", "body").join(marks.hint("shuffle_hash"), ["doc", "part"], "left").select(
        "doc_id", "body", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("copy", F.lit(False)).alias("copy")
    )
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(lambda b: _kept(b, threshold), f"doc_id {kind}, n_bytes long, spans {_SPANS}, kept binary")
