import random

import numpy as np
import pytest

from evidence_surface.llm import suffix_dedup as s
from evidence_surface.llm.suffix_ranks import ContextStream, FirstStream, joined
from plain import odd_texts

SCHEMA = "doc_id long, text string, doc string, kept int"


def expected(rows, threshold):
    """rows: (id, text) -> list of (n_bytes, spans, kept) in the order of rows."""
    least = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - threshold + 1):
            key, doc_ = raw[i : i + threshold], float("inf") if doc is None else doc
            least[key] = min(least.get(key, doc_), doc_)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        cut = np.zeros(len(raw) + 2, int)
        for i in range(len(raw) - threshold + 1):
            if least[raw[i : i + threshold]] < (float("inf") if doc is None else doc):
                cut[i + 1 : i + 1 + threshold] = 1
        step = np.diff(cut)
        spans = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))
        out.append((len(raw), spans, bytes(b for b, c in zip(raw, cut[1:]) if not c)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "ément", "x", "ingtion", "aaaa", "stone"]) + str(rng.randrange(30))
    passage = [" ".join(word() for _ in range(n)) for n in (6, 9, 12, 30)]
    texts = []
    for i in range(70):
        own = " ".join(word() for _ in range(rng.randrange(1, 60)))
        p = rng.choice(passage)
        at, k = rng.randrange(len(own) + 1), rng.randrange(0, 4)
        texts.append(own[:at] + p[k : len(p) - rng.randrange(0, 4)] + own[at:])
        if i % 5 == 0:  # a near copy
            near = list(texts[-1])
            for _ in range(rng.randrange(0, 4)):
                near[rng.randrange(len(near))] = "#"
            texts.append("".join(near))
        if i % 9 == 0:
            texts.append(texts[-1])
    return texts + ["ab" * 60, "ba" * 70, "a" * 300, "a" * 49, "a" * 50, "b" * 51 + "c", "b" * 50] + odd_texts()[:8]


def by_row(rows):
    return sorted((str(r["doc_id"]), r["n_bytes"], [(x["start"], x["stop"]) for x in r["spans"]], bytes(r["kept"])) for r in rows)


@pytest.mark.parametrize("threshold,batch", [(50, 10_000), (50, 7), (36, 10_000)])
def test_against_plain(spark, threshold, batch):
    texts = corpus(threshold + batch)
    rng = random.Random(1)
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = by_row(s.suffix_dedup(docs, threshold=threshold).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    want = expected(rows, threshold)
    assert sum(len(w[1]) for w in want) > 40
    assert got == sorted((str(i), *w) for (i, _), w in zip(rows, want))


def test_ties_nulls_and_empty_table(spark):
    long = "some passage of more than fifty bytes in all, to be sure"
    rows = [(4, long), (4, long), (4, "x" + long), (None, long), (None, "y" + long), (2, long[1:]), (9, "z" + long + "z"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(s.suffix_dedup(docs).collect()) == sorted((str(i), *w) for (i, _), w in zip(rows, expected(rows, 50)))
    assert s.suffix_dedup(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    base = odd_texts()[8]
    rows = [(1, base), (2, base[1000:200_000]), (3, "q" + base[5:])]
    got = {r["doc_id"]: r for r in s.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_bytes"] == len(base.encode()) and bytes(got[1]["kept"]) == base.encode() and not got[1]["spans"]
    assert bytes(got[2]["kept"]) == b"" and bytes(got[3]["kept"]) == b"q"


def test_context_stream_is_the_same_in_any_batches():
    rng = np.random.default_rng(4)
    n = 400
    rows = np.stack([np.sort(rng.integers(0, 40, n)), rng.integers(0, 3, n), rng.integers(0, 6, n)])
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]

    def run(size):
        stream, covered, opened = ContextStream(), [], []
        for a in range(0, n, size):
            r, c, d = rows[:, a : a + size]
            mask, found = stream.feed(r, c, d, np.zeros_like(d), np.arange(a, a + len(r)))
            covered.append(mask)
            opened += found[3].tolist()
        return np.concatenate(covered).tolist(), sorted(opened)

    assert run(n) == run(1) == run(7) == run(33)


def test_joined():
    a, b = joined(np.array([5, 0, 7, 20]), np.array([8, 3, 9, 21]))
    assert a.tolist() == [0, 5, 20] and b.tolist() == [3, 9, 21]


@pytest.mark.parametrize("share,batch", [(1, 10_000), (1, 5), (10_000, 7)])
def test_crowded_ranks(spark, monkeypatch, share, batch):
    """The same result if ranks are dealt by context and by string."""
    monkeypatch.setattr(s, "HOT_ROWS", 8)
    monkeypatch.setattr(s, "HOT_SHARE", share)
    texts = corpus(5) + [f"{i * 7919:040d} in front, then the passage all of them hold, of ninety bytes or so, and then {i * 104729:040d}" for i in range(60)]
    rng = random.Random(2)
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = by_row(s.suffix_dedup(docs).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert got == sorted((str(i), *w) for (i, _), w in zip(rows, expected(rows, 50)))


def test_crowded_key_is_not_kept_by_one_task(spark, monkeypatch):
    """Documents that share a passage with own bytes around it: none of its keys goes to WindowStream."""
    monkeypatch.setattr(s, "HOT_ROWS", 8)
    plain = s._matches
    texts = [f"{i * 7919:040d} in front, then the passage all of them hold, of ninety bytes or so, and then {i * 104729:040d}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    most = spark.sparkContext.accumulator(0)

    def watched(batches, threshold):
        def seen():
            for b in batches:
                most.add(b.num_rows)
                yield b

        yield from plain(seen(), threshold)

    monkeypatch.setattr(s, "_matches", watched)
    got = by_row(s.suffix_dedup(docs).collect())
    assert got == sorted((str(i), *w) for (i, _), w in zip(enumerate(texts), expected(list(enumerate(texts)), 50)))
    assert sum(len(r[2]) for r in got) == 59
    assert most.value < 60, "rows of a crowded key went to the task that keeps a key's strings"


def test_first_stream_is_the_same_in_any_batches():
    rng = np.random.default_rng(3)
    rows = np.stack([rng.integers(0, 9, 300), rng.integers(0, 3, 300), rng.integers(0, 6, 300)])
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]

    def run(size):
        stream = FirstStream()
        return np.concatenate([stream.feed(*rows[:, a : a + size]) for a in range(0, 300, size)]).tolist()

    least = {}
    for a, b, d in rows.T.tolist():
        least[a, b] = min(least.get((a, b), d), d)
    assert run(300) == run(1) == run(7) == [d > least[a, b] for a, b, d in rows.T.tolist()]
