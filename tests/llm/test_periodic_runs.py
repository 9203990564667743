import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidence_surface.llm.periodic_runs import greatest_run, periodic_runs, planted_repeats
from evidence_surface.llm.queries import op11_periodic_runs
from evidence_surface.llm.repair import grammar, runs
from plain import SPACE, odd_texts

DATA = "/root/testdata/sf0.001"


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def plain_runs(words):
    """Every period against every word; (start, stop, period)."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w = np.array([codes[x] for x in words], np.int64)
    out = []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edges = np.flatnonzero(np.diff(same.astype(np.int8)))
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist()):
            shorter = any(x <= s and e <= y for x, y, _ in out)
            if e - s >= max(6, 4 * q) and not shorter:
                out.append((s, e, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc, words):
    found = plain_runs(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = (None,) * 4
    for s, e, q in found:
        n = e - s
        if best[0] is None or (n * best[2], -s, -q) > (best[1] * q, -best[0], -best[2]):
            best = (s, n, q, 1000 * n // q)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(found), *best, sha(lines), sha(kept))


def plain_planted(doc, words):
    h = zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def strings(rng, n):
    for _ in range(n):
        kind, size = rng.integers(0, 4), int(rng.integers(0, 90))
        if kind == 0:
            yield rng.integers(0, 2, size)
        elif kind == 1:
            yield np.tile(rng.integers(0, 3, rng.integers(1, 8)), 30)[:size]
        elif kind == 2:
            yield np.concatenate([np.tile(rng.integers(0, 3, rng.integers(1, 6)), rng.integers(1, 12)) for _ in range(4)])
        else:
            yield rng.integers(0, 5, size)


def test_runs_against_every_period():
    rng = np.random.default_rng(3)
    docs = list(strings(rng, 600))
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = list(zip(*(x.tolist() for x in runs(np.concatenate(docs), first))))
    want = [(s + f, e + f, q) for d, f in zip(docs, first.tolist()) for s, e, q in plain_runs(d.tolist())]
    assert len(want) > 300 and got == want


def test_grammar_derives_its_occurrences():
    """Every occurrence of a node holds the same words, and each boundary of two words is some node's."""
    rng = np.random.default_rng(4)
    docs = list(strings(rng, 50))
    words, first = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    g = grammar(words, first)
    boundaries = []
    for node, at in zip(g.occurrence.tolist(), g.at.tolist()):
        a, n = g.start[node], g.left[node] + g.right[node]
        assert words[a : a + n].tolist() == words[at : at + n].tolist()
        boundaries.append(at + g.left[node])
    inner = set(range(len(words))) - set(first.tolist())
    assert sorted(boundaries) == sorted(inner)


def test_a_node_is_searched_once():
    """Of a word repeated a million times the grammar has some twenty nodes of repeated symbols."""
    g = grammar(np.zeros(1 << 17, np.int64), np.array([0, 1 << 17]))
    assert len(g.start) == 17 and len(g.occurrence) == (1 << 17) - 1
    assert [x.tolist() for x in runs(np.zeros(1 << 17, np.int64), np.array([0, 1 << 17]))] == [[0], [1 << 17], [1]]


def test_query_against_plain(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op11_periodic_runs(spark, DATA).collect())
    want = sorted(plain_row(d, plain_planted(d, words_of(t))) for d, t in docs)
    assert got == want and sum(r[1] for r in got) > 5


def test_odd_texts(spark):
    texts = odd_texts() + ["x " * 40_000, "a b a b a b a b", "A a A a A a A a", "a  b\na\tb a b a b", "b c " * 5 + "c b c b c b c b"]
    rows = [(i, t, [1], "x") for i, t in enumerate(texts)] + [(None, "y y y y y y", [1], "x"), (0, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs array<int>, collapsed string")
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect()]
    want = []
    for doc, text, *_ in rows:
        words = words_of(text)
        found = plain_runs(words) if len(words) < 50_000 else []
        gone = {i for s, e, q in found for i in range(s + q, e)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((doc, len(words), [(s, e - s, q) for s, e, q in found], kept))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert periodic_runs(docs.limit(0)).count() == 0


def test_renamed_columns(spark):
    docs = spark.createDataFrame([("k", "z z z z z z", 1)], "key string, body string, doc_id int")
    row = periodic_runs(docs, "key", "body").first()
    assert (row["doc_id"], row["collapsed"]) == ("k", "z")


@pytest.mark.parametrize("found, want", [([], None), ([(9, 8, 2), (3, 4, 1), (3, 8, 2)], (3, 4, 1)), ([(0, 9, 2), (5, 14, 3)], (5, 14, 3))])
def test_greatest_run(spark, found, want):
    df = spark.createDataFrame([(found,)], "r array<struct<start:long,length:long,period:long>>")
    best = df.select(greatest_run(F.col("r")).alias("b")).first()["b"]
    assert (tuple(best) if best else None) == want


def test_planted_repeats(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(300)] + [(None, "a b"), (10, None), (40, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in df.withColumn("new", planted_repeats(F.col("doc_id"), F.col("text"))).collect():
        if r["doc_id"] is None or r["text"] is None:
            assert r["new"] == r["text"]
        else:
            assert re.split(" ", r["new"]) == (plain_planted(r["doc_id"], words_of(r["text"])) or [""])
