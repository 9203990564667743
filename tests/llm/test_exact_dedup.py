import hashlib

import numpy as np

from evidence_surface.llm import fuse
from evidence_surface.llm.exact_dedup import digests, exact_dedup, screen, grouped, take_snapshot
from plain import SPACE, odd_texts

SCHEMA = "doc_id long, text string, sha string, n int"


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 1000, 40_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        f = fuse.build(np.concatenate([keys, keys[: n // 2]]))
        assert fuse.contains(keys, *f).all()
        other = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
        assert fuse.contains(other, *f).mean() < 0.01 or n < 3


def test_against_plain(spark):
    texts = odd_texts() + ["x  y", "x y", "x\ny", " x y", "x y"] * 4
    rows = [((i * 7) % 41, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], SCHEMA)
    norm = lambda t: SPACE.sub(" ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    got = {r["doc_id"]: r for r in exact_dedup(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        g, r = groups[norm(t)], got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(g), len(g), i == min(g))
        assert r["text_sha256"] == hashlib.sha256(norm(t).encode()).hexdigest()


def test_screen_lets_every_known_digest_through(spark):
    old = digests(spark.createDataFrame([(i, f"t{i}", "", 0) for i in range(500)], SCHEMA))
    new = digests(spark.createDataFrame([(i, f"t{i}", "", 0) for i in range(400, 5000)], SCHEMA))
    hits = {r["keep_id"] for r in screen(grouped(new), take_snapshot(old)).where("hit").collect()}
    assert hits >= set(range(400, 500)) and len(hits) < 250


def test_null_ids_repeats_and_empty_table(spark):
    docs = spark.createDataFrame(
        [(None, "a", "", 0), (None, "a", "", 0), (None, "b", "", 0), (3, "b", "", 0), (3, "b", "", 0)], SCHEMA
    )
    got = sorted((r["text_sha256"][:4], str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup(docs).collect())
    a, b = (hashlib.sha256(x).hexdigest()[:4] for x in (b"a", b"b"))
    assert got == sorted(
        [(a, "None", "None", 2, False), (a, "None", "None", 2, True), (b, "None", "3", 3, False), (b, "3", "3", 3, False), (b, "3", "3", 3, True)]
    )
    assert exact_dedup(docs.limit(0)).count() == 0
