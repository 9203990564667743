import random
from collections import Counter

import pytest

from evidence_surface.llm import jaccard_join as j
from evidence_surface.llm.components import components
from plain import odd_texts, space_words

SCHEMA = "doc_id long, text string, class_id string, cls int"


def shingles(text, n=5):
    w = space_words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def expected(rows, least):
    sets = [shingles(t) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            if sets[i] and len(sets[i] & sets[k]) >= least * len(sets[i] | sets[k]):
                links[i] += 1
                links[k] += 1
                up[top(i)] = top(k)
    least_id = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least_id[top(i)] = min(least_id.get(top(i), doc), doc)
    return {doc: (least_id[top(i)], links[i]) for i, (doc, _) in enumerate(rows) if doc is not None}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(30, 150))]
        for k in range(rng.randrange(1, 14)):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
            if k % 4 == 0:
                texts.append(" ".join(own))
    texts += [" ".join(passage + [word() for _ in range(30)]) for _ in range(60)]  # shared, yet unlike
    return texts


@pytest.mark.parametrize("node_rows,block_rows", [(100, 1000), (8, 1000), (4, 5)])
def test_against_plain(spark, monkeypatch, node_rows, block_rows):
    monkeypatch.setattr(j, "NODE_ROWS", node_rows)
    monkeypatch.setattr(j, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(j, "PAIRS_AT_ONCE", 50)
    texts = corpus() + odd_texts()
    rows = list(zip(random.Random(1).sample(range(10 * len(texts)), len(texts)), texts))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    want = expected(rows, 0.8)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in j.jaccard_classes(docs).collect()}
    assert got == want


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(j, "NODE_ROWS", 20)
    monkeypatch.setattr(j, "BLOCK_ROWS", 64)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    want = expected(rows, 0.8)
    got = j.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got} == want
    assert [r["doc_id"] for r in got if r["kept"]] == [0]


def test_repeats_nulls_and_empty_table(spark):
    docs = spark.createDataFrame(
        [(4, "a b c"), (4, "a b c"), (None, "A b  c"), (None, None), (2, ""), (3, "")], "doc_id long, text string"
    )
    got = Counter((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in j.jaccard_classes(docs).collect())
    assert got == {(4, 4, 2, True): 2, (None, 4, 2, False): 1, (None, None, 0, True): 1, (2, 2, 0, True): 1, (3, 3, 0, True): 1}
    assert j.jaccard_classes(docs.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert j.runs_for(0.9999) == 4 and j.runs_for(0.9) == 1


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}
