import random

from evidence_surface.llm import decontamination as d
from plain import alnum_words, odd_texts

SCHEMA = "doc_id long, text string, item_id string, windows int"


def expected(text, items):
    words, found = alnum_words(text), set()
    for item_id, item in items:
        item = alnum_words(item)
        span = min(len(item), d.SPAN)
        allowed = d.MOST_SUBSTITUTED if span == d.SPAN else 0
        for i in range(len(words) - span + 1 if span else 0):
            for j in range(len(item) - span + 1):
                if sum(a != b for a, b in zip(words[i : i + span], item[j : j + span])) <= allowed:
                    found.add((item_id, i))
    return sorted({a for a, _ in found}), sorted({b for _, b in found})


def cases():
    rng = random.Random(3)
    word = lambda: rng.choice("the of and cat dog sun été blue tree rock".split())
    items = [(i, " ".join(word() + str(rng.randrange(4)) for _ in range(rng.randrange(12, 30)))) for i in range(8)]
    items += [(100, "short one"), (101, ""), (102, None), (103, "the the the the the the the the the the the the the")]
    docs = []
    for i in range(60):
        base = [word() + str(rng.randrange(4)) for _ in range(40)]
        passage = alnum_words(items[i % 8][1])
        for k in rng.sample(range(len(passage)), i % 5):
            passage[k] = "other"
        docs.append(" ".join(base[:20] + passage[: 10 + i % 20] + base[20:]))
    docs += ["The the THE, the the the the the the the the the the the", "a SHORT, one b"]
    return docs + odd_texts(), items


def test_every_pair_of_windows_meets_a_mask():
    from itertools import combinations

    for places in combinations(range(d.SPAN), d.MOST_SUBSTITUTED):
        assert any(not set(places) & set(kept) for kept in d.masks())


def test_against_plain(spark, monkeypatch):
    texts, items = cases()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {i: expected(t, items) for i, t in enumerate(texts)}
    assert sum(bool(w[0]) for w in want.values()) > 20
    for most in (d.SEEDS_PER_BLOCK, 500):  # one block, several
        monkeypatch.setattr(d, "SEEDS_PER_BLOCK", most)
        rows = d.decontaminate(docs, benchmark).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert (r["item_ids"], r["windows"]) == want[r["doc_id"]]
            assert r["contaminated"] == bool(want[r["doc_id"]][0]) == (not r["kept"])


def test_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b", "", 0), (1, "a b", "", 0), (1, "a b", "", 0)], SCHEMA)
    benchmark = spark.createDataFrame([(7, "A, b"), (8, "a b")], "item_id long, text string")
    assert [r["item_ids"] for r in d.decontaminate(docs, benchmark).collect()] == [[7, 8]] * 3
    assert [r["item_ids"] for r in d.decontaminate(docs, benchmark.limit(0)).collect()] == [[]] * 3
    assert d.decontaminate(docs.limit(0), benchmark).count() == 0


def test_every_short_window_meets_a_mask():
    from itertools import combinations

    assert [d.most_substituted(n) for n in (1, 5, 6, 11, 12)] == [0, 0, 1, 1, 2]
    for n in range(1, d.SPAN):
        for places in combinations(range(n), d.most_substituted(n)):
            assert any(not set(places) & set(kept) for kept in d.masks(n, d.most_substituted(n)))


def test_short_items_with_a_substitution(spark):
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(1, 12)]
    docs, want = [], {}
    for n, item in items:
        for most in range(3):
            for at in range(n):
                words = item.split()
                for k in range(most):
                    words[(at + k) % n] = "other"
                want[len(docs)] = [n] if words.count("other") <= (n >= 6) else []
                docs.append((len(docs), "before it " + " ".join(words) + " after it"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = d.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert {r["doc_id"]: r["item_ids"] for r in rows} == want
    assert all(r["windows"] == ([2] if want[r["doc_id"]] else []) for r in rows)


def test_repeated_items_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(d, "SEEDS_PER_BLOCK", 500)
    benchmark = spark.createDataFrame([(i % 3, f"item {i % 3} of the benchmark") for i in range(300)], "item_id long, text string")
    blocks = list(d._blocks(benchmark, "item_id", "text"))
    assert sorted(i for ids, _ in blocks for i in ids) == [0, 1, 2]


def test_blocks_are_released_one_after_the_other(spark, monkeypatch):
    texts, items = cases()
    held, most = set(), []
    send = spark.sparkContext.broadcast

    def counted(value):
        sent = send(value)
        destroy = sent.destroy
        held.add(sent)
        most.append(len(held))
        monkeypatch.setattr(sent, "destroy", lambda *a: (held.discard(sent), destroy(*a)), raising=False)
        return sent

    monkeypatch.setattr(d, "SEEDS_PER_BLOCK", 300)
    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = d.overlapping(docs, benchmark).collect()
    assert {r["doc_id"] for r in rows} == {i for i, t in enumerate(texts) if expected(t, items)[0]}
    assert len(most) > 3 and max(most) == 1 and not held
