import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from evidence_surface.llm import language as L
from plain import odd_texts

SYLLABLES = {"xx": "the ing er on th at".split(), "yy": "der sch ung ein ich ß".split(), "zz": "ción que ó lo ar ñ".split()}


def make(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
        rows.append((i, " ".join(words), lang, "lang_pred"))
    return rows


def test_gradients_match_differences():
    network, rng = L.Network(["a", "b", "c"], seed=3), np.random.default_rng(0)
    for unit in (network.ahead, network.back):
        unit.weights[:] = [w.astype(np.float64) for w in unit.weights]
        unit.table, unit.gates, unit.candidate = unit.weights
    network.label, network.bias = network.label.astype(float), network.bias.astype(float)
    codes, wanted = rng.integers(97, 101, (5, 4)), np.array([0, 1, 2, 1])
    codes[3:, 2] = 256
    _, gradients = network.gradients(codes, wanted)
    for weight, gradient in zip(network.weights(), gradients):
        for at in [tuple(rng.integers(0, n) for n in weight.shape) for _ in range(4)] + [np.unravel_index(np.abs(gradient).argmax(), weight.shape)]:
            old, step = weight[at], 1e-3
            weight[at] = old + step
            up = network.gradients(codes, wanted)[0]
            weight[at] = old - step
            down = network.gradients(codes, wanted)[0]
            weight[at] = old
            assert gradient[at] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-5)


def test_pooled_is_the_mean_over_positions(monkeypatch):
    monkeypatch.setattr(L, "LANES", 3)
    network = L.Network(["a", "b"], seed=1)
    texts = ["", "x", "word " * 100, "é" * 64]
    got = L.pooled(network, pa.array(texts))
    for text, row in zip(texts, got):
        raw = np.frombuffer(text.encode(), np.uint8).astype(int)
        each = []
        for a in range(0, len(raw), L.WINDOW):
            codes = np.full((L.WINDOW, 1), 256)
            codes[: len(raw[a : a + L.WINDOW]), 0] = raw[a : a + L.WINDOW]
            each.append(network.positions(codes)[1][: len(raw[a : a + L.WINDOW]), 0])
        assert np.allclose(row, np.concatenate(each).mean(axis=0) if each else 0, atol=1e-4)


def test_held_out_accuracy(spark):
    rows = make(900, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in L.predict_language(docs).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang, _ in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_cases(spark):
    texts = odd_texts() + ["123 !?", "1"]
    rows = [(i, t, "xx" if i % 2 else None) for i, t in enumerate(texts)] + [(None, "word", "xx"), (None, "word", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.predict_language(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            lettered = any(c.isalpha() for c in texts[r["doc_id"]] or "")
            assert (r["lang_pred"], r["score"] > 0) == (("xx", True) if lettered else ("und", False))
    assert {r["lang_pred"] for r in L.predict_language(docs.withColumn("lang", L.F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.predict_language(docs.limit(0)).count() == 0


def test_pieces_are_spread_over_the_whole_text(spark):
    texts = ["a", "é" * 32, "b" * 65, "c" * 64 * 5 + "d", "".join(chr(97 + i) * 64 for i in range(11)), "x" * 100_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [bytes(p) for p in r["p"]] for r in rows.select("i", L.pieces(L.F.col("t")).alias("p")).collect()}
    for i, text in enumerate(texts):
        data = text.encode()
        cut = [data[a : a + L.WINDOW] for a in range(0, len(data), L.WINDOW)]
        some = min(len(cut), L.TRAIN_WINDOWS)
        assert got[i] == [cut[o * len(cut) // some] for o in range(some)]


def test_quota_fills_what_rare_languages_leave():
    assert L.quota([], 10) == 1
    assert L.quota([3, 4], 10) == 4
    assert L.quota([1, 100, 100], 11) == 5
    assert L.quota([50] * 20, 10) == 1


def test_training_rows_hold_every_language_and_no_text(spark):
    rows = [(i, "common " * 50, "xx") for i in range(3000)] + [(5000 + i, f"rare {i}", "yy") for i in range(3)]
    rows += [(None, "w" * 3_000_000, "zz"), (None, "no id " * 3, "zz"), (7, None, "zz"), (8, "", "zz"), (9, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.training_rows(docs, most=100).collect()
    by = {lang: [r for r in got if r["lang"] == lang] for lang in ("xx", "yy", "zz")}
    assert [len(by[k]) for k in by] == [95, 3, 2] and len(got) == 100
    assert all(len(p) <= L.WINDOW for r in got for p in r["pieces"])
    assert all(len(r["pieces"]) <= L.TRAIN_WINDOWS for r in got)
    again = L.training_rows(docs.repartition(5), most=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
