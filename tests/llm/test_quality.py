import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from evidence_surface.llm import quality
from plain import lower_ascii, odd_texts

TOKEN = re.compile(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\x80-\U0010ffff\t-\r ]+")


def plain_grams(text):
    """Tokens, shapes and pairs of shapes."""
    out, before, last = [], None, None
    for token in TOKEN.findall(text or ""):
        low = lower_ascii(token)
        if token[0].isdigit() and token[0].isascii():
            shape = "9"
        elif not (token[0].isalpha() and token[0].isascii()) and ord(token[0]) < 128:
            shape = "sign " + token
        elif re.search("[A-Z]", token) and not re.search("[a-z]", token) and len(re.findall("[A-Z]", token)) > 1:
            shape = "upper"
        else:
            shape = "capital" if "A" <= token[0] <= "Z" else "lower"
        shape += " again" if low == last else ""
        out += [("token", low), ("shape", shape), ("pair", before, shape)]
        before, last = shape, low
    return out


def test_grams_match_plain_ones():
    texts = odd_texts()[:7] + ["A a BB bb bb!! !! 12 12 x1 ÉCOLE 漢!!", "", "...", "Word WORD WOrd"]
    grams, doc = quality.gram_buckets(pa.array(texts, pa.string()))
    names = {}
    for i, t in enumerate(texts):
        own, plain = grams[doc == i], plain_grams(t)
        n = len(plain) // 3
        assert len(own) == len(plain)
        for k in range(3):  # the same n-gram gets the same bucket, another one (nearly always) another
            for bucket, gram in zip(own[k * n : (k + 1) * n], plain[k::3]):
                assert names.setdefault(gram, bucket) == bucket
    assert len(set(names.values())) > 0.95 * len(names)


def make(n=600):
    rng = random.Random(4)
    words = "the of and cat tree blue stone river walks under".split()
    rows = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(body) if i % 3 else "!! ".join(w.upper() for w in body), int(i % 3 > 0)))
    return rows


def test_held_out_quality(spark):
    rows = make()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in rows], "doc_id long, text string, quality int, kept string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.quality_filter(docs, labels).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i] == bool(q) for i, _, q in rows if i % 2 == 0]) > 0.98


def test_kth_largest(spark):
    values = [1.5, 1.5, -3.0, 7.25, 7.25, 7.25, 0.0, 1e-12, 100.0, -1e9]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 4, 5, 8, 10):
        assert quality.kth_largest(keys, k) == sorted(values, reverse=True)[k - 1]


def test_best_cut():
    assert quality.best_cut(np.array([1.0, 2.0]), np.array([True, True])) is None
    assert quality.best_cut(np.array([-4.0, -3.0, 1.0, 2.0]), np.array([False, False, True, True])) == -1.0
    assert math.isfinite(quality.best_cut(np.array([1.0, 1.0]), np.array([True, False])))


def test_odd_cases(spark):
    docs = spark.createDataFrame(
        [(i, t) for i, t in enumerate(odd_texts())] + [(None, "x y"), (3, "one")], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 0)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        rows = quality.quality_filter(docs, known).collect()
        assert len(rows) == len(odd_texts()) + 2
        assert all(r["kept"] == (r["log_weight"] is not None) for r in rows)
        assert sum(r["log_weight"] is None for r in rows) == 3
    assert quality.quality_filter(docs.limit(0), labels).count() == 0


def test_weights_and_decisions_against_plain_counts(spark):
    rows = [(i, t) for i, t, _ in make(120)] + [(500, None), (501, ""), (7, make(120)[7][1])]
    labels = [(i, q) for i, _, q in make(120) if i % 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.quality_filter(docs, spark.createDataFrame(labels, "doc_id long, quality int"), seed=3).collect()
    good = {i for i, q in labels if q}
    raw, target, grams = Counter(), Counter(), []
    for i, t in rows:
        own, _ = quality.gram_buckets(pa.array([t or ""]))
        grams.append(own.tolist())
        raw.update(grams[-1])
        target.update(grams[-1] if i in good else ())
    sizes = [sum(c.values()) + quality.BUCKETS for c in (target, raw)]
    weight = {}
    for (i, t), own in zip(rows, grams):
        ratios = [math.log((target[g] + 1) / sizes[0]) - math.log((raw[g] + 1) / sizes[1]) for g in own]
        weight[i, t or ""] = quality.REFERENCE_GRAMS * sum(ratios) / len(ratios) if ratios else None
    noise = docs.selectExpr("doc_id", "coalesce(text, '') t", f"pmod(xxhash64(doc_id, coalesce(text, ''), 3), {1 << 52}) r")
    draw = {(r["doc_id"], r["t"]): (r["r"] + 0.5) / (1 << 52) for r in noise.collect()}
    keys = {k: w - math.log(-math.log(draw[k])) for k, w in weight.items() if w is not None}
    known = [(weight[i, t or ""], i in good) for i, t in dict(rows).items() if i in dict(labels)]
    gains = []
    for cut in {w for w, _ in known}:  # the best cut lies below one of the labelled weights
        hits = [sum(w >= cut for w, g in known if g), sum(w < cut for w, g in known if not g)]
        gains.append((hits[0] / len(good) + hits[1] / (len(known) - len(good)), cut))
    best = max(g for g, _ in gains)
    among = [(i, t or "") for i, t in rows if t]
    wanted = []
    for gain, cut in gains:
        if gain > best - 1e-9:
            k = sum(weight[d] >= cut - 1e-6 for d in among)
            least = sorted((keys[d] for d in among), reverse=True)[k - 1]
            wanted.append({d for d in among if keys[d] >= least - 1e-6})
    texts = {(i, k["text_key"]): t or "" for (i, t), k in zip(rows, docs.selectExpr("xxhash64(coalesce(text, '')) text_key").collect())}
    assert len(got) == len(rows)
    for r in got:
        want = weight[r["doc_id"], texts[r["doc_id"], r["text_key"]]]
        assert (r["log_weight"] is None) == (want is None) and (want is None or abs(r["log_weight"] - want) < 1e-6)
    kept = {(r["doc_id"], texts[r["doc_id"], r["text_key"]]) for r in got if r["kept"]}
    assert kept in wanted and 0 < len(kept) < len(weight)
    assert len({r["kept"] for r in got if r["doc_id"] == 7}) == 1  # equal keys share their fate
