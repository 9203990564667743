import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evidence_surface.llm import divergence as module
from evidence_surface.llm.divergence import divergence, kept_terms
from plain import lower_ascii, odd_texts

SCHEMA = "doc_id long, text string, lang string, source string, value int, rank string, term string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [lower_ascii(t) for t in TERM.findall(text or "")]


def plain(rows, least=3, most=200):
    """rows: (text, lang, source)."""
    held, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        held[lang].update(set(terms_of(text)))
        n[lang, source].update(terms_of(text))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in held[lang].items() if c >= least]
        share = lambda count, total: 1 + 1_000_000_000 * (count + 1) // (total + len(kept))
        whole = sum((n[lang, s] for s in sources), Counter())
        totals = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(n[lang, s][t], totals[s]) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(totals.values())) for t in kept}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "x", "y") for i, r in enumerate(rows)], SCHEMA)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def some_rows(seed=5, docs=400):
    rng = random.Random(seed)
    stems = ["a", "ab", "abc", "b", "é", "ée", "漢", "Zürich", "x" * 70, "Word", "WORDS", "words"]
    rows = []
    for i in range(docs):
        words = [rng.choice(stems) + rng.choice(["", "s", str(i % 9), "q" * (i % 5), "ß"]) for _ in range(rng.randrange(25))]
        rows.append((" ".join(words), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "ş2", None])))
    return rows + [(t, "odd", f"s{i % 3}") for i, t in enumerate(odd_texts())]


def test_against_plain(spark):
    rows = some_rows()
    assert got(divergence(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("tile_terms, tile_sources", [(3, 64), (8192, 2), (5, 1)])
def test_tiles_do_not_matter(spark, monkeypatch, tile_terms, tile_sources):
    monkeypatch.setattr(module, "TILE_TERMS", tile_terms)
    monkeypatch.setattr(module, "TILE_SOURCES", tile_sources)
    rows = some_rows(6, 150)
    assert got(divergence(frame(spark, rows), most_terms=4)) == plain(rows, most=4)


def test_shuffled_sides(spark, monkeypatch):
    monkeypatch.setattr(module, "bounded_side", lambda df, rows: df)
    rows = some_rows(7, 100)
    assert got(divergence(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_kept_terms(spark, least):
    rng = random.Random(least)
    rows = [(i % 2, " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(8))) for i in range(300)]
    held = defaultdict(Counter)
    for lang, text in rows:
        held[lang].update(set(terms_of(text)))
    want = sorted((lang, t) for lang in held for t, c in held[lang].items() if c >= least)
    df = spark.createDataFrame(rows, "lang_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in kept_terms(df, least).collect()) == want


def test_prefixes_between_the_bounds(spark):
    """Two documents hold many terms of one prefix: more than the threshold by terms, fewer by documents."""
    rows = [(0, " ".join(f"abcdefghij{chr(97 + k)}" for k in range(20)))] * 2 + [(0, "abzz"), (0, "abzz abzz"), (0, "ABZZ")]
    df = spark.createDataFrame(rows, "lang_id long, text string")
    assert [tuple(r) for r in kept_terms(df, 3).collect()] == [(0, "abzz")]


def test_no_kept_terms_ties_and_empty_table(spark):
    rows = [("only here", "en", "a"), (None, "en", "b"), ("", "en", "c")]
    assert got(divergence(frame(spark, rows))) == plain(rows)
    assert {r[4] for r in plain(rows)} == {0} and len(plain(rows)) == 6
    same = [("tie one two", "en", s) for s in "abcd"] * 3
    assert got(divergence(frame(spark, same))) == plain(same)
    assert divergence(frame(spark, rows).limit(0)).count() == 0


def test_repeated_rows_count_each(spark):
    rows = [("again", "en", "a")] * 3 + [("other", "en", "b")] * 3 + [("rare", "en", "b")] * 2
    assert got(divergence(frame(spark, rows))) == plain(rows)
    assert [r[3] for r in plain(rows) if r[2] == "term"] == ["again", "other"]


def test_names_of_columns(spark):
    df = frame(spark, some_rows(8, 60))
    renamed = df.select(F.col("text").alias("item"), F.col("lang").alias("part"), F.col("source").alias("lang_id"))
    assert got(divergence(renamed, "item", "part", "lang_id")) == got(divergence(df))
