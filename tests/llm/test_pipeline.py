"""The pipeline's stages against plain versions, each on the stage's own input."""

import os

import pytest

import corpus_pipeline as p
from evidence_surface.llm import quality as q
from plain import SPACE
from test_decontamination import expected as overlaps
from test_jaccard_join import expected as classes

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with planted copies, near copies, leaks, and odd rows."""
    from test_quality import make

    out = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t) for i, t, _ in make(240)]
    item = "this passage of the benchmark has more than twelve words so that a window fits in it"
    long = " ".join(f"the{i} cat of{i} stone" for i in range(40))
    rows += [(1000 + i, long if i % 2 else f"\t{long} ") for i in range(5)]
    rows += [(1010 + i, long.replace("cat", "tree", 1 + i)) for i in range(3)]
    rows += [(1100, f"the cat walks {item} the tree"), (1101, f"the cat {item.replace('than', 'as').replace('fits', 'is')} tree")]
    rows += [(1200, "the river walks of the blue tree"), (1200, "the river walks of the blue tree"), (None, "the blue stone of a tree"), (1201, None), (1202, "")]
    spark.createDataFrame([(*r, "en", "s", 1) for r in rows], COLUMNS).write.parquet(f"{out}/documents.parquet")
    labels = [(i, k) for i, _, k in make(240) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_against_plain(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = rows_of(docs)
    kept = {(r["doc_id"], r["text_key"]): r["kept"] for r in q.quality_filter(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    keys = docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS k").collect()
    want = sorted(((r["doc_id"], r["text"]) for r in keys if kept[r["doc_id"], r["k"]]), key=str)
    docs = p.materialise(p.quality(spark, docs, folder), "t")
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert rows_of(docs) == want and 0 < len(want) < len(given)
    assert not [d for d, t in want if d is not None and d < 240 and d % 3 == 0]

    best, rows = {}, rows_of(docs)
    for d, t in rows:
        key = SPACE.sub(" ", t or "")
        best[key] = min([best[key], d] if key in best else [d], key=lambda x: (x is None, x or 0))
    docs = p.materialise(p.exact(spark, docs, folder), "t")
    got = rows_of(docs)
    assert len(got) == len(best) and {SPACE.sub(" ", t or ""): d for d, t in got} == best

    links = classes([(d if d is not None else 10**6, t) for d, t in got], 0.8)
    docs = p.materialise(p.near(spark, docs, folder), "t")
    now = rows_of(docs)
    assert {d if d is not None else 10**6 for d, _ in now} == {c for c, _ in links.values()}
    assert len(now) < len(got)

    docs = p.materialise(p.clean_of_benchmark(spark, docs, folder), "t")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert rows_of(docs) == [r for r in now if not overlaps(r[1], items)[0]]
    assert len(now) - docs.count() == 2

    pieces = p.packed(spark, docs, folder)
    assert pieces.agg({"length": "sum"}).first()[0] == sum(r["doc_tokens"] for r in pieces.where("start = 0").collect())


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert p.run(spark, folder).where("start = 0").count() > 100
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
    assert os.path.exists(p.__file__)


def test_clashing_columns_and_very_long_texts(spark):
    long = " ".join(f"w{i % 977} v{i % 1013}" for i in range(60_000))
    spaced = long.replace(" ", " \t", 1)
    rows = [(1, long, 5, 6, "a"), (2, spaced, 7, 8, "b"), (2, spaced, 7, 8, "b"), (3, "other words", 9, 1, "c"), (None, None, 2, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key_ int, gone_doc_id int, gone_text_key_ string")
    kept = p.exact(spark, docs, "")
    assert kept.columns == docs.columns
    got = {r["doc_id"]: tuple(r) for r in kept.collect()}
    assert got == {1: rows[0], 3: rows[3], None: rows[4]}
    decided = docs.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS text_key", "doc_id <=> 2 OR doc_id IS NULL AS kept")
    assert sorted(map(str, map(tuple, p._keep(docs, decided).collect()))) == sorted(map(str, [rows[1], rows[2], rows[4]]))
