import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from evidence_surface.llm.line_dedup import line_dedup
from evidence_surface.llm.queries import op3_line_dedup
from plain import odd_texts, space_words

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, spans string, first int"


def expected(rows, least):
    """rows: (id, text), ids distinct; kept text by cutting every unit seen before."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        kept = b""
        for line in (text or "").encode().split(b"\n"):
            unit = tuple(space_words(line.decode()))
            if len(unit) >= least and unit in seen:
                continue
            kept += line + b"\n"
            if len(unit) >= least:
                seen.add(unit)
        out[doc] = kept
    return out


@pytest.mark.parametrize("least", [1, 3])
def test_against_plain(spark, least):
    line = "The same LINE of words, here."
    texts = odd_texts() + [f"{line}\nown {i} of doc\n  the same\tline of words, here. " for i in range(40)]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in line_dedup(docs, least_words=least).collect()}
    want = expected(rows, least)
    assert len(got) == len(rows)
    for doc, text in rows:
        kept = got[doc]["kept_text"].encode()
        assert kept.rstrip(b"\n") == want[doc].rstrip(b"\n")
        raw = (text or "").encode()
        spans = [(s["start"], s["stop"]) for s in got[doc]["spans"]]
        assert sum(b - a for a, b in spans) == got[doc]["n_removed"] == len(raw) - len(kept)


def test_paragraphs(spark):
    docs = spark.createDataFrame([(1, "a b\nc d\n\ne f", "", 0), (2, "x\n\na b\nc d\n\ny", "", 0)], SCHEMA)
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup(docs, unit="paragraph", least_words=2).collect()}
    assert got == {1: "a b\nc d\n\ne f", 2: "x\n\ny"}


def plain_units(text):
    """Sentences of a line joined until they have 8 words; fewer at the line's end join the unit before."""
    for line in re.findall(r"[^\n]*\n|[^\n]+$", text):
        units = [""]
        for piece in re.findall(r".*?[.!?][\x20\t\x0b-\r]+|.+$", line, re.S):
            if len(units[-1].split()) >= 8:
                units.append("")
            units[-1] += piece
        if len(units) > 1 and len(units[-1].split()) < 8:
            units[-2:] = ["".join(units[-2:])]
        yield from units


def test_sentences(spark):
    rng = random.Random(4)
    shared = ["One two three four five six seven eight.", "Short!", "Is it so? No.", "a b c d e f g h i j k l m."]
    texts = ["", None, ".", "Of. Of. Of.", "x.y z", "  lead. in\r\n", "!? ?! . . . . . . . . . ."]
    for i in range(120):
        parts = [rng.choice(shared + [f"Own words {i} {rng.random()} of a document."]) for _ in range(rng.randrange(9))]
        texts.append("".join(p + rng.choice([" ", "  ", "\n", "\t", " \n\n"]) for p in parts))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup(docs, unit="sentence").collect()}
    seen = set()
    for i, text in enumerate(texts):
        kept = ""
        for unit in plain_units(text or ""):
            words = tuple(space_words(unit))
            if words not in seen or not words:
                kept += unit
            seen.add(words)
        assert got[i] == kept


def test_a_passage_inside_a_line(spark):
    passage = " ".join(f"Sentence {k} of the passage has some nine words here." for k in range(8))
    docs = spark.createDataFrame([(i, f"Begins with own {i} words. {passage} Ends {i}.\nOther {i}", "", 0) for i in range(9)], SCHEMA)
    rows = line_dedup(docs, unit="sentence").collect()
    assert [r["n_removed"] > 0.7 * len(passage) for r in sorted(rows)] == [False] + [True] * 8


def test_unknown_unit(spark):
    with pytest.raises(ValueError):
        line_dedup(spark.createDataFrame([(1, "a", "", 0)], SCHEMA), unit="page")


def test_repeated_rows_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(5, "a b c", "", 0), (5, "a b c", "", 0), (None, "a b c", "", 0)], SCHEMA)
    got = sorted((r["doc_id"] or -1, r["kept_text"]) for r in line_dedup(docs, least_words=3).collect())
    assert got == [(-1, "a b c"), (5, ""), (5, "")]
    assert line_dedup(docs.limit(0)).count() == 0


def test_short_lines_count(spark):
    short = "All rights\nreserved.\n\n"
    rows = [(1, short + "one"), (2, "two\n" + short), (3, "Reserved. \nall rights\n \n")]
    got = {r["doc_id"]: r["kept_text"] for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: short + "one", 2: "two\n\n", 3: " \n"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no sample tables")
def test_query_against_plain(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    seen, want = set(), {}
    for doc, text in sorted(rows):
        kept = ""
        for unit in plain_units(text or ""):
            words = tuple(space_words(unit))
            kept += "" if words and words in seen else unit
            seen.add(words)
        want[doc] = (len((text or "").encode()) - len(kept.encode()), hashlib.sha256(kept.encode()).hexdigest())
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in op3_line_dedup(spark, DATA).collect()} == want
