import zlib

import numpy as np
import pytest

from evidence_surface.llm.packing import differencing, pack, windows_of
from evidence_surface.llm.tokens import Encoder
from plain import odd_texts

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
ODD = [
    "it's they'RE", "<|endoftext|> a", "İstanbul ΣΑΣ", "éa é", "漢字 12３ Ⅷ", "a\u0085d​e", "\U0001f600 x",
    "a_b-c__d", "ǅ ß ẞ ﬁ", "\x00\x1cx", "½ ² 1٠", "a　b  c",
]


def test_ids_equal_the_librarys():
    from tokenizers import Tokenizer

    texts = [t or "" for t in odd_texts()] + ODD + ["", "Mixed CASE 123 !!! word"] * 3
    plain = Tokenizer.from_file(PATH)
    ids, counts = Encoder(PATH).encode(texts)
    assert np.split(ids, np.cumsum(counts)[:-1]).__len__() == len(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_differencing_on_known_case():
    window, fullest = differencing(np.array([8, 7, 6, 5, 4]), 2)  # the classic case: difference 2
    sums = np.bincount(window, weights=[8, 7, 6, 5, 4])
    assert fullest == sums.max() == 16 and sums.sum() == 30


def test_windows_hold_and_fill():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 513, 600)
    window, offset = windows_of(lengths, 2048)
    sums = np.bincount(window, weights=lengths)
    assert sums.max() <= 2048 and sums.sum() / (2048 * len(sums)) > 0.97
    for w in range(len(sums)):
        own = np.argsort(offset[window == w])
        ends = np.cumsum(lengths[window == w][own])
        assert (offset[window == w][own] == ends - lengths[window == w][own]).all()


def test_every_id_lies_in_one_piece(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    texts = odd_texts() + ODD + ["word " * 5000, "word " * 2047, "word " * 2046]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, ids string, length int")
    rows = pack(docs, PATH, with_ids=True).collect()
    totals = {}
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        got = b"".join(bytes(r["ids"]) for r in own)
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert [r["start"] for r in own] == np.r_[0, np.cumsum([r["length"] for r in own])][:-1].tolist()
        assert {r["doc_tokens"] for r in own} == {len(ids)}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        totals.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in totals.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string")
    rows = pack(docs, PATH).collect()
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in rows) == [("1", 2), ("1", 2), ("None", 1)]
    assert pack(docs.limit(0), PATH).count() == 0
