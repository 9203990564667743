import base64
import gzip
import hashlib
import io
import os
import random

import pytest

from pyspark.sql import functions as F

from evidence_surface.llm import warc
from plain import odd_texts

SCHEMA = "id long, record_id string, url string, payload binary, digest string, n int"


def rows():
    rng = random.Random(2)
    bodies = [(t or "").encode() if t is not None else None for t in odd_texts()]
    bodies += [rng.randbytes(rng.choice((0, 10, 3000, 70_000))) for _ in range(60)] + [b"same"] * 25 + [warc.MAGIC * 50]
    ids = rng.sample(range(1000), len(bodies))
    return [(i, f"urn:x:{i}", None if i % 9 == 0 else f"http://a/{i}\r\n x", b, "q", 1) for i, b in zip(ids, bodies)]


@pytest.mark.parametrize("least,split", [(0, 1 << 20), (0, 501), (5, 4096)])
def test_round_trip(spark, tmp_path, least, split):
    data = rows()
    files = warc.write_warc(spark.createDataFrame(data, SCHEMA).repartition(3), str(tmp_path / "w"), least)
    got = {r["record_id"]: r for r in warc.read_warc(files, split).collect()}
    assert len(got) == len(data) == files.agg({"records": "sum"}).first()[0]
    largest = {}
    for i, _, _, b, *_ in data:
        largest[b or b""] = max(i, largest.get(b or b"", i))
    for i, record_id, url, b, *_ in data:
        r, b = got[record_id], b or b""
        revisit = len(b) >= least and largest[b] != i
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (f"urn:x:{largest[b]}" if revisit else None)
        assert r["payload_bytes"] == len(b)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert revisit or bytes(r["payload"]) == b
        assert (r["url"] is None) == (url is None) and "\n" not in (r["url"] or "")
    assert warc.list_warc(spark, str(tmp_path / "w")).count() == files.count()


def test_every_range_owns_what_starts_inside(tmp_path):
    members = [warc.record(f"urn:{i}", None, b"x" * 20, 2, b"ab", "urn:0") for i in range(9)]
    data = b"junk" + b"".join(members[:4]) + b"\0\0" + warc.MAGIC + b"no" + b"".join(members[4:]) + members[0][:40]
    offsets = [data.index(m) for m in members]
    for start in range(0, len(data), 37):
        for stop in (start + 1, start + 37, len(data)):
            got = [o for o, _ in warc.records_in(io.BytesIO(data), start, stop)]
            assert got == [o for o in offsets if start <= o < stop]


def test_members_are_plain_gzip(spark, tmp_path):
    files = warc.write_warc(spark.createDataFrame(rows()[:5], SCHEMA).coalesce(1), str(tmp_path / "w"))
    path = files.first()["path"]
    assert gzip.decompress(open(path, "rb").read()).count(b"WARC/1.1\r\n") == 5
    assert [f for f in os.listdir(tmp_path / "w") if f.endswith(".tmp")] == []


def test_empty_table(spark, tmp_path):
    files = warc.write_warc(spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert warc.read_warc(files).count() == 0


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    """Adaptive execution would merge the ranges, which are small rows, into one task."""
    files = warc.write_warc(spark.createDataFrame(rows(), SCHEMA).coalesce(1), str(tmp_path / "w"))
    read = warc.read_warc(files, split_bytes=-(-files.first()["bytes"] // 8))
    assert read.select(F.spark_partition_id()).distinct().count() >= 7


def test_large_payloads_and_headers(spark, tmp_path):
    """A payload beyond a batch, a header beyond one step of the reader."""
    long = bytes(range(256)) * 40_000
    data = [(1, "urn:x:1", "http://a/" + "é" * 60_000, long, "q", 1), (2, "urn:x:2", None, long + b"!", "q", 1), (3, "urn:x:3", None, long, "q", 1)]
    files = warc.write_warc(spark.createDataFrame(data, SCHEMA), str(tmp_path / "w"))
    got = {r["record_id"]: r for r in warc.read_warc(files, split_bytes=10_000).collect()}
    assert bytes(got["urn:x:3"]["payload"]) == long and bytes(got["urn:x:2"]["payload"]) == long + b"!"
    assert got["urn:x:1"]["refers_to"] == "urn:x:3" and got["urn:x:1"]["url"] == data[0][2]
