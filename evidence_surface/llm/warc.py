"""WARC archives: a writer of one gzip member per record, and a reader that splits files.

Writer: each task writes its rows to one file of the folder and returns its path and size. The
name holds the task's attempt and the file is moved into place when it is whole, so a repeated
task leaves at most a file that the returned table does not list. Records of equal payloads
(of `least_bytes` or more) are written once, as the response with the largest id; the others
are revisits that refer to it, with the HTTP headers but no payload.

Reader: files are cut into byte ranges of `split_bytes`, one row each, and dealt to tasks. A
task looks for gzip magic in its range, takes a place for a member only if a WARC header can
be decoded there, and owns the records that start inside the range, to whose end it reads on.

Paths may be of any file system pyarrow knows (local or shared folders, object stores, HDFS).

Defined results: null payload is empty; null url writes no target; of equal payloads, rows that
repeat the largest id are all responses; null ids are smallest, and a group of null ids only
is all responses. Control characters in a url are percent-encoded. Other columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidence_surface.llm.common import bounded_side, materialise

SPLIT_BYTES = 32 << 20
RANGES_PER_CORE = 64  # tasks at most; beyond that a task reads several ranges
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_STEP = 1 << 16
_HEADER_BYTES = 1 << 20


def _open_folder(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return pyarrow.fs.FileSystem.from_uri(folder)


def _plain(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(
    record_id: str, url: str | None, digest: bytes, n: int, payload: bytes | None, refers_to: str | None
) -> bytes:
    """One record as a gzip member; a record that refers to another has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_plain(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, path = _open_folder(folder)
    task = TaskContext.get()
    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
    out, size, records = None, 0, 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("record_id", "url", "digest", "n", "payload", "refers_to")]
        for row in zip(*columns):
            if out is None:
                out = fs.open_output_stream(f"{path}/.{name}.tmp")
            member = record(*row)
            out.write(member)
            size += len(member)
            records += 1
    if out is not None:
        out.close()
        fs.move(f"{path}/.{name}.tmp", f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [records]})


def write_warc(rows: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes `rows` (id, record_id, url, payload binary) and returns path, bytes, records per file."""
    fs, path = _open_folder(folder)
    fs.create_dir(path, recursive=True)
    payload = F.coalesce("payload", F.lit(b""))
    rows = rows.select("id", "record_id", "url", payload.alias("payload")).withColumns(
        {"digest": F.unhex(F.sha1("payload")), "n": F.octet_length("payload").cast("long")}
    )
    first = F.max(F.struct("id", "record_id"))
    repeated = rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(first.alias("first"), F.count("*").alias("rows"))
    repeated = materialise(repeated.where("rows > 1").drop("rows"), "repeated")
    # payloads are shuffled only if more digests repeat than are ever broadcast
    repeated = bounded_side(repeated, repeated.count())
    response = F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first.id"))
    records = rows.join(repeated, "digest", "left").select(
        "record_id",
        "url",
        "digest",
        "n",
        F.when(response, F.col("payload")).alias("payload"),
        F.when(~response, F.col("first.record_id")).alias("refers_to"),
    )
    return materialise(
        records.mapInArrow(lambda b: _write(b, folder), "path string, bytes long, records long"), "archives"
    )


def list_warc(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes of the archives in a folder that any writer made."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("path", F.col("length").alias("bytes"))


class _Window:
    """Bytes of a file from a place on, read in steps."""

    def __init__(self, file, at: int, first: int):
        self.file, self.at, self.data = file, at, b""
        self.more(first)

    def more(self, n: int) -> bool:
        self.file.seek(self.at + len(self.data))
        new = self.file.read(n)
        self.data += new
        return bool(new)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _decode(window: _Window, whole: bool) -> tuple[bytes, int] | None:
    """The member at the window's start and its length; only up to its header unless `whole`.
    None if no WARC header can be decoded there."""
    unpacker, out, used = zlib.decompressobj(31), [], 0
    seen = b""
    while not unpacker.eof:
        if used == len(window.data) and not window.more(_STEP):
            return None  # cut off
        step = window.data[used : used + _STEP]
        try:
            out.append(unpacker.decompress(step))
        except zlib.error:
            return None
        used += len(step) - len(unpacker.unused_data)
        if len(seen) < _HEADER_BYTES:
            seen += out[-1]
            if not b"WARC/1.".startswith(seen[:7]):
                return None
            if not whole and b"\r\n\r\n" in seen:
                return seen, used
    return (b"".join(out), used) if b"".join(out[:1])[:7] == b"WARC/1." or seen[:7] == b"WARC/1." else None


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _parse(member: bytes) -> dict:
    head, _, rest = member.partition(b"\r\n\r\n")
    headers = _headers(head)
    block = rest[: int(headers.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers.get("warc-type", "")
    if kind == "revisit":
        n = int(_headers(http).get("content-length", 0))
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    else:
        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if headers.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
            raise ValueError(f"payload of {headers.get('warc-record-id')} does not fit its digest")
    return {
        "record_type": kind,
        "record_id": headers.get("warc-record-id", "").strip("<>"),
        "refers_to": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
        "url": headers.get("warc-target-uri"),
        "payload_digest": digest,
        "payload_bytes": n,
        "payload": payload,
    }


def records_in(file, start: int, stop: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the records that start in the byte range of an open file."""
    window = _Window(file, start, min(stop - start + len(MAGIC), _STEP))
    chained = False  # whether the window starts where a member has just ended
    while window.at < stop:
        place = window.data.find(MAGIC)
        if place < 0:
            chained = False
            window.drop(max(0, len(window.data) - len(MAGIC) + 1))
            if not window.more(_STEP):
                return
            continue
        if window.at + place >= stop:
            return
        window.drop(place)
        if (place or not chained) and _decode(window, whole=False) is None:
            window.drop(1)
            chained = False
            continue
        member = _decode(window, whole=True)
        if member is None:
            window.drop(1)
            chained = False
            continue
        yield window.at, _parse(member[0])
        window.drop(member[1])
        chained = True


_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("refers_to", pa.string()),
        ("url", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)
_BATCH_BYTES = 8 << 20


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for split in batch.to_pylist():
            fs, path = _open_folder(split["path"])
            rows, held = [], 0
            with fs.open_input_file(path) as file:
                for offset, row in records_in(file, split["start"], split["stop"]):
                    held += len(row["payload"])
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row | {"path": split["path"], "offset": offset})
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the archives in `files` (path, bytes)."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("long")), F.lit(split_bytes).cast("long"))
    splits = files.select("path", "bytes", F.explode(starts).alias("start")).select(
        "path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("stop")
    )
    # a number of its own: the rows are small, and would be merged into few tasks by their size
    tasks = min(splits.count(), RANGES_PER_CORE * files.sparkSession.sparkContext.defaultParallelism)
    return splits.repartition(max(tasks, 1)).mapInArrow(
        lambda b: _read(b, with_payload),
        "path string, offset long, record_type string, record_id string, refers_to string, url string, "
        "payload_digest string, payload_bytes long, payload binary",
    )
