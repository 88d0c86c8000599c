"""WARC archives: writing, normalising monolithic gzip files, reading back.

Some tools compress an archive as one gzip stream, which nobody can seek in.
The normaliser inflates such a file once, in constant memory, finds the records
by their headers, writes each as a gzip member of its own and lists offsets in
a sidecar index, so that any record can be read by itself.

Payloads that occur again are written as ``revisit`` records, which carry the
digest and length of the payload and the id of the record that has it.

Scale. Every task streams its rows into its own archive in the shared folder
and renames it when it is complete, so a task that is run again replaces its
file with the same content. Which of equal payloads is the response is decided
on digests alone, pre-aggregated before they are shuffled.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import salted_join

LEAST_BYTES = 100
LEVEL = 4
READ = 1 << 20
#: Fixed values of the WARC format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that all executors see, and the path there."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {_clean(v)}\r\n".encode() for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str = "") -> str:
    name = f"page:{page_id}" if page_id is not None else f"payload:{digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The response or revisit record of a page; ``refers_to`` is the page that has the payload."""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", url or ""),
        ("WARC-Payload-Digest", "sha256:" + digest),
        ("Page-ID", "" if page_id is None else str(page_id)),
        ("Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if refers_to is not None:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to)),
            ("Refers-To-Page-ID", str(refers_to)),
        ]
        payload = b""
    return record(headers, payload)


class _Stream:
    """Bytes of a gzip file, inflated piece by piece, with reads of exact length."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.engine, self.buffer, self.members = source, zlib.decompressobj(31), bytearray(), 1

    def _more(self) -> bool:
        raw = self.engine.unconsumed_tail or (self.engine.unused_data if self.engine.eof else b"") or self.source.read(READ)
        if not raw:
            return False
        if self.engine.eof:
            self.engine, self.members = zlib.decompressobj(31), self.members + 1
        self.buffer += self.engine.decompress(raw, READ)
        return True

    def line(self) -> bytes | None:
        """Up to and with the next line feed; None at the end of the stream."""
        seen = 0
        while (at := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self._more():
                at = len(self.buffer) - 1
                break
        if at < 0:
            return None
        out = bytes(self.buffer[: at + 1])
        del self.buffer[: at + 1]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.buffer and not self._more():
                raise ValueError("the archive ends inside a record")
            part = bytes(self.buffer[:n])
            del self.buffer[: len(part)]
            n -= len(part)
            yield part


def records(source: BinaryIO) -> Iterator[tuple[dict[str, str], Iterator[bytes], bytes]]:
    """(headers, pieces of the block, raw head) of each record of a gzip file of one or many members.

    The pieces must be read, or are skipped, before the next record.
    """
    stream = _Stream(source)
    while True:
        line = stream.line()
        while line is not None and not line.strip():
            line = stream.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head, headers = bytearray(line), {}
        while (line := stream.line()) is not None and line.strip():
            head += line
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[key.strip().lower()] = value.strip()
        head += b"\r\n"
        block = stream.take(int(headers.get("content-length", 0)))
        yield headers, block, bytes(head)
        for _ in block:
            pass


def normalise(source: BinaryIO, target: BinaryIO, index: BinaryIO, level: int = LEVEL) -> int:
    """Rewrite each record of ``source`` as its own gzip member; the number of records.

    ``index`` gets one JSON line per record: id, type, URI, digest, and the
    offset and length of its member in ``target``.
    """
    offset = count = 0
    for headers, block, head in records(source):
        engine, length = zlib.compressobj(level, zlib.DEFLATED, 31), 0

        def put(data: bytes) -> None:
            nonlocal length
            target.write(data)
            length += len(data)

        put(engine.compress(head))
        for part in block:
            put(engine.compress(part))
        put(engine.compress(b"\r\n\r\n") + engine.flush())
        entry = {
            "id": headers.get("warc-record-id"),
            "type": headers.get("warc-type"),
            "uri": headers.get("warc-target-uri"),
            "digest": headers.get("warc-payload-digest"),
            "offset": offset,
            "length": length,
        }
        index.write((json.dumps(entry) + "\n").encode())
        offset, count = offset + length, count + 1
    return count


def _replaced(files: pafs.FileSystem, path: str, write: Callable[[BinaryIO], None]) -> None:
    """Write a file under another name first, so that it is there whole or not at all."""
    draft = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(draft, compression=None) as f:
        write(f)
    files.move(draft, path)


def write_monolithic(path: str, rows: Iterator[bytes], files: pafs.FileSystem, level: int = LEVEL) -> None:
    def write(f: BinaryIO) -> None:
        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
        for r in rows:
            f.write(engine.compress(r))
        f.write(engine.flush())

    _replaced(files, path, write)


def normalise_file(files: pafs.FileSystem, source: str, target: str) -> None:
    """``target`` and ``target + ".idx"`` from the file ``source``."""

    def write(f: BinaryIO) -> None:
        with files.open_input_stream(source, compression=None) as s:
            _replaced(files, target + ".idx", lambda i: normalise(s, f, i))

    _replaced(files, target, write)


def _archive(root: str, folder: str):
    """(page_id, url, html, sha, first) -> paths of normalised archives, one for each task with rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = open_fs(root)
        base = f"{base.rstrip('/')}/{folder}"
        files.create_dir(base, recursive=True)
        # another attempt of the task, also one beside this, has files of its own; only the paths of one attempt are passed on
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        count = 0

        def rows() -> Iterator[bytes]:
            nonlocal count
            for b in batches:
                for page, url, html, sha, first in zip(*(c for c in b.columns), strict=True):
                    count += 1
                    yield page_record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), sha.as_py(), first.as_py())

        whole, done = f"{base}/{name}.mono.gz", f"{base}/{name}.warc.gz"
        write_monolithic(whole, rows(), files)
        if count:
            normalise_file(files, whole, done)
        files.delete_file(whole)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([done]), pa.array([count], pa.int64())], ["path", "records"])

    return run


def read_records(files: pafs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, found by the sidecar index, each inflated by itself."""
    with files.open_input_stream(path + ".idx", compression=None) as f:
        entries = [json.loads(x) for x in f.read().splitlines()]
    with files.open_input_stream(path, compression=None) as f:
        for e in entries:
            member = f.read(e["length"])
            for headers, block, _ in records(io.BytesIO(member)):
                yield headers, b"".join(block)


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_fs(root)
        for b in batches:
            for path in b.column(0).to_pylist():
                out: list[list] = [[], [], [], [], []]

                def table() -> pa.RecordBatch:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

                for headers, block in read_records(files, path):
                    digest, size = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["payload-length"])
                    kind, first = headers["warc-type"], headers.get("refers-to-page-id")
                    if kind == "response":
                        got = hashlib.sha256(block).hexdigest()
                        if got != digest or len(block) != size:
                            raise ValueError(f"{path}: the payload of page {headers['page-id']} is damaged")
                    page = headers["page-id"]
                    row = (int(page) if page else None, size, digest, kind, int(first) if first else None)
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
                    if len(out[0]) >= 10_000:
                        yield table()
                        for c in out:
                            c.clear()
                yield table()

    return run


def round_trip(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = LEAST_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """Archive all pages and read the archives back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to. Of
    equal payloads of ``least_bytes`` or more, the smallest id's is a response,
    the others revisit it; of repeated rows with that id all are responses. A
    null html is an empty payload, a null url an empty header. Rows without an
    id come back without one and revisit the page that has their payload, if any
    has an id. Extra columns are ignored; an empty table writes no archive and
    gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("sha", F.sha2("html", 256))
    same = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "sha")
    same = same.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = scratch.save(same.where("n > 1 and first is not null").select("sha", "first", "n"), "same")
    typed = salted_join(rows, same, "sha", "n", "page_id", how="left").select(
        "page_id", "url", "html", "sha", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first")
    )
    name = folder or "archives"
    written = scratch.save(typed.mapInArrow(_archive(scratch.root, name), "path string, records long"), "written")
    return written.select("path").mapInArrow(_read(scratch.root), READ_SCHEMA)
