"""WARC archives with a two-level capture index.

Pages are written as gzip members of WARC files in the shared folder: the first page
of equal payloads as a response, later ones as revisits that refer to it.  Captures
are sorted by reversed-host key and written as compressed blocks of lines; the sparse
directory keeps the first key, file, offset and length of each block.  A lookup finds
the block by binary search in the directory, the lines by binary search in the block,
and then reads just the records' byte ranges.  Blocks have the same size in an archive
of any size: a directory of more than ``MOST_BLOCKS`` rows is itself written as sorted
blocks under a sparser directory, and so on, until the top is that small.

Files are named by attempt and listed in a table that Spark commits, so a task that
runs twice leaves an unlisted file and no double records.

Defined cases: a null payload counts as empty; payloads under ``REVISIT_BYTES`` are
always responses; a null URL is captured as ``urn:page:<id>``; repeats of one row (same
id) are written once each and are responses if their id is the smallest; a null id is
never the one referred to unless its group has no other, and then all are responses;
an empty table gives an empty result; very long payloads are written and read one at a
time; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, staged, store_of, text_or_empty

REVISIT_BYTES = 100
#: Lines in a block at least, and rows of a directory that is kept as a table at most.
BLOCK_LINES = 1000
MOST_BLOCKS = 100_000
#: Payload bytes that a reader holds before it passes them on, and bytes of records for a task.
BATCH_BYTES, TASK_BYTES = 8 << 20, 4 << 20
#: A WARC file is closed at this size.
FILE_BYTES = 1 << 30
#: Fixed value: the capture time, as pages carry none.
CAPTURED = "1970-01-01T00:00:00Z"

_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PLACES = "key binary, file string, offset long, length long"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Archive(NamedTuple):
    """Where an archive lies and its sparse directory: parallel lists sorted by first key."""

    path: str
    bytes: int  # of all records
    levels: int  # of blocks under this directory
    first: list[bytes]
    block: list[tuple[str, int, int]]  # index file, offset, length


def capture_key(url: str) -> str:
    """The URL with its host reversed, so that a domain's captures lie together."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url
    if not host:
        return url
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{name}){parts.path or '/'}" + (f"?{query}" if query else "")


def _line_key(url: str, page_id: int | None) -> bytes:
    """What lines are sorted by; blanks and control characters cannot occur inside."""
    plain = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m.group()):02X}", capture_key(url))
    return f"{plain} {'' if page_id is None else page_id}".encode("utf-8", "surrogatepass")


def _url(url: str | None, page_id: int | None) -> str:
    return url if url else f"urn:page:{'' if page_id is None else page_id}"


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def write_record(url: str, page_id: int | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    http = _HTTP.format(len(payload)).encode()
    body = http + payload if refers_to is None else http
    clean = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m.group()):02X}", url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
        head.append(f"Page-Refers-To: {refers_to}")
    head += [
        f"Page-ID: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n", 1, mtime=0)


def read_record(member: bytes) -> tuple[dict[str, str], int, bytes]:
    """(WARC fields, length of the full payload, payload) of one gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return fields, length, payload


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> Archive:
    """Write every row as a record, and the index over all of them."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    payload = text_or_empty(payload_col)
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    large = F.octet_length("payload") >= REVISIT_BYTES
    firsts = rows.filter(large).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = staged(firsts.filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "warc-firsts")
    marked = rows.join(firsts, "digest", "left").select(
        "id", "url", "payload", "digest", F.when(large & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(path)
        store.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                lines = []
                columns = (batch.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "refers_to"))
                for page_id, url, text, digest, refers_to in zip(*columns, strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    url = _url(url, page_id)
                    member = write_record(url, page_id, text.encode("utf-8", "surrogatepass"), digest, refers_to)
                    out.write(member)
                    lines.append((_line_key(url, page_id), name, at, len(member)))
                    at += len(member)
                arrays = [pa.array(list(c), t) for c, t in zip(zip(*lines, strict=True), types, strict=True)] if lines else []
                if arrays:
                    yield pa.RecordBatch.from_arrays(arrays, ["key", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    types = [pa.binary(), pa.string(), pa.int64(), pa.int64()]
    captures = staged(marked.mapInArrow(write, _PLACES), "warc-captures")
    return _write_index(captures, path)


def _write_blocks(rows: DataFrame, path: str) -> DataFrame:
    """Sorted (key, file, offset, length) rows as blocks of lines; the same of each block, by its first key."""
    lines = BLOCK_LINES

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(path)
        name, at, pending, out = f"{uuid.uuid4().hex}.idx", 0, [], None
        try:

            def flush() -> pa.RecordBatch:
                nonlocal at, out
                out = out or store.open_output_stream(f"{folder}/{name}", compression=None)
                block = zlib.compress(b"\n".join(line for _, line in pending), 6)
                out.write(block)
                row = [[pending[0][0]], [name], [at], [len(block)]]
                at += len(block)
                pending.clear()
                arrays = [pa.array(c, t) for c, t in zip(row, types, strict=True)]
                return pa.RecordBatch.from_arrays(arrays, ["key", "file", "offset", "length"])

            for batch in batches:
                columns = (batch.column(c).to_pylist() for c in ("key", "file", "offset", "length"))
                for key, file, offset, length in zip(*columns, strict=True):
                    # blocks end between keys, so that all captures of a key are in one block
                    if len(pending) >= lines and pending[-1][0] != key:
                        yield flush()
                    pending.append((key, key + f" {file} {offset} {length}".encode()))
            if pending:
                yield flush()
        finally:
            if out:
                out.close()

    types = [pa.binary(), pa.string(), pa.int64(), pa.int64()]
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key")
    return staged(ordered.mapInArrow(write, _PLACES), "warc-directory")


def _write_index(captures: DataFrame, path: str) -> Archive:
    size = captures.agg(F.sum("length")).first()[0] or 0
    directory, levels = _write_blocks(captures, path), 1
    while directory.count() > MOST_BLOCKS:
        directory, levels = _write_blocks(directory, path), levels + 1
    rows = sorted((bytes(r.key), (r.file, r.offset, r.length)) for r in directory.collect())  # MOST_BLOCKS at most
    return Archive(path, size, levels, [k for k, _ in rows], [b for _, b in rows])


class _Blocks:
    """Binary search through the directory and the levels of blocks; the last block of each level is kept."""

    def __init__(self, archive: Archive, store: pa.fs.FileSystem, folder: str) -> None:
        self.archive, self.store, self.folder = archive, store, folder
        self.place: list[tuple | None] = [None] * archive.levels
        self.lines: list[list[bytes]] = [[]] * archive.levels
        self.keys: list[list[bytes]] = [[]] * archive.levels

    def _open(self, level: int, place: tuple[str, int, int]) -> None:
        if self.place[level] == place:
            return
        file, offset, length = place
        with self.store.open_input_file(f"{self.folder}/{file}") as f:
            self.lines[level] = zlib.decompress(f.read_at(length, offset)).split(b"\n")
        self.keys[level] = [line.rsplit(b" ", 3)[0] for line in self.lines[level]]
        self.place[level] = place

    def places(self, key: bytes) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of the captures of a key."""
        at = bisect.bisect_right(self.archive.first, key) - 1
        if at < 0:
            return
        place = self.archive.block[at]
        for level in range(self.archive.levels - 1, 0, -1):
            self._open(level, place)
            at = bisect.bisect_right(self.keys[level], key) - 1
            place = _place(self.lines[level][at])
        self._open(0, place)
        for at in range(bisect.bisect_left(self.keys[0], key), bisect.bisect_right(self.keys[0], key)):
            yield _place(self.lines[0][at])


def _place(line: bytes) -> tuple[str, int, int]:
    file, offset, length = line.rsplit(b" ", 3)[1:]
    return file.decode(), int(offset), int(length)


def _read_row(member: bytes, file: str, offset: int) -> tuple:
    """Page id, payload bytes, digest, type, page referred to, payload of one record."""
    fields, size, payload = read_record(member)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind, page, refers = fields["WARC-Type"], fields["Page-ID"], fields.get("Page-Refers-To")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record at {file}:{offset} does not match its digest")
    return int(page) if page else None, size, digest, kind, int(refers) if refers else None, payload if kind == "response" else None


def lookup(archive: Archive, wanted: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """All captures of the (id, URL) rows of *wanted*, repeats asked for once.

    Columns: the id, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to`` and ``payload`` (null for revisits).
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([_line_key(_url(u, i), i) for i, u in pairs], pa.binary())], ["key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(archive.path)
        blocks = _Blocks(archive, store, folder)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            places = sorted(p for key in batch.column(0).to_pylist() for p in blocks.places(key))
            rows, held, opened, f = [], 0, "", None
            try:
                for file, offset, length in places:
                    if file != opened:
                        if f:
                            f.close()
                        opened, f = file, store.open_input_file(f"{folder}/{file}")
                    rows.append(_read_row(f.read_at(length, offset), file, offset))
                    held += len(rows[-1][5] or b"")
                    if held >= BATCH_BYTES:
                        yield table(rows)
                        rows, held = [], 0
            finally:
                if f:
                    f.close()
            if rows:
                yield table(rows)

    names = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = (
        f"{id_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )
    asked = wanted.select(F.col(id_col).cast("long"), url_col).mapInArrow(keys, "key binary").distinct()
    tasks = max(1, -(-archive.bytes // TASK_BYTES))  # keys are small: what they lead to counts
    return asked.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(read, schema)
