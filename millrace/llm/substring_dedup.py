"""Substring deduplication with a log-structured fingerprint index.

Every window of ``WINDOW`` words gets a fingerprint of 80 bits, 64 of them to sort by.
A task turns the texts it reads into *runs*: sorted, immutable lists of distinct
fingerprints, each with the smallest document that has it and its place there, cut by
fingerprint range into buckets and compressed.  Runs are kept in levels: as soon as a
task has ``FAN`` of them they are merge-joined and compacted to one, which leaves the
task; then all that left for a bucket are merge-joined.  A place is flagged, with the
place of the owner it repeats, when a smaller document has its fingerprint.  Compaction
of a whole bucket makes the index for the next batch: with ``history`` its runs take
part in the merge, so a new batch is deduplicated against all earlier ones.

A fingerprint that many documents share takes one entry in a compacted run, as the other
documents are flagged where they are read.  Flags travel as one blob for each bucket and
slice of the documents, and are gathered slice by slice to spans: places in a row that
repeat places in a row of one owner.

Verification: each span asks its owner's text for a 128-bit digest of the very words it
stands for, and no word is removed unless the digests of both texts agree; other places
of the same text with those words are compared word by word.  Windows whose owner is in
``history`` are verified where ``earlier`` gives the texts of those batches, else by
their 80 bits.

Defined cases: a null text has no words; a text with fewer than ``WINDOW`` words
keeps all; windows never span documents; a window whose first document is the same
document (a repeat within it, or a repeated row) stays; rows with a null id neither
lose words nor count as earlier documents; an empty table gives an empty result;
extra columns are ignored, whatever their names.  Very long texts make one larger run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, swept, text_or_empty

WINDOW = 13
#: Windows in one run, about (a run ends at a document's end), and runs that are merged to one.
RUN_WINDOWS, FAN = 1_000_000, 4
#: Windows that one bucket may hold, about: 32 bytes each in the merging task.
BUCKET_WINDOWS = 1_000_000
#: Parts that a run is cut into at most.
MOST_PARTS = 1 << 14
#: Bytes of text whose flags are gathered in one task.
SLICE_BYTES = 32 << 20
#: Bytes of text for each word, to choose the number of buckets.
_WORD_BYTES = 6
_CACHED_WORDS = 250_000
_ODD, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

Fingerprints = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _polynomial(words: np.ndarray, odd: int) -> np.ndarray:
    """Of each window w0..w12 the sum of wi * odd^(12-i), by doubling."""
    m1 = np.uint64(odd)
    with np.errstate(over="ignore"):
        m2 = m1 * m1
        m4 = m2 * m2
        h2 = words[:-1] * m1 + words[1:]
        h4 = h2[:-2] * m2 + h2[2:]
        h8 = h4[:-4] * m4 + h4[4:]
        h12 = h8[:-4] * m4 + h4[8:]
        h = h12[:-1] * m1 + words[12:]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def window_fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 16 bits for each window of a sequence of word hashes."""
    if len(words) < WINDOW:
        return np.empty(0, np.uint64), np.empty(0, np.uint16)
    with np.errstate(over="ignore"):
        turned = words * np.uint64(_OTHER) ^ (words >> np.uint64(29))
    return _polynomial(words, _ODD), (_polynomial(turned, _OTHER) >> np.uint64(48)).astype(np.uint16)


def _planes(values: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes first: sorted numbers then compress well."""
    width = values.dtype.itemsize
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes()


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Unsigned arrays, each in the narrowest width that holds it, compressed."""
    head, body = [], []
    for x in arrays:
        top = int(x.max()) if len(x) else 0
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * np.dtype(k).itemsize)
        head += [len(x), np.dtype(kind).itemsize]
        body.append(_planes(x.astype(kind)))
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(body))


def _unpacked(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    at, out = 16 * len(kinds), []
    for (n, width), kind in zip(np.frombuffer(raw[:at], np.int64).reshape(-1, 2).tolist(), kinds, strict=True):
        plain = np.ascontiguousarray(np.frombuffer(raw[at : at + n * width], np.uint8).reshape(width, n).T)
        out.append(plain.view(f"<u{width}").reshape(-1).astype(kind))
        at += n * width
    return out


class Run(NamedTuple):
    """Entries sorted by fingerprint: 64 and 16 bits, row of *docs* (id, text hash), place."""

    h: np.ndarray
    c: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    docs: np.ndarray

    def part(self, keep: slice | np.ndarray) -> Run:
        used, doc = np.unique(self.doc[keep], return_inverse=True)
        return Run(self.h[keep], self.c[keep], doc.astype(np.uint32), self.place[keep], self.docs[used])

    def pack(self) -> bytes:
        return _packed([np.diff(self.h, prepend=np.uint64(0)), self.c, self.doc, self.place, *self.docs.T.astype(np.int64).view(np.uint64)])

    @staticmethod
    def open(blob: bytes) -> Run:
        h, c, doc, place, ids, hashes = _unpacked(blob, ["<u8", "<u2", "<u4", "<u4", "<u8", "<u8"])
        return Run(np.cumsum(h, dtype=np.uint64), c, doc, place, np.stack([ids, hashes], 1).view(np.int64))


class Flags(NamedTuple):
    """Flagged windows: row of *docs* and place, and those of the owner that they repeat."""

    doc: np.ndarray
    place: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    docs: np.ndarray

    def slices(self, count: int) -> dict[int, bytes]:
        """One blob for each slice of the flagged documents."""
        if not len(self.doc):
            return {}
        with np.errstate(over="ignore"):
            mixed = self.docs[:, 0].view(np.uint64) * np.uint64(_ODD) >> np.uint64(20)
        number = (mixed % np.uint64(count)).astype(np.int64)[self.doc]
        order = np.lexsort((self.place, self.doc, number))
        cut = np.flatnonzero(np.diff(number[order], prepend=-1))
        out = {}
        for a, b in zip(cut, [*cut[1:], len(order)], strict=True):
            rows = order[a:b]
            used, both = np.unique(np.concatenate([self.doc[rows], self.owner[rows]]), return_inverse=True)
            doc, owner = both[: len(rows)], both[len(rows) :]
            docs = self.docs[used].T.astype(np.int64).view(np.uint64)
            out[int(number[rows[0]])] = _packed([doc, self.place[rows], owner, self.at[rows], *docs])
        return out

    @staticmethod
    def open(blob: bytes) -> Flags:
        doc, place, owner, at, ids, hashes = _unpacked(blob, ["<u4", "<u4", "<u4", "<u4", "<u8", "<u8"])
        return Flags(doc, place, owner, at, np.stack([ids, hashes], 1).view(np.int64))


def _settle(run: Run) -> tuple[Flags, Run]:
    """Of entries sorted by 64 bits, and among equal ones by document: what repeats a smaller document, and what stays."""
    h, c, doc, place, docs = run
    if np.any((h[1:] == h[:-1]) & (c[1:] != c[:-1])):  # 64 bits alike by accident
        order = np.lexsort((place, docs[doc, 0], c, h))
        h, c, doc, place = h[order], c[order], doc[order], place[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    start = np.flatnonzero(head)
    first = np.repeat(start, np.diff([*start, len(h)])) if len(h) else start
    repeats = docs[doc, 0] > docs[doc[first], 0]
    late = np.flatnonzero(repeats)
    flags = Flags(doc[late], place[late], doc[first[late]], place[first[late]], docs)
    # rows that share the smallest id keep an entry each
    head[1:] |= (doc[1:] != doc[:-1]) & ~repeats[1:]
    return flags, Run(h, c, doc, place, docs).part(np.flatnonzero(head))


def merge(runs: list[Run]) -> tuple[Flags, Run]:
    """Merge-join runs: what repeats a smaller document, and the compacted run."""
    base = np.cumsum([0, *(len(r.docs) for r in runs[:-1])]).astype(np.uint32)
    h, c, place = (np.concatenate([r[i] for r in runs]) for i in (0, 1, 3))
    doc = np.concatenate([r.doc + b for r, b in zip(runs, base, strict=True)])
    docs = np.concatenate([r.docs for r in runs])
    order = np.argsort(docs[doc, 0], kind="stable")
    order = order[np.argsort(h[order], kind="stable")]
    return _settle(Run(h[order], c[order], doc[order], place[order], docs))


_COLUMNS = [("bucket", pa.int64()), ("tier", pa.int32()), ("run", pa.binary()), ("last", pa.int64()), ("slice", pa.int32()), ("flags", pa.binary())]
_RUN_SCHEMA = "bucket long, tier int, run binary, last long, slice int, flags binary"


class Layout(NamedTuple):
    """How fingerprints are dealt to buckets, and flags to slices.

    No run is cut into more than ``MOST_PARTS`` parts.  Of more buckets than that, so many
    in a row make one at first; its runs are merged by tiers of bounded size, and the
    compacted runs are cut into the buckets.
    """

    buckets: int
    slices: int
    first: int  # parts of a run when it is made
    tiers: int

    @staticmethod
    def of(windows: int, buckets: int, slices: int) -> Layout:
        if buckets <= MOST_PARTS:
            return Layout(buckets, slices, buckets, 1)
        first = MOST_PARTS
        buckets = -(-buckets // first) * first
        return Layout(buckets, slices, first, -(-windows // (first * BUCKET_WINDOWS)))

    def cut(self, run: Run, parts: int) -> Iterator[tuple[int, Run]]:
        """The non-empty parts of a run, of ``parts`` that share all fingerprints evenly."""
        number = (run.h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        start = np.flatnonzero(np.diff(number.astype(np.int64), prepend=-1))
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(number)], strict=True):
            yield int(number[a]), run.part(slice(a, b))

    def rows(self, run: Run, parts: int) -> list[tuple]:
        out = []
        for number, part in self.cut(run, parts):
            blob = part.pack()
            out.append((number, zlib.crc32(blob) % self.tiers, blob, int(part.docs[:, 0].max()), None, None))
        return out

    def told(self, flags: Flags, parts: int) -> list[tuple]:
        return [(k % parts, 0, None, None, k, blob) for k, blob in flags.slices(self.slices).items()]


def _batch(made: list[tuple]) -> pa.RecordBatch:
    columns = zip(*made, strict=True) if made else [[]] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _COLUMNS, strict=True)], [n for n, _ in _COLUMNS])


def runs(rows: DataFrame, layout: Layout, fingerprints: Fingerprints = window_fingerprints) -> DataFrame:
    """Runs of (id, text_hash, text) rows, cut into buckets, and what was flagged in making them.

    Rows are either a run (bucket, run, largest id in it) or flags (bucket, slice, flags).
    """
    coarse = min(64, layout.first)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pending, ids, count = _WordHashes(), [], [], 0
        level: list[dict[int, bytes]] = []  # of each run of the level, its coarse parts

        def flush() -> pa.RecordBatch:
            """The pending texts become a run of the level."""
            docs = np.array(ids, np.int64).reshape(-1, 2)
            by_id = np.argsort(docs[:, 0], kind="stable")
            parts = [pending[i] for i in by_id]
            sizes = np.array([len(h) for h, _ in parts])
            h, c = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            doc = np.repeat(by_id.astype(np.uint32), sizes)
            place = (np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
            order = np.argsort(h, kind="stable")
            flags, run = _settle(Run(h[order], c[order], doc[order], place[order], docs))
            level.append({number: part.pack() for number, part in layout.cut(run, coarse)})
            pending.clear()
            ids.clear()
            return _batch(layout.told(flags, layout.first))

        def leave() -> Iterator[pa.RecordBatch]:
            """The runs of the level, compacted to one."""
            for number in range(coarse):
                parts = [Run.open(r[number]) for r in level if number in r]
                if not parts:
                    continue
                flags, run = merge(parts) if len(parts) > 1 else (None, parts[0])
                told = layout.told(flags, layout.first) if flags else []
                yield _batch([*told, *layout.rows(run, layout.first)])
            level.clear()

        for batch in batches:
            columns = (batch.column(c) for c in ("id", "text_hash", "text"))
            for i, t, text in zip(*columns, strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                if len(words) < WINDOW:
                    continue
                made = fingerprints(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                pending.append(made)
                ids.append((i.as_py(), t.as_py()))
                count += len(made[0])
                if count >= RUN_WINDOWS:
                    yield flush()
                    count = 0
                    if len(level) == FAN:
                        yield from leave()
        if pending:
            yield flush()
        yield from leave()

    made = rows.select("id", "text_hash", "text").mapInArrow(make, _RUN_SCHEMA)
    if layout.first == layout.buckets:
        return made

    def tier(table: pa.Table) -> pa.Table:
        """The runs of one tier of a first bucket, compacted to one and cut into the buckets."""
        blobs = table.column("run").drop_null().to_pylist()
        passed = table.filter(pa.compute.is_valid(table.column("flags")))
        if not blobs:
            return passed
        flags, run = merge([Run.open(b) for b in blobs])
        return pa.concat_tables([passed, pa.Table.from_batches([_batch([*layout.told(flags, layout.buckets), *layout.rows(run, layout.buckets)])])])

    return made.groupBy("bucket", "tier").applyInArrow(tier, _RUN_SCHEMA)


def _compact(table: pa.Table) -> pa.Table:
    bucket, blobs = table.column("bucket")[0].as_py(), table.column("run").drop_null().to_pylist()
    last = pa.compute.max(table.column("last")).as_py()
    made = [merge([Run.open(b) for b in blobs])[1].pack()] if blobs else []
    columns = [pa.array([bucket] * len(made), pa.int64()), pa.array(made, pa.binary()), pa.array([last] * len(made), pa.int64())]
    return pa.table(columns, names=["bucket", "run", "last"])


_SPANS = "id long, text_hash long, place int, n int, owner long, owner_hash long, at int"


def _spans(table: pa.Table) -> pa.Table:
    """All flags of a slice as spans; of several owners of a place the smallest is taken."""
    parts = [Flags.open(b.as_py()) for b in table.column("flags")]
    base = np.cumsum([0, *(len(p.docs) for p in parts[:-1])]).astype(np.uint32)
    docs, number = np.unique(np.concatenate([p.docs for p in parts]), axis=0, return_inverse=True)
    number = number.reshape(-1)
    doc, owner = (number[np.concatenate([p[i] + b for p, b in zip(parts, base, strict=True)])] for i in (0, 2))
    place, at = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 3))
    parts.clear()
    order = np.lexsort((at, owner, place, doc))
    doc, owner, place, at = doc[order], owner[order], place[order], at[order]
    single = np.ones(len(doc), bool)
    single[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    doc, owner, place, at = doc[single], owner[single], place[single], at[single]
    start = np.ones(len(doc), bool)
    start[1:] = (np.diff(doc) != 0) | (np.diff(owner) != 0) | (np.diff(place) != 1) | (np.diff(at) != 1)
    start = np.flatnonzero(start)
    size = np.diff([*start, len(doc)])
    rows, of = docs[doc[start]], docs[owner[start]]
    columns = [rows[:, 0], rows[:, 1], place[start], size, of[:, 0], of[:, 1], at[start]]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    return pa.table([pa.array(np.ascontiguousarray(c).astype(t.to_pandas_dtype())) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _SPANS.split(", ")])


def flagged_spans(made: DataFrame, slices: int) -> DataFrame:
    """Merge all runs by bucket and gather their flags: places in a row, with the owner's that they repeat."""

    def meet(table: pa.Table) -> pa.Table:
        blobs = table.column("run").drop_null().to_pylist()
        passed = table.filter(pa.compute.is_valid(table.column("flags"))).select(["slice", "flags"])
        del table
        found = merge([Run.open(b) for b in blobs])[0].slices(slices) if len(blobs) > 1 else {}
        columns = [pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.binary())]
        return pa.concat_tables([passed, pa.table(columns, names=["slice", "flags"])])

    flags = made.groupBy("bucket").applyInArrow(meet, "slice int, flags binary")
    return flags.groupBy("slice").applyInArrow(_spans, _SPANS)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the words of the spans that an owner's text is asked for."""
    for batch in batches:
        row, places, sizes, digests = [], [], [], []
        for i, (text, asked) in enumerate(zip(batch.column("text"), batch.column("asked"), strict=True)):
            words = text.as_py().encode("utf-8", "surrogatepass").split()
            for span in asked.as_py():
                row.append(i)
                places.append(span["at"])
                sizes.append(span["n"])
                digests.append(_digest(words[span["at"] : span["at"] + span["n"] + WINDOW - 1]))
        rows = pa.array(row, pa.int64())
        columns = [batch.column("id").take(rows), batch.column("text_hash").take(rows), pa.array(places, pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["owner", "owner_hash", "at", "n", "digest"])


def _with_digests(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, text_hash, spans) of flagged texts: each span with the digest of its owner's words, null without the owner."""
    asked = spans.select("owner", "owner_hash", "at", "n").distinct()
    asked = asked.groupBy("owner", "owner_hash").agg(F.collect_list(F.struct("at", "n")).alias("asked"))
    asked = asked.toDF("id", "text_hash", "asked")
    # hashing the narrow side spares the texts a sort
    owners = texts.join(asked.hint("shuffle_hash"), ["id", "text_hash"]).select("id", "text_hash", "text", "asked")
    answers = owners.mapInArrow(_answers, "owner long, owner_hash long, at int, n int, digest binary").distinct()
    found = spans.join(staged(answers, "substring-answers"), ["owner", "owner_hash", "at", "n"], "left")
    return found.groupBy("id", "text_hash").agg(F.collect_list(F.struct("place", "n", "digest")).alias("spans"))


def _removed(words: list[bytes], spans: list[dict], trusted: bool) -> np.ndarray:
    """Which words go: those of verified windows, and of the text's other windows with the same words."""
    gone, seen = np.zeros(len(words) + 1, np.int32), []
    for span in spans:
        a, n = span["place"], span["n"]
        agreed = trusted if span["digest"] is None else span["digest"] == _digest(words[a : a + n + WINDOW - 1])
        if agreed:
            seen += range(a, a + n)
    if not seen:
        return gone[:-1] != 0
    places = np.array(seen, np.int64)
    known = _WordHashes()
    h, _ = window_fingerprints(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    values, counts = np.unique(h, return_counts=True)
    if counts.max() > 1:
        first = dict(zip(h[places].tolist(), seen, strict=True))
        again = np.flatnonzero(np.isin(h, np.intersect1d(values[counts > 1], h[places])))
        same = [p for p in again.tolist() if words[p : p + WINDOW] == words[(q := first[int(h[p])]) : q + WINDOW]]
        places = np.union1d(places, np.array(same, np.int64))
    np.add.at(gone, places, 1)
    np.add.at(gone, places + WINDOW, -1)
    return np.cumsum(gone)[:-1] > 0


def _text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _in_order(history: DataFrame, rows: DataFrame) -> None:
    last, least = history.agg(F.max("last")).first()[0], rows.agg(F.min("id")).first()[0]
    if last is not None and least is not None and least <= last:
        raise ValueError(f"a batch begins at id {least}, and the history reaches to {last}: batches go by rising ids")


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    history: DataFrame | None = None,
    earlier: DataFrame | None = None,
    buckets: int | None = None,
    with_text: bool = False,
    fingerprints: Fingerprints = window_fingerprints,
) -> DataFrame:
    """Words removed from every row: id, ``n_words``, ``n_removed``, ``kept_sha256`` [, ``kept_text``].

    ``history`` is an index of earlier batches from :func:`compacted_index`, made with the
    same ``buckets``; all ids of a batch must be larger than those in it (an error else).
    ``earlier`` holds the rows of those batches, for verification.
    """
    size = _text_bytes(docs, text_col)
    buckets = buckets or max(8, -(-size // (_WORD_BYTES * BUCKET_WINDOWS)))
    layout = Layout.of(size // _WORD_BYTES, buckets, max(8, -(-size // SLICE_BYTES)))
    rows = _rows(docs, id_col, text_col)
    named = rows.filter("id IS NOT NULL")
    made = runs(named, layout, fingerprints).drop("tier")
    owners = named
    if history is not None:
        _in_order(history, named)
        none = [F.lit(None).cast(t).alias(c) for c, t in (("slice", "int"), ("flags", "binary"))]
        made = made.unionByName(history.select("bucket", "run", "last", *none))
        if earlier is not None:
            owners = owners.union(_rows(earlier, id_col, text_col).filter("id IS NOT NULL"))
    trusted = history is not None and earlier is None
    spans = staged(flagged_spans(made, layout.slices), "substring-spans")
    swept(docs.sparkSession)
    found = staged(_with_digests(spans, owners), "substring-flags")
    swept(docs.sparkSession)
    # hashing the narrow side spares the texts a sort
    joined = rows.join(found.hint("shuffle_hash"), ["id", "text_hash"], "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digests, texts = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                kept = words
                if spans.is_valid:
                    gone = _removed(words, spans.as_py(), trusted)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                left = b" ".join(kept)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode("utf-8", "replace") if with_text else None)
            columns = [batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
            columns += [pa.array(texts, pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.select("id", "text", "spans").mapInArrow(remove, schema)


def compacted_index(
    docs: DataFrame, buckets: int, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The index (bucket, run, last) of *docs* merged with *history*: one run for each bucket."""
    rows = _rows(docs, id_col, text_col).filter("id IS NOT NULL")
    layout = Layout.of(_text_bytes(docs, text_col) // _WORD_BYTES, buckets, 1)
    made = runs(rows, layout).filter("run IS NOT NULL").select("bucket", "run", "last")
    if history is not None:
        _in_order(history, rows)
        made = made.unionByName(history.select("bucket", "run", "last"))
    return staged(made.groupBy("bucket").applyInArrow(_compact, "bucket long, run binary, last long"), "substring-index")
