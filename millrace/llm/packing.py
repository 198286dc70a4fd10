"""Best-fit packing of documents into fixed-length sequences by pattern packing.

Only the histogram of piece lengths (at most ``size`` numbers) reaches the driver.
There, repeat counts of few-document patterns are fitted to the histogram by non-negative
least squares and rounded down.  The patterns come by column generation: each round weighs
all patterns of two to four documents and takes the fullest and heaviest for every length.
What is left over is packed best fit, longest first, again by length and repeat count.  The
plan maps (length, rank among the pieces of that length) to a sequence and an offset;
its size depends on ``size`` and not on the number of documents.  Ranks come from
salted windows, so that a frequent length is spread over many tasks.

Defined cases: a null text counts as the empty text, whose only token is the end
token; very long texts are encoded whole and cut to pieces, of which all but the first
have the full length; repeated rows are packed once each, null ids too; pieces of one
length are alike to the plan, ties go by id, piece and checksum; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import BYTE_PATTERN, Encoder, Vocabulary, byte_letters
from .common import staged, worker_state

SIZE = 1024
END_ID = 2
#: Patterns are of up to so many documents.
PATTERN_DOCS = 4
#: Rounds of new patterns, and sweeps over all counts in a round, at most; what is not
#: fitted by then is packed best fit, as is a share of this much.
_ROUNDS, _SWEEPS, _ENOUGH = 40, 20, 0.002
#: Rows that one rank window may hold on average.
_RANK_ROWS = 200_000


def byte_encoder(path: str) -> Callable[[str], bytes]:
    """Encoder of a byte-level vocabulary without word ends; gives little-endian 32-bit ids.

    The compiled library does the work; texts that exhaust its stack (very long runs
    of one kind of character) are encoded by the plain implementation.
    """
    import tiktoken

    state = worker_state()
    if path not in state:
        vocabulary = Vocabulary(path)
        value = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(value.__getitem__, t)): i for t, i in vocabulary.ids.items() if t not in vocabulary.special}
        state[path] = tiktoken.Encoding("byte", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=vocabulary.special)
    fast, plain = state[path], (path, "plain")

    def encode(text: str) -> bytes:
        try:
            return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        except BaseException as e:
            # its pattern matcher has a stack of fixed size
            if type(e).__name__ != "PanicException" and not (isinstance(e, ValueError) and "Regex error" in str(e)):
                raise
            if plain not in state:  # held by the workers that need it alone
                state[plain] = Encoder(Vocabulary(path))
            return state[plain].encode(text)

    return encode


def pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False
) -> DataFrame:
    """Tokenise and cut: (id, piece, start, length, ids_crc32[, ids])."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = byte_encoder(path), END_ID.to_bytes(4, "little")
        for batch in batches:
            row, number, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column("_text")):
                raw = encode(text.as_py() or "") + end
                n = len(raw) // 4
                at, k = 0, 0
                stop = n % size or size
                while at < n:
                    part = raw[4 * at : 4 * stop]
                    row.append(i)
                    number.append(k)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(memoryview(part).cast("i").tolist())
                    at, stop, k = stop, stop + size, k + 1
            columns = [
                batch.column("_id").take(pa.array(row, pa.int64())),
                pa.array(number, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(cut, schema).withColumnRenamed("_id", id_col)


def _largest(have: np.ndarray, most: int) -> int:
    """The largest length of at most *most* that has pieces, or 0."""
    found = np.flatnonzero(have[: most + 1])
    return int(found[-1]) if len(found) else 0


def propose_patterns(have: np.ndarray, weight: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """For each length the best pattern that has it, of all patterns of two to ``PATTERN_DOCS`` lengths.

    Best is what leaves the smallest gap, and then has the largest weight.  All patterns are
    weighed, by sums of one to ``PATTERN_DOCS`` - 1 lengths; none is left out of the choice.
    """
    lengths = [int(x) for x in np.flatnonzero(have[:size])]
    best = np.full((PATTERN_DOCS, size + 1), -np.inf)  # best[k, s]: weight of k lengths that add up to s
    last = np.zeros((PATTERN_DOCS, size + 1), np.int32)  # and one of those lengths
    best[0, 0] = 0.0
    for k in range(1, PATTERN_DOCS):
        for length in lengths:
            made = best[k - 1, : size + 1 - length] + weight[length]
            better = made > best[k, length:]
            best[k, length:][better] = made[better]
            last[k, length:][better] = length
    docs = best[1:].argmax(0) + 1
    reached = np.flatnonzero(best[1:].max(0) > -np.inf)
    found = {}
    for length in lengths:
        at = np.searchsorted(reached, size - length, side="right") - 1
        if at < 0:
            continue
        rest, parts = int(reached[at]), [length]
        for k in range(int(docs[rest]), 0, -1):
            parts.append(int(last[k, rest]))
            rest -= parts[-1]
        found[tuple(sorted(parts, reverse=True))] = None
    return list(found)


def fit_counts(patterns: list[tuple[int, ...]], wanted: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeat counts by non-negative least squares (cyclic coordinate descent), and what they leave."""
    rest, counts = wanted.astype(float).copy(), counts.copy()
    columns = [np.unique(np.array(p), return_counts=True) for p in patterns]
    for (at, times), count in zip(columns, counts, strict=True):
        rest[at] -= times * count
    norms = [float((m * m).sum()) for _, m in columns]
    for _ in range(_SWEEPS):
        moved = 0.0
        for j, (at, times) in enumerate(columns):
            step = max(-counts[j], float(rest[at] @ times) / norms[j])
            if step:
                counts[j] += step
                rest[at] -= times * step
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    return counts, rest


def choose_patterns(wanted: np.ndarray, size: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Patterns and their fitted counts, by column generation.

    What the fit leaves of the histogram weighs the lengths of the next round's patterns,
    until a round proposes none that is new or leaves no less.
    """
    patterns: list[tuple[int, ...]] = []
    counts, rest, left = np.zeros(0), wanted.astype(float), np.inf
    for _ in range(_ROUNDS):
        known = set(patterns)
        new = [p for p in propose_patterns(wanted, rest, size) if p not in known]
        if not new or not _ENOUGH * wanted.sum() < np.abs(rest).sum() <= 0.995 * left:
            break
        left = np.abs(rest).sum()
        counts, rest = fit_counts([*patterns, *new], wanted, np.concatenate([counts, np.zeros(len(new))]))
        used = np.flatnonzero(counts)
        patterns, counts = [[*patterns, *new][j] for j in used], counts[used]
    return patterns, counts


def plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) pairs that use every piece once; histogram[l] pieces have length l."""
    left, out = histogram.astype(np.int64).copy(), []

    def use(pattern: tuple[int, ...], most: int) -> None:
        at, times = np.unique(np.array(pattern), return_counts=True)
        repeats = int(min(most, (left[at] // times).min()))
        if repeats > 0:
            left[at] -= times * repeats
            out.append((pattern, repeats))

    if left[size]:
        use((size,), int(left[size]))
    patterns, counts = choose_patterns(left, size)
    least = int(np.flatnonzero(left)[0]) if left.any() else 0
    for j in np.argsort(-counts, kind="stable"):
        # a pattern with room for one more piece is no good one
        if counts[j] >= 1 and size - sum(patterns[j]) < least:
            use(patterns[j], int(counts[j]))
    while left.any():
        pattern, gap, spare = [], size, left.copy()
        while gap and (length := _largest(spare, gap)):
            pattern.append(length)
            spare[length] -= 1
            gap -= length
        use(tuple(pattern), int(left.max()))
    return out


def _placement(plans: list[tuple[tuple[int, ...], int]], size: int) -> tuple[np.ndarray, ...]:
    """Per (length, first rank) interval, in order: the key, the first sequence and the offset."""
    used, sequence, rows = [0] * (size + 1), 0, []
    for pattern, repeats in plans:
        offset = 0
        for length in pattern:
            rows.append((length << 44 | used[length], sequence, offset))
            used[length] += repeats
            offset += length
        sequence += repeats
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False
) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    cut = staged(pieces(docs, path, id_col, text_col, size, with_ids), "pack-pieces")
    rows = cut.count()
    salts = max(8, min(4096, rows // _RANK_ROWS))
    who = ["length", "_salt"]
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)))
    cells = staged(salted.groupBy(who).agg(F.count(F.lit(1)).alias("n")), "pack-cells")
    histogram = np.zeros(size + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        histogram[r.length] = r.n
    keys, sequences, offsets = _placement(plan(histogram, size), size)

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*who, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy(who).orderBy(id_col, "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order) - 1).join(cells, who)
    ranked = ranked.select(*cut.columns, (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            key = length << 44 | rank
            at = np.searchsorted(keys, key, side="right") - 1
            columns = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            columns += [pa.array(sequences[at] + key - keys[at]), pa.array(offsets[at])]
            names = [c for c in batch.schema.names if c != "_rank"] + ["sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from a result of ``pack(..., with_ids=True)``; at most ``size`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
