"""Quality classifier: naive Bayes log-count ratios under a linear hinge-loss model.

A text becomes a set of hashed n-gram indicators.  Each indicator is scaled by the
ratio of its smoothed, normalised counts in the two classes, and a linear model with
squared hinge loss is fitted to the scaled indicators by dual coordinate descent.  The
margin becomes a probability by a logistic curve fitted to margins of rows that their
model has not seen (cross-fitting on the training rows only).

The fit uses a bounded sample of labelled rows (``TRAIN_ROWS``, those with the
smallest hash of their id); only their indicator numbers reach the driver.  The model,
one weight for each of ``2 ** BITS`` indicators, is a constant-size array that goes
out to the tasks; scoring is one row-local scan of all rows.

Defined cases: a null text counts as the empty text and is scored by the model's
intercept; a label that is null, or a labelled id without a row, is not used; an id
labelled twice trains with each label; without rows of both classes every score is the
share of good labels (0.5 without any); repeated rows are scored alike; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
#: Labelled rows that the model is fitted on at most.
TRAIN_ROWS = 6000
FOLDS, HELD_OUT_FOLD = 5, 0
THRESHOLD = 0.3
SMOOTHING = 1.0
COST = 0.05
EPOCHS = 12
_CACHED_WORDS = 300_000

# Classes of bytes for shape n-grams: lower, upper and other letters, digits, white
# space, and every other ASCII character as itself.
_SHAPE = np.array(
    [
        1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b >= 128 else 5 if b in b" \t\x0b\x0c" else b % 64 + 8
        for b in range(256)
    ],
    np.uint64,
)


class Model(NamedTuple):
    weight: np.ndarray  # one for each indicator
    ratio: np.ndarray  # log-count ratio of each indicator
    bias: float
    slope: float  # of the logistic curve over margins
    shift: float

    def score(self, row: np.ndarray) -> float:
        margin = _margin(row, self.weight, self.bias, self.ratio)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _buckets(values: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (values + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int32)


def indicators(text: str | None, known: dict) -> np.ndarray:
    """The distinct n-gram numbers of a text: words, word pairs, and shape 2- to 5-grams.

    Shapes also see how often n-grams come back (in powers of two for each 1000 bytes),
    which is how repetition shows.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = []
    words = np.fromiter(map(known.__getitem__, raw.lower().split()), np.uint64)
    with np.errstate(over="ignore"):
        if len(words):
            found.append(_buckets(words, 1))
            again = (words[1:] == words[:-1]).sum()
            found.append(_buckets(np.array([int(again * 20 // len(words)), len(words).bit_length() + 100, _ratio(len(set(words.tolist())), len(words)) + 200], np.uint64), 2))
        if len(words) > 1:
            found.append(_buckets(words[1:] * np.uint64(3) + words[:-1], 3))
        shape = _SHAPE[np.frombuffer(raw, np.uint8)]
        gram = shape
        for n in range(2, 6):
            if len(shape) < n:
                break
            gram = gram[:-1] * np.uint64(131) + shape[n - 1 :]
            values, counts = np.unique(gram, return_counts=True)
            level = np.frexp(counts * 1000.0 / len(raw))[1].astype(np.int64) + 32
            found += [_buckets(values, 3 + n), _buckets(values * np.uint64(64) + level.astype(np.uint64), 13 + n)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


def _ratio(a: int, b: int) -> int:
    return 20 * a // b


def _descend(rows: list[np.ndarray], sign: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear model over scaled indicators: dual coordinate descent for the squared hinge loss."""
    weight, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    scaled = [_scaled(r, ratio) for r in rows]
    norm = np.array([(s * s).sum() + 1.0 for s in scaled])
    # classes weigh the same in total
    share = np.where(sign > 0, (sign > 0).mean(), (sign < 0).mean())
    diagonal = share / COST
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            margin = sign[i] * (weight[rows[i]] @ scaled[i] + bias) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - margin / (norm[i] + diagonal[i]))
            step = (new - alpha[i]) * sign[i]
            if step:
                weight[rows[i]] += step * scaled[i]
                bias += step
                alpha[i] = new
    return weight, bias


def _scaled(row: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    values = ratio[row]
    return values / (np.sqrt((values * values).sum()) or 1.0)


def _margin(row: np.ndarray, weight: np.ndarray, bias: float, ratio: np.ndarray) -> float:
    return float(weight[row] @ _scaled(row, ratio)) + bias


def _ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log-count ratios of the indicators."""
    counts = [np.full(1 << BITS, SMOOTHING), np.full(1 << BITS, SMOOTHING)]
    for r, g in zip(rows, good, strict=True):
        counts[int(g)][r] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def _logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability over margins, by Newton steps."""
    a, b = 1.0, 0.0
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w, e = p * (1 - p) + 1e-9, target - p
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, np.array([(e * margin).sum(), e.sum()]))
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    empty = np.zeros(1 << BITS, np.float32)
    if not good.any() or good.all():
        share = float(good.mean()) if len(good) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(empty, empty, 0.0, 1.0, float(np.log(share / (1 - share))))
    sign = np.where(good, 1.0, -1.0)
    fold, margin = np.arange(len(rows)) % 3, np.zeros(len(rows))
    for k in range(3):
        inside = np.flatnonzero(fold != k)
        if good[inside].all() or not good[inside].any():
            continue
        part = [rows[i] for i in inside]
        ratio = _ratios(part, good[inside])
        weight, bias = _descend(part, sign[inside], ratio)
        out = np.flatnonzero(fold == k)
        margin[out] = [_margin(rows[i], weight, bias, ratio) for i in out]
    slope, shift = _logistic(margin, good)
    ratio = _ratios(rows, good)
    weight, bias = _descend(rows, sign, ratio)
    return Model(weight.astype(np.float32), ratio.astype(np.float32), bias, slope, shift)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows whose labels are never learned from."""
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    return fold == HELD_OUT_FOLD


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most ``TRAIN_ROWS`` labelled rows that are not held out."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.select(id_col, (F.col(label_col) == 1).alias("_good"))
    sample = known.orderBy(F.xxhash64(id_col), id_col, "_good").limit(TRAIN_ROWS)
    chosen = docs.select(id_col, text_col).join(F.broadcast(sample), id_col)  # TRAIN_ROWS rows

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            rows = [indicators(t.as_py(), hashes).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["_id", "good", "row"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    found = chosen.mapInArrow(number, f"_id {kind}, good boolean, row binary")
    # repeats of a labelled row could outgrow the sample: one row for each id and label
    found = found.groupBy("_id", "good").agg(F.first("row").alias("row"))
    table = found.toArrow().to_pylist()
    table.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["_id"])), r["good"]))
    return fit([np.frombuffer(r["row"], np.int32) for r in table], np.array([r["good"] for r in table], bool))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            scores = np.array([model.score(indicators(t.as_py(), hashes)) for t in batch.column(2)], float)
            columns = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    scored = rows.mapInArrow(run, f"_id {kind}, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("_id", id_col)


