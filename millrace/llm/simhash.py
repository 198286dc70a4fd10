"""SimHash near-duplicates by multi-index hashing.

A text's words are lower-cased (A-Z), joined to 3-word shingles with repeats, and
hashed with XXH64 (seed 42); a fingerprint bit is set when more than half of the
hashes have it.  Fingerprints within ``MAX_BITS`` = 3 differing bits link.

Index: a fingerprint is two 32-bit segments.  Of two linked fingerprints at least
one segment differs in at most one bit, so every segment is looked up under itself
and its 32 one-bit neighbours (the Hamming ball of radius 1) in a table of all
segments, and full distances are verified inside the join.  32-bit keys keep a bucket
small: 10^10 distinct fingerprints put about two in each.

Dense groups: what a ball meets is first compared with one fingerprint of each bucket
only, which is linear, and the links found so bring the fingerprints into groups.  Then
the buckets are joined again for pairs of different groups alone; pairs inside the group
that prevails in a bucket are never made (``linking.pairs_across``).  Copies with one
fingerprint meet only once (links are computed between distinct fingerprints) and rows
are labelled by a join of written tables, which adaptive execution splits when one
fingerprint holds a large share of the rows.

Defined cases: a null or wordless text has fingerprint zero and links like any
other; fewer than three words give one shingle, the whole sequence; a null id is
labelled like its fingerprint and never is the smallest id unless all are null;
repeated rows share a label; an empty table gives an empty result; very long texts are
hashed whole, a slab of shingles at a time; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import never_sent, released, staged
from .components import connected_components
from .linking import pairs_across, with_groups

MAX_BITS = 3
SHINGLE = 3
SEED = 42
_SLAB = 1 << 18


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of one text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    count, digest, join = max(1, len(words) - SHINGLE + 1), xxhash.xxh64_intdigest, b" ".join
    slabs = (range(at, min(count, at + _SLAB)) for at in range(0, count, _SLAB))
    return majority(np.fromiter((digest(join(words[i : i + SHINGLE]), SEED) for i in r), np.uint64, len(r)) for r in slabs)


def majority(slabs: Iterable[np.ndarray]) -> int:
    """The number whose bits are those that more than half of the 64-bit hashes have."""
    count, ones = 0, np.zeros(64, np.int64)
    for hashes in slabs:
        count += len(hashes)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.fromiter((fingerprint(t.as_py()) for t in batch.column("_text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out.view(np.int64))], ["_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) rows; fp is the fingerprint's bits as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_fingerprints, f"_id {kind}, fp long").withColumnRenamed("_id", id_col)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at most ``MAX_BITS`` apart, as a written table.

    ``distinct`` has one column ``fp`` without repeats.  Of a dense group not all pairs
    come, but enough to connect it as all would.
    """
    fp = F.col("fp")
    segments = F.array(
        F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned(fp, 32).alias("key")),
        F.struct(F.lit(1).alias("seg"), fp.bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")),
    )
    table = distinct.select(F.col("fp").alias("a"), F.inline(segments))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << bit).cast("long") for bit in range(32)))
    ball = table.select(F.col("a").alias("b"), "seg", F.explode(flips).alias("flip"), F.col("key").alias("own"))
    ball = ball.select("b", "seg", F.col("own").bitwiseXOR(F.col("flip")).alias("key"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]

    # one fingerprint of each bucket, for all that look the bucket up
    heads = table.groupBy("seg", "key").agg(F.min("a").alias("a"), F.count(F.lit(1)).alias("n"))
    met = ball.join(never_sent(heads), ["seg", "key"]).filter((F.col("n") > 1) | (F.col("a") != F.col("b")))
    met = staged(met, "simhash-met")
    stars = staged(met.filter((F.col("a") != F.col("b")) & close).select(*ordered).distinct(), "simhash-stars")
    groups = connected_components(stars)
    shared = met.filter("n > 1")
    table = table.join(never_sent(shared.select("seg", "key").distinct()), ["seg", "key"], "left_semi")
    own = staged(with_groups(table, groups, "a"), "simhash-own")
    asked = staged(with_groups(shared.select("seg", "key", "b"), groups, "b"), "simhash-asked")
    found = pairs_across(own, asked, ["seg", "key"]).filter(close).select(*ordered)
    found = staged(stars.union(found).distinct(), "simhash-links")
    released(met, stars, own, asked)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row of *docs*."""
    rows = staged(fingerprints(docs, id_col, text_col), "simhash-rows")
    classes = staged(rows.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-classes")
    component = connected_components(links(classes.select("fp")))
    labelled = classes.join(never_sent(component.withColumnRenamed("node", "fp")), "fp", "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root")
    )
    labelled = staged(labelled, "simhash-roots")
    smallest = staged(labelled.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-smallest")
    classes = staged(labelled.join(never_sent(smallest), "root").select("fp", "component_id"), "simhash-labels")
    return rows.join(never_sent(classes), "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
