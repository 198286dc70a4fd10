"""Near copies at a Jaccard similarity of word shingles: SimHash first, and an exact way for the rest.

The pipeline's near-duplicate stage: five-word shingles (A-Z lower-cased) and a
similarity of 0.8.

1.  Multi-index hashing (``simhash.links``): each text's shingle set has a 64-bit SimHash;
    Hamming balls around its segments fetch the table's matches within three bits.  Pairs
    found so are verified on the exact shingle sets, and bring most copies into groups.
2.  Pairs at 0.8 can be many bits apart, so the rest comes from prefixes of the exact
    sets, in which every such pair meets for certain: two sets of at least that similarity
    share an element of the first n - ceil(0.8 n) + 1 of each, in whatever order all sets
    are put.  The order here is by hash, with shingles that a sample of the texts shows to
    be frequent behind all others, so that the prefixes hold few of them; which shingles
    are sampled decides about speed only.  A pair that meets must pass three bounds that no
    similar pair fails: on its lengths, on what is left behind the place where it meets, and
    on the bits in which 512-bit parities of the sets differ (no more than the elements in
    which the sets do).  What is left is verified on the exact sets of the whole texts.

Large groups: each text is first compared with the closest that its SimHash links it with,
then with the head of its prefix elements that it has the most of them in common with; then
only texts whose verified links have not brought them together already are paired, without
making the pairs inside the group that prevails under an element.  Where an element would
still bring many pairs together, texts outside its largest group are first compared, over a
few turns, with a fixed number of that group's texts, and linked with the closest by
parities; a part of a group that is similar to a text is met so whatever the group's size.
For pairs that are left there the bound on parities is part of the join.

Names: a text is named by a 64-bit hash.  Texts that a second hash tells apart get another
name, so that unlike texts never share one (but for an agreement of all 128 bits).

Defined cases: a null text counts as the empty text; equal texts are one class; texts of
fewer than five words have one shingle, the whole sequence, and texts without words are
near no other text; very long texts are taken whole (their sets are held one at a time);
of a group the row with the smallest id stays, null ids last, and of equal ids the one
whose text has the smaller name; repeated rows share a group, and one of them stays; an
empty table gives an empty result; extra columns pass through ``firsts``, whatever
their names, and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import never_sent, released, staged, swept, text_or_empty
from .components import connected_components
from .linking import pairs_across, with_groups

#: Similar sets have at least NEAR parts of OF of their union in common.
NEAR, OF = 4, 5
SHINGLE = 5
#: One text of so many is sampled; shingles found so often there are frequent, the
#: most frequent at most so many (8 bytes each in every task).
SAMPLE, OFTEN, MOST = 16, 3, 1_000_000
#: Bits that tell at the scan which texts have candidates, at most (32 MB in every task).
MOST_BITS = 1 << 28
#: Pairs of different groups for each row under an element, from which on it is crowded;
#: texts that a row is compared with in a turn there, and turns at most.
CROWD, HEADS, TURNS = 8, 8, 4
_CACHED_WORDS = 200_000
_PARITY = [f"p{i}" for i in range(8)]
_MIX = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_hashes(text: str, known: dict | None = None) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes: sums of the words' hashes times odd numbers."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    count = len(words) - SHINGLE + 1
    if count < 1:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    known = _Words() if known is None else known
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    made = np.zeros(count, np.uint64)
    for i in range(SHINGLE):
        made += each[i : i + count] * np.uint64(_MIX[i])
    return np.unique(made)


def prefix(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The elements, in the common order, of which a similar set's prefix has one."""
    late = np.isin(hashes, frequent, assume_unique=True)
    return np.concatenate([hashes[~late], hashes[late]])[: len(hashes) - -(-NEAR * len(hashes) // OF) + 1]


def parity(hashes: np.ndarray) -> np.ndarray:
    """512 bits, as eight signed longs; each element turns one over."""
    bits = np.bincount((hashes >> np.uint64(32)).astype(np.int64) & 511, minlength=512) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _all_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in batches:
        sets = [shingle_hashes(t.as_py(), known) for t in batch.column("_text")]
        found = np.concatenate([*sets, np.empty(0, np.uint64)])
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["key"])


def _frequent(named: DataFrame) -> np.ndarray:
    """Sorted hashes of frequent shingles; only these, MOST at most, reach the driver."""
    sample = named.filter(F.pmod("node", F.lit(SAMPLE)) == 0).select("_text")
    counts = sample.mapInArrow(_all_shingles, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts.filter(F.col("n") >= OFTEN), "near-frequent")
    # powers of two, so that the histogram has a few rows
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("level")).count().collect()
    total, least = 0, None
    for level, count in sorted(map(tuple, sizes), reverse=True):
        total += count
        if total > MOST:
            break
        least = level
    if least is None:
        return np.empty(0, np.uint64)
    found = counts.filter(F.floor(F.log2("n")) >= least).select("key").toArrow().column(0).to_numpy()
    return np.sort(found.view(np.uint64))


def _indexed(named: DataFrame) -> DataFrame:
    """(node, n, fp, parity, keys): each row's set size, SimHash, parity and prefix."""
    frequent = _frequent(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), known) for t in batch.column("_text")]
            parities = np.array([parity(s) for s in sets], np.int64).reshape(-1, len(_PARITY))
            keys = [prefix(s, frequent) if len(s) else s for s in sets]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64)
            prints = np.array([simhash.majority([s]) for s in sets], np.uint64).view(np.int64)
            columns = [batch.column("node"), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints)]
            columns += [pa.array(parities[:, i].copy()) for i in range(len(_PARITY))]
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "fp", *_PARITY, "keys"])

    longs = ", ".join(f"{p} long" for p in _PARITY)
    return named.select("node", "_text").mapInArrow(run, f"node long, n int, fp long, {longs}, keys array<long>")


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """Bits by the low digits of the nodes, about 16 for each node and ``MOST_BITS`` at most, as bytes."""
    bits = min(MOST_BITS, 1 << max(20, (16 * nodes.count()).bit_length()))
    at = F.pmod("node", F.lit(bits)) + 1
    made = nodes.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in made.collect():  # 4096 bytes each, bits / 8 in all
        out[4096 * (r.part - 1) : 4096 * r.part] = np.frombuffer(r.bits, np.uint8)
    return out


def _sets(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the *wanted* nodes: texts stay where they are read, most of the others are passed over there."""
    bitmap = _bitmap(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            at = np.mod(batch.column("node").to_numpy(zero_copy_only=False), 8 * len(bitmap))
            rows = pa.array(np.flatnonzero(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1))
            sets = [shingle_hashes(t.as_py(), known).tobytes() for t in batch.column("_text").take(rows)]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(rows), pa.array(sets, pa.binary())], ["node", "set"])

    sets = named.select("node", "_text").mapInArrow(run, "node long, set binary")
    return sets.join(wanted.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hold = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            hold.append(both > 0 and OF * both >= NEAR * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(hold, pa.bool_()))


def _postings(index: DataFrame) -> DataFrame:
    """(key, node, n, left) of the prefix elements that two texts have; left: elements from there on."""
    each = index.select("node", "n", F.posexplode("keys").alias("at", "key"))
    each = each.select("key", "node", "n", (F.col("n") - F.col("at")).alias("left"))
    shared = each.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("key")
    # hashing the narrow side spares the elements a sort
    return each.join(staged(shared, "near-shared").hint("shuffle_hash"), "key", "left_semi").distinct()


def _possible(n: str, left: str, m: str, right: str) -> Column:
    """The bounds on lengths and places, for sets of n and m elements that meet where left and right are left."""
    lengths = OF * F.least(n, m) >= NEAR * F.greatest(n, m)
    return lengths & ((NEAR + OF) * F.least(left, right) >= NEAR * (F.col(n) + F.col(m)))


def _apart(x: str, y: str) -> Column:
    """The bits in which two parities differ, their columns' names beginning so."""
    each = (F.bit_count(F.col(f"{x}{p}").bitwiseXOR(F.col(f"{y}{p}"))) for p in _PARITY)
    return reduce(Column.__add__, each)


def _close(apart: Column, n: str, m: str) -> Column:
    """The bound on parities: similar sets differ in (OF - NEAR) of (OF + NEAR) parts of their elements at most."""
    return (OF + NEAR) * apart <= (OF - NEAR) * (F.col(n) + F.col(m))


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b: each node with one of its own SimHash, and that one with the closest SimHash it links with."""
    prints = nodes.filter("n > 0").select("node", "fp")
    heads = staged(prints.groupBy("fp").agg(F.min("node").alias("head")), "near-prints")
    same = prints.join(never_sent(heads), "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = simhash.links(heads.select("fp"))
    both = links.union(links.select("b", "a"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    closest = both.groupBy("a").agg(F.min(F.struct(apart.alias("apart"), "b")).alias("near")).select("a", F.col("near.b").alias("b"))
    x, y = (never_sent(heads.toDF(side, f"{side}_head")) for side in ("a", "b"))
    linked = closest.join(x, "a").join(y, "b")
    linked = linked.select(F.least("a_head", "b_head").alias("a"), F.greatest("a_head", "b_head").alias("b"))
    return same.union(linked).distinct()


def _ties(postings: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different groups: each node with the head that it has the most prefix elements in common with."""
    one = F.struct(F.xxhash64("node"), "node", "a_group", "n", "left")
    heads = postings.groupBy("key").agg(F.min(one).alias("top")).select(
        "key", F.col("top.node").alias("head"), F.col("top.a_group").alias("of"), F.col("top.n").alias("m"), F.col("top.left").alias("right")
    )
    met = postings.join(never_sent(staged(heads, "near-heads")), "key").filter(F.col("a_group") != F.col("of"))
    met = met.filter(_possible("n", "left", "m", "right")).groupBy("node", "head").agg(F.count(F.lit(1)).alias("common"))
    best = met.groupBy("node").agg(F.max(F.struct("common", "head")).alias("top")).select("node", F.col("top.head").alias("head"))
    return best.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def _crowded(postings: DataFrame) -> DataFrame:
    """(key, main) of the elements with many pairs of different groups; main: the group with the most rows."""
    counts = postings.groupBy("key", "a_group").agg(F.count(F.lit(1)).alias("n"))
    found = counts.groupBy("key").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("inside"), F.max(F.struct("n", "a_group")).alias("main")
    )
    many = F.col("rows") * F.col("rows") - F.col("inside") > 2 * CROWD * F.col("rows")
    return staged(found.filter(many).select("key", F.col("main.a_group").alias("main")), "near-crowded")


def _with_parities(postings: DataFrame, crowded: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows under crowded elements, with ``main`` and parities."""
    found = postings.join(never_sent(crowded), "key").join(never_sent(nodes.select("node", *_PARITY)), "node")
    return staged(found.select("key", "node", "n", "left", "a_group", "main", *_PARITY), "near-crowd")


def _nearest(crowd: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b), a < b, of different groups: each node with the closest of HEADS rows of each of its crowded elements.

    The rows are drawn anew for each element and turn, from its main group first.
    """
    draws = [F.struct(F.col("a_group") != F.col("main"), F.xxhash64(F.lit(turn * HEADS + i), "key", "node"), "node", "a_group", "n", "left") for i in range(HEADS)]
    drawn = crowd.groupBy("key").agg(*(F.min(d).alias(f"h{i}") for i, d in enumerate(draws)))
    heads = [F.struct(*(F.col(f"h{i}.{c}").alias(c) for c in ("node", "a_group", "n", "left"))) for i in range(HEADS)]
    heads = drawn.select("key", F.inline(F.array_distinct(F.array(*heads)))).toDF("key", "head", "of", "m", "right")
    heads = staged(heads.join(never_sent(nodes.select(F.col("node").alias("head"), *(F.col(p).alias(f"_{p}") for p in _PARITY))), "head"), "near-heads")
    apart = _apart("", "_")
    met = crowd.join(never_sent(heads), "key").filter(F.col("a_group") != F.col("of")).filter(_possible("n", "left", "m", "right") & _close(apart, "n", "m"))
    met = met.groupBy("node").agg(F.min(F.struct(apart / (F.col("n") + F.col("m")), "head")).alias("top")).select("node", F.col("top.head").alias("head"))
    return met.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def _meetings(postings: DataFrame, crowded: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different groups that have a prefix element in common."""

    def met(rows: DataFrame, *bounds: Column) -> DataFrame:
        asked = rows.select("key", *(F.col(c).alias("b_group" if c == "a_group" else f"_{c}") for c in rows.columns if c != "key"))
        found = pairs_across(rows, asked, ["key"], symmetric=True).filter(_possible("n", "left", "_n", "_left"))
        for bound in bounds:
            found = found.filter(bound)
        return found.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"))

    if crowded.isEmpty():
        return met(postings).distinct()
    crowd = _with_parities(postings, crowded, nodes).drop("main")
    quiet = staged(postings.join(never_sent(crowded), "key", "left_anti"), "near-quiet")
    return met(quiet).union(met(crowd, _close(_apart("", "_"), "n", "_n"))).distinct()


def _grouped(postings: DataFrame, groups: DataFrame) -> DataFrame:
    found = with_groups(postings.select("key", "node", "n", "left"), groups, "node")
    return staged(found.withColumnRenamed("node_group", "a_group"), "near-grouped")


def _verified(pairs: DataFrame, nodes: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are similar enough."""
    names = ["n", *_PARITY]
    x, y = (never_sent(nodes.toDF(k, *(f"{k}_{c}" for c in names))) for k in ("a", "b"))
    close = _close(_apart("a_", "b_"), "a_n", "b_n")
    pairs = staged(pairs.join(x, "a").join(y, "b").filter(close).select("a", "b"), "near-pairs")
    wanted = staged(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "near-wanted")
    sets = staged(_sets(named, wanted), "near-sets")
    both = pairs.join(never_sent(sets.toDF("a", "set_a")), "a").join(never_sent(sets.toDF("b", "set_b")), "b")
    links = staged(both.select("a", "b", "set_a", "set_b").mapInArrow(_similar, "a long, b long"), "near-links")
    released(pairs, wanted, sets)
    swept(named.sparkSession)
    return links


def _named(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(_id, node, _check, _text) rows, and the names that unlike texts share."""
    text = text_or_empty(text_col)
    name, check = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    rows = docs.select(F.col(id_col).alias("_id"), name.alias("node"), check.alias("_check"), text.alias("_text"))
    twins = rows.groupBy("node").agg(F.min("_check").alias("_least"), F.max("_check").alias("_most"))
    twins = staged(twins.filter("_least <> _most").select("node", "_least"), "near-twins")
    return rows, twins


def _told_apart(rows: DataFrame, twins: DataFrame) -> DataFrame:
    """Rows whose ``node`` names one text: of texts with one hash all but one go by their second."""
    if twins.isEmpty():
        return rows.drop("_check")
    found = rows.join(twins, "node", "left").withColumn("node", F.when(F.col("_check") != F.col("_least"), F.col("_check")).otherwise(F.col("node")))
    return found.drop("_check", "_least")


def _groups(named: DataFrame) -> DataFrame:
    """(node, component) of the nodes that have near copies, ``named`` being (node, _text) rows."""
    index = staged(_indexed(named), "near-index")
    nodes = staged(index.select("node", "n", "fp", *_PARITY).distinct(), "near-parities")
    found = _by_simhash(nodes)
    nodes = nodes.drop("fp")
    links = _verified(found, nodes, named)
    plain = staged(_postings(index), "near-postings")
    released(index)
    swept(named.sparkSession)
    postings = _grouped(plain, connected_components(links))
    links = links.union(_verified(_ties(postings), nodes, named))
    released(postings)
    for turn in range(TURNS + 1):
        postings = _grouped(plain, connected_components(links))
        crowded = _crowded(postings)
        if turn == TURNS or crowded.isEmpty():
            break
        crowd = _with_parities(postings, crowded, nodes)
        more = _verified(_nearest(crowd, nodes, turn), nodes, named)
        released(crowd)
        if more.isEmpty():
            break
        links = links.union(more)
        released(postings)
    released(plain)
    links = links.union(_verified(_meetings(postings, crowded, nodes), nodes, named))
    released(postings)
    return connected_components(links)


def _labelled(named: DataFrame) -> DataFrame:
    """(node, keep_node, keep_id, keep_repeats, rows) of every node: which row of its group stays.

    ``rows`` counts the group's rows, ``keep_repeats`` those with the id and the text that stay.
    """
    by_id = named.groupBy("node", "_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "node", "n")
    ids = staged(by_id.groupBy("node").agg(F.min(first).alias("first"), F.sum("n").alias("n")), "near-nodes")
    found = with_groups(ids, _groups(named.select("node", "_text")), "node").withColumnRenamed("node_group", "root")
    found = staged(found, "near-roots")
    least = found.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("rows"))
    least = least.select("root", F.col("first.node").alias("keep_node"), F.col("first._id").alias("keep_id"), F.col("first.n").alias("keep_repeats"), "rows")
    return staged(found.select("node", "root").join(never_sent(staged(least, "near-least")), "root").drop("root"), "near-labels")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group_id) of every row: the id of the row of its group that stays."""
    named = _told_apart(*_named(docs, id_col, text_col))
    labels = _labelled(named)
    rows = staged(named.select("_id", "node"), "near-rows")
    return rows.join(never_sent(labels), "node").select(F.col("_id").alias(id_col), F.col("keep_id").alias("group_id"))


def firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of *docs* that stay: one of each group, told by its id and its text."""
    rows, twins = _named(docs, id_col, text_col)
    labels = _labelled(_told_apart(rows, twins))
    crowded = labels.filter("rows > 1").toDF("_node", "_keep_node", "_keep_id", "_keep_repeats", "_rows").drop("_rows")
    text = text_or_empty(text_col)
    own = docs.select(*(F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(docs.columns)), F.col(id_col).alias("_id"), F.xxhash64(text).alias("node"), F.xxhash64(F.lit(1), text).alias("_check"))
    own = _told_apart(own, twins).withColumnRenamed("node", "_node")
    # hashing the narrow side spares the texts a sort
    met = own.join(crowded.hint("shuffle_hash"), "_node", "left")
    stays = F.col("_keep_node").isNull() | ((F.col("_node") == F.col("_keep_node")) & F.col("_id").eqNullSafe(F.col("_keep_id")))
    kept = met.filter(stays)
    if not crowded.filter("_keep_repeats > 1").isEmpty():  # one of the repeats of a row
        again = Window.partitionBy("_node").orderBy("_node")
        single = kept.filter("coalesce(_keep_repeats, 1) = 1")
        once = kept.filter("_keep_repeats > 1").withColumn("_n", F.row_number().over(again)).filter("_n = 1").drop("_n")
        kept = single.unionByName(once)
    return kept.select(*(F.col(f"_own{i}").alias(c) for i, c in enumerate(docs.columns)))
