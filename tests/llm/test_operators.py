"""The training-data operators on small fixtures, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from millrace.llm import (
    bpe,
    components,
    exact_dedup,
    license_scan,
    near_copies,
    packing,
    pii,
    quality_nb,
    quality_rules,
    simhash,
    substring_dedup,
    warc,
)
from millrace.llm.components import connected_components

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("kept", T.StringType()),  # clashes with result columns
        T.StructField("n_words", T.StringType()),
    ]
)
PASSAGE = " ".join(f"shared{i}" for i in range(30))
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "Alpha beta gamma delta. The quick brown fox jumps over it.\nNext line is here now."),
    (2, "Alpha beta gamma delta. The quick brown fox jumps over it.\nNext line is here now."),
    (3, f"first words {PASSAGE} last words"),
    (4, f"other start {PASSAGE} other end <|endoftext|>"),
    (5, None),
    (6, ""),
    (7, LONG),
    (8, "Released under the MIT License. Licensed under the Apache License, Version 2.0."),
    (8, "Released under the MIT License. Licensed under the Apache License, Version 2.0."),
    (9, "a a a a a a É ß ΑΣ 'll don't 12³ 　 \x85 x"),
    (None, "no id at all"),
    (10, "mail joe.doe@example.com card 4111 1111 1111 1111 and 4111111111111112 from 10.20.30.40 on 2021-02-28 or 2021-02-30"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_exact(docs, empty):
    rows = exact_dedup.exact_dedup(docs).collect()
    groups = Counter(t or "" for _, t in TEXTS)
    for r in rows:
        t = r.text or ""
        ids = [i for i, x in TEXTS if (x or "") == t and i is not None]
        assert (r.keep_id, r.group_size) == (max(ids, default=None), groups[t])
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert r.kept == (r.doc_id == r.keep_id)
    kept = exact_dedup.exact_dedup(docs).filter("kept")
    assert exact_dedup.one_row_per_id(kept).count() == len(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_rules_measures(docs, empty):
    for r in quality_rules.measure(docs).collect():
        t = r.clean_text is not None and next(x or "" for i, x in TEXTS if i == r.doc_id)
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert quality_rules.measure(empty).count() == 0


def test_rules_lines(spark):
    prose = "\n".join(f"Plain{i} sentence{i} number{i} of a clean{i} document, made{i} of other{i} words{i}." for i in range(9))
    table = "\n".join(" | ".join(f"c{i}{j}" for j in range(12)) for i in range(9))
    rows = spark.createDataFrame([(1, prose), (2, table), (3, prose + "\nHome\nAll rights reserved.")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.measure(rows).collect()}
    assert [got[i].kept for i in (1, 2, 3)] == [True, False, True]
    assert got[1].clean_text == got[3].clean_text == prose


def test_simhash(spark, docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert sorted(int(r.fingerprint, 16) for r in rows) == sorted(simhash.fingerprint(t) for _, t in TEXTS)
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[2] == 1 and by[5] == by[6] == 5
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [10_000, 5])
def test_components(spark, monkeypatch, block):
    """One block, and star rounds where the table is larger than a block."""
    monkeypatch.setattr(components, "BLOCK_EDGES", block)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (100, 102), (-5, 100), (200, 201), (202, 201)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((-5, 100, 101, 102), -5), **dict.fromkeys((200, 201, 202), 200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies(spark):
    base = [f"word{i}" for i in range(300)]
    near, far = list(base), list(base)
    near[40], near[200] = "changed", "altered"
    for i in range(0, 300, 9):
        far[i] = f"other{i}"
    rows = [(5, base), (6, near), (7, far), (8, [f"none{i}" for i in range(300)])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(9, None), (10, "")], "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in near_copies.near_copies(df).collect()}
    assert got == {5: 5, 6: 5, 7: 7, 8: 8, 9: 9, 10: 9}


def _without_repeats(rows):
    """For each (id, text) the text that is left, by a table of all windows."""
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        w = words(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for j in range(len(w) - 12):
            if i is not None and first[tuple(w[j : j + 13])] < i:
                gone |= set(range(j, j + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _deduplicated(df, **options):
    made = substring_dedup.substring_dedup(df, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in made), key=str)


def _passages():
    """Rows that share passages within and across tasks, repeat them inside, and share ids."""
    rng = np.random.default_rng(2)
    common = [[f"p{k}x{i}" for i in range(int(rng.integers(13, 60)))] for k in range(12)]
    rows = []
    for i in range(150):
        parts = [[f"own{i}x{rng.integers(30)}" for _ in range(int(rng.integers(2, 20)))]]
        for k in rng.integers(12, size=int(rng.integers(0, 4))):
            parts += [common[k][int(rng.integers(3)) :], [f"own{i}y{rng.integers(30)}" for _ in range(int(rng.integers(0, 9)))]]
        rows.append((int(rng.integers(100)), " ".join(w for p in parts for w in p)))
    return [*rows, rows[0], rows[7], (500, " ".join(common[0] * 3)), (501, " ".join(["a"] * 40)), (502, " ".join(["a"] * 30)), (None, " ".join(common[1]))]


def test_substring(spark, docs, empty):
    assert _deduplicated(docs, buckets=5) == _without_repeats(TEXTS)
    rows = _passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _deduplicated(df, buckets=7) == _without_repeats(rows)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_levels_and_tiers(spark, monkeypatch):
    """Runs of few windows, merged in levels, and more buckets than parts of a run."""
    for name, value in (("RUN_WINDOWS", 300), ("FAN", 2), ("MOST_PARTS", 4), ("BUCKET_WINDOWS", 200)):
        monkeypatch.setattr(substring_dedup, name, value)
    rows = _passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _deduplicated(df, buckets=11) == _without_repeats(rows)


def test_substring_verifies_words(spark):
    """Fingerprints that all agree remove nothing but what truly repeats."""

    def alike(hashes):
        n = max(0, len(hashes) - 12)
        return np.zeros(n, np.uint64), np.zeros(n, np.uint16)

    texts = [" ".join(f"t{i}w{k}" for k in range(40)) for i in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.substring_dedup(df, fingerprints=alike).collect()} == {0}


def test_substring_in_batches(spark, docs):
    rows = [(i, t) for i, t in [*TEXTS, *((i and i + 20, t) for i, t in _passages())] if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r[0]: [x for x in _without_repeats(rows) if x[0] == r[0]] for r in rows}
    old, new = df.filter("doc_id < 60"), df.filter("doc_id >= 60")
    index = substring_dedup.compacted_index(old, 4)
    for options in ({}, {"earlier": old}):
        made = _deduplicated(new, history=index, buckets=4, **options)
        assert made == sorted((x for i, w in whole.items() if i >= 60 for x in w), key=str)
    both = substring_dedup.compacted_index(new, 4, history=index)
    assert both.groupBy("bucket").count().filter("count > 1").count() == 0
    with pytest.raises(ValueError, match="rising"):
        substring_dedup.substring_dedup(old, history=index, buckets=4)


def test_bpe(docs, empty):
    path = public.path("word_bpe_49k.json")
    want = tokenizers.Tokenizer.from_file(path)
    for r in bpe.encode_documents(docs, path, with_text=True).collect():
        t = next(x for i, x in TEXTS if i == r.doc_id) or ""
        ids = want.encode(t, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded == want.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(empty, path).count() == 0


def test_bpe_slabs_and_stores(monkeypatch):
    """Slabs of any size, a store of merged words that overflows, and a lexicon of some words give the library's ids."""
    path = public.path("word_bpe_49k.json")
    want, v = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary(path)
    rng = np.random.default_rng(0)
    letters = list("abcdefghijklmnopqrstuvwxyzéß0123456789'.,!-")
    texts = [" ".join("".join(rng.choice(letters, int(rng.integers(1, 14)))) for _ in range(int(rng.integers(0, 60)))) for _ in range(120)]
    texts += ["", "x" * 5000, "<|endoftext|>a<|endoftext|>", "ﬁ ½ 漢字 👍🏽"]
    some = sorted({w.encode() for t in texts[::3] for w in v.words(v.fold(t))})
    lexicon = bpe.Lexicon(bpe.Lexicon.compile((w, v.merge(w.decode())) for w in some))
    expected = [np.array(e.ids, "<u4").tobytes() for e in want.encode_batch(texts, add_special_tokens=False)]
    for chars, held in ((1, 1), (500, 4000), (10**9, 10**9)):
        monkeypatch.setattr(bpe, "SLAB_CHARS", chars)
        monkeypatch.setattr(bpe, "MERGED_BYTES", held)
        assert list(bpe.Encoder(v, lexicon).slabs(iter(texts))) == expected


def test_lexicon_and_merges():
    v = bpe.Vocabulary(public.path("word_bpe_49k.json"))
    some = sorted(w.encode() for w in ["tap", "taps", "top", "tops", "stop", "stops", "é", "a"])
    lexicon = bpe.Lexicon(bpe.Lexicon.compile((w, v.merge(w.decode())) for w in some))
    assert all(memoryview(lexicon.find(w)).cast("I").tolist() == v.merge(w.decode()) for w in some)
    assert lexicon.find(b"to") is None and lexicon.find(b"stopss") is None
    asked = [w for i in range(300) for w in (some[i % 8], b"to", b"stops" * 40, b"z", some[i % 8] + b"x")]
    assert lexicon.find_all(asked) == [lexicon.find(w) for w in asked] and lexicon.find_all([]) == []
    assert bpe.Lexicon(bpe.Lexicon.compile([])).find_all([b"a"]) == [None]
    assert len(lexicon.final) < sum(len(w) for w in some)  # suffixes are shared
    word = "internationalisation" * 3
    short, bpe.SHORT_WORD = v.merge(word), 0
    try:
        assert v.merge(word) == short
    finally:
        bpe.SHORT_WORD = 48


def test_packing(docs, empty):
    path = public.path("byte_bpe_50k.json")
    want = tokenizers.Tokenizer.from_file(path)
    rows = packing.pack(docs, path, with_ids=True).collect()
    seen = Counter()
    for r in rows:
        t = next(x for i, x in TEXTS if i == r.doc_id) or ""
        ids = [*want.encode(t, add_special_tokens=False).ids, 2][r.start : r.start + r.length]
        assert r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.length == 1024 or r.piece == 0
        seen[r.sequence_id] += r.length
    for s in seen:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(seen) == -(-sum(seen.values()) // 1024)
    assert packing.pack(empty, path).count() == 0


def test_packing_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    h = np.bincount(np.clip(rng.lognormal(5, 0.8, 200_000).astype(int), 1, 1024), minlength=1025)
    plan = packing.plan(h)
    used = np.zeros(1025, int)
    for pattern, n in plan:
        assert sum(pattern) <= 1024
        for x in pattern:
            used[x] += n
    assert (used == h).all()
    assert sum(n for _, n in plan) <= 1.002 * -(-int((h * np.arange(1025)).sum()) // 1024) + 1


def test_packing_weighs_all_patterns():
    """For each length the fullest and heaviest of all patterns of two to four lengths, by enumeration."""
    from itertools import combinations_with_replacement

    rng = np.random.default_rng(1)
    for size in (9, 16, 23):
        have = rng.integers(0, 2, size + 1)
        have[[0, size]] = 0
        weight = rng.random(size + 1)
        lengths = np.flatnonzero(have).tolist()
        every = [p for k in (2, 3, 4) for p in combinations_with_replacement(lengths, k) if sum(p) <= size]
        got = packing.propose_patterns(have, weight, size)
        rank = lambda p: (sum(p), sum(weight[x] for x in p))
        for length in lengths:
            best = max((rank(p) for p in every if length in p), default=None)
            found = [rank(p) for p in got if length in p]
            assert best is None or any(f[0] == best[0] and abs(f[1] - best[1]) < 1e-9 for f in found)
        assert all(2 <= len(p) <= 4 and sum(p) <= size for p in got)


def test_packing_plan_uses_four_documents():
    """A dense histogram of 2 million pieces: near the bound, with patterns of every size."""
    rng = np.random.default_rng(0)
    x = np.maximum(1, rng.lognormal(6, 1, 2_000_000).astype(int))
    h = np.bincount(np.where(x > 1024, x % 1024 + (x % 1024 == 0), x), minlength=1025)
    plan = packing.plan(h)
    by_size = Counter()
    for pattern, n in plan:
        by_size[len(pattern)] += n
    assert min(by_size[k] for k in (2, 3, 4)) > 100
    assert sum(by_size.values()) <= 1.0005 * -(-int((h * np.arange(1025)).sum()) // 1024)


def test_license(docs, empty):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert (got[8].n_base, got[8].first_word, got[8].last_word) == (2, 3, 8)
    assert got[8].base_labels == "apache,mit" and got[8].labels == "apache,apache-2.0,mit"
    assert got[5].n_words == 0 and got[5].first_word is None and got[1].labels == "" and got[1].score == 0
    assert license_scan.scan(empty).count() == 0


def test_pii(docs, empty):
    got = {r.doc_id: r for r in pii.pseudonymise(docs).collect()}
    t = got[10].text
    assert got[10].pii_kinds == "card,date,email,ipv4" and got[10].n_pii == 4
    assert "4111111111111112" in t and "2021-02-30" in t  # neither is valid
    for gone in ("joe.doe@", "4111 1111 1111 1111", "10.20.30.40", "2021-02-28"):
        assert gone not in t
    card = re.sub(r"\D", "", re.search(r"card ([\d ]+) and", t)[1])
    assert len(card) == 16 and pii.luhn_digit(card[:-1]) == card[-1]
    assert got[5].text is None and got[6].text == "" and got[7].text == LONG
    assert pii.pseudonymise(empty).count() == 0


def test_permutation_is_one_to_one_and_moves_all():
    p = pii.Permutation("k")
    for n in (2, 3, 10, 97, 1000):
        made = [p(x, n, "t") for x in range(n)]
        assert sorted(made) == list(range(n)) and all(a != b for a, b in enumerate(made))
    assert [p(x, 97, "t") for x in range(97)] != [pii.Permutation("other")(x, 97, "t") for x in range(97)]


def test_warc(spark):
    big = "<html>" + "payload " * 40
    rows = [(3, "http://a.example.com/x?b=2&a=1", big), (1, "https://www.a.example.com/y", big), (2, None, big), (4, "http://b.org", "tiny"), (5, "http://b.org", "tiny"), (6, "not a url", None), (7, "http://c.org/é", "ü" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    got = {r.page_id: r for r in warc.lookup(archive, pages).collect()}
    assert len(got) == 7
    for i, _, html in rows:
        body = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
    assert [got[i].record_type for i in range(1, 8)] == ["response", "revisit", "revisit", "response", "response", "response", "response"]
    assert [got[i].refers_to for i in (2, 3, 4)] == [1, 1, None] and bytes(got[7].payload) == ("ü" * 100).encode()
    assert warc.lookup(archive, pages.filter("page_id = 4")).count() == 1
    none = warc.write_archive(pages.limit(0))
    assert warc.lookup(none, pages).count() == 0


def test_warc_levels_and_odd_rows(spark, monkeypatch):
    """Directories of directories; repeated rows, null ids, long payloads and clashing column names."""
    for name, value in (("BLOCK_LINES", 3), ("MOST_BLOCKS", 4), ("BATCH_BYTES", 2000), ("TASK_BYTES", 4000)):
        monkeypatch.setattr(warc, name, value)
    rng = np.random.default_rng(0)
    rows = [(i, f"http://h{rng.integers(9)}.org/p{rng.integers(30)}", f"<p>{rng.integers(40)}</p>" * 60) for i in range(120)]
    rows += [rows[5], rows[5], (None, "http://h1.org/p1", "null id " * 40), (None, None, None), (500, "http://long.org/", "x" * 1_500_000), (501, "http://long.org/", "x" * 1_500_000)]
    pages = spark.createDataFrame([(*r, b"p", "d") for r in rows], "page_id long, url string, html string, payload binary, digest string")
    archive = warc.write_archive(pages)
    assert archive.levels > 2 and len(archive.first) <= 4
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    want = []
    for i, _, html in rows:
        body = html or ""
        again = len(body) >= 100 and body in first and i != first[body]
        want.append((i, len(body), hashlib.sha256(body.encode()).hexdigest(), "revisit" if again else "response", first[body] if again else None, None if again else len(body)))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else len(r.payload)) for r in warc.lookup(archive, pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_classifier(spark, empty):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["river", "stone", "walks", "evening", "paper"], 60)) + "." for _ in range(150)]
    bad = [" | ".join(rng.choice(["BUY", "$$$", "click", "###"], 40)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate([*good, *bad, None, ""])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(0, None), (9999, 1)], "doc_id long, quality int")
    rows = quality_nb.score(docs, quality_nb.train(docs, labels)).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
        if r.doc_id < 300:
            assert r.predicted == int(r.doc_id < 150)
    untrained = quality_nb.train(docs, labels.filter("doc_id < 0"))
    assert {r.score for r in quality_nb.score(docs, untrained).collect()} == {0.5}
    assert quality_nb.score(empty, untrained).count() == 0


def _jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_finds_every_pair(spark):
    rng = np.random.default_rng(3)
    odds = 1 / np.arange(1, 5001)
    draw = lambda n: [f"w{k}" for k in rng.choice(5000, n, p=odds / odds.sum())]
    rows, want = [], {}
    for k in range(240):
        base = draw(int(rng.integers(100, 800)))
        part = int(len(base) * rng.uniform(0.05, 0.25))
        at = int(rng.integers(0, len(base) - part))
        copy = (base + draw(part), base[part:], base[:at] + draw(part) + base[at + part :])[k % 3]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + (_jaccard(base, copy) < 0.8)}
    # a group of which no member is like all others: a window sliding over one text
    chain = draw(1400)
    rows += [(1000 + k, " ".join(chain[20 * k : 20 * k + 400])) for k in range(40)]
    want |= {1000 + k: 1000 for k in range(40)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.group_id for r in near_copies.near_copies(df).collect()} == want
    assert 60 < sum(i != g for i, g in want.items() if i < 1000) < 200


def test_rules_long_lines_of_few_words(spark):
    prose = [f"Plain{i} sentence{i} number{i} of a clean{i} document, made{i} of other{i} words{i}." for i in range(8)]
    blobs = ["0123456789abcdef" * 125 for _ in range(3)]
    # a fifth to a quarter of the characters are punctuation: kept; long boilerplate of few words: not
    marks = " ".join("abc," for _ in range(12)) + " done."
    legal = "All rights reserved " + " ".join("x" * 20 for _ in range(12)) + "."
    rows = [(1, prose + blobs), (2, [*prose, marks]), (3, [*prose, legal]), (4, [*prose, " ".join(["ab$cdefg"] * 8) + "."])]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.measure(df).collect()}
    whole = "\n".join(prose)
    assert [got[i].kept for i in (1, 2, 3, 4)] == [False, True, True, True]
    assert [got[i].clean_text for i in (1, 3, 4)] == [whole] * 3
    assert got[2].clean_text == f"{whole}\n{marks}"


@pytest.mark.parametrize(
    ("text", "value", "kind"),
    [
        ("exp 4111 1111 1111 1111 12/27", "4111 1111 1111 1111", "card"),
        ("code 4111111111111111 123", "4111111111111111", "card"),
        ("pay 4111111111111111 5 times", "4111111111111111", "card"),
        ("no 4111-1111-1111-1111-123.", "4111-1111-1111-1111", "card"),
        ("to ES9121000418450200051332 BIC CAIXESBB", "ES9121000418450200051332", "iban"),
        ("to ES91 2100 0418 4502 0005 1332 BIC", "ES91 2100 0418 4502 0005 1332", "iban"),
        ("to AT611904300234573201 EUR 50", "AT611904300234573201", "iban"),
    ],
)
def test_pii_with_more_behind_it(text, value, kind):
    new, kinds = pii.Pseudonyms("key").replace(text)
    head, tail = text.split(value)
    assert kinds == [kind] and new.startswith(head) and new.endswith(tail) and len(new) == len(text)
    made = re.sub(r"[ -]", "", new[len(head) : len(new) - len(tail)])
    assert made != re.sub(r"[ -]", "", value)
    assert pii.iban_holds(made) if kind == "iban" else pii.luhn_digit(made[:-1]) == made[-1]
    assert pii.Pseudonyms("key").replace("not 4111 1111 1111 1112 12/27")[1] == []


def test_near_copies_keep_unrelated_rows(spark):
    """Rows are told by id and text: repeated and null ids, repeated rows, clashing names, an unlike text with the id of a copy."""
    text = " ".join(f"word{i}" for i in range(200))
    copy, other = text.replace("word7 ", "changed "), " ".join(f"none{i}" for i in range(200))
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [(3, text), (8, copy), (8, other), (None, copy + " more"), (None, "alone here as a text of its own"), (5, other + " end"), (9, long), (9, long), (4, None), (6, "")]
    df = spark.createDataFrame([(i, t, "n", "g") for i, t in rows], "doc_id long, text string, node string, _id string")
    kept = near_copies.firsts(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(3, text), (None, "alone here as a text of its own"), (5, other + " end"), (9, long), (4, None)], key=str)


def test_near_copies_names_told_apart(spark):
    rows = spark.createDataFrame([(1, 5, 10, "a"), (2, 5, 11, "b"), (3, 6, 12, "c")], "_id long, node long, _check long, _text string")
    twins = spark.createDataFrame([(5, 10)], "node long, _least long")
    assert sorted((r._id, r.node) for r in near_copies._told_apart(rows, twins).collect()) == [(1, 5), (2, 11), (3, 6)]


def _simhash_plainly(text):
    """Word by word and bit by bit, without the module's code."""
    import xxhash

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    texts = [(i, t) for i, t in TEXTS if i != 7]
    for k in range(30):
        base = [f"W{x}" for x in rng.integers(400, size=150)]
        for n in range(6):
            words = list(base)
            for at in rng.integers(150, size=n):
                words[at] = f"x{rng.integers(1000)}"
            texts.append((100 + 10 * k + n, " ".join(words)))
    prints = [_simhash_plainly(t) for _, t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {r: min((texts[i][0] for i in range(len(texts)) if root[i] == r and texts[i][0] is not None), default=None) for r in set(root)}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, fingerprint string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(((t[0], f"{p:016x}", least[r]) for t, p, r in zip(texts, prints, root, strict=True)), key=str)
    assert len(least) < len(texts) - 20


def test_simhash_dense_group(spark):
    """A dense group: its links come as far fewer than its pairs, and none between groups is lost."""
    rng = np.random.default_rng(4)
    center = int(rng.integers(1 << 62))
    values = {center} | {center ^ (1 << i) for i in range(60)} | {center ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}
    far = center ^ 0b1111 ^ (0b11 << 40)
    values |= {far, far ^ (1 << 50), center ^ (0b11111 << 30)}
    links = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert all(a < b and (a ^ b).bit_count() <= 3 for a, b in links)

    def components(pairs):
        root = {v: v for v in values}
        for a, b in pairs:
            old, new = root[a], root[b]
            root = {v: new if r == old else r for v, r in root.items()}
        return {frozenset(v for v in values if root[v] == r) for r in set(root.values())}

    every = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3]
    assert components(links) == components(every) and len(links) < len(every) / 2


def _valid(kind, text):
    """Whether a text is a value of its kind, by plain checks."""
    import ipaddress
    from datetime import date

    digits = re.sub(r"\D", "", text)
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(map(int, reversed(digits))))
        return total % 10 == 0 and 13 <= len(digits) <= 19
    if kind == "iban":
        plain = text.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "ssn":
        a, g, s = text.split("-")
        return a not in ("000", "666") and a < "900" and g != "00" and s != "0000"
    if kind == "ipv4":
        return bool(ipaddress.IPv4Address(text))
    if kind == "date":
        return bool(date.fromisoformat(text))
    if kind == "secret":
        return bool(re.fullmatch(r"[0-9a-f]{32,128}|[0-9A-F]{32,128}", text))
    return True


def test_pii_values_keep_kind_shape_and_links():
    """Planted values of every kind: all are found and replaced by valid ones of the same shape; nothing else moves."""
    rng = np.random.default_rng(0)
    d = lambda n: "".join(map(str, rng.integers(10, size=n)))

    def iban():
        body = f"{'WEST' if rng.integers(2) else d(4)}{d(14)}"
        check = 98 - int("".join(str(int(c, 36)) for c in body + "GB00")) % 97
        return f"GB{check:02d}{body}"

    def card():
        body = "4" + d(14)
        return next(body + c for c in "0123456789" if _valid("card", body + c))

    makers = {
        "card": card,
        "iban": iban,
        "ssn": lambda: f"{rng.integers(1, 666):03d}-{rng.integers(1, 100):02d}-{rng.integers(1, 10000):04d}",
        "ipv4": lambda: ".".join(map(str, rng.integers(256, size=4))),
        "date": lambda: f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}",
        "secret": lambda: "a1" + "".join(rng.choice(list("0123456789abcdef"), 38)),
        "phone": lambda: f"+1 ({rng.integers(200, 999)}) {rng.integers(200, 999)}-{d(4)}",
        "email": lambda: f"{rng.choice(['Ann', 'bo', 'C.d'])}{d(3)}@Mail{rng.integers(9)}.example.org",
    }
    replace, seen = pii.Pseudonyms("key").replace, {}
    for _ in range(400):
        planted = [(k, makers[k]()) for k in rng.choice(list(makers), 4)]
        text = " | ".join(f"wörd{i} {v} then" for i, (_, v) in enumerate(planted))
        new, kinds = replace(text)
        assert kinds == [k for k, _ in planted]
        parts = re.fullmatch(" \\| ".join(f"wörd{i} (.*) then" for i in range(4)), new).groups()
        for (kind, old), made in zip(planted, parts, strict=True):
            shape = [re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d+" if kind == "ipv4" else r"\d", "9", v))) for v in (old, made)]
            assert _valid(kind, made) and made != old and shape[0] == shape[1] or kind == "secret" and _valid(kind, made)
            assert seen.setdefault((kind, old), made) == made
    assert len(set(seen.values())) == len(seen)
    none = "0" * 20 + " or 000-12-3456 or 666-12-3456 or 999.1.1.1 or 2021-02-30 or 4111111111111112"
    assert replace(none) == (none, [])


@pytest.mark.parametrize("unit", ["a", "1", "0123456789abcdef", "a@", "a.b", "Zz9+"])
def test_pii_long_runs_take_time_in_proportion(unit):
    import time

    replace = pii.Pseudonyms("key").replace
    start = time.perf_counter()
    replace(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - start < 10


def test_pii_key_and_columns(spark):
    df = spark.createDataFrame([(1, "call +1 (743) 555-3824", 9), (1, "call +1 (743) 555-3824", 9), (None, None, 9)], "doc_id long, text string, n_pii int")
    texts = [r.text for r in pii.pseudonymise(df).orderBy("doc_id").collect()]
    assert texts[0] is None and texts[1] == texts[2] != "call +1 (743) 555-3824"
    assert pii.pseudonymise(df).columns == ["doc_id", "text", "n_pii", "pii_kinds"]
    assert {r.text for r in pii.pseudonymise(df, key="other").collect()} != set(texts)
    spark.conf.set(pii.KEY_SETTING, "given")
    try:
        assert pii.key_of(spark) == "given"
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def _scanned_plainly(text):
    """Every template tried at every word, without the index."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    base = [(i, label) for i in range(len(words)) for phrase, label in license_scan.BASE_PHRASES if words[i : i + len(phrase.split())] == phrase.encode().split()]
    found = []
    for t in license_scan.TEMPLATES:
        wanted = [w.encode() for w in t.words]
        phrases = [[w.encode() for w in p] for p in t.phrases]
        for start in range(len(words)):
            here = words[start : start + len(wanted)]
            share = sum(a == b for a, b in zip(here, wanted, strict=False)) / len(wanted)
            if share >= 0.8 and all(any(here[i : i + len(p)] == p for i in range(len(here))) for p in phrases):
                found.append((t.label, start, share))
    starts = [i for i, _ in base]
    score = max([x for *_, x in found] + [0.5] * bool(base), default=0.0)
    labels = {label for _, label in base}
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {x for x, *_ in found})), score, sorted(found))


def test_license_against_brute_force(spark, empty):
    """Templates with words changed, cut, repeated and among other words, at and around the least share."""
    rng = np.random.default_rng(0)
    common = "the of license software to and or is under public permission version 2 0".split()
    rows = [(1, None), (1, None), (None, "Released under the MIT License."), (2, ""), (3, "mit license " * 4000), (4, "É mit-license, MIT  LICENSE apache license general public license")]
    for i in range(250):
        words = list(rng.choice(common, int(rng.integers(0, 30))))
        for t in rng.choice(len(license_scan.TEMPLATES), int(rng.integers(1, 3))):
            body = list(license_scan.TEMPLATES[t].words)
            for at in rng.choice(len(body), int(len(body) * rng.choice([0, 0.1, 0.2, 0.21, 0.3])), replace=False):
                body[at] = str(rng.choice(common))
            words += body[: int(len(body) * rng.choice([1, 1, 0.85, 0.7]))] + list(rng.choice(common, int(rng.integers(0, 9))))
        rows.append((i + 10, " ".join(w.upper() if rng.random() < 0.1 else str(w) for w in words)))
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, labels string, score double")
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, sorted((m.label, m.start, m.share) for m in r.matches)) for r in license_scan.scan(df).collect()]
    assert sorted(got, key=str) == sorted([(i, *_scanned_plainly(t)) for i, t in rows], key=str)
    assert sum(bool(g[-1]) for g in got) > 80
    assert license_scan.scan(empty).count() == 0


def _judged_plainly(text):
    """The line rules in plain Python: (kept, the text that is left)."""
    gap = " \t\n\x0b\x0c\r"

    def words(t):
        return [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]

    def fails(line):
        low, n, chars = line.strip(" ").lower(), len(words(line)), sum(c not in gap for c in line)
        share = lambda kind: sum(c in kind for c in line)
        no_end = n < 4 and not re.search("[.!?…:;。！？][\"'”’»)\\]]*[" + gap + "]*\n?$", line)
        bars = share("|»›·•")
        navigation = (bars >= 3 and bars * 5 > n) or re.search(quality_rules._NAVIGATION.replace("\\W", "[^A-Za-z0-9_]"), low)
        boilerplate = n <= 30 and re.search(quality_rules._BOILERPLATE, low)
        odd = (n > 4 and share("!?;:=/\\_~^+\"`@.,()[]{}#*$%&|<>-") * 4 > chars) or share("#*$%&|<>") * 10 > chars
        return chars > 0 and bool(no_end or navigation or boilerplate or odd)

    text = text or ""
    left = "\n".join(x for x in text.split("\n") if not fails(x))
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
    lost = sum(c not in gap for c in left) * 100 < sum(map(len, w)) * 60
    return not (len(w) < 50 or 2 * len(cover) > len(w) or lost), left


def test_rules_verdict_against_brute_force(spark):
    rng = np.random.default_rng(0)
    lines = ["Home", "Tous droits réservés.", "Alle Rechte vorbehalten - Impressum", "a | b | c | d", "Weiterlesen »", "Política de privacidad y uso de cookies.", "###$$$%%% x", "", "   ", "short line", "x; y; z: (a) [b] {c}!", "Zwei Wörter."]
    rows = []
    for i in range(200):
        prose = [" ".join(f"w{rng.integers(900)}" for _ in range(int(rng.integers(5, 25)))) + rng.choice([".", "", "!", ' »', "…"]) for _ in range(int(rng.integers(0, 9)))]
        rows.append((i, "\n".join(rng.permutation([*prose, *rng.choice(lines, int(rng.integers(0, 8)))]).tolist())))
    rows += [(500, None), (None, rows[3][1]), (501, "all rights reserved " * 5000), (502, "word. " * 30_000)]
    got = {r.doc_id: (r.kept, r.clean_text) for r in quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: _judged_plainly(t) for i, t in rows}
    assert 20 < sum(k for k, _ in got.values()) < 180


def test_classifier_solves_its_dual(monkeypatch):
    """At the solution of the descent the primal's gradient vanishes, as that of squared hinge loss must."""
    monkeypatch.setattr(quality_nb, "EPOCHS", 400)
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(60)]
    good = np.array([(r < 20).mean() + rng.normal(0, 0.2) > 0.5 for r in rows])
    ratio = quality_nb._ratios(rows, good)
    counts = np.ones((2, 1 << quality_nb.BITS))
    for r, g in zip(rows, good, strict=True):
        counts[int(g), r] += 1
    p = counts / counts.sum(1, keepdims=True)
    assert np.allclose(ratio, np.log(p[1] / p[0]))
    sign = np.where(good, 1.0, -1.0)
    weight, bias = quality_nb._descend(rows, sign, ratio)
    x = np.zeros((len(rows), len(ratio) + 1))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
        x[i, -1] = 1.0
    w = np.append(weight, bias)
    share = np.where(good, good.mean(), (~good).mean())
    cost = quality_nb.COST / (2 * share)  # of a row's squared loss
    slack = np.maximum(0, 1 - sign * (x @ w))
    gradient = w - 2 * ((cost * slack * sign) @ x)
    assert np.abs(gradient).max() < 1e-6 * max(1, np.abs(w).max()) and slack.max() > 0


def test_classifier_odd_rows(spark):
    """Null ids, repeated rows, a very long text and columns that clash with the result's."""
    text = "river stone walks evening paper. " * 3
    rows = [(None, text), (1, text), (1, text), (2, "BUY $$$ click " * 40_000), (3, None)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, score string, good string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (1, 1)], "doc_id long, quality int")
    found = quality_nb.score(docs, quality_nb.train(docs, labels))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == 5
    assert len({r.score for r in found.filter("doc_id = 1 or doc_id is null").collect()}) == 1


def _joins_sent(spark, run):
    """The plans with a broadcast join among those that *run* has executed."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = store.executionsList(int(before), int(store.executionsCount() - before))
    plans = [plans.apply(i).physicalPlanDescription() for i in range(plans.size())]
    assert any("Join" in p for p in plans)
    return [p for p in plans if "BroadcastHashJoin" in p]


def test_simhash_sends_no_table_to_the_driver(spark, docs):
    """Tables under the session's threshold grow with the input; several at once were too large for the driver."""
    assert not _joins_sent(spark, lambda: simhash.near_duplicates(docs).collect())


def test_near_copies_send_no_table_to_the_driver(spark, docs):
    assert not _joins_sent(spark, lambda: near_copies.near_copies(docs).collect())
    assert not _joins_sent(spark, lambda: near_copies.firsts(docs).collect())


def test_near_copies_of_a_loose_group(spark, monkeypatch):
    """Many texts around one, most pairs of them just above or below the similarity: few pairs are made, no link is lost."""
    rng, base, texts = np.random.default_rng(5), [f"w{i}" for i in range(150)], []
    for i in range(400):
        words = list(base)
        for at in rng.choice(150, rng.choice((2, 2, 3, 4)), replace=False):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, up, made = [set(near_copies.shingle_hashes(t).tolist()) for t in texts], list(range(400)), []

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in range(400):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    verified = near_copies._verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "_verified", counted)
    got = {r.doc_id: r.group_id for r in near_copies.near_copies(df).collect()}
    assert got == {i: root(i) for i in range(400)}
    assert len(set(got.values())) > 1 and sum(made) < 8 * len(texts)
