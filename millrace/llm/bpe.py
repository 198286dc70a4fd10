"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

Frequent words are compiled with their ids into a shared-suffix automaton whose
states count the words below each arc, so that a walk yields the word's number and
with it its ids.  The compiled file lies in the shared folder and workers memory-map it.
Texts are encoded by slabs: the distinct words of a slab walk the automaton together, byte
by byte; words that the lexicon lacks are merged exactly, lowest rank first, and a bounded
store keeps what was merged.  The lexicon only saves work: any word set gives the same ids.

Defined cases: a null text counts as the empty text (no ids); a special token's
literal string in a text is that special token, as the tokenizers library reads it;
one very long word is merged in n log n steps, and a very long text is a slab of its own;
repeated rows and null ids are encoded alike; words of one count go by byte order into the
lexicon; an empty table gives an empty result and an empty lexicon; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, staged, store_of, worker_state

#: Words compiled into the lexicon at most; the rest is merged when met.
LEXICON_WORDS = 50_000
#: Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 400_000
#: Characters of a slab of texts, about, whose distinct words are looked up together.
SLAB_CHARS = 2_000_000
#: Bytes of merged words that a worker keeps at most.
MERGED_BYTES = 48 << 20
#: Words of at most so many bytes are merged by plain scanning.
SHORT_WORD = 48

# White space of Unicode, and the two word patterns of the vocabularies.
SPACE = r"\t-\r \x85\xa0  -     　"
WORD_END_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
BYTE_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary file, with or without word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.end = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = {
            (self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)
        }
        letters = byte_letters()
        self.inner = [self.ids[x] for x in letters]
        self.last = [self.ids[x + self.end] for x in letters]
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.words: Callable[[str], list[str]] = regex.compile(WORD_END_PATTERN if self.end else BYTE_PATTERN).findall
        self.folds = bool(self.end)

    def parts(self, text: str) -> Iterator[tuple[int | None, str]]:
        """The text cut at special tokens: (their id, "") or (None, text between)."""
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                yield self.special[part], ""
            elif part:
                yield None, self.fold(part)

    def fold(self, text: str) -> str:
        if not self.folds:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter is lowered alone
        return text.lower()

    def merge(self, word: str) -> list[int]:
        """The ids of one word by exact merges: lowest rank first, then leftmost."""
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        n, pairs = len(ids), self.pairs
        if n <= SHORT_WORD:
            return self._merge_short(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = pairs[pair][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], k, p))
        return [i for i in ids if i >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same by scanning all pairs for each merge."""
        get, none = self.pairs.get, (1 << 62, 0)
        ranked = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranked and (best := min(ranked)) is not none:
            i = ranked.index(best)
            ids[i : i + 2] = [best[1]]
            del ranked[i]
            if i:
                ranked[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranked):
                ranked[i] = get((ids[i], ids[i + 1]), none)
        return ids


class Lexicon:
    """A compiled minimal acyclic transducer from words to ids, read in place.

    One block of unsigned 32-bit numbers: counts; per state the first arc and
    whether a word ends; per arc the byte, the target and how many words come
    before it; then the ids with one offset per word.
    """

    def __init__(self, numbers: Sequence[int]) -> None:
        states, arcs, words = numbers[0], numbers[1], numbers[2]
        cuts = [3]
        for size in (states + 1, states, arcs, arcs, arcs, words + 1):
            cuts.append(cuts[-1] + size)
        block = np.frombuffer(numbers, np.uint32)  # in place
        view = [block[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        first, self.final, label, self.target, self.skip, self.offset = view
        self.ids = block[cuts[-1] :]
        # arcs are sorted by state, and by byte within a state
        self.keys = np.repeat(np.arange(states, dtype=np.int64), np.diff(first.astype(np.int64))) << 8 | label

    @staticmethod
    def compile(entries: Iterable[tuple[bytes, Sequence[int]]]) -> array:
        """Build from words in byte order; equal suffix states are shared as words are added."""
        registry: dict[tuple, int] = {}
        kept: list[tuple[bool, tuple]] = []  # state: (word ends, ((byte, state), ...))
        below: list[int] = []
        path: list[list] = [[False, []]]  # open states along the last word: [word ends, arcs]
        last, offset, ids = b"", [0], array("I")

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                end, arcs = path.pop()
                key = (end, tuple(arcs))
                state = registry.get(key)
                if state is None:
                    state = registry[key] = len(kept)
                    kept.append(key)
                    below.append(end + sum(below[t] for _, t in arcs))
                path[-1][1].append((last[len(path) - 1], state))

        for word, out in entries:
            common = len(os.path.commonprefix([word, last]))
            close(common)
            path.extend([False, []] for _ in word[common:])
            path[-1][0] = True
            last = word
            ids.extend(out)
            offset.append(len(ids))
        close(0)
        kept.append((path[0][0], tuple(path[0][1])))  # the start state is the last one
        first, label, target, skip = [0], [], [], []
        for end, arcs in kept:
            before = int(end)
            for byte, state in arcs:
                label.append(byte)
                target.append(state)
                skip.append(before)
                before += below[state]
            first.append(len(label))
        head = [len(kept), len(label), len(offset) - 1]
        return array("I", [*head, *first, *(int(e) for e, _ in kept), *label, *target, *skip, *offset]) + ids

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)).cast("I"))

    def find(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian 32-bit numbers, or None."""
        return self.find_all([word])[0]

    def find_all(self, words: Sequence[bytes]) -> list[bytes | None]:
        """The same for many words, which walk the automaton together: the n-th bytes of all in one step."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        raw = np.frombuffer(b"".join(words), np.uint8)
        left = np.cumsum(np.bincount(sizes, minlength=1)[::-1])[::-1]  # words of so many bytes or more
        state = np.full(len(words), len(self.final) - 1, np.int64)
        number, alive = np.zeros(len(words), np.int64), np.ones(len(words), bool)
        for step in range(len(left) - 1):
            rows = np.flatnonzero(alive[: left[step + 1]])
            if not len(rows):
                break
            key = state[rows] << 8 | raw[starts[rows] + step]
            arc = np.searchsorted(self.keys, key)
            arc[arc == len(self.keys)] = 0
            hit = self.keys[arc] == key if len(self.keys) else np.zeros(len(rows), bool)
            alive[rows[~hit]] = False
            rows, arc = rows[hit], arc[hit]
            number[rows] += self.skip[arc]
            state[rows] = self.target[arc]
        alive &= self.final[state] == 1
        out: list[bytes | None] = [None] * len(words)
        for i, n in zip(order[alive].tolist(), number[alive].tolist(), strict=True):
            out[i] = self.ids[self.offset[n] : self.offset[n + 1]].tobytes()
        return out


class _Merged(dict):
    """Ids of words that were merged; emptied when it holds ``MERGED_BYTES``."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.held = vocabulary, 0

    def __missing__(self, word: str) -> bytes:
        found = array("I", self.vocabulary.merge(word)).tobytes()
        self.held += 200 + len(word) + len(found)
        if self.held > MERGED_BYTES:
            self.clear()
            self.held = 0
        self[word] = found
        return found


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None) -> None:
        self.vocabulary, self.lexicon, self.merged = vocabulary, lexicon, _Merged(vocabulary)
        self.names = [vocabulary.tokens.get(i, "") for i in range(max(vocabulary.tokens) + 1)]

    def _looked_up(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words: the lexicon's, else merged ones."""
        some = list(words)
        found = self.lexicon.find_all([w.encode("utf-8", "surrogatepass") for w in some]) if self.lexicon and some else [None] * len(some)
        return {w: self.merged[w] if ids is None else ids for w, ids in zip(some, found, strict=True)}

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        split = [[(special, self.vocabulary.words(part)) for special, part in self.vocabulary.parts(t)] for t in texts]
        known = self._looked_up(set().union(*(words for parts in split for _, words in parts)))
        get = known.__getitem__
        return [b"".join(b"".join(map(get, words)) if special is None else special.to_bytes(4, "little") for special, words in parts) for parts in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def slabs(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text in turn, by slabs of about ``SLAB_CHARS`` characters."""
        slab, held = [], 0
        for text in texts:
            slab.append(text)
            held += len(text)
            if held >= SLAB_CHARS:
                yield from self.encode_all(slab)
                slab, held = [], 0
        yield from self.encode_all(slab)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by blanks: what a vocabulary without a decoder gives."""
        return " ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


def word_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; each task adds up what it has read before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = Vocabulary(path), Counter()

        def flush() -> pa.RecordBatch:
            words, n = list(seen.keys()), list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                for special, part in vocabulary.parts(text.as_py() or ""):
                    if special is None:
                        seen.update(vocabulary.words(part))
            if len(seen) > COUNTED_WORDS:
                yield flush()
        yield flush()

    return docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the ``words`` most frequent words of all texts; returns the shared file's path."""
    # written first: the driver would otherwise merge a list of this length from every partition
    top = word_counts(docs, path, text_col).orderBy(F.desc("n"), "word").limit(words).select("word")
    top = staged(top, "lexicon-words").collect()
    vocabulary = Vocabulary(path)
    entries = sorted((r.word.encode("utf-8"), r.word) for r in top)
    compiled = Lexicon.compile((raw, vocabulary.merge(word)) for raw, word in entries)
    path = shared_path(docs.sparkSession, "lexicon")
    store, folder = store_of(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/words.bin", compression=None) as f:
        f.write(compiled.tobytes())
    return f"{path}/words.bin"


def open_lexicon(path: str) -> Lexicon:
    """The lexicon of a shared file, memory-mapped; of a store without local paths it is fetched once for a worker."""
    store, name = store_of(path)
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        return Lexicon.open(name)
    with tempfile.NamedTemporaryFile(suffix=".bin") as f, store.open_input_stream(name, compression=None) as source:
        f.write(source.read())
        f.flush()
        return Lexicon.open(f.name)  # the mapping outlives the name


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """Encode every whole text and decode it again.

    Columns: the id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with
    ``with_text``, ``ids`` (array of int) and ``decoded``.
    """
    name = compile_lexicon(docs, path, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_text else ""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state()
        if (path, name) not in state:
            state[path, name] = Encoder(Vocabulary(path), open_lexicon(name))
        encoder = state[path, name]
        for batch in batches:
            counts, of_ids, of_text, all_ids, all_text = [], [], [], [], []
            for ids in encoder.slabs(text.as_py() or "" for text in batch.column("_text")):
                decoded = encoder.decode(ids)
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if with_text:
                    all_ids.append(memoryview(ids).cast("i").tolist())
                    all_text.append(decoded)
            columns = [batch.column("_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)]
            names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(encode, schema).withColumnRenamed("_id", id_col)
