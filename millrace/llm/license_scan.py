"""Licence scan with a positional rare-token index.

Templates are word lists.  Document frequencies of the template words are counted
over all documents (their number is that of the template words) and give each word its
inverse document frequency.  Every template is indexed by its rarest words with their
positions: one and ``VOTES`` more than the words that a copy may have changed, so that
each place with enough words in place meets at least ``VOTES`` postings.  A file is looked
up by the indexed words that it has, highest inverse document frequency first; each hit
votes for the relative position at which a template would start, votes are intersected,
and an aligned template counts when enough of its words stand in place and all its key
phrases do.

Words are runs of ASCII letters and digits and of non-ASCII bytes, A-Z lower-cased.
Defined cases: a null text has no words, no places and score 0; overlapping and
repeated places all count; a template cut off by the end of the text counts with the
words that are there; ties in rarity go to the earlier position; very long texts are
scanned whole; repeated rows and null ids are scanned alike; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Postings that must agree on a place before it is verified, where a template has so many.
VOTES = 2
#: Share of a template's words that must stand in place.
MIN_SHARE = 0.8


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]  # each must stand in place within the template


def template(label: str, text: str, *phrases: str) -> Template:
    return Template(label, tuple(text.split()), tuple(tuple(p.split()) for p in phrases))


# Base phrases with their labels.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Bodies and notices of public licences, as words, with phrases that must
# stand in them.
TEMPLATES = (
    template("mit", "released under the mit license", "mit license"),
    template("mit", "licensed under the mit license", "mit license"),
    template(
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions""",
        "hereby granted free of charge",
    ),
    template(
        "mit",
        """the above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the software""",
        "permission notice shall be included",
    ),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    template(
        "apache-2.0",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
        license you may obtain a copy of the license at http www apache org licenses license 2 0""",
        "apache license version 2 0",
    ),
    template(
        "apache-2.0",
        """unless required by applicable law or agreed to in writing software distributed under the license is distributed on
        an as is basis without warranties or conditions of any kind either express or implied see the license for the
        specific language governing permissions and limitations under the license""",
        "without warranties or conditions of any kind",
    ),
    template("gpl", "licensed under the gnu general public license", "general public license"),
    template("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    template(
        "gpl-3.0",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version 3 of the license or at your option any later
        version""",
        "gnu general public license",
        "version 3",
    ),
    template(
        "gpl-2.0",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version 2 of the license or at your option any later
        version""",
        "gnu general public license",
        "version 2",
    ),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template("agpl", "gnu affero general public license", "affero general public license"),
    template(
        "agpl",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general
        public license as published by the free software foundation either version 3 of the license or at your option any
        later version""",
        "gnu affero general public license",
    ),
    template("bsd", "licensed under the bsd license", "bsd license"),
    template(
        "bsd",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met""",
        "source and binary forms",
    ),
    template(
        "bsd-3-clause",
        """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission""",
        "endorse or promote products",
    ),
    template(
        "mpl-2.0",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at""",
        "mozilla public license",
    ),
    template(
        "isc",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
        "with or without fee",
    ),
    template(
        "zlib",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable
        for any damages arising from the use of this software permission is granted to anyone to use this software for any
        purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions""",
        "redistribute it freely",
    ),
    template(
        "unlicense",
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
        compile sell or distribute this software either in source code form or as a compiled binary for any purpose
        commercial or non commercial and by any means""",
        "unencumbered software",
    ),
    template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    template("cc-by", "creative commons attribution 4 0 international license", "attribution 4 0 international"),
    template("cc0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
)

# Every byte as a word byte (A-Z lower-cased) or as a blank.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def document_frequencies(docs: DataFrame, text_col: str, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """In how many texts each wanted word occurs, over all rows; one row per word reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(wanted.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
        )

    rows = docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.collect()}


class Index:
    """Postings of each template's rarest words: word -> (template number, position)."""

    def __init__(self, templates: Sequence[Template], frequency: dict[bytes, int]) -> None:
        self.labels = [t.label for t in templates]
        self.words = [tuple(w.encode() for w in t.words) for t in templates]
        self.phrases = [[tuple(w.encode() for w in p) for p in t.phrases] for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.votes = []
        for number, words in enumerate(self.words):
            may_miss = len(words) - math.ceil(MIN_SHARE * len(words))
            rarest = sorted(range(len(words)), key=lambda i: (frequency.get(words[i], 0), i))[: may_miss + VOTES]
            for position in rarest:
                self.postings[words[position]].append((number, position))
            # in a copy with enough words in place so many of the looked-up ones are
            self.votes.append(len(rarest) - may_miss)
        #: Indexed words, highest inverse document frequency first.
        self.rank = {w: i for i, w in enumerate(sorted(self.postings, key=lambda w: (frequency.get(w, 0), w)))}

    def scan(self, words: list[bytes], where: dict[bytes, list[int]]) -> list[tuple[int, int, float]]:
        """(template number, start, share of words in place) of every verified template."""
        votes: Counter = Counter()
        for word in sorted(self.rank.keys() & where.keys(), key=self.rank.__getitem__):
            for number, position in self.postings[word]:
                votes.update((number, at - position) for at in where[word] if at >= position)
        return [(n, start, share) for (n, start), count in votes.items() if count >= self.votes[n] and (share := self.verify(n, words, start))]

    def verify(self, number: int, words: list[bytes], start: int) -> float:
        """The share of a template's words that stand in place from *start* on, 0 if it does not count there."""
        wanted = self.words[number]
        here = words[start : start + len(wanted)]
        share = sum(a == b for a, b in zip(here, wanted, strict=False)) / len(wanted)
        return share if share >= MIN_SHARE and all(_stands(here, p) for p in self.phrases[number]) else 0.0


def _stands(words: Sequence[bytes], phrase: tuple[bytes, ...]) -> bool:
    n = len(phrase)
    return any(tuple(words[i : i + n]) == phrase for i in range(len(words) - n + 1))


def _base_places(words: list[bytes], where: dict[bytes, list[int]]) -> dict[str, list[int]]:
    """Starts of the base phrases by label, from where their first words stand."""
    places = {}
    for phrase, label in BASE_PHRASES:
        parts = [w.encode() for w in phrase.split()]
        starts = [i for i in where.get(parts[0], ()) if words[i : i + len(parts)] == parts]
        if starts:
            places[label] = starts
    return places


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES
) -> DataFrame:
    """Licence labels per row; ``matches`` lists the verified templates with their word position."""
    vocabulary = frozenset(w.encode() for t in templates for w in t.words)
    index = Index(templates, document_frequencies(docs, text_col, vocabulary))
    looked_up = frozenset(index.postings) | {p.split()[0].encode() for p, _ in BASE_PHRASES}
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, matches array<struct<label:string,start:bigint,share:double>>"
    )
    match_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match_type]
        for batch in batches:
            rows = []
            for text in batch.column("_text"):
                words = words_of(text.as_py())
                where: dict[bytes, list[int]] = {}
                if not looked_up.isdisjoint(words):
                    for i, w in enumerate(words):
                        if w in looked_up:
                            where.setdefault(w, []).append(i)
                base = _base_places(words, where) if where else {}
                found = sorted(index.scan(words, where), key=lambda f: (f[1], f[0])) if where else []
                starts = [i for s in base.values() for i in s]
                labels = {index.labels[n] for n, _, _ in found} | base.keys()
                score = max([share for _, _, share in found] + [0.5] * bool(base), default=0.0)
                rows.append(
                    (
                        len(words),
                        len(starts),
                        min(starts, default=None),
                        max(starts, default=None),
                        ",".join(sorted(base)),
                        ",".join(sorted(labels)),
                        score,
                        [{"label": index.labels[n], "start": s, "share": x} for n, s, x in found],
                    )
                )
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *arrays], ["_id", *names])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
