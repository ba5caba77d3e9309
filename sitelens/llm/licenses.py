"""License scans over a positional rare-token index.

The index holds short notices of well-known licences.  Per file, the scan takes the licence words that are
rarest in the corpus (highest inverse document frequency), looks up their places in the notices, and counts
how often the place in the file less the place in the notice is the same.  A notice whose rare words agree on
one offset, or on offsets close to each other, is compared word by word there, and counts only if its mandatory
phrases stand in the file.

Document frequencies come from all documents, for the words of the notices only, so the table of them is
bounded by the notices.  Documents are scanned twice and never shuffled.

Defined cases: a null or empty text has no words and no labels; repeated rows are reported once per row; ties
between offsets go to the smallest; a very long text is walked once a phrase and notice; other columns, whatever
their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, as_bytes

#: The phrases that label a file wherever their words stand consecutively.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label, mandatory phrases and notice, as the licences themselves word them.
NOTICES = [
    (
        "mit",
        ["permission is hereby granted free of charge"],
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "apache",
        ["apache license", "version 2 0"],
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ),
    ("apache", ["apache license", "version 2 0"], "Licensed under the Apache License, Version 2.0."),
    (
        "gpl",
        ["gnu general public license", "free software foundation"],
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "bsd",
        ["redistribution and use in source and binary forms"],
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer.",
    ),
    (
        "isc",
        ["permission to use copy modify and or distribute this software"],
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl",
        ["mozilla public license", "v 2 0"],
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at",
    ),
    (
        "cc-by",
        ["creative commons attribution"],
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
]
#: The rarest licence words of a file that are looked up, the share of them that must agree on an offset, and
#: the share of a notice's words that must stand in their places.
LOOKED_UP, AGREE, COVER = 12, 0.5, 0.7
#: Words may be inserted, such as a comment mark on each line: offsets within a BAND-th of a notice count together.
BAND = 6


class Index:
    """Postings word -> [(notice, place)], with the corpus's document frequencies."""

    def __init__(self, frequency: dict[bytes, int], n_docs: int):
        self.notices = [(label, [p.encode().split() for p in must], alnum_words(t.encode())) for label, must, t in NOTICES]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, _, words) in enumerate(self.notices):
            for i, w in enumerate(words):
                self.postings[w].append((k, i))
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for w in self.postings}
        self.phrases = [(f" {p} ".encode(), label) for p, label in PHRASES.items()]

    def base(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """The start of every place of a phrase, and the labels of the phrases that occur."""
        line = b" " + b" ".join(words) + b" "
        starts, labels = [], set()
        for phrase, label in self.phrases:
            at, before, n = line.find(phrase), 0, 0
            while at >= 0:
                n += line.count(b" ", before, at)  # words since the last place
                before = at
                starts.append(n)
                labels.add(label)
                at = line.find(phrase, at + 1)
        return starts, labels

    @staticmethod
    def _stands(places: list[int], low: int, high: int) -> bool:
        at = bisect_left(places, low)
        return at < len(places) and places[at] <= high

    def match(self, words: list[bytes]) -> dict[str, float]:
        """Label -> the share of its best notice's words that stand in their places."""
        here = set(words) & self.postings.keys()
        if not here:
            return {}
        rare = sorted(here, key=lambda w: (-self.idf[w], w))
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in here:
                places[w].append(i)
        found: dict[str, float] = {}
        line = b""
        for k, (label, must, notice) in enumerate(self.notices):
            own = [w for w in rare if any(n == k for n, _ in self.postings[w])][:LOOKED_UP]
            wanted = sorted(set(notice), key=lambda w: (-self.idf[w], w))[:LOOKED_UP]
            if len(own) < AGREE * len(wanted):
                continue
            votes: Counter[int] = Counter()
            for w in own:  # the places of a word intersect the notice's by their difference
                inside = [i for n, i in self.postings[w] if n == k]
                votes.update({p - i for p in places[w] for i in inside})
            line = line or b" " + b" ".join(words) + b" "
            if not all(b" " + b" ".join(m) + b" " in line for m in must):
                continue
            band = len(notice) // BAND
            offsets = sorted(votes)
            stop, held = 0, 0
            for at, offset in enumerate(offsets):  # votes of all offsets up to a band further on
                while stop < len(offsets) and offsets[stop] <= offset + band:
                    held += votes[offsets[stop]]
                    stop += 1
                if held >= AGREE * len(wanted):
                    same = sum(self._stands(places[w], offset + i, offset + i + band) for i, w in enumerate(notice) if w in places)
                    if same >= COVER * len(notice):
                        found[label] = max(found.get(label, 0.0), same / len(notice))
                held -= votes[offset]
        return found


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many of all documents each word of the notices occurs, and how many documents there are."""
    vocabulary = frozenset(w for _, _, t in NOTICES for w in alnum_words(t.encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                n += 1
                seen.update(vocabulary.intersection(alnum_words(text)))
        rows = [(None, n), *sorted(seen.items())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in rows], pa.binary()), pa.array([k for _, k in rows], pa.int64())], names=["word", "n"]
        )

    rows = docs.select(text_col).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by_word = {bytes(r.word) if r.word is not None else None: r.n for r in rows}
    return by_word, by_word.pop(None, 0)


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a file: id, n_words, n_base, first_word, last_word, base_labels, labels, score (0 to 1)."""
    index = docs.sparkSession.sparkContext.broadcast(Index(*frequencies(docs, text_col)))
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column("text")):
                words = alnum_words(text)
                starts, base = ix.base(words)
                found = ix.match(words)
                score = max([*found.values(), 0.5 if base else 0.0])
                rows.append(
                    (len(words), len(starts), min(starts, default=None), max(starts, default=None),
                     ",".join(sorted(base)), ",".join(sorted(base | found.keys())), score)
                )
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            added = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *added],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = out.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(
        run,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double",
    )
