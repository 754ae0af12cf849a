"""License scans: a generalised suffix automaton of licence templates, streamed over by each text.

Texts are words (ASCII letters and digits and all characters beyond ASCII, A-Z lower-cased). Runs of words that any
template knows are fed to the automaton, which gives, at each word, the longest match that ends there (matching
statistics); its suffix links give the other templates' shorter ones. Matches of MIN_MATCH words or more that cannot be
extended in their template are chained, per template, in the order of both the text and the template and over gaps of at
most MAX_GAP words; a chain that covers a COVERED share of a template, and lies in no better chain of another,
gives its label and a span. Base labels come from places where one of four phrases stands. The automaton's size is that
of the templates, a constant, and texts are read whole, in bounded pieces.

Null and empty texts have no words and no labels, score 0 and null places. Repeated rows give equal rows; empty tables an
empty result; further columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import ALNUM, hash_words, row_groups, table, text_bytes, word_hashes

MIN_MATCH, MAX_GAP, COVERED = 4, 64, 0.6
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
PHRASE_SCORE = 0.5

TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache", "licensed under the apache license version 2 0"),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed "
        "to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any "
        "kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version this program is "
        "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability "
        "or fitness for a particular purpose see the gnu general public license for more details",
    ),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
        "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
        "to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    ("mit", "released under the mit license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
        "file you can obtain one at http mozilla org mpl 2 0",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced"),
)


class Automaton:
    """Generalised suffix automaton of token sequences; ends[state] lists the (sequence, end) of a state's strings."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        marks: list[list[tuple[int, int]]] = [[]]
        for s, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token, marks)
                marks[last].append((s, i + 1))
        order = sorted(range(len(self.link)), key=lambda v: -self.length[v])
        ends = [set(m) for m in marks]
        for v in order:
            if self.link[v] > 0:
                ends[self.link[v]] |= ends[v]
        self.ends = [sorted(e) for e in ends]

    def _state(self, length: int, marks: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        marks.append([])
        return len(self.link) - 1

    def _split(self, p: int, token: int, q: int, marks: list) -> int:
        clone = self._state(self.length[p] + 1, marks)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int, marks: list) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q, marks)
        new = self._state(self.length[last] + 1, marks)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q, marks)
        return new

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest match that ends at each token."""
        v, n = 0, 0
        for token in tokens:
            while v and token not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if token in self.next[v]:
                v, n = self.next[v][token], n + 1
            else:
                v, n = 0, 0
            yield n, v


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.labels = [name for name, _ in templates]
        texts = [t.split() for _, t in templates]
        vocabulary = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.sizes = [len(t) for t in texts]
        self.sequences = [[number[w] for w in t] for t in texts]
        self.automaton = Automaton(self.sequences)
        h = hash_words(vocabulary, ALNUM)
        order = np.argsort(h)
        self.known, self.number = h[order], order
        self.phrases = [(hash_words(p.split(), ALNUM), label) for p, label in PHRASES.items()]

    def base(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all phrases, and the number of the phrase of each."""
        starts, which = [], []
        for k, (p, _) in enumerate(self.phrases):
            at = np.flatnonzero(h[: len(h) - len(p) + 1] == p[0]) if len(h) >= len(p) else np.zeros(0, np.int64)
            for j in range(1, len(p)):
                at = at[h[at + j] == p[j]]
            at = at[row[at] == row[at + len(p) - 1]]
            starts.append(at)
            which.append(np.full(len(at), k))
        return np.concatenate(starts), np.concatenate(which)

    def runs(self, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(first word, numbers) of runs of MIN_MATCH known words or more."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        ok = self.known[at] == h
        new = np.ones(len(h), bool)
        new[1:] = (ok[1:] != ok[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        lens = np.diff(np.append(first, len(h)))
        for f in np.flatnonzero(ok[first] & (lens >= MIN_MATCH)):
            yield int(first[f]), self.number[at[first[f] : first[f] + lens[f]]].tolist()

    def matches(self, first: int, tokens: list[int]) -> Iterator[tuple[int, int, int, int]]:
        """(template, start in it, start in the text, length) of matches that cannot be extended in their own template."""
        found = list(self.automaton.statistics(tokens))
        for i, (n, v) in enumerate(found):
            after = tokens[i + 1] if i + 1 < len(tokens) else None
            longer: set[tuple[int, int]] = set()
            while n >= MIN_MATCH:  # along the suffix links are the places where only a part of the match ends
                for template, end in self.automaton.ends[v]:
                    if (template, end) not in longer:
                        longer.add((template, end))
                        if after is None or end == self.sizes[template] or self.sequences[template][end] != after:
                            yield template, end - n, first + i + 1 - n, n
                v = self.automaton.link[v]
                n = self.automaton.length[v]

    def spans(self, matched: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, start, end, covered share) of the best chain that ends at each match, those above COVERED only.

        A chain inside one of more words of another template, or of a larger share of it, is that template's text, not one of its own.
        """
        out = []
        by: dict[int, list[tuple[int, int, int]]] = {}
        for template, t, d, n in matched:
            by.setdefault(template, []).append((d, t, n))
        for template, own in by.items():
            own.sort()
            best: list[tuple[int, int]] = []  # words covered, first word
            low = 0
            for i, (d, t, n) in enumerate(own):
                while own[low][0] + self.sizes[template] + MAX_GAP < d:
                    low += 1
                got, start = n, d
                for j in range(i - 1, low - 1, -1):
                    e, u, m = own[j]
                    if u + m <= t and e + m <= d <= e + m + MAX_GAP and best[j][0] + n > got:
                        got, start = best[j][0] + n, best[j][1]
                best.append((got, start))
                share = got / self.sizes[template]
                if share >= COVERED:
                    out.append((template, start, d + n, min(1.0, share), got))
        kept = [c for c in out if not any(e[1] <= c[1] and c[2] <= e[2] and (e[4], e[3]) > (c[4], c[3]) and e[0] != c[0] for e in out)]
        return [c[:4] for c in kept]


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner: Scanner = shared.value
        names = [label for _, label in scanner.phrases]
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for i, j in row_groups(offs):
                h, _, _, woff = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ALNUM)
                row = np.repeat(np.arange(j - i), np.diff(woff))
                at, which = scanner.base(h, row)
                own = row[at]
                place = at - woff[own]
                n_base = np.bincount(own, minlength=j - i)
                low, high = np.full(j - i, np.iinfo(np.int64).max), np.full(j - i, -1)
                np.minimum.at(low, own, place)
                np.maximum.at(high, own, place)
                base: list[set[str]] = [set() for _ in range(j - i)]
                for r, k in zip(own.tolist(), which.tolist(), strict=True):
                    base[r].add(names[k])
                matched: dict[int, list] = {}
                for first, tokens in scanner.runs(h, row):
                    matched.setdefault(int(row[first]), []).extend(scanner.matches(first, tokens))
                labels, score, spans = [set(b) for b in base], np.where(n_base > 0, PHRASE_SCORE, 0.0), [""] * (j - i)
                for r, found in matched.items():
                    chains = scanner.spans(found)
                    widest: dict[int, tuple] = {}
                    for c in chains:
                        if c[0] not in widest or c[3] > widest[c[0]][3]:
                            widest[c[0]] = c
                    for template, start, end, share in widest.values():
                        labels[r].add(scanner.labels[template])
                        score[r] = max(score[r], share)
                    spans[r] = ",".join(f"{scanner.labels[t]}:{s - woff[r]}:{e - woff[r]}" for t, s, e, _ in sorted(widest.values(), key=lambda c: (c[1], c[0])))
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(np.diff(woff)),
                        pa.array(n_base.astype(np.int64)),
                        pa.array(low, pa.int64(), mask=none),
                        pa.array(high, pa.int64(), mask=none),
                        pa.array([",".join(sorted(b)) for b in base]),
                        pa.array([",".join(sorted(x)) for x in labels]),
                        pa.array(score),
                        pa.array(spans, pa.string()),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return scan


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Labels, score and spans (label:first word:end word) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(shared), schema)


def op5_license_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op5_license_sam": op5_license_sam}
ORACLES: dict[str, str] = {}
