"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every template's words. A text streams through it: at each word it knows the longest run of words
that ends there and stands in some template (the matching statistics). Runs that can't be lengthened, of ``SHORTEST``
words at least, are chained in the order of text and template; a chain is a span, and its worth the share of the template
that it covers. Where a run stands several times in a template, the place next after the chain's end counts. A label that names a version is given only where the span holds the version's words. Phrases are marked on the automaton's states, and so are found wherever they end.

Cases: a null or empty text has no words, no labels and score 0; texts of any length stream through whole; repeated rows
are scanned each for itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .pieces import text_groups
from .work import columns

SHORTEST, GAP, ENOUGH = 3, 40, 0.75
#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: The words of public licence notices.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "apache-1.1": ["Licensed under the Apache License, Version 1.1"],
    "mit": [
        "Licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "mpl-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1"],
}
#: Words of which a span must hold one run whole before it gives a label that names a version.
VERSIONS = {"apache-2.0": ["Version 2.0", "LICENSE-2.0"], "gpl-3.0": ["version 3"], "gpl-2.0": ["version 2"], "apache-1.1": ["Version 1.1"], "mpl-1.1": ["Version 1.1"], "mpl-2.0": ["v. 2.0", "version 2.0", "MPL/2.0"]}
for _kind, _long in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _version, _scope in {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}.items():
        _name = f"cc-{_kind.lower()}-{_version}"
        TEMPLATES[_name] = [f"Licensed under CC {_kind} {_version}", f"This work is licensed under a Creative Commons {_long} {_version} {_scope} License"]
        VERSIONS[_name] = [f"{_kind} {_version}", f"{_long} {_version}"]
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and everything beyond ASCII, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


_RUNS = {name: [b" %b " % b" ".join(words_of(run)) for run in runs] for name, runs in VERSIONS.items()}


def tells_version(name: str, words: list[bytes]) -> bool:
    """Whether a span's words hold what its label says of the version; labels without a version need nothing."""
    if name not in _RUNS:
        return True
    text = b" %b " % b" ".join(words)
    return any(run in text for run in _RUNS[name])


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the root."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[dict[int, list[int]]] = [{}]  # of a state: the places where its strings end, by template, in order
        self.names: list[str] = []
        self.sizes: list[int] = []
        for name, texts in templates.items():
            for text in texts:
                words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
                self._add(words, len(self.names))
                self.names.append(name)
                self.sizes.append(len(words))
        spelled = {p: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(p)] for p in phrases}
        for words in spelled.values():
            self._add(words, None)
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:
            for t, places in self.places[s].items():
                places[:] = sorted(set(places))
                self.places[self.link[s]].setdefault(t, []).extend(places)
        own: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for phrase, words in spelled.items():
            s = 0
            for w in words:
                s = self.next[s][w]
            own[s].append((len(words), phrases[phrase]))
        self.ends: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for s in reversed(order):  # ancestors first
            self.ends[s] = own[s] + self.ends[self.link[s]]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.places.append({})
        return len(self.next) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        c = self._state(self.length[p] + 1)
        self.next[c], self.link[c], self.link[q] = dict(self.next[q]), self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w], p = c, self.link[p]
        return c

    def _add(self, words: list[int], template: int | None) -> None:
        last = 0
        for end, w in enumerate(words):
            q = self.next[last].get(w)
            if q is not None:  # another sequence has it
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
            else:
                s, p = self._state(self.length[last] + 1), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w], p = s, self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[s] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
                last = s
            if template is not None:
                self.places[last].setdefault(template, []).append(end)

    def statistics(self, words: list[bytes]):
        """The runs that can't be lengthened, (first word, length, state), and the phrases' places (first word, label)."""
        runs: list[tuple[int, int, int]] = []
        found: list[tuple[int, str]] = []
        following, link, length, ends = self.next, self.link, self.length, self.ends
        s = n = 0
        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                if n >= SHORTEST:
                    runs.append((i - n, n, s))
                s = n = 0
                continue
            if w not in following[s]:
                if n >= SHORTEST:
                    runs.append((i - n, n, s))
                while s and w not in following[s]:
                    s = link[s]
                n = length[s]
                if w not in following[s]:
                    continue
            s = following[s][w]
            n += 1
            if ends[s]:
                found += [(i + 1 - k, label) for k, label in ends[s] if k <= n]
        if n >= SHORTEST:
            runs.append((len(words) - n, n, s))
        return runs, found


def chains(automaton: Automaton, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
    """Spans (label, first word, end word, covered share of the template), by chaining runs in both orders."""
    open_: dict[int, list[int]] = {}  # of a template: first word, end word, end in the template, words covered
    out: list[tuple[str, int, int, float]] = []

    def close(t: int) -> None:
        first, end, _, covered = open_.pop(t)
        out.append((automaton.names[t], first, end, min(1.0, covered / automaton.sizes[t])))

    for first, n, state in runs:
        for t, places in automaton.places[state].items():
            if t in open_:
                chain = open_[t]
                # of all places, the first that leads on from the chain's end in the template
                at = bisect_left(places, chain[2])
                if first - chain[1] <= GAP and at < len(places):
                    place = places[at]
                    open_[t] = [chain[0], max(chain[1], first + n), place + 1, chain[3] + min(n, place + 1 - chain[2])]
                    continue
                close(t)
            open_[t] = [first, first + n, places[0] + 1, n]
    for t in list(open_):
        close(t)
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: bigint, end_word: bigint, covered: double>>"


def scan_text(automaton: Automaton, text: str | None) -> tuple:
    words = words_of(text)
    runs, found = automaton.statistics(words)
    spans = [x for x in chains(automaton, runs) if x[3] >= ENOUGH and tells_version(x[0], words[x[1] : x[2]])] if runs else []
    starts = [s for s, _ in found]
    base = {label for _, label in found}
    labels = ",".join(sorted(base | {x[0] for x in spans}))
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), labels, max((x[3] for x in spans), default=0.0), spans


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Counts, labels and spans of every document; no shuffle, the automaton travels with the task."""
    automaton = Automaton(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.float64())]))
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]

    def run(batches):
        for ids, texts in text_groups(batches):
            rows = [scan_text(automaton, t) for t in texts]
            if rows:
                found = list(zip(*rows, strict=True))
                found[-1] = tuple([dict(zip(("label", "first_word", "end_word", "covered"), x, strict=True)) for x in spans] for spans in found[-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, t) for c, t in zip(found, types[1:], strict=True)]], names=names)

    return columns(docs, "doc_id", "text").mapInArrow(run, RESULT)


def op3_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
