"""License scans: a generalised suffix automaton of license texts gives matching statistics, chained into template spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, ship

#: Fixed phrases of the contract, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Fixed texts: the operative paragraphs and notices of common public licenses.
TEMPLATES = {
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "cc0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "epl": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
}
#: Shortest match in words that is chained, widest gap in a chain, and what part of a template a chain must cover.
SEED, GAP, COVER = 5, 12, 0.5

_PLAIN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_PLAIN).split()


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers; each state knows where in which templates its strings end."""

    templates: list[str] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    go: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    @classmethod
    def of(cls, templates: dict[str, str], extra_words: list[bytes] = ()) -> Automaton:
        a = cls()
        for word in extra_words:
            a.vocabulary.setdefault(word, len(a.vocabulary) + 1)
        for k, (name, text) in enumerate(sorted(templates.items())):
            ids = [a.vocabulary.setdefault(w, len(a.vocabulary) + 1) for w in words_of(text.encode())]
            a.templates.append(name)
            a.sizes.append(len(ids))
            last = 0
            for i, c in enumerate(ids):
                last = a._extend(last, c)
                a.ends[last].append((k, i + 1))
        for s in sorted(range(1, len(a.link)), key=lambda s: -a.length[s]):  # ends of longer strings are ends of their suffixes
            a.ends[a.link[s]] += a.ends[s]
        a.ends[0] = []
        return a

    def _new(self, length: int, go: dict[int, int], link: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.go) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string and c, cut off from a state of longer strings if need be."""
        q = self.go[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.go[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.go[last]:
            return self._split(last, c)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.go[p]:
            self.go[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def matches(self, ids: list[int], least: int = SEED) -> Iterator[tuple[int, int, int]]:
        """(start, end, state) of the longest matches with the templates, where they cannot be extended to the right."""
        s = n = 0
        for i, c in enumerate(ids):
            if n >= least and c not in self.go[s]:
                yield i - n, i, s
            while s and c not in self.go[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.go[s]:
                s, n = self.go[s][c], n + 1
        if n >= least:
            yield len(ids) - n, len(ids), s


def chain(matches: list[tuple[int, int, list[tuple[int, int]]]], sizes: list[int], gap: int = GAP) -> dict[int, list[tuple[int, int, int]]]:
    """For each template: its chains (first word, end word, template words covered).

    Matches (start, end, ends in templates) come in order of their start; a chain takes the next
    match that goes on in text and template with at most ``gap`` words between.
    """
    all_: dict[int, list[list[int]]] = {}
    open_: dict[int, list[list[int]]] = {}  # without those that ended over ``gap`` words before: later matches start no earlier
    for start, end, ends in matches:
        for k, t_end in ends:
            n = end - start
            best = None
            open_[k] = [c for c in open_.get(k, ()) if start - c[1] <= gap]
            for c in open_[k]:  # [first, end, covered, template end]
                over = max(0, c[1] - start)
                if end > c[1] and -gap <= t_end - n + over - c[3] <= gap and t_end > c[3] and (best is None or c[2] > best[2]):
                    best = c
            if best is None:
                open_[k].append([start, end, n, t_end])
                all_.setdefault(k, []).append(open_[k][-1])
            else:
                best[2] += min(end - max(start, best[1]), t_end - best[3])
                best[1], best[3] = end, t_end
    return {k: [(a, b, min(n, sizes[k])) for a, b, n, _ in cs] for k, cs in all_.items()}


class Scanner:
    """What the executors hold: the automaton and the phrases as word numbers."""

    def __init__(self, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None):
        phrases = PHRASES if phrases is None else phrases
        words = [w.encode() for p in phrases for w in p.split()]
        self.automaton = Automaton.of(TEMPLATES if templates is None else templates, words)
        self.phrases = [([self.automaton.vocabulary[w.encode()] for w in p.split()], label) for p, label in phrases.items()]

    def scan(self, texts: list[bytes]) -> list[dict]:
        """For each whole text: words, phrase places and labels, license spans (label, first, end, coverage)."""
        a = self.automaton
        docs = [words_of(t) for t in texts]
        size = np.array([len(d) for d in docs], np.int64)
        start = np.concatenate([[0], np.cumsum(size + 1)])
        ids = np.zeros(start[-1] + 4, np.int64)  # a 0 after each text, and a few at the end
        get = a.vocabulary.get
        for s, d in zip(start[:-1], docs, strict=True):
            ids[s : s + len(d)] = [get(w, 0) for w in d]
        owner = lambda at: np.searchsorted(start, at, "right") - 1
        out = [{"n_words": int(n), "places": [], "base": set(), "spans": []} for n in size]
        for phrase, label in self.phrases:
            same = np.ones(len(ids) - 4, bool)
            for j, c in enumerate(phrase):
                same &= ids[j : j + len(same)] == c
            for at in np.flatnonzero(same):
                d = out[int(owner(at))]
                d["places"].append(int(at - start[int(owner(at))]))
                d["base"].add(label)
        # A match of SEED words lies in a run of as many words that occur in templates, so other words need no automaton.
        edge = np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]]))
        runs: dict[int, list[tuple[int, int]]] = {}
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for s, e in zip(first[last - first >= SEED], last[last - first >= SEED], strict=True):
            runs.setdefault(int(owner(s)), []).append((int(s), int(e)))
        for d, parts in runs.items():
            found = [(s - start[d] + x, s - start[d] + y, a.ends[state]) for s, e in parts for x, y, state in a.matches(ids[s:e].tolist())]
            for k, chains in chain([(int(x), int(y), z) for x, y, z in found], a.sizes).items():
                out[d]["spans"] += [(a.templates[k], x, y, n / a.sizes[k]) for x, y, n in chains]
        for d in runs:
            out[d]["spans"] = best_spans(out[d]["spans"])
        return out


#: Words of a bin in which kept spans are looked up.
_BIN = 256


def best_spans(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Without those of which another, that covers more of its own template, holds over half: templates share much of their texts.

    Whatever holds over half of a span holds its middle, so only spans that are kept there are compared.
    """
    kept: list[tuple[str, int, int, float]] = []
    at: dict[int, list[tuple[str, int, int, float]]] = {}
    for s in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[0])):
        if not any(2 * (min(s[2], k[2]) - max(s[1], k[1])) > s[2] - s[1] and k[3] > s[3] for k in at.get((s[1] + s[2]) // 2 // _BIN, ())):
            kept.append(s)
            for b in range(s[1] // _BIN, (s[2] - 1) // _BIN + 1):
                at.setdefault(b, []).append(s)
    return kept


def report(docs: DataFrame, scanner: Scanner | None = None, cover: float = COVER) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row of ``docs``.

    Score: the largest part of a template that one chain covers. A chain adds its label from
    ``cover`` on. A null text counts as empty; repeated rows are treated alike; other columns are
    ignored; an empty table gives no rows. Memory: one Arrow batch and the automaton.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    ship(docs.sparkSession)
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = shared.value.scan([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()])
            long = [[s for s in f["spans"] if s[3] >= cover] for f in found]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"),
                "n_words": pa.array([f["n_words"] for f in found], pa.int64()),
                "n_base": pa.array([len(f["places"]) for f in found], pa.int64()),
                "first_word": pa.array([min(f["places"], default=None) for f in found], pa.int64()),
                "last_word": pa.array([max(f["places"], default=None) for f in found], pa.int64()),
                "base_labels": pa.array([",".join(sorted(f["base"])) for f in found], pa.string()),
                "labels": pa.array([",".join(sorted(f["base"] | {s[0] for s in x})) for f, x in zip(found, long, strict=True)], pa.string()),
                "score": pa.array([max((s[3] for s in f["spans"]), default=0.0) for f in found], pa.float64()),
                "spans": pa.array([[dict(zip(("label", "start", "end", "coverage"), s, strict=True)) for s in sorted(x, key=lambda s: s[1:3])] for x in long], pa.list_(span)),
            })

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, coverage: double>>"
    )
