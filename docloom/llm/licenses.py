"""Licence scans by a generalised suffix automaton.

Templates are the full texts in licence_texts/ (named by SPDX identifier), the usual notices, and short statements made by a rule
from the names of licences. Their words make one suffix automaton. A text is streamed through it: after
each word the automaton holds the longest suffix of the text read so far that occurs in a
template (the matching statistic). Where at least MIN_MATCH words match, the templates that share as many are found by suffix links, and the region is streamed through the
automaton of each alone, whose matches longer ones of others hide. They are chained while both texts move forward and gaps stay under MAX_GAP
words; a chain that covers MIN_COVER of its template is a span of that licence. Licences share wording: of spans that
overlap by half of the shorter one, that which covers most words of its template stays (of equals, the larger share). The base phrases
are templates of their own, found at every place where the automaton's match ends with one.

Defined cases: a null text is empty (no words, no labels, score 0); texts are scanned whole,
with memory for their matches only; repeated rows are scanned each; other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

from pyspark.sql import DataFrame

from docloom.llm.common import map_rows

MIN_MATCH = 5
MAX_GAP = 30
MIN_COVER = 0.6

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Names of licences by SPDX identifier.
NAMES = {
    "0bsd": ("Zero-Clause BSD License", "BSD Zero Clause License"), "agpl-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "GNU AGPL v3"),
    "apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License", "Apache License 2.0"), "artistic-1.0": ("Artistic License 1.0",), "artistic-2.0": ("Artistic License 2.0",),
    "bsd-2-clause": ("BSD 2-Clause License", "Simplified BSD License"), "bsd-3-clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"), "bsl-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "cc0-1.0": ("CC0 1.0", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"),
    "cc-by-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"), "cc-by-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution ShareAlike 3.0 Unported License"), "cc-by-sa-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution ShareAlike 4.0 International License"),
    "cc-by-nc-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution NonCommercial 4.0 International License"), "cc-by-nd-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution NoDerivatives 4.0 International License"),
    "cc-by-nc-sa-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution NonCommercial ShareAlike 4.0 International License"),
    "cc-by-nc-nd-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License"),
    "cddl-1.0": ("Common Development and Distribution License",), "epl-1.0": ("Eclipse Public License, Version 1.0", "Eclipse Public License v1.0"), "epl-2.0": ("Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"),
    "eupl-1.2": ("European Union Public Licence, version 1.2",), "gfdl-1.3": ("GNU Free Documentation License, Version 1.3",),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU General Public License v2", "GPLv2"), "gpl-3.0": ("GNU General Public License, version 3", "GNU General Public License v3", "GPLv3"),
    "isc": ("ISC License",), "lgpl-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"), "lgpl-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "LGPLv3"),
    "mit": ("MIT License", "Expat License"), "mpl-1.1": ("Mozilla Public License, Version 1.1",), "mpl-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    "ms-pl": ("Microsoft Public License",), "ncsa": ("University of Illinois NCSA Open Source License",), "odbl-1.0": ("Open Database License", "Open Data Commons Open Database License"), "ofl-1.1": ("SIL Open Font License, Version 1.1",),
    "psf-2.0": ("Python Software Foundation License",), "unlicense": ("Unlicense",), "upl-1.0": ("Universal Permissive License",), "wtfpl": ("WTFPL",), "zlib": ("zlib License",),
}
# How a statement names a licence.
STATEMENTS = ("Licensed under the {}", "Licensed under {}", "Released under the {}", "Distributed under the {}", "Distributed under the terms of the {}", "Available under the {}", "Published under the {}", "under the terms of the {}", "This work is licensed under the {}", "This work is licensed under a {}", "This project is licensed under the {}")
# Wording of common notices.
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details."
NOTICES = [
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("gpl-2.0", _GNU.format("program", ";", "General Public License", ";", "2")),
    ("gpl-3.0", _GNU.format("program", ":", "General Public License", ",", "3")),
    ("lgpl-2.1", _GNU.format("library", ";", "Lesser General Public License", ";", "2.1")),
    ("lgpl-3.0", _GNU.format("library", ":", "Lesser General Public License", ",", "3")),
    ("agpl-3.0", _GNU.format("program", ":", "Affero General Public License", ",", "3")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("gfdl-1.3", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
]


def templates() -> list[tuple[str, str]]:
    """(label, wording) of every template: full texts, notices, statements."""
    folder = resources.files("docloom.llm") / "licence_texts"
    full = [(f.name.removesuffix(".txt").lower(), f.read_text("utf-8")) for f in sorted(folder.iterdir(), key=lambda f: f.name)]
    return full + NOTICES + [(label, form.format(name)) for label, names in NAMES.items() for name in names for form in STATEMENTS if len(words_of(form.format(name))) >= MIN_MATCH]


_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORD).split() if text else []


class Automaton:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.labels = [label for label, _ in templates] + list(phrases.values())
        self.n_phrases = len(phrases)
        texts = [words_of(t) for t in [x for _, x in templates] + list(phrases)]
        self.lengths = [len(t) for t in texts]
        self.texts = [x for _, x in templates]
        self.singles: dict[int, Automaton] = {}
        self.above: dict[int, frozenset[int]] = {}
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for k, words in enumerate(texts):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, self.vocab.setdefault(w, len(self.vocab)), ends)
                ends[last].add((k, i + 1))
        first = len(templates)
        #: which phrases are suffixes of a state's strings; where in which template they end, for strings long enough to count
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.len]
        by_length = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        whole = {(k, n) for k, n in enumerate(self.lengths)}
        for v in reversed(by_length):
            # suffixes that are too short for a match need no places, but those of phrases
            link = self.link[v]
            ends[link] |= ends[v] if self.len[link] >= MIN_MATCH else {e for e in ends[v] if e[0] >= first}
        self.ends = [sorted(e for e in x if e[0] < first) if v else [] for v, x in enumerate(ends)]
        for v in by_length:
            own = [(k, n) for k, n in ends[v] & whole if k >= first and self.len[v] == n]
            self.phrases[v] = sorted(own) + self.phrases[self.link[v]]

    def _state(self, length: int, link: int, after: dict[int, int], ends: list) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(after)
        ends.append(set())
        return len(self.len) - 1

    def _extend(self, last: int, c: int, ends: list) -> int:
        def split(p: int, q: int) -> int:
            copy = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]), ends)
            self.link[q] = copy
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = copy
                p = self.link[p]
            return copy

        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else split(last, q)
        new, p = self._state(self.len[last] + 1, 0, {}, ends), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else split(p, q)
        return new

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Maximal matches (first word, end, state), and phrases found (first word, end, template)."""
        after, link, length_of, phrases = self.next, self.link, self.len, self.phrases
        matches, found = [], []
        state = length = 0
        at = -2
        known = self.vocab.get
        for i, t in [(i, t) for i, t in enumerate(map(known, words)) if t is not None]:
            if i != at + 1:
                if length > 1:
                    matches.append((at + 1 - length, at + 1, state))
                state = length = 0
            elif t not in after[state]:
                if length > 1:
                    matches.append((at + 1 - length, at + 1, state))
                while state and t not in after[state]:
                    state = link[state]
                    length = length_of[state]
            at = i
            state = after[state][t] if t in after[state] else 0
            length = length + 1 if state else 0
            for k, n in phrases[state]:
                if length >= n:
                    found.append((i + 1 - n, i + 1, k))
        if length > 1:
            matches.append((at + 1 - length, at + 1, state))
        return matches, found

    def sharing(self, words: list[bytes]) -> set[int]:
        """The templates that have MIN_MATCH following words of these."""
        out: set[int] = set()
        for _, state in self.steps(words):
            if state not in self.above:
                top = state
                while self.len[self.link[top]] >= MIN_MATCH:
                    top = self.link[top]
                self.above[state] = frozenset(k for k, _ in self.ends[top])
            out |= self.above[state]
        return out

    def steps(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(index, state) of each word at which MIN_MATCH words or more match."""
        state = length = 0
        for i, t in enumerate(map(self.vocab.get, words)):
            while state and t not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if t in self.next[state]:
                state, length = self.next[state][t], length + 1
                if length >= MIN_MATCH:
                    yield i, state

    def alone(self, k: int) -> Automaton:
        """The automaton of one template: what it matches isn't hidden by longer matches of others."""
        if k not in self.singles:
            self.singles[k] = Automaton([(self.labels[k], self.texts[k])], {})
        return self.singles[k]

    def spans(self, words: list[bytes], matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template covered) of chains over MIN_COVER."""
        regions: list[list[int]] = []
        for a, b, _ in matches:
            if b - a >= MIN_MATCH:
                if regions and a - regions[-1][1] <= MAX_GAP:
                    regions[-1][1] = b
                else:
                    regions.append([a, b])
        out = []
        for start, end in regions:
            region = words[start:end]
            for k in sorted(self.sharing(region)):
                one = self.alone(k)
                own = sorted((a, b, e - (b - a), e) for a, b, state in one.stream(region)[0] if b - a >= MIN_MATCH for _, e in one.ends[state])
                out += [(self.labels[k], start + a, start + b, min(1.0, n / self.lengths[k]), n) for a, b, n in chains(own, self.lengths[k]) if n >= MIN_COVER * self.lengths[k]]
        return [s[:4] for s in rivals(out)]


def chains(own: list[tuple[int, int, int, int]], length: int) -> list[tuple[int, int, int]]:
    """(first word, end, words covered) of the best chain that ends with each of the sorted matches (first word, end, its place and end in the template)."""
    best: list[tuple[int, int, int]] = []
    for j, (a, b, s, e) in enumerate(own):
        cover, start = e - s, a
        i = j - 1
        while i >= 0 and own[i][0] >= a - MAX_GAP - length:
            # overlaps count once
            if own[i][1] <= a + MIN_MATCH and a - own[i][1] <= MAX_GAP and own[i][3] <= e and own[i][2] < s and own[i][0] < a:
                add = best[i][2] + e - max(s, own[i][3])
                if add > cover:
                    cover, start = add, best[i][0]
            i -= 1
        best.append((start, b, cover))
    return best


def rivals(spans: list[tuple]) -> list[tuple]:
    """Spans without those that overlap one of more covered words (of as many: of a larger share) by half of the shorter; in text order."""
    kept: list[tuple] = []
    for s in sorted(spans, key=lambda s: (-s[4], -s[3], s[1], s[2], s[0])):
        if not any(2 * (min(s[2], t[2]) - max(s[1], t[1])) >= min(s[2] - s[1], t[2] - t[1]) for t in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[1:3] + s[:1])


_AUTOMATON: list[Automaton] = []


def _automaton() -> Automaton:
    if not _AUTOMATON:
        _AUTOMATON.append(Automaton(templates(), PHRASES))
    return _AUTOMATON[0]


def scan_text(text: str | None, automaton: Automaton | None = None) -> dict:
    automaton = automaton or _automaton()
    words = words_of(text)
    matches, found = automaton.stream(words)
    spans = automaton.spans(words, matches) if matches else []
    base = {automaton.labels[k] for _, _, k in found}
    starts = [a for a, _, _ in found]
    return {
        "n_words": len(words), "n_base": len(found), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s[0] for s in spans})),
        "score": max([s[3] for s in spans] + [1.0] * bool(found), default=0.0), "spans": [dict(zip(("label", "first_word", "end_word", "covered"), s)) for s in spans],
    }


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row; a narrow map."""

    def scan(cols, automaton):
        rows = [scan_text(t, automaton) for t in cols[1]]
        yield {id_col: cols[0]} | {k: [r[k] for r in rows] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), scan, f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, end_word: long, covered: double>>", _automaton)
