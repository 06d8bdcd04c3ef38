"""Licence scans with a suffix automaton of licence texts.

All templates go into one generalised suffix automaton over word numbers. A text's words are streamed through it; at each word
the automaton holds the longest stretch ending there that occurs in any template (matching statistics). Where that stretch
cannot grow it is a maximal match; long ones are chained template by template, in order in the text and in the template, to
spans, and a span that covers enough of its template reports the template's label. Short templates (phrases) have to be there
whole. Only stretches whose neighbouring words are neighbours in some template are streamed: others match no two words.

Defined results: a null or empty text has no words and no match; texts are taken whole and streamed, which needs memory for
one text's words; repeated rows each get their row; of chains with equal cover the one that begins first counts; an empty table
gives no rows. ``find`` returns the columns asked for, which must not be named like its results; others may have any name.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_pass, schema_with, slices, utf8

#: Phrases (label, words) whose places are counted as they stand. Fixed values.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Licence texts (label, text), openings and notices that are published for copying. Fixed values.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
    whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
    notice shall be included in all copies or substantial portions of the Software."""),
    ("mit", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
    THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
    COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
    ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
    under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
    See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
    License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
    and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
    and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at"""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
    publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
    commercial or non-commercial, and by any means."""),
    ("cc", "This work is licensed under a Creative Commons Attribution International License"),
    ("cc", "licensed under CC BY 4.0"),
    ("cc", "licensed under CC BY-SA 4.0"),
    ("cc", "licensed under CC BY-NC 4.0"),
    ("cc", "licensed under CC BY-NC-SA 4.0"),
    ("cc", "licensed under CC BY-ND 4.0"),
    ("cc", "licensed under CC BY-NC-ND 4.0"),
)

#: Words of a match that may take part in a chain (a shorter template: all of it), share of a template that a span covers at
#: least, and words that may lie between two matches of a chain, as a share of the template's.
LONG, COVER, GAP = 4, 0.7, 1.0

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SPANS = "array<struct<label: string, template: int, start: bigint, end: bigint, template_start: int, template_end: int, cover: double>>"
PLACES = "array<struct<label: string, start: bigint>>"
_SPANS = pa.list_(pa.struct({"label": pa.string(), "template": pa.int32(), "start": pa.int64(), "end": pa.int64(), "template_start": pa.int32(), "template_end": pa.int32(), "cover": pa.float64()}))
_PLACES = pa.list_(pa.struct({"label": pa.string(), "start": pa.int64()}))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: digits, letters and all that is not ASCII."""
    return text.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the places where each state's stretches end."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]]):
        self.labels = [label for label, _ in (*phrases, *templates)]
        self.n_phrases = len(phrases)
        self.vocabulary: dict[bytes, int] = {}
        texts = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text.encode())] for _, text in (*phrases, *templates)]
        self.sizes = [len(t) for t in texts]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, text in enumerate(texts):
            last = 0
            for at, word in enumerate(text):
                last = self._grow(last, word)
                self.ends[last].append((number, at + 1))
        longest_first = sorted(range(1, len(self.length)), key=lambda s: -self.length[s])
        for s in longest_first:  # a stretch ends wherever a longer one with it as its end does
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]
        self.inside = [frozenset(t for t, _ in e) for e in self.ends]
        #: phrases that end with any stretch of a state that is long enough
        self.phrases: list[tuple[int, ...]] = [()] * len(self.length)
        for number in range(self.n_phrases):
            state = 0
            for word in texts[number]:
                state = self.next[state][word]
            self.phrases[state] += (number,)
        for s in reversed(longest_first):
            self.phrases[s] += self.phrases[self.link[s]]
        size = len(self.vocabulary)
        self.neighbours = np.zeros((size + 1, size + 1), bool)  # the last row and column stand for all other words
        for text in texts:
            self.neighbours[text[:-1], text[1:]] = True

    def _grow(self, last: int, word: int) -> int:
        if word in self.next[last]:
            there = self.next[last][word]
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            there = self.next[p][word]
            self.link[new] = there if self.length[there] == self.length[p] + 1 else self._split(p, word, there)
        return new

    def _split(self, p: int, word: int, there: int) -> int:
        """The stretches of ``there`` that are short enough to follow ``p`` get a state of their own."""
        twin = self._state(self.length[p] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = twin
        while p != -1 and self.next[p].get(word) == there:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.length) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """``(phrase, start)`` of each phrase and ``(template, template start, start, words)`` of each long maximal match."""
        get, other = self.vocabulary.get, len(self.vocabulary)
        numbers = np.fromiter((get(w, other) for w in words), np.int32, len(words))
        met = self.neighbours[numbers[:-1], numbers[1:]]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], met.astype(np.int8), [0]])))
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int, int]] = []
        for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
            self._stream(first, numbers[first : last + 1].tolist(), places, matches)
        return places, matches

    def _stream(self, first: int, numbers: list[int], places: list, matches: list) -> None:
        state = held = 0
        for at, word in enumerate(numbers, first):
            if word not in self.next[state]:
                self._keep(state, held, at, matches)
                while state > 0 and word not in self.next[state]:
                    state = self.link[state]
                    held = self.length[state]
            before, state = state, self.next[state][word]
            if len(self.inside[state]) < len(self.inside[before]):  # what goes on here is not in all templates
                self._note(before, held, at, self.inside[before] - self.inside[state], matches)
            held += 1
            for phrase in self.phrases[state]:
                if held >= self.sizes[phrase]:
                    places.append((phrase, at + 1 - self.sizes[phrase]))
        self._keep(state, held, first + len(numbers), matches)

    def _keep(self, state: int, held: int, end: int, matches: list) -> None:
        # a shorter stretch ends in more places; those of the templates the longest one is not in count as well
        seen: frozenset[int] = frozenset()
        while state > 0:
            self._note(state, held, end, self.inside[state] - seen, matches)
            seen = self.inside[state]
            state = self.link[state]
            held = self.length[state]

    def _note(self, state: int, held: int, end: int, templates: frozenset[int], matches: list) -> None:
        for template, there in self.ends[state]:
            if template in templates and held >= min(LONG, self.sizes[template]):
                matches.append((template, there - held, end - held, held))


def chains(matches: list[tuple[int, int, int, int]], sizes: list[int]) -> list[tuple[int, int, int, int, int, float]]:
    """``(template, start, end, template start, template end, cover)``: the spans that do not overlap within a template.

    Matches follow each other in the text and in the template with at most ``GAP`` template lengths of words between them; a
    word of the template counts once. The span with the greatest cover goes first, then those apart from it.
    """
    found = []
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for template, there, at, size in matches:
        by_template.setdefault(template, []).append((at, there, size))
    for template, own in sorted(by_template.items()):
        whole = sizes[template]
        own.sort()
        best: list[tuple[int, int, int]] = []  # words covered, where the chain starts in text and template
        low = 0
        for k, (at, there, size) in enumerate(own):
            while own[low][0] + whole * (2 + GAP) < at:
                low += 1
            top = (size, -at, there)
            for j in range(low, k):
                a, t, n = own[j]
                shared = max(0, a + n - at, t + n - there)  # words of this match that the one before has
                if shared < size and t < there and a < at and at - (a + n) <= GAP * whole:
                    top = max(top, (best[j][0] + size - shared, best[j][1], best[j][2]))
            best.append(top)
        taken: list[tuple[int, int]] = []  # apart from each other, in order
        for k in sorted(range(len(own)), key=lambda k: (-best[k][0], own[k][0] + own[k][2])):
            covered, start, there = best[k][0], -best[k][1], best[k][2]
            span = (start, own[k][0] + own[k][2])
            spot = bisect_left(taken, span)
            apart = (spot == 0 or taken[spot - 1][1] <= span[0]) and (spot == len(taken) or span[1] <= taken[spot][0])
            if apart and (covered >= COVER * whole or not taken):
                insort(taken, span)
                found.append((template, *span, there, own[k][1] + own[k][2], min(1.0, covered / whole)))
    return found


@lru_cache(4)
def automaton(templates: tuple, phrases: tuple) -> Automaton:
    return Automaton(templates, phrases)


def find(docs: DataFrame, columns: list[str], templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """``columns`` of the documents, ``n_words``, ``places`` of the phrases, covered template ``spans`` and the best ``cover``."""
    templates, phrases = tuple(templates), tuple(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(templates, phrases)
        for part in slices(batches):
            n_words, places, spans, cover = [], [], [], []
            for text in part.column("_text").to_pylist():
                words = words_of(text)
                hits, matches = machine.scan(words) if len(words) > 1 else ([], [])
                chained = chains(matches, machine.sizes)
                n_words.append(len(words))
                places.append([{"label": machine.labels[p], "start": at} for p, at in hits])
                kept = [c for c in chained if c[5] >= COVER]
                spans.append([{"label": machine.labels[t], "template": t, "start": a, "end": b, "template_start": c, "template_end": d, "cover": e} for t, a, b, c, d, e in kept])
                cover.append(max((c[5] for c in chained), default=0.0))
            arrays = [pa.array(n_words, pa.int64()), pa.array(places, _PLACES), pa.array(spans, _SPANS), pa.array(cover, pa.float64())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *arrays], names=[*part.schema.names[:-1], "n_words", "places", "spans", "cover"])

    kept = docs.select(*[docs[f"`{c}`"] for c in columns], utf8().alias("_text"))
    return arrow_pass(kept, run, schema_with(kept, f"n_words bigint, places {PLACES}, spans {SPANS}, cover double", "_text"))
