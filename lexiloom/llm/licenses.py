"""License scans: a generalised suffix automaton of template words, through which whole texts stream.

The automaton holds every run of words that occurs in a template or a phrase. A text's words go through it one
by one; at each word it gives the matching statistic, the length of the longest run ending there that some
template has. A state knows the phrases that end its runs, so places of phrases are read off on the way. Where
a run of ``MIN_MATCH`` words or more ends (the next word does not lengthen it), its occurrences in templates are
links of chains: a link joins the chain of its template, at most ``GAP`` words back and further on in the
template, that then covers most words. A closed chain that covers ``SHARE`` of its template's words is a span
and gives the template's label; of spans of one template that overlap the one that covers most stays.

Words are taken and matched a stretch at a time, so memory beside the text itself is bounded by the templates
and the stretch. Null and empty texts have no words, no labels and score 0. Repeated rows are scanned each; all
columns to keep travel in ``_row``. An empty table gives an empty one. The score is the largest share of a
template that a chain covers, 1 where a phrase stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, packed

#: Words of a run that chains are made of, at least.
MIN_MATCH = 6
#: Words between two runs of a chain, at most.
GAP = 40
#: Share of a template's words that a span covers, at least.
SHARE = 0.5
#: Bytes of a text that are words at once.
STRETCH = 1 << 20

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Texts and notices of public licences.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

#: Words are runs of ASCII letters and digits and of all other characters beyond ASCII.
_SPACED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_SPACED).split()


class Automaton:
    """All runs of the templates' words. State 0 is the empty run; templates and phrases are told apart by their numbers."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], min_match: int = MIN_MATCH, gap: int = GAP, share: float = SHARE):
        self.min_match, self.gap, self.share = min_match, gap, share
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.labels, self.sizes = [label for label, _ in templates], []
        self.phrase_labels = list(phrases.values())
        ends: dict[int, list[tuple[int, int]]] = {}
        for t, (_, text) in enumerate(templates):
            states = self._add(words_of(text))
            self.sizes.append(len(states))
            for end, state in enumerate(states):
                ends.setdefault(state, []).append((t, end))
        whole = [self._add(words_of(p))[-1] for p in phrases]
        self.phrase_sizes = [self.length[s] for s in whole]
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        # A state's runs end where its children's do; short runs need no places.
        for state in reversed(order):
            up = self.link[state]
            if state in ends and self.length[up] >= min_match:
                ends.setdefault(up, []).extend(ends[state])
        self.places = {s: sorted(e) for s, e in ends.items() if self.length[s] >= min_match}
        # Phrases that end a state's runs; a phrase's own text has nothing before it, so it is the longest of its state.
        self.phrases: dict[int, tuple[int, ...]] = {}
        for state in order:
            found = self.phrases.get(self.link[state], ()) + tuple(p for p, s in enumerate(whole) if s == state)
            if found:
                self.phrases[state] = found

    def _add(self, words: list[bytes]) -> list[int]:
        """Adds a text; the state of each of its beginnings."""
        last, states = 0, []
        for w in words:
            last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
            states.append(last)
        # A later clone may be a beginning's state no more: read it again.
        state, states = 0, []
        for w in words:
            state = self.next[state][self.vocabulary[w]]
            states.append(state)
        return states

    def _state(self, length: int, link: int, then: dict[int, int]) -> int:
        self.next.append(then)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, state: int, c: int) -> int:
        """The state of ``state``'s longest run with ``c`` behind it, parted from longer runs if need be."""
        q = self.next[state][c]
        if self.length[q] == self.length[state] + 1:
            return q
        clone = self._state(self.length[state] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while state >= 0 and self.next[state].get(c) == q:
            self.next[state][c] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, c)
        return new


class Scan:
    """One text's stream through the automaton."""

    def __init__(self, automaton: Automaton):
        self.of = automaton
        self.n = self.at = 0  # words so far; the word after the last known one
        self.state = self.run = 0
        self.places = 0
        self.first = self.last = None
        self.found: set[int] = set()
        #: Chains by template: [first word, last word, first and last word of the template, covered, extended].
        self.chains: dict[int, list[list]] = {}
        self.spans: dict[int, list[list]] = {}
        self.best = 0.0

    def feed(self, words: list[bytes]) -> None:
        ids = np.fromiter(map(self.of.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(ids >= 0)
        next_, link, length, phrases, least = self.of.next, self.of.link, self.of.length, self.of.phrases, self.of.min_match
        state, run, after = self.state, self.run, self.at
        for i, c in zip((known + self.n).tolist(), ids[known].tolist()):
            if i != after:  # words between that no template has
                if run >= least:
                    self._match(after - 1, run, state)
                state = run = 0
            after = i + 1
            then = next_[state].get(c)
            if then is None:
                if run >= least:
                    self._match(i - 1, run, state)
                while state and then is None:
                    state = link[state]
                    then = next_[state].get(c)
                run = length[state]
            state, run = then, run + 1
            if state in phrases:
                for p in phrases[state]:
                    if self.of.phrase_sizes[p] <= run:
                        self.places += 1
                        start = i + 1 - self.of.phrase_sizes[p]
                        self.first = start if self.first is None else min(self.first, start)
                        self.last = start if self.last is None else max(self.last, start)
                        self.found.add(p)
        self.state, self.run, self.at, self.n = state, run, after, self.n + len(words)

    def close(self) -> None:
        if self.run >= self.of.min_match:
            self._match(self.at - 1, self.run, self.state)
        self.state = self.run = 0
        for t in list(self.chains):
            self._closed(t, None)

    def _match(self, last: int, run: int, state: int) -> None:
        """A longest run that ends at word ``last``."""
        first = last - run + 1
        places = self.of.places[state]
        for t in {t for t, _ in places}:
            self._closed(t, first - 1 - self.of.gap)
        new = []
        for t, end in places:
            chain = [first, last, end - run + 1, end, run, False]
            before = None
            for c in self.chains.get(t, ()):
                if c[1] < last and c[3] < end:
                    covered = c[4] + min(run, last - c[1], end - c[3])
                    if covered > chain[4]:
                        chain, before = [c[0], last, c[2], end, covered, False], c
            if before is not None:
                before[5] = True
            new.append((t, chain))
        for t, chain in new:
            self.chains.setdefault(t, []).append(chain)

    def _closed(self, t: int, since: int | None) -> None:
        """Chains that end before ``since`` (all, if none) can grow no more."""
        held = self.chains.get(t)
        if not held:
            return
        over = [c for c in held if since is None or c[1] < since]
        self.chains[t] = [c for c in held if since is not None and c[1] >= since]
        spans = self.spans.setdefault(t, [])
        for c in over:
            share = c[4] / self.of.sizes[t]
            self.best = max(self.best, share)
            if c[5] or share < self.of.share:
                continue
            if spans and c[0] <= spans[-1][1]:
                if c[4] > spans[-1][4]:
                    spans[-1] = c
            else:
                spans.append(c)

    def result(self) -> tuple:
        spans = sorted((c[0], c[1], t, c[2], c[3], c[4]) for t, found in self.spans.items() for c in found)
        base = sorted({self.of.phrase_labels[p] for p in self.found})
        labels = sorted({*base, *(self.of.labels[s[2]] for s in spans)})
        told = [{"label": self.of.labels[s[2]], "template": s[2], "first_word": s[0], "last_word": s[1], "template_first": s[3], "template_last": s[4], "covered": s[5], "share": s[5] / self.of.sizes[s[2]]} for s in spans]
        return self.n, self.places, self.first, self.last, base, labels, 1.0 if base else self.best, told


def scan(text: str, automaton: Automaton) -> tuple:
    one, data, begin = Scan(automaton), text.encode().translate(_SPACED), 0
    while begin < len(data):
        end = data.find(b" ", begin + STRETCH)
        end = len(data) if end < 0 else end
        one.feed(data[begin:end].split())
        begin = end
    one.close()
    return one.result()


SPAN = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("template_first", pa.int32()), ("template_last", pa.int32()), ("covered", pa.int32()), ("share", pa.float64())])


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, text_col: str = "text", keep: list[str] | None = None, min_match: int = MIN_MATCH, gap: int = GAP, share: float = SHARE) -> DataFrame:
    """``_row`` (the columns to keep), ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and ``spans`` for each row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(packed(docs, keep=keep), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    held: list[Automaton] = []

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Automaton(templates, phrases, min_match, gap, share))
        types = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), pa.list_(SPAN)]
        for b in batches:
            found = [scan(t.as_py(), held[0]) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([b.column("_row"), *[pa.array([x[k] for x in found], t) for k, t in enumerate(types)]], names=["_row", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    span = "array<struct<label: string, template: int, first_word: bigint, last_word: bigint, template_first: int, template_last: int, covered: int, share: double>>"
    return rows.mapInArrow(scanned, f"_row {rows.schema['_row'].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double, spans {span}")
