"""License scans: base phrases and template-markup matching by token automata."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: One-line references to licenses, in template markup. [[...]] may be missing, {{n}} stands for up to n words of any kind.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license [[,]] version 2.0",
        "released under the apache [[software]] license [[,]] [[version]] 2.0",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "[[released]] under the [[{{1}} clause]] bsd license",
    ],
    "cc-by": ["[[licensed under [[a]] [[the]]]] creative commons attribution {{2}} [[international]] license"],
    "cc0": ["[[released]] under cc0", "creative commons zero [[{{3}}]] public domain dedication"],
    "gpl": ["gnu [[lesser]] [[affero]] general public license [[version {{1}}]]", "[[licensed]] under the gpl"],
    "mit": [
        "[[released]] under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software [[and associated documentation files]]",
    ],
    "mpl-2.0": ["subject to the terms of the mozilla public license [[,]] v [[.]] 2.0", "mozilla public license [[,]] version 2.0"],
    "proprietary": ["copyright [[c]] {{6}} all rights reserved", "confidential and proprietary", "unauthorized copying of this file [[,]] via any medium [[,]] is strictly prohibited"],
}

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
[[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
[[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = "[[3.]] Neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY {{12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {{{{2}}}} of the License[[, or (at your option) any later version]].
This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
[[You should have received a copy of the GNU {name} along with this {thing}[[; if not, {{{{16}}}}]].]]"""

#: License notices in the same markup. All wording outside of the regions is mandatory; marks and case do not count.
NOTICES = {
    "agpl": [_GNU.format(thing="program", name="Affero General Public License")],
    "apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at {{10}}
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License."""
    ],
    "bsd-2-clause": [f"{_BSD} {_BSD_END}"],
    "bsd-3-clause": [f"{_BSD} {_BSD_NAMES} {_BSD_END}"],
    "cc0": ["To the extent possible under law, {{8}} has waived all copyright and related or neighboring rights to {{12}} [[This work is published from {{4}}]]"],
    "gpl": [_GNU.format(thing="program", name="General Public License")],
    "isc": [
        """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND {{6}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL {{6}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    ],
    "lgpl": [_GNU.format(thing="library", name="Lesser General Public License"), _GNU.format(thing="program", name="Lesser General Public License")],
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
        including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL {{10}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {{8}}"],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        [[In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.]]"""
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will {{6}} be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        [[1.]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
        If you use this software in a product, an [[acknowledgment]] [[acknowledgement]] in the product documentation would be appreciated but is not required.
        [[2.]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        [[3.]] This notice may not be removed or altered from any source distribution."""
    ],
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """A-Z lower-cased; words are runs of digits, letters and whatever is not ASCII."""
    return _WORD.findall((text or "").translate(_UPPER)) if text else []


class Template:
    """A template as an automaton over words. Its deterministic states are made as texts reach them, so optional and replaceable regions cost no backtracking."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.step: list[list[tuple[str | None, int]]] = [[]]  # (word, None: any word or "": none; target)
        self.end = self._build(self._parse(re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup)), 0)
        start = self._closure({0})
        self.first = {w for w, _ in self._moves(start) if w}
        if any(w is None for w, _ in self._moves(start)):
            raise ValueError(f"{label}: a template must begin with wording")
        if self.end in start:
            raise ValueError(f"{label}: a template needs mandatory wording")
        self.words = {w for moves in self.step for w, _ in moves if w}
        self.sets, self.number = [start], {start: 0}
        self.next: list[dict[str | None, int]] = [{}]

    def _parse(self, tokens: list[str]) -> list:
        stack: list[list] = [[]]
        for t in tokens:
            if t == "[[":
                stack.append([])
            elif t == "]]":
                if len(stack) == 1:
                    raise ValueError(f"{self.label}: ]] without [[")
                stack[-2].append(("optional", stack.pop()))
            elif t.startswith("{{"):
                stack[-1].append(("any", int(t[2:-2])))
            else:
                stack[-1] += [("word", w) for w in words_of(t)]
        if len(stack) > 1:
            raise ValueError(f"{self.label}: [[ without ]]")
        return stack[0]

    def _new(self) -> int:
        self.step.append([])
        return len(self.step) - 1

    def _build(self, parts: list, at: int) -> int:
        for kind, x in parts:
            if kind == "word":
                to = self._new()
                self.step[at].append((x, to))
                at = to
            elif kind == "any":
                places = [at]
                for _ in range(x):
                    to = self._new()
                    self.step[places[-1]].append((None, to))
                    places.append(to)
                end = self._new()
                for p in places:
                    self.step[p].append(("", end))
                at = end
            else:
                end = self._build(x, at)
                to = self._new()
                self.step[at].append(("", to))
                self.step[end].append(("", to))
                at = to
        return at

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for w, to in self.step[todo.pop()]:
                if w == "" and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def _moves(self, states) -> list[tuple[str | None, int]]:
        return [(w, to) for s in states for w, to in self.step[s] if w != ""]

    def _go(self, state: int, word: str | None) -> int:
        """The state after ``word`` (None: one that the template does not name), made if it is new; -1: none."""
        to = self._closure({t for w, t in self._moves(self.sets[state]) if w is None or w == word})
        if to and to not in self.number:
            self.number[to] = len(self.sets)
            self.sets.append(to)
            self.next.append({})
        self.next[state][word] = self.number[to] if to else -1
        return self.next[state][word]

    def match(self, words: list[str], at: int) -> int:
        """End of the longest match that begins at word ``at``, or -1."""
        state, end = 0, -1
        for k in range(at, len(words)):
            w = words[k] if words[k] in self.words else None
            to = self.next[state].get(w)
            state = self._go(state, w) if to is None else to
            if state < 0:
                break
            if self.end in self.sets[state]:
                end = k + 1
        return end


class Scanner:
    def __init__(self, base: dict[str, str], *templates: dict[str, list[str]]):
        self.base = [(p.split(" "), label) for p, label in base.items()]
        self.templates = [Template(label, m) for some in templates for label, ms in some.items() for m in ms]
        self.anchors: dict[str, list] = {}
        for t in self.templates:
            for w in t.first:
                self.anchors.setdefault(w, []).append(t)
        for p, label in self.base:
            self.anchors.setdefault(p[0], [])
        self.keys = frozenset(self.anchors)

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        if self.keys.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0, 0
        starts, base_labels, labels, covered, matches = [], set(), set(), set(), 0
        for at, w in enumerate(words):
            if w not in self.keys:
                continue
            for phrase, label in self.base:
                if words[at : at + len(phrase)] == phrase:
                    starts.append(at)
                    base_labels.add(label)
                    covered.update(range(at, at + len(phrase)))
            for t in self.anchors[w]:
                if (end := t.match(words, at)) > 0:
                    labels.add(t.label)
                    covered.update(range(at, end))
                    matches += 1
        score = len(covered) / len(words)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels)), score, matches


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Scan each whole text of ``docs`` (doc_id, text); null counts as empty.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and
    largest start, else null), base_labels, labels (with those of matching templates; distinct, sorted, comma-joined),
    score (share of the words that lie in a match, 0 for none) and n_templates (template matches). Repeated
    rows each return; other columns are ignored. ``templates`` (label to markups) are by default the one-line references and the
    full notices; of each template the longest match at each place counts.
    """
    rules = (BASE if base is None else base, *((TEMPLATES, NOTICES) if templates is None else (templates,)))

    def run(batches):
        s = Scanner(*rules)
        for b in batches:
            rows = [s.scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_templates"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long")
