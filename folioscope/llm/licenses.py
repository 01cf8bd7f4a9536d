"""License scans with a generalised suffix automaton of licence tokens.

The templates and the base phrases are put, word by word, into one suffix
automaton.  A file is streamed through it: at each word the automaton holds
the longest run of words, ending there, that occurs anywhere in a template
(the matching statistics); its suffix links tell the same for each template.
Runs that a template does not prolong are its long matches; they are chained
in order, and the chain's span counts as a licence where it covers enough of the template, its version number included.  A base phrase stands
wherever the held run ends in the phrase, which the automaton knows through
its suffix links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import PUNCT, byte_rows, slices

#: Words of a match that can be chained.
LEAST = 5
#: Share of a template's words that a chain must cover.
COVERAGE = 0.8
#: Words of the file, or of the template, that may lie between two chained matches.
GAP = 40

# Base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Names by which licences are granted.
NAMES = {
    "mit": ["MIT License", "Expat License"],
    "apache-2": ["Apache License, Version 2.0", "Apache License 2.0", "Apache Software License, Version 2.0"],
    "gpl-3": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3 license"],
    "gpl-2": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2 license"],
    "lgpl-3": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL version 3"],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL version 2.1"],
    "agpl-3": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL version 3"],
    "mpl-2": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"],
    "epl-2": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "bsd-2-clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "bsd-3-clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "isc": ["ISC License"],
    "zlib": ["zlib License"],
    "bsl-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "cc0-1.0": ["CC0 1.0 Universal", "CC0 1.0 license"],
}
GRANTS = ["Licensed under the {}", "Released under the {}", "Distributed under the {}", "Available under the terms of the {}", "Under the terms of the {}"]

# Elements of the Creative Commons licences, and the versions that are in use.
ELEMENTS = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
CC = ["by", "by-sa", "by-nc", "by-nc-sa", "by-nd", "by-nc-nd"]
CC_VERSIONS = ["2.0", "2.5", "3.0", "4.0"]

# The GNU notice, its licences with their versions, and what they call the work.
GNU_NOTICE = "This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} License as published by the Free Software Foundation{stop} either version {version} of the License, or (at your option) any later version."
GNU_ONLY = "This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} License version {version} as published by the Free Software Foundation."
GNU_WARRANTY = "This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} License for more details."
GNU = {
    "gpl-2": ("program", "General Public", "2", ";"),
    "gpl-3": ("program", "General Public", "3", ":"),
    "lgpl-2.1": ("library", "Lesser General Public", "2.1", ";"),
    "lgpl-3": ("library", "Lesser General Public", "3", ":"),
    "agpl-3": ("program", "Affero General Public", "3", ":"),
}

# Bodies and notices of licences, as they are published.
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
BODIES = {
    "mit": [f"{_MIT_GRANT} {_MIT_AS_IS}", _MIT_GRANT],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "epl-2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "bsd-2-clause": [f"{_BSD_2} {_AS_IS}", _BSD_2],
    "bsd-3-clause": [f"{_BSD_2} {_BSD_3} {_AS_IS}", f"{_BSD_2} {_BSD_3}", _BSD_3],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "0bsd": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "bsl-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."],
    "cc0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
}


def templates() -> dict[str, list[str]]:
    """All templates by label: bodies and notices, and grants by name, made up from their parts by rule."""
    out: dict[str, list[str]] = {label: list(texts) for label, texts in BODIES.items()}
    for label, (work, name, version, mark) in GNU.items():
        part = {"work": work, "name": name, "version": version, "mark": mark, "stop": "," if mark == ":" else ";"}
        notices = [GNU_NOTICE.format(**part), GNU_ONLY.format(**part)]
        out.setdefault(label, []).extend([*notices, *(f"{n} {GNU_WARRANTY.format(**part)}" for n in notices)])
    for label, names in NAMES.items():
        out.setdefault(label, []).extend(g.format(n) for n in names for g in GRANTS)
    for kind in CC:
        long = "-".join(ELEMENTS[e] for e in kind.split("-"))
        for version in CC_VERSIONS:
            out.setdefault(f"cc-{kind}", []).extend(
                [f"Licensed under CC {kind} {version}", f"Licensed under a Creative Commons {long} {version} International License", f"Creative Commons {long} {version} Unported License"]
            )
    return out


TEMPLATES = templates()

_CLEAN = bytes(0x20 if PUNCT[b + 32 if 65 <= b <= 90 else b] else (b + 32 if 65 <= b <= 90 else b) for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text, lower-cased over A-Z."""
    return text.translate(_CLEAN).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the ends of every state's runs."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[list[tuple[int, int]]] = [[]]

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for the shorter runs that reach it through p."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], name: int) -> None:
        """Adds a sequence; ``name`` comes back with the places at which its runs end."""
        last = 0
        for at, word in enumerate(words, 1):
            known = self.next[last].get(word)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
            else:
                p, new = last, self._state(self.length[last] + 1, {}, 0)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                last = new
            self.ends[last].append((name, at))

    def finish(self) -> None:
        """Hands the ends of longer runs to the states of their suffixes."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.ends[self.link[s]] += self.ends[s]


class Scanner:
    """The automaton of templates and base phrases, and the scan of one text."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = Automaton()
        self.templates: list[tuple[str, int]] = []
        #: Places of the version numbers of each template, which a span must cover: kin differ in little else.
        self.versions: list[list[int]] = []
        self.phrases: list[tuple[str, int]] = []
        number = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text.encode())]
        for label, texts in sorted(templates.items()):
            for text in texts:
                self.automaton.add(words := number(text), len(self.templates))
                self.templates.append((label, len(words)))
                plain = words_of(text.encode())
                has = [i for i, w in enumerate(plain) if any(48 <= c < 58 for c in w)]
                self.versions.append([i for i in has if not plain[i].isdigit() or i and plain[i - 1] in (b"version", b"v", b"license", b"bsd")])
        sequences = [(label, number(phrase)) for phrase, label in phrases.items()]
        for label, words in sequences:
            self.automaton.add(words, -1)
            self.phrases.append((label, len(words)))
        self.automaton.finish()
        a = self.automaton
        self._known: dict[int, dict[tuple[int, int], int]] = {}
        self._lost: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        #: By state, the phrases that end the runs of the state, longest suffix first.
        self.ending: list[list[tuple[int, int]]] = [[] for _ in a.next]
        for k, (_, words) in enumerate(sequences):
            state = 0
            for w in words:
                state = a.next[state][w]
            self.ending[state].append((len(words), k))
        for s in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            self.ending[s] = self.ending[s] + self.ending[a.link[s]]

    def _held(self, state: int) -> dict[tuple[int, int], int]:
        """By (template, place) where the runs of a state end, or LEAST words of them at least: how many words do."""
        if state not in self._known:
            out: dict[tuple[int, int], int] = {}
            t, a = state, self.automaton
            while t > 0 and a.length[t] >= LEAST:
                for end in a.ends[t]:
                    if end[0] >= 0:
                        out.setdefault(end, a.length[t])
                t = a.link[t]
            self._known[state] = out
        return self._known[state]

    def _dropped(self, state: int, after: int) -> list[tuple[int, int, int]]:
        """(template, place, words) of the matches held in ``state`` that ``after``, one word on, does not prolong."""
        key = state, after
        if key not in self._lost:
            kept = self._held(after)
            self._lost[key] = [(name, at, n) for (name, at), n in self._held(state).items() if (name, at + 1) not in kept]
        return self._lost[key]

    def scan(self, words: list[bytes]):
        """Places (start, phrase) of the base phrases, and (label, start, end, coverage) of the template spans."""
        a, ids = self.automaton, [*map(self.vocabulary.get, words), None]
        follow, link, length, ending = a.next, a.link, a.length, self.ending
        base: list[tuple[int, int]] = []
        seeds: dict[int, set[tuple[int, int, int]]] = {}
        state = run = 0
        for at, word in enumerate(ids):
            before, held = state, run
            if word is None:
                state = run = 0
            else:
                while state and word not in follow[state]:
                    state = link[state]
                    run = length[state]
                state = follow[state].get(word, 0)
                run = run + 1 if state else 0
                for size, phrase in ending[state]:
                    if run >= size:
                        base.append((at + 1 - size, phrase))
            if held >= LEAST:
                for name, place, n in self._dropped(before, state):
                    n = min(n, held)
                    if n >= LEAST:
                        seeds.setdefault(name, set()).add((at - n, place - n, n))
        return sorted(base), self._spans(seeds)

    def _spans(self, by_template: dict[int, set[tuple[int, int, int]]]) -> list[tuple[str, int, int, float]]:
        """Chains the matches of each template; a chain ends where the next match is too far or goes back."""
        spans = []
        for name, seeds in by_template.items():
            label, size = self.templates[name]
            for chain in _chains(sorted(seeds)):
                if sum(n for *_, n in chain) < COVERAGE * size:
                    continue
                covered = np.zeros(size, bool)
                for _, at, run in chain:
                    covered[at : at + run] = True
                if covered.mean() >= COVERAGE and covered[self.versions[name]].all():
                    spans.append((label, chain[0][0], max(s + run for s, _, run in chain), float(covered.mean()), int(covered.sum())))
        return sorted(x[:4] for group in _overlapping(spans) for x in _longest(group))


def _overlapping(spans: list[tuple]):
    """Groups of spans that lie over one another, one after another."""
    group, reach = [], 0
    for span in sorted(spans, key=lambda x: (x[1], x[2], x)):
        if group and span[1] >= reach:
            yield group
            group = []
        group.append(span)
        reach = max(reach, span[2]) if len(group) > 1 else span[2]
    if group:
        yield group


def _longest(group: list[tuple]) -> list[tuple]:
    """Licences share wording: of spans that lie over one another for the most part, the one with most words stays."""
    kept: list[tuple] = []
    for span in sorted(group, key=lambda x: (-x[4], -x[3], x)):
        if all(2 * (min(span[2], k[2]) - max(span[1], k[1])) <= min(span[2] - span[1], k[2] - k[1]) for k in kept):
            kept.append(span)
    return kept


def _chains(seeds: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Colinear chains of (file start, template start, words), the best end first.

    A chain is followed back from its end to the first match that a better chain
    has taken; matches inside a chain's stretch that it does not use begin none.
    """
    best, back = [0] * len(seeds), [-1] * len(seeds)
    for i, (x, y, n) in enumerate(seeds):
        best[i] = n
        j = i - 1
        while j >= 0 and x - seeds[j][0] - seeds[j][2] <= 2 * GAP + n:
            px, py, pn = seeds[j]
            overlap = max(px + pn - x, py + pn - y, 0)
            if px < x and py < y and y - py - pn <= GAP and x - px - pn <= GAP and best[j] + n - overlap > best[i]:
                best[i], back[i] = best[j] + n - overlap, j
            j -= 1
    out, gone = [], [False] * len(seeds)
    for i in sorted(range(len(seeds)), key=lambda i: (-best[i], i)):
        if gone[i]:
            continue
        chain, at = [], i
        while at >= 0 and not gone[at]:
            gone[at] = True
            chain.append(seeds[at])
            at = back[at]
        low, high = chain[-1][0], max(x + n for x, _, n in chain)
        for way in (-1, 1):
            k = i + way
            while 0 <= k < len(seeds) and low <= seeds[k][0] < high:
                if seeds[k][0] + seeds[k][2] <= high:
                    gone[k] = True
                k += way
        out.append(chain[::-1])
    return out


_scanner: Scanner | None = None


def _scanned(batches):
    global _scanner
    _scanner = _scanner or Scanner()
    s = _scanner
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())]))
    for batch in batches:
        for rows in slices(batch, "text"):
            n, base, labels, spans, places = [], [], [], [], []
            for text in byte_rows(rows.column("text")):
                words = words_of(text)
                found, covered = s.scan(words)
                n.append(len(words))
                places.append([p for p, _ in found])
                base.append(sorted({s.phrases[k][0] for _, k in found}))
                labels.append(sorted({s.phrases[k][0] for _, k in found} | {x[0] for x in covered}))
                spans.append([dict(zip(("label", "first_word", "end_word", "coverage"), x)) for x in covered])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(base, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string())), pa.array(spans, span_type)],
                ["doc_id", "n_words", "base_places", "base_labels", "labels", "spans"],
            )


def scan_licenses(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """(doc_id, n_words, base_places, base_labels, labels, spans) of every row.

    ``base_places`` holds the first word of every place of a base phrase,
    ``spans`` the covered stretches of words with their template's label and
    the covered share of it.  Null and empty texts have 0 words and empty lists;
    long texts are streamed; repeated rows and null ids are rows like others.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spans = T.ArrayType(T.StructType().add("label", "string").add("first_word", "long").add("end_word", "long").add("coverage", "double"))
    schema = T.StructType([chosen.schema["doc_id"]]).add("n_words", "long").add("base_places", T.ArrayType(T.LongType()))
    schema = schema.add("base_labels", T.ArrayType(T.StringType())).add("labels", T.ArrayType(T.StringType())).add("spans", spans)
    return chosen.mapInArrow(_scanned, schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License places and labels of all documents; the score is the best covered share of a template.

    Null and empty texts have no words and no labels.
    """
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    score = F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.when(F.size("base_places") > 0, 1.0).otherwise(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min("base_places").alias("first_word"), F.array_max("base_places").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), score.alias("score"),
    )
