"""Licence scans: a generalised suffix automaton of licence tokens gives matching statistics, whose long matches are chained into spans."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.llm.bpe import groups
from lexvane.llm.common import table

#: Phrases whose places are all counted, with their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Wordings of licences and of their notices.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd-2", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
]
#: Shortest match in words, longest gap in words between chained matches, least covered share of a template.
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 12, 0.75

_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def licence_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and non-ASCII characters of a text (UTF-8)."""
    return (text or b"").translate(_PLAIN).split()


class SuffixAutomaton:
    """All substrings of several word sequences: nodes with transitions, suffix links, longest lengths and places."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[list[tuple[int, int]]] = [[]]  # (sequence, end) of each node's substrings
        for words in sequences:
            node = 0
            for w in words:
                node = self._extend(node, w)
        for s, words in enumerate(sequences):
            node = 0
            for end, w in enumerate(words, 1):
                node = at = self.next[node][w]
                while at > 0:
                    self.places[at].append((s, end))
                    at = self.link[at]

    def _new(self, length: int, link: int, transitions: dict[bytes, int]) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        self.places.append([])
        return len(self.next) - 1

    def _split(self, node: int, word: bytes, to: int) -> int:
        """A node for the suffixes of to's substrings that fit node + word."""
        clone = self._new(self.length[node] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = clone
        while node >= 0 and self.next[node].get(word) == to:
            self.next[node][word] = clone
            node = self.link[node]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            to = self.next[last][word]
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        made, node = self._new(self.length[last] + 1, 0, {}), last
        while node >= 0 and word not in self.next[node]:
            self.next[node][word] = made
            node = self.link[node]
        if node >= 0:
            to = self.next[node][word]
            self.link[made] = to if self.length[to] == self.length[node] + 1 else self._split(node, word, to)
        return made

    def matches(self, words: list[bytes], least: int) -> list[tuple[int, int, int]]:
        """(end, length, node) of each longest match of `least` words or more that the next word doesn't prolong."""
        found, node, length = [], 0, 0
        nexts, links, lengths = self.next, self.link, self.length
        root = nexts[0]
        for i, w in enumerate(words):
            if w in nexts[node]:
                node = nexts[node][w]
                length += 1
                continue
            if length >= least:
                found.append((i, length, node))
            if w not in root:
                node = length = 0
                continue
            while w not in nexts[node]:
                node = links[node]
            length = lengths[node] + 1
            node = nexts[node][w]
        if length >= least:
            found.append((len(words), length, node))
        return found


class LicenceScanner:
    def __init__(self, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]):
        self.phrases = [(b" " + b" ".join(licence_words(p.encode())) + b" ", label) for p, label in phrases]
        self.labels = [label for label, _ in templates]
        self.sequences = [licence_words(t.encode()) for _, t in templates]
        self.automaton = SuffixAutomaton(self.sequences)

    def phrase_places(self, words: list[bytes]) -> list[tuple[int, str]]:
        body = b" " + b" ".join(words) + b" "
        out = []
        for phrase, label in self.phrases:
            at = body.find(phrase)
            seen = word = 0
            while at >= 0:
                word += body.count(b" ", seen, at)
                seen = at
                out.append((word, label))
                at = body.find(phrase, at + 1)
        return out

    def _chains(self, s: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
        """(first word, word after the last, covered share) of chains of the sorted anchors, best first, each clear of better ones.

        Ties go to the earlier one. After each, only the anchors are chained anew whose chain began before its end.
        """
        size = len(self.sequences[s])
        reach = size * (MAX_GAP + 1)  # places rise in a chain, so it has size anchors at most
        best: list[tuple[int, int]] = []  # covered words and first word of the chain that ends with each anchor

        def chain(k: int, low: int) -> tuple[int, int]:
            at, place, length = found[k]
            covered, first = length, at
            for j in range(bisect_left(found, (max(low, at - size - MAX_GAP),)), k):
                a, p, n = found[j]
                over = max(0, a + n - at, p + n - place)  # words that both would cover
                if at > a and place > p and at - a - n <= MAX_GAP and place - p - n <= MAX_GAP and over < length and best[j][0] + length - over > covered:
                    covered, first = best[j][0] + length - over, best[j][1]
            return covered, first

        for k in range(len(found)):
            best.append(chain(k, 0))
        heap = [(-c, k) for k, (c, _) in enumerate(best) if c / size >= MIN_COVER]
        heapify(heap)
        gone, out = set(), []
        while heap:
            covered, k = heappop(heap)
            if k in gone or best[k][0] != -covered:
                continue
            first, stop = best[k][1], found[k][0] + found[k][2]
            out.append((first, stop, -covered / size))
            after = bisect_left(found, (stop,))
            gone.update(j for j in range(bisect_left(found, (first - size,)), after) if found[j][0] + found[j][2] > first)
            for j in range(after, bisect_left(found, (stop + reach,))):
                if best[j][1] < stop:
                    best[j] = chain(j, stop)
                    if best[j][0] / size >= MIN_COVER:
                        heappush(heap, (-best[j][0], j))
        return out

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, word after the last, covered share of the template) of all copies of templates, by place.

        Where spans overlap, as those of versions of a licence do, the one that covers the most words of the text stays; of equal ones
        that of the larger share, then the earlier one, then the earlier template.
        """
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, node in self.automaton.matches(words, MIN_MATCH):
            for s, stop in self.automaton.places[node]:
                anchors.setdefault(s, []).append((end - length, stop - length, length))
        enough = lambda s, found: sum(a[2] for a in found) >= MIN_COVER * len(self.sequences[s])
        chains = [(-c[2] * len(self.sequences[s]), -c[2], c[0], s, c[1]) for s, found in anchors.items() if enough(s, found) for c in self._chains(s, sorted(found))]
        starts, out = [], []  # of the spans that stay, in order; they are disjoint
        for _, share, first, s, stop in sorted((round(c[0]), *c[1:]) for c in chains):
            k = bisect_left(starts, first)
            if (k == 0 or out[k - 1][2] <= first) and (k == len(out) or out[k][1] >= stop):
                starts.insert(k, first)
                out.insert(k, (self.labels[s], first, stop, -share))
        return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """A row for each row: key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base: places of the phrases; first_word and last_word: their least and greatest start, null without any. labels: of the
    phrases and of the spans, distinct, sorted, comma-joined ('' for none). score: the greatest covered share of a template among
    the spans, 1 with a phrase, 0 with neither. spans: array of (label, start, stop, cover), counted in words and disjoint. A null
    or empty text has no words and labels. Each row is judged alone, repeated ones too; an empty table gives an empty one; other
    columns are not read. No shuffle; a text of any length streams through the automaton once, and ties between chains go to the earlier one.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenceScanner(phrases, templates)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in groups(texts):
                rows = []
                for t in texts[start:stop]:
                    words = licence_words(t)
                    places, spans = scanner.phrase_places(words), scanner.spans(words)
                    starts, base = [p for p, _ in places], {label for _, label in places}
                    labels = base | {s[0] for s in spans}
                    score = 1.0 if places else max((s[3] for s in spans), default=0.0)
                    rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [dict(zip(("label", "start", "stop", "cover"), s, strict=True)) for s in spans]))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *columns], names)

    schema = f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long,cover:double>>"
    return docs.select(key, F.col(text).cast("string").cast("binary")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
