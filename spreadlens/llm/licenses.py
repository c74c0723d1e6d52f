"""Licence scans by sentence rules (operator 9).

A text is cut into sentences; each is normalised and looked up among known
licence sentences, which gives an identifier or none.  Ordered rules, each a
sequence of identifiers, are matched against the runs of identifiers of
neighbouring sentences, the first rule that fits at a place taking it.

Defined results: null and empty texts have no sentences; a sentence repeated
is found again each time; text between two known sentences breaks a sequence,
a list marker ("1.", "a)") is no sentence and breaks none;
null ids stay; repeated rows give equal rows; whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame

from . import common

#: Sentences of well-known licence texts and notices, by identifier.
SENTENCES = {
    "mit_ref": "Released under the MIT License.|Licensed under the MIT License.|This project is licensed under the MIT License."
               "|Distributed under the MIT License.|SPDX-License-Identifier: MIT",
    "mit_title": "The MIT License|MIT License|The MIT License (MIT)",
    "mit_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache_ref": "Licensed under the Apache License, Version 2.0.|Released under the Apache License 2.0.|SPDX-License-Identifier: Apache-2.0"
                  "|This project is licensed under the Apache License 2.0.",
    "apache_grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache_copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache_warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache_see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3_ref": "This work is licensed under the GNU General Public License, version 3.|Licensed under the GNU General Public License v3.0."
                "|SPDX-License-Identifier: GPL-3.0-only|SPDX-License-Identifier: GPL-3.0-or-later",
    "gpl2_ref": "This work is licensed under the GNU General Public License, version 2.|SPDX-License-Identifier: GPL-2.0-only"
                "|SPDX-License-Identifier: GPL-2.0-or-later",
    "lgpl3_ref": "This work is licensed under the GNU Lesser General Public License, version 3.|SPDX-License-Identifier: LGPL-3.0-only",
    "agpl3_ref": "This work is licensed under the GNU Affero General Public License, version 3.|SPDX-License-Identifier: AGPL-3.0-only",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_see": "See the GNU General Public License for more details.",
    "gpl_copy": "You should have received a copy of the GNU General Public License along with this program.",
    "bsd_ref2": "Licensed under the BSD 2-Clause License.|SPDX-License-Identifier: BSD-2-Clause",
    "bsd_ref3": "Licensed under the BSD 3-Clause License.|SPDX-License-Identifier: BSD-3-Clause",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc_ref": "Licensed under the ISC License.|SPDX-License-Identifier: ISC",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl_ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.|Licensed under the Mozilla Public License 2.0."
               "|SPDX-License-Identifier: MPL-2.0",
    "unlicense_ref": "This is free and unencumbered software released into the public domain.|SPDX-License-Identifier: Unlicense",
    "cc0_ref": "Licensed under CC0 1.0 Universal.|SPDX-License-Identifier: CC0-1.0",
    "ccby_ref": "Licensed under CC BY 4.0.|This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa_ref": "Licensed under CC BY-SA 4.0.|This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync_ref": "Licensed under CC BY-NC 4.0.|This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "reserved": "All rights reserved.",
}
#: Ordered rules, the fuller text first.
RULES = [
    ("MIT", ["mit_title", "mit_grant", "mit_notice", "mit_warranty", "mit_liability"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty", "mit_liability"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("Apache-2.0", ["apache_grant", "apache_copy", "apache_warranty", "apache_see"]),
    ("Apache-2.0", ["apache_grant", "apache_copy"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_see", "gpl_copy"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope", "gpl_see", "gpl_copy"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("ISC", ["isc_grant"]),
    ("MIT", ["mit_ref"]), ("Apache-2.0", ["apache_ref"]), ("Apache-2.0", ["apache_grant"]),
    ("GPL-3.0", ["gpl3_ref"]), ("GPL-2.0", ["gpl2_ref"]), ("LGPL-3.0", ["lgpl3_ref"]), ("AGPL-3.0", ["agpl3_ref"]),
    ("BSD-2-Clause", ["bsd_ref2"]), ("BSD-3-Clause", ["bsd_ref3"]), ("ISC", ["isc_ref"]), ("MPL-2.0", ["mpl_ref"]),
    ("Unlicense", ["unlicense_ref"]), ("CC0-1.0", ["cc0_ref"]), ("CC-BY-4.0", ["ccby_ref"]),
    ("CC-BY-SA-4.0", ["ccbysa_ref"]), ("CC-BY-NC-4.0", ["ccbync_ref"]), ("Proprietary", ["reserved"]),
]

RESULT = "doc_id bigint, n_sentences bigint, n_known bigint, n_found bigint, licenses string, spans string"

#: A sentence ends at a line's end, or at a full stop, question or exclamation mark before white space.
SENTENCE = re.compile(r"\S(?:[^\n.!?]|[.!?](?!\s))*[.!?]*")
#: A list marker before a sentence, digits or a letter: "1. ", "2) ", "(a) "; also behind a comment's signs.
MARKER = re.compile(r"[\W_]*(?:[0-9]+|[A-Za-z])[.)](?:\s+|$)")
TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def normalise(sentence: str) -> str:
    return " ".join(TOKEN.findall(sentence.lower()))


class Rules:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: list = RULES):
        self.known = {normalise(s): name for name, all_of in sentences.items() for s in all_of.split("|")}
        self.rules = [(name, tuple(seq)) for name, seq in rules]
        # the first words of every known sentence, by how many there are: a sentence over several lines is put together
        self.prefixes = {" ".join(k.split(" ")[:n]) for k in self.known for n in range(1, k.count(" ") + 1)}

    def sentences(self, text: str) -> Iterator[tuple[int, int, str | None]]:
        """(start, end, identifier) of each sentence; lines that only together are known form one sentence, the longest."""
        parts: list[tuple[int, int, str, str]] = []  # start, end, words, words behind a list marker
        for m in SENTENCE.finditer(text):
            if words := normalise(m[0]):
                mark = MARKER.match(m[0])
                parts.append((m.start() + (mark.end() if mark else 0), m.end(), words, normalise(m[0][mark.end():]) if mark else words))
        i = 0
        while i < len(parts):
            start, end, _, words = parts[i]
            name, last, j = self.known.get(words), i, i + 1
            while words in self.prefixes and j < len(parts):
                words = f"{words} {parts[j][2]}"
                if words in self.known:
                    name, last, end = self.known[words], j, parts[j][1]
                j += 1
            if parts[i][3]:
                yield start, end, name
            i = last + 1

    def match(self, ids: list[str | None]) -> Iterator[tuple[str, int, int]]:
        """(licence, first, last + 1) of the rules found in a sequence of identifiers."""
        i = 0
        while i < len(ids):
            if ids[i] is not None:
                for name, seq in self.rules:
                    if tuple(ids[i:i + len(seq)]) == seq:
                        yield name, i, i + len(seq)
                        i += len(seq) - 1
                        break
            i += 1

    def scan(self, text: str) -> tuple[int, int, list[tuple[int, int, str]]]:
        """Sentences, known ones, and (start, end, licence) of each rule found."""
        found = list(self.sentences(text))
        ids = [x[2] for x in found]
        hits = [(found[a][0], found[b - 1][1], name) for name, a, b in self.match(ids)]
        return len(found), sum(x is not None for x in ids), hits


def _scan(batches, rules):
    r = Rules(*rules)
    for b in batches:
        out = [r.scan(t) for t in common.to_strings(b.column(1))]
        yield common.batch(RESULT, b.column(0), [x[0] for x in out], [x[1] for x in out], [len(x[2]) for x in out],
                           [",".join(sorted({n for _, _, n in x[2]})) for x in out],
                           [",".join(f"{n}:{s}:{e}" for s, e, n in x[2]) for x in out])


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list = RULES) -> DataFrame:
    """One row per document: sentences, known ones, rules found, the licences, and their spans (code points)."""
    common.bounded_batches(docs.sparkSession)
    return common.documents(docs).mapInArrow(partial(_scan, rules=(sentences, rules)), RESULT)
