"""License scans by sentence rules.

Texts are cut into sentences, a sentence is normalised to its lower-cased words
and looked up among the sentences of known licences. What a document then is, is
a short sequence of sentence identifiers with their places; licence rules are
ordered lists of such identifiers, with a limit to the words between two. The
longest rule that matches at a place wins it.

Sentences are cut three times: with line feeds as ends, for notices that stand in
a line of their own; without (blank lines excepted), for texts that wrap; and at
colons, for texts in one line. Comment marks and the like are no words, so they
don't count.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import typed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words that may stand between two sentences of a rule.
MOST_BETWEEN = 40

#: Sentences of public licences and of the notices that name them.
SENTENCES = {
    "apache2-notice": "Licensed under the Apache License, Version 2.0",
    "apache2-the-license": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache2-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-obtain-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache2-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-copies": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-author": "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-holders": "Neither the names of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-free-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-free-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-free-2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "lgpl-free-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl-free-3": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-free-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "version-2-1991": "Version 2, June 1991",
    "version-2.1-1999": "Version 2.1, February 1999",
    "version-3-2007": "Version 3, 29 June 2007",
    "version-3-november": "Version 3, 19 November 2007",
    "apache-title": "Apache License",
    "version-2-2004": "Version 2.0, January 2004",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-notice": "Dedicated to the public domain under CC0 1.0",
    "epl2-title": "Eclipse Public License - v 2.0",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "psf2-title": "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2",
}
#: Fixed values: (licence, sentences in order).
TEXT_RULES = (
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("apache2-the-license",)),
    ("Apache-2.0", ("apache2-the-license", "apache2-obtain", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache2-the-license", "apache2-obtain-https", "apache2-basis", "apache2-see")),
    ("Apache-2.0", ("apache-title", "version-2-2004")),
    ("MIT", ("mit-grant", "mit-copies")),
    ("MIT", ("mit-grant", "mit-copies", "mit-as-is", "mit-liable")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names-university")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names-author")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names-holders")),
    ("GPL-2.0", ("gpl-title", "version-2-1991")),
    ("GPL-2.0", ("gpl-free-2-only",)),
    ("GPL-2.0-or-later", ("gpl-free-2",)),
    ("GPL-2.0-or-later", ("gpl-free-2", "gpl-hope", "gpl-details")),
    ("GPL-3.0", ("gpl-title", "version-3-2007")),
    ("GPL-3.0-or-later", ("gpl-free-3",)),
    ("GPL-3.0-or-later", ("gpl-free-3", "gpl-hope", "gpl-details")),
    ("LGPL-2.1", ("lgpl-title", "version-2.1-1999")),
    ("LGPL-2.1-or-later", ("lgpl-free-2.1",)),
    ("LGPL-3.0", ("lgpl-title", "version-3-2007")),
    ("LGPL-3.0-or-later", ("lgpl-free-3",)),
    ("AGPL-3.0", ("agpl-title", "version-3-november")),
    ("AGPL-3.0-or-later", ("agpl-free-3",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("MPL-2.0", ("mpl2-form",)),
    ("MPL-2.0", ("mpl2-form", "mpl2-obtain")),
    ("CC0-1.0", ("cc0-title",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("EPL-2.0", ("epl2-title",)),
    ("BSL-1.0", ("bsl-title",)),
    ("BSL-1.0", ("bsl-notice",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense-free",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")),
    ("PSF-2.0", ("psf2-title",)),
)
#: Identifiers of licences and the names by which notices call them.
NAMES = {
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License", "MIT license terms"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Modified BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License 1.0",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
#: What a notice says before a licence's name.
NOTICES = ("Licensed under", "Released under", "Distributed under", "Available under", "This project is licensed under", "This work is licensed under", "This software is licensed under", "This program is licensed under", "This software is released under")


def notices() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """(sentences, rules): each notice with each name, with and without an article, and SPDX tags."""
    sentences, rules = {}, []
    for licence, names in NAMES.items():
        said = [f"{notice} {article}{name}" for notice in NOTICES for name in names for article in ("the ", "", "a ")]
        tags = [f"SPDX-License-Identifier: {licence}{more}" for more in (("", "-only") if "GPL" in licence else ("",))]
        for i, text in enumerate([*said, *tags]):
            sentences[f"{licence}-notice-{i}"] = text
            rules.append((licence, (f"{licence}-notice-{i}",)))
        if "GPL" in licence:
            sentences[f"{licence}-later"] = f"SPDX-License-Identifier: {licence}-or-later"
            rules.append((f"{licence}-or-later", (f"{licence}-later",)))
    return sentences, rules


RULES = (*TEXT_RULES, *notices()[1])
ALL_SENTENCES = SENTENCES | notices()[0]


@dataclass
class Book:
    """Sentences by hash, and rules by their first sentence, the longest first."""

    hashes: np.ndarray
    names: list[str]
    rules: dict[str, list[tuple[str, tuple[str, ...]]]]


def _runs(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of runs of words that cover h."""
    place = (np.arange(len(h)) - np.repeat(start, size)).astype(np.uint64)
    return K.mix(np.add.reduceat(K.mix(h + place * K.U64(0x9E3779B97F4A7C15)), start) + size.astype(np.uint64))


def book(sentences: dict[str, str] = ALL_SENTENCES, rules=RULES) -> Book:
    hasher, rows = K.Hasher("alnum", lower=True), []
    for name, text in sentences.items():
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        h = hasher.words(raw, np.array([0, len(raw)]))[2]
        rows.append((int(_runs(h, np.array([0]), np.array([len(h)]))[0]), name))
    rows = sorted({h: name for h, name in reversed(rows)}.items())  # of equal sentences the first
    by: dict[str, list] = {}
    for licence, names in sorted(rules, key=lambda r: -len(r[1])):
        by.setdefault(names[0], []).append((licence, names))
    return Book(np.array([r[0] for r in rows], dtype=np.uint64), [r[1] for r in rows], by)


def sentences_of(data: np.ndarray, offsets: np.ndarray, hasher: K.Hasher, known: Book) -> list[tuple[int, int, int, str]]:
    """(text, first word, word after the last, sentence) of the known sentences, in order; words are numbered over all texts."""
    starts, ends, h, first = hasher.words(data, offsets)
    if not len(h):
        return []
    base = int(offsets[0])
    part = data[base : int(offsets[-1])]
    feed = part == 0x0A
    blank = (part == 0x20) | ((part >= 0x09) & (part <= 0x0D))
    stop, colon = np.zeros(len(part), dtype=bool), np.zeros(len(part), dtype=bool)
    stop[:-1] = np.isin(part[:-1], np.frombuffer(b".!?", dtype=np.uint8)) & blank[1:]
    colon[:-1] = (part[:-1] == 0x3A) & blank[1:]

    def between(flags: np.ndarray, least: int) -> np.ndarray:
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[starts[1:] - base] - total[ends[:-1] - base] >= least

    text = K.text_of_words(first)
    end = between(stop, 1) | (text[1:] != text[:-1])
    found = set()
    for cut in (end | between(feed, 1), end | between(feed, 2), end | between(colon, 1)):
        start = np.concatenate([[0], np.flatnonzero(cut) + 1])
        size = np.diff(np.concatenate([start, [len(h)]]))
        s = _runs(h, start, size)
        at = np.minimum(np.searchsorted(known.hashes, s), len(known.hashes) - 1)
        for i in np.flatnonzero(known.hashes[at] == s).tolist():
            found.add((int(text[start[i]]), int(start[i]), int(start[i] + size[i]), known.names[at[i]]))
    return sorted(found)


def matches(rows: list[tuple[int, int, int, str]], known: Book) -> list[tuple[str, int, int]]:
    """(licence, first word, word after the last) in one text's known sentences; a sentence belongs to one match at most."""
    out, i, used = [], 0, set()
    for i in range(len(rows)):
        if i in used:
            continue
        for licence, names in known.rules.get(rows[i][3], []):
            chain = [i]
            for name in names[1:]:
                last, j = rows[chain[-1]][2], None
                for at in range(chain[-1] + 1, len(rows)):
                    if rows[at][1] > last + MOST_BETWEEN:
                        break
                    if rows[at][1] >= last and rows[at][3] == name and at not in used:
                        j = at
                        break
                if j is None:
                    break
                chain.append(j)
            if len(chain) == len(names):
                used.update(chain)
                out.append((licence, rows[i][1], rows[chain[-1]][2]))
                break
    return out


def license_scan(docs: DataFrame, sentences: dict[str, str] = ALL_SENTENCES, rules=RULES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_sentences (known ones), found: an array of (license, start, end) in characters, end exclusive.

    Null and empty texts have none. Of rules that match at one sentence the one
    with most sentences wins, and of equal ones the first in the book; of equal
    sentences in the book the first counts. Rows that repeat a doc_id, or have none,
    are scanned each by itself; an empty table gives an empty result; further
    columns aren't looked at.
    """
    known = book(sentences, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = K.Hasher("alnum", lower=True)
        for b in batches:
            data, offsets = K.column(b.column(1))
            for lo, hi in K.spans(offsets):
                own = offsets[lo : hi + 1]
                count, out = [0] * (hi - lo), [[] for _ in range(hi - lo)]
                by: dict[int, list] = {}
                for row in sentences_of(data, own, hasher, known):
                    by.setdefault(row[0], []).append(row)
                if by:
                    starts, ends, _, _ = hasher.words(data, own)
                for text, rows in by.items():
                    count[text] = len(rows)
                    chars = lambda at: len(data[own[text] : at].tobytes().decode())  # noqa: B023, E731
                    out[text] = [{"license": name, "start": chars(starts[a]), "end": chars(ends[z - 1])} for name, a, z in matches(rows, known)]
                kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(out, kind)], ["doc_id", "n_sentences", "found"])

    return typed(docs, ("doc_id", "long"), ("text", "string")).mapInArrow(run, "doc_id long, n_sentences long, found array<struct<license:string,start:long,end:long>>")


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_licenses (matches), licenses (distinct, sorted, comma-joined), spans (license:start:end, comma-joined)."""
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x.license))), ",")
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x.license, x.start.cast("string"), x["end"].cast("string"))), ",")
    return license_scan(docs).select("doc_id", "n_sentences", F.size("found").cast("long").alias("n_licenses"), names.alias("licenses"), spans.alias("spans"))
