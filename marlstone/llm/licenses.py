"""License scans by conditional compression.

The words around licensing terms form candidate blocks.  A block is compressed
plainly and once with every template as a zstandard raw dictionary; templates
are ranked by the bytes that they save.  All that save any
are confirmed, best first, by exact wording differences: every place of the
template's words in the block, for long templates with up to ``DIFFERENCE`` of
the words dropped or added.  Confirmed words are blanked out and the block is
compressed again, so that notices alike do not hide each other, until nothing
more is confirmed.  No rank is cut off.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from marlstone.llm.words import utf8_rows

# Wording of common licence notices, without names, years and addresses.
_AS_IS = (
    "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of "
    "merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable "
    "for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection "
    "with the Software or the use or other dealings in the Software."
)
_BSD_AS_IS = (
    "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but "
    "not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the "
    "copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages "
    "(including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) "
    "however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) "
    "arising in any way out of the use of this software, even if advised of the possibility of such damage."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
    "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies."
)
_ISC_AS_IS = (
    "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied "
    "warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or "
    "consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, "
    "negligence or other tortious action, arising out of or in connection with the use or performance of this software."
)
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", _MIT, f"{_MIT} {_AS_IS}"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD-3-Clause": (_BSD_3, f"{_BSD_3} {_BSD_AS_IS}"),
    "BSD-2-Clause": (_BSD_2, f"{_BSD_2} {_BSD_AS_IS}"),
    "ISC": (_ISC, f"{_ISC} {_ISC_AS_IS}"),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        + _ISC_AS_IS,
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in "
        "a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions "
        "must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed "
        "or altered from any source distribution.",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
        "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
        "so, all subject to the following:",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
    "CC0-1.0": ("Licensed under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0",),
}
#: Words right before a short notice that turn it into its opposite, with or without one more word between.
DENIALS, BETWEEN = frozenset((b"not", b"never", b"nor")), frozenset((b"be", b"been", b"being", b"yet"))
SIGNS = (b"licen", b"copyright", b"permission", b"redistribut", b"public domain", b"unencumbered", b"spdx")
_SIGN = re.compile(rb"licen[cs]|copyright|permission|redistribut|unencumbered|domain|spdx")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Blocks for long and short templates: words on either side of a sign (more than any template holds), and the longest
#: block and overlap of those that longer ones are cut into.
LONG_BLOCKS, SHORT_BLOCKS = (320, 2000, 640), (24, 72, 24)
#: Templates of so many words may differ in up to DIFFERENCE of them.
LONG, DIFFERENCE = 20, 0.1
#: Bytes that a template has to save to be confirmed.
LEAST_SAVED = 1
#: What stands for a word of a confirmed notice (no word looks like it).
CLAIMED = b"~"


def wording(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def blocks(words: list[bytes], reach: int, most: int, overlap: int) -> list[tuple[int, int, bool]]:
    """Merged (start, end) word ranges around licensing terms, and whether no other piece of the range follows."""
    out: list[list[int]] = []
    for i, w in enumerate(words):
        if _SIGN.search(w):
            a, b = max(0, i - reach), min(len(words), i + reach + 1)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
    return [(s, min(b, s + most), s + most >= b) for a, b in out for s in range(a, max(a + 1, b - overlap), most - overlap)]


class Template:
    """One notice: its words, and a compressor that has it as dictionary."""

    def __init__(self, licence: str, text: str):
        self.licence = licence
        self.words = wording(text.encode())
        self.counts = Counter(self.words)
        self.line = b" " + b" ".join(self.words) + b" "
        dictionary = zstandard.ZstdCompressionDict(self.line, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_checksum=False)

    def exact(self, line: bytes) -> list[tuple[int, int, int]]:
        """(first word, end, 0) of every place of the very words."""
        found, at, place, seen = [], line.find(self.line), 0, 0
        while at >= 0:
            place += line.count(b" ", seen, at)
            found.append((place, place + len(self.words), 0))
            seen, at = at, line.find(self.line, at + 1)
        return found

    def places(self, words: list[bytes], line: bytes, counts: Counter) -> list[tuple[int, int, int]]:
        """(first word, end, differing words) of every place of the template, apart from each other."""
        n = len(self.words)
        if n < LONG:
            return self.exact(line)
        most = int(DIFFERENCE * n)
        # A place lacks at most so many of the template's words.
        if sum((self.counts - counts).values()) > most:
            return []
        numbers = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        mine = np.array([numbers[w] for w in self.words])
        codes = np.array([numbers.get(w, -1) for w in words])
        away = _aligned(mine, codes, anywhere=True)
        around = np.concatenate([[n + 1], away, [n + 1]])
        ends = np.flatnonzero((away <= most) & (away < around[:-2]) & (away <= around[2:]))
        taken = np.zeros(len(words), bool)
        found = []
        for end in sorted(ends.tolist(), key=lambda j: (away[j], j)):
            d = int(away[end])
            back = _aligned(mine[::-1], codes[max(0, end - n - d) : end][::-1], anywhere=False)
            start = end - int(np.flatnonzero(back == d)[0])
            if not taken[start:end].any():
                taken[start:end] = True
                found.append((start, end, d))
        return found


def _aligned(template: np.ndarray, codes: np.ndarray, *, anywhere: bool) -> np.ndarray:
    """Least words to drop or add between the template and the words up to each end, from anywhere or from the first."""
    at = np.arange(len(codes) + 1)
    row = np.zeros_like(at) if anywhere else at
    for c in template:
        above = row + 1
        above[1:] = np.where(codes == c, np.minimum(above[1:], row[:-1]), above[1:])
        row = np.minimum.accumulate(above - at) + at
    return row


@cache
def templates() -> tuple[tuple[Template, ...], zstandard.ZstdCompressor]:
    plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    named = [(k, f"SPDX-License-Identifier: {k}") for k in TEMPLATES]
    return tuple(Template(k, t) for k, t in [*((k, t) for k, texts in TEMPLATES.items() for t in texts), *named]), plain


def ranked(line: bytes, among: Iterable[Template]) -> list[tuple[int, int, Template]]:
    """(bytes saved, plain size, template) of the templates that a block's words compress better with, best first."""
    _, plain = templates()
    size = len(plain.compress(line))
    savings = [(size - len(t.compressor.compress(line)), size, t) for t in among]
    return sorted((x for x in savings if x[0] >= LEAST_SAVED), key=lambda x: -x[0])


@dataclass(frozen=True)
class Claim:
    start: int
    end: int
    away: int
    template: Template
    saved: float

    @property
    def score(self) -> int:
        """Own words that stand there, less the words that differ."""
        return len(self.template.words) - 2 * self.away


def _undisputed(claims: list[Claim]) -> list[Claim]:
    """Claims without a better one over most of the same words."""
    starts, ends, scores = (np.array([getattr(c, k) for c in claims]) for k in ("start", "end", "score"))
    out = []
    for c in claims:
        shared = np.minimum(ends, c.end) - np.maximum(starts, c.start)
        if not ((scores > c.score) & (5 * shared >= 4 * (c.end - c.start))).any():
            out.append(c)
    return out


def _search(words: list[bytes], shape: tuple[int, int, int], among: list[Template]) -> list[Claim]:
    """Confirmed claims of some templates, whose words are blanked out in ``words``."""
    found = []
    for a, b, last in blocks(words, *shape):
        while True:
            block = words[a:b]
            line = b" " + b" ".join(block) + b" "
            counts = Counter(block)
            # What reaches into the overlap is seen whole by the next piece.
            claims = [
                Claim(a + start, a + end, away, t, saved / size)
                for saved, size, t in ranked(line, among)
                for start, end, away in t.places(block, line, counts)
                if last or a + start < b - shape[2]
            ]
            if not claims:
                break
            for c in _undisputed(claims):
                found.append(c)
                words[c.start : c.end] = [CLAIMED] * (c.end - c.start)
    return found


def _denied(words: list[bytes], start: int) -> bool:
    before = words[max(0, start - 2) : start]
    return before[-1:] != [] and (before[-1] in DENIALS or (before[-1] in BETWEEN and before[0] in DENIALS))


def scan(text: bytes | None) -> list[tuple[str, int, int, float]]:
    """(licence, first word, differing words, share of bytes saved) of confirmed notices, in order.

    Of templates that claim the same words only the best stays: the one with
    most of its own words there after twice the differing words are taken off.
    A short notice right after "not" and the like is none.
    """
    if not text:
        return []
    low = text.lower()
    if not any(s in low for s in SIGNS):
        return []
    words = _WORD.findall(low)
    known, _ = templates()
    open_words = words.copy()
    found = _search(open_words, LONG_BLOCKS, [t for t in known if len(t.words) >= LONG])
    found += [c for c in _search(open_words, SHORT_BLOCKS, [t for t in known if len(t.words) < LONG]) if not _denied(words, c.start)]
    notices: dict[tuple[str, int], tuple[int, float]] = {}
    for c in found:
        key = c.template.licence, c.start
        notices[key] = min(notices.get(key, (c.away, -c.saved)), (c.away, -c.saved))
    return [(licence, place, away, -saved) for (licence, place), (away, saved) in sorted(notices.items(), key=lambda x: (x[0][1], x[0][0]))]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("license", pa.string()), ("word", pa.int64()), ("differences", pa.int64()), ("saved", pa.float64())]))
    for batch in batches:
        found = [[{"license": k, "word": w, "differences": d, "saved": s} for k, w, d, s in scan(t)] for t in utf8_rows(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "notices"])


def license_notices(documents: DataFrame) -> DataFrame:
    """(doc_id, n_notices, licenses, exact, notices), one row per input row.

    ``licenses`` joins the distinct SPDX-style ids in order by commas ('' if
    none); ``exact`` tells whether every notice has its template's very words;
    ``notices`` has place, differing words and bytes saved of each.  Null and
    empty texts have none; ids may repeat or be null; other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    notice = "notices array<struct<license:string,word:long,differences:long,saved:double>>"
    return docs.mapInArrow(_scanned, f"doc_id long, {notice}").select(
        "doc_id",
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["license"]))), ",").alias("licenses"),
        F.forall("notices", lambda x: x["differences"] == 0).alias("exact"),
        "notices",
    )
