"""License scan by conditional compression.

The words near a licence keyword (Aho-Corasick), as many to either side as any
template has and across line breaks, form candidate blocks. Every template's best
place in each template-sized window of a block that holds enough of its words is a
candidate; a window without them can't be confirmed, so none is missed. Candidates
are compressed, plain and with each's template as a raw zstandard dictionary, and
ranked by the bytes that the dictionary saves. In that order they are confirmed by
their exact wording: the share of the template's words found in order is at least
``LEAST``, and version numbers and other differences are listed; of overlapping ones
that save the same to a few bytes, the one with fewest differences wins. A confirmed place
is masked for those after it, and what is left of the block is searched again
until no template is found, so a list of notices or a repeated one is found whole.

Null and empty texts have no findings; a document without one still has its
row. Texts of any length are scanned whole, row by row, nothing is shuffled.
Repeated rows are scanned as rows; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, to_arrow

# Wordings of public licences, as published.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "SPDX": "SPDX-License-Identifier:",
    "all-rights-reserved": "All rights reserved.",
}
#: Every template holds one that no line break can part.
KEYWORDS = ("licens", "licenc", "spdx-", "permission", "redistribution", "free software", "domain", "reserved", "without warranty", "commons")

_WORD = re.compile(r"\w+(?:[.\-/]\w+)*")
#: Words either side of a hit that join its block: as many as the longest template's window, and some.
WINDOW_WORDS = max(len(_WORD.findall(t)) for t in TEMPLATES.values()) * 5 // 4 + 10
#: Least share of the template's words found in order.
LEAST = 0.8
#: Bytes of savings that tell nothing: a literal more or less, and the length of a match's offset.
SLACK = 8

_ID = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)", re.I)


@lru_cache(maxsize=1)
def _tools():
    a = ahocorasick.Automaton()
    for w in KEYWORDS:
        a.add_word(w, len(w))
    a.make_automaton()
    plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    given = {n: zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for n, t in TEMPLATES.items()}
    return a, plain, given


@lru_cache(maxsize=1)
def _words():
    """A number per template word, and of each template its words, their places as bits from either
    end, which numbers it has (the last: any other word) and how many other words may stand between."""
    own = {n: _WORD.findall(t.lower()) for n, t in TEMPLATES.items() if n != "SPDX"}  # (an identifier follows SPDX)
    number = {w: i for i, w in enumerate(sorted({w for ws in own.values() for w in ws}))}
    out = {}
    for n, ws in own.items():
        want = [number[w] for w in ws]
        known = np.zeros(len(number) + 1, bool)
        known[want] = True
        has, back = ({w: sum(1 << i for i, x in enumerate(some) if x == w) for w in set(want)} for some in (want, want[::-1]))
        out[n] = (want, has, back, known, max(4, len(want) // 4))
    return number, out


def _lower(text: str) -> str:
    """The text in lower case, at the same places."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _back(low: str, at: int, stop: int) -> int:
    """Where the ``WINDOW_WORDS``-th word before ``at`` begins; ``stop`` if fewer words follow it."""
    size = 12 * WINDOW_WORDS
    while True:
        begin = max(stop, at - size)
        # A word at the edge may begin before it.
        found = [m.start() for m in _WORD.finditer(low, begin, at)][begin > stop :]
        if len(found) >= WINDOW_WORDS:
            return found[-WINDOW_WORDS]
        if begin == stop:
            return stop
        size *= 2


def blocks(text: str) -> list[tuple[int, int]]:
    """Spans (code points) of the words around keyword hits; neighbours are joined."""
    low = _lower(text)
    out: list[list[int]] = []
    starts, words = array("q"), iter(())
    for end, n in _tools()[0].iter(low):
        s = end - n + 1
        if not out or s > out[-1][1]:
            begin = _back(low, s, out[-1][1] if out else 0)
            if not out or begin > out[-1][1]:
                out.append([begin, begin])
                starts, words = array("q"), _WORD.finditer(low, begin)
        left = WINDOW_WORDS - (len(starts) - bisect_right(starts, s))
        while left > 0:
            if (m := next(words, None)) is None:
                out[-1][1] = len(low)
                break
            starts.append(m.start())
            out[-1][1] = m.end()
            left -= m.start() > s
    return [(s, e) for s, e in out]


def _found(has: dict[int, int], m: int, ids: list[int]) -> int:
    """How many of a template's ``m`` words are in ``ids`` in order (bit-parallel common subsequence)."""
    v = full = (1 << m) - 1
    for w in ids:
        if w in has:
            u = v & has[w]
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def _tight(has: dict[int, int], back: dict[int, int], m: int, ids: list[int], k: int) -> tuple[int, int]:
    """The span of ``ids`` that ends first, and there begins last, with ``k`` words in order."""
    ends = []
    for which, some in ((has, ids), (back, None)):
        some = ids[ends[0] - 1 :: -1] if some is None else some
        v = full = (1 << m) - 1
        for i, w in enumerate(some):
            if w in which:
                u = v & which[w]
                v = ((v + u) | (v - u)) & full
                if m - v.bit_count() >= k:
                    ends.append(i + 1)
                    break
    return ends[0] - ends[1], ends[0]


def _places(ids: np.ndarray, n: str) -> Iterator[tuple[int, int, int]]:
    """(words found, first, end) of the best place of template ``n`` in every stretch as long as it
    where it can be: no other window holds enough of its words."""
    want, has, back, known, room = _words()[1][n]
    m, size = len(want), len(want) + room
    least = next(k for k in range(m + 1) if k / m >= LEAST)
    total = np.concatenate([[0], np.cumsum(known[ids])])
    begin = np.arange(max(1, len(ids) - size + 1))
    can = np.flatnonzero(total[np.minimum(begin + size, len(ids))] - total[begin] >= least)
    if not len(can):
        return
    need = Counter(want)
    for run in np.split(can, np.flatnonzero(np.diff(can) != 1) + 1):
        for at in range(0, len(run), size):
            first, many = int(run[at]), min(size, len(run) - at)
            here = ids[first : first + many - 1 + size].tolist()
            # Of each window, the template's words in any order: an upper bound.
            have, bound, bounds = Counter(here[:size]), 0, []
            bound = sum(min(have[w], c) for w, c in need.items())
            for i in range(many):
                if i:
                    gone, new = here[i - 1], here[i - 1 + size] if i - 1 + size < len(here) else -1
                    if gone in need:
                        bound -= have[gone] <= need[gone]
                        have[gone] -= 1
                    if new in need:
                        have[new] += 1
                        bound += have[new] <= need[new]
                bounds.append((-bound, i))
            best, window = least - 1, -1
            for bound, i in sorted(bounds):
                if -bound <= best:
                    break
                if (k := _found(has, m, here[i : i + size])) > best:
                    best, window = k, i
            if window >= 0:
                s, e = _tight(has, back, m, here[window : window + size], best)
                yield best, first + window + s, first + window + e


def compressed(place: str, n: str) -> tuple[int, int]:
    """Bytes of a place (whatever its line width) compressed plain, and with template ``n`` as dictionary."""
    _, plain, given = _tools()
    data = " ".join(place.split()).encode("utf-8", "surrogatepass")
    return len(plain.compress(data)), len(given[n].compress(data))


def judge(block: str) -> list[tuple[str, float, float, str, int, int]]:
    """(template, reduction, share of its words in order, differences, span) of every place."""
    number, templates = _words()
    low = _lower(block)
    ids, starts, ends = array("i"), array("q"), array("q")
    for m in _WORD.finditer(low):
        ids.append(number.get(m[0], -1))
        starts.append(m.start())
        ends.append(m.end())
    all_ids = np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)
    out = []
    left = [(0, len(ids))]
    while left:  # stretches in which no place is confirmed yet
        begin, end = left.pop()
        found = []
        for n, (want, *_) in templates.items():
            for k, s, e in _places(all_ids[begin:end], n) if (end - begin) / len(want) >= LEAST else ():
                s, e = begin + s, begin + e
                size, rest = compressed(low[starts[s] : ends[e - 1]], n)
                found.append((rest - size, len(want) - 2 * k, n, s, e, k, 1 - rest / size))
        taken: list[tuple[int, int]] = []
        free = lambda s, e: not ((i := bisect_right(taken, (s, e))) and taken[i - 1][1] > s) and not (i < len(taken) and taken[i][0] < e)
        ranked = sorted(found)
        for at, (saved, _, _, s, e, *_) in enumerate(ranked):
            if not free(s, e):
                continue
            # Savings that differ by less than a match costs are equal; of those the exact wording decides.
            close = (c for c in ranked[at:] if c[0] - saved <= SLACK and c[3] < e and s < c[4] and free(c[3], c[4]))
            _, _, n, s, e, k, reduction = min(close, key=lambda c: c[1])
            insort(taken, (s, e))
            own = [low[starts[i] : ends[i]] for i in range(s, e)]
            out.append((n, max(0.0, reduction), k / len(templates[n][0]), _differences(_WORD.findall(TEMPLATES[n].lower()), own), starts[s], ends[e - 1]))
        if taken:
            edges = [begin, *(x for span in taken for x in span), end]
            left += [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
    return sorted(out, key=lambda f: f[4:])


def _differences(want: list[str], own: list[str]) -> str:
    m = SequenceMatcher(None, want, own, autojunk=False)
    return "; ".join(f"-{' '.join(want[i1:i2])}+{' '.join(own[j1:j2])}" for op, i1, i2, j1, j2 in m.get_opcodes() if op != "equal")


def find(text: str | None) -> list[dict]:
    """Confirmed licences of a text with their spans."""
    out = []
    for s, e in blocks(text) if text else ():
        block = text[s:e]
        for m in _ID.finditer(block):
            out.append({"license": m[1], "start": s + m.start(), "end": s + m.end(), "reduction": 1.0, "share": 1.0, "differences": ""})
        for n, reduction, share, diff, at, to in judge(block):
            out.append({"license": n.split("-notice")[0], "start": s + at, "end": s + to, "reduction": reduction, "share": share, "differences": diff})
    return out


FIELDS = "license string, start long, end long, reduction double, share double, differences string"
FOUND = pa.schema([("doc_id", pa.int64()), ("n_licenses", pa.int64()), ("licenses", pa.string()), ("findings", pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("share", pa.float64()), ("differences", pa.string())])))])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: how many findings, the distinct licences, and each finding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [find(t) for t in b.column(1).to_pylist()]
            yield to_arrow(FOUND, doc_id=b.column(0), n_licenses=[len(f) for f in found], licenses=[",".join(sorted({x["license"] for x in f})) for f in found], findings=found)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n_licenses long, licenses string, findings array<struct<{FIELDS.replace(' ', ':').replace(',:', ', ')}>>")
