"""License scans by patience alignment (operator 1).

A template's words are aligned with a stretch of a document: words that occur once in
both are anchors, their longest increasing subsequence is kept, and the gaps between
anchors are aligned the same way; a gap without such words keeps the equal words at
its two ends.  Coverage is the share of the template's words that were aligned.  A
license is found where coverage is at least ``COVERAGE``, the words that name it and its version are
aligned, no word that names another license (``TELLING``) stands in the stretch or next to it in its
sentence, and no denial (``DENIALS``) stands before its verb or, in a notice of one sentence, inside.  A notice of one
sentence is looked for within a sentence.  Of overlapping finds the one with the most aligned words stays; of equal ones the one with
the better coverage, then the first name, then the earlier place.  ``and the X License`` behind a find,
in the same sentence, is a find of its own (``MORE``).

A template can only be covered where at least one of its ``triggers`` stands: words of
which more occurrences make up the template than may be missing.  Texts without any
trigger end there, and only stretches around triggers are aligned.

Defined cases: null or empty texts hold no license; very long texts are scanned whole;
a notice that stands twice is found twice; repeated rows give repeated finds; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

COVERAGE = 0.8

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
_WORK = "This work is licensed under the GNU {0}General Public License, version {1}."

#: Fixed values: (identifier, words that name the license, public notice text).
TEMPLATES = (
    ("Apache-2.0", "apache 2 0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", "apache 2 0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT-line", "mit", "Licensed under the MIT License."),
    ("MIT-text", "", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0", "gnu 3", _WORK.format("", 3)),
    ("GPL-2.0", "gnu 2", _WORK.format("", 2)),
    ("LGPL-3.0", "gnu lesser 3", _WORK.format("Lesser ", 3)),
    ("LGPL-2.1", "gnu lesser 2 1", _WORK.format("Lesser ", 2.1)),
    ("AGPL-3.0", "gnu affero 3", _WORK.format("Affero ", 3)),
    ("GPL-3.0-notice", "gnu 3", _GNU.format("", 3)),
    ("GPL-2.0-notice", "gnu 2", _GNU.format("", 2)),
    ("LGPL-3.0-notice", "gnu lesser 3", _GNU.format("Lesser ", 3)),
    ("LGPL-2.1-notice", "gnu lesser 2 1", _GNU.format("Lesser ", 2.1)),
    ("AGPL-3.0-notice", "gnu affero 3", _GNU.format("Affero ", 3)),
    ("BSD-2-Clause", "", _BSD_HEAD),
    ("BSD-3-Clause", "endorse", _BSD_HEAD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "mozilla 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "eclipse 2 0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Unlicense", "", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-NC-4.0", "cc by nc 4 0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "cc by sa 4 0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "cc by nd 4 0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "cc by nc sa 4 0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "cc by nc nd 4 0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "cc by 4 0", "Licensed under CC BY 4.0."),
    ("All-rights-reserved", "rights reserved", "All rights reserved."),
    *((f"{i}-SPDX", " ".join(re.findall("[a-z0-9]+", i.lower())), f"SPDX-License-Identifier: {i}") for i in ("MIT", "Apache-2.0", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")),
)
#: Words that tell licenses apart; one that a template lacks must not stand in or next to its stretch.
TELLING = frozenset("apache mit gnu lesser affero mozilla eclipse nc nd sa isc endorse noncommercial noderivatives sharealike".split())
#: A notice behind one of these words says the opposite, also with words of its verb between them.
DENIALS = frozenset("not no never without neither nor cannot isn aren wasn weren don doesn didn won".split())
VERB = frozenset("t is are was were be been being has have will longer currently yet ever anymore either both also to this the a licensed released distributed published provided offered available made dual under".split())
#: What may follow a find in its sentence, behind one of the words of JOINING and words of BETWEEN.
MORE = (
    ("Apache-2.0", "apache license version 2 0"), ("Apache-2.0", "apache license 2 0"), ("MIT", "mit license"), ("ISC", "isc license"), ("MPL-2.0", "mozilla public license v 2 0"), ("MPL-2.0", "mozilla public license version 2 0"),
    ("EPL-2.0", "eclipse public license 2 0"), ("EPL-2.0", "eclipse public license version 2 0"), *((f"{i}-{v}", f"gnu {kind}general public license version {v.removesuffix('.0').replace('.', ' ')}") for i, kind, v in (("GPL", "", "2.0"), ("GPL", "", "3.0"), ("LGPL", "lesser ", "2.1"), ("LGPL", "lesser ", "3.0"), ("AGPL", "affero ", "3.0"))),
    *((f"CC-{c}-4.0", f"cc {c.lower().replace('-', ' ')} 4 0") for c in ("BY-NC-SA", "BY-NC-ND", "BY-NC", "BY-SA", "BY-ND", "BY")),
)
SPDX_MORE = tuple((n, names) for n, names, _ in TEMPLATES if n.endswith("-SPDX"))
JOINING, BETWEEN = frozenset("and or".split()), frozenset("and or either the under also at your option".split())

_WORD = re.compile(r"[A-Za-z0-9]+")
#: Where a sentence ends; one letter and a dot is no end.
_END = re.compile(r"(?<!\b[A-Za-z])[.!?][\"')\]]*(?:\s|$)|\n\s*\n")


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k:] = [v] if k == len(tops) else [v, *tops[k + 1 :]]
        at[k:] = [i] if k == len(at) else [i, *at[k + 1 :]]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word lists, rising in both."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        if anchors:
            kept = [anchors[k] for k in longest_rise([j for _, j in anchors])]
            pairs += kept
            for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
                todo.append((i + 1, i2, j + 1, j2))
        else:
            while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
                pairs.append((a0, b0))
                a0, b0 = a0 + 1, b0 + 1
            while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
                a1, b1 = a1 - 1, b1 - 1
                pairs.append((a1, b1))
    return sorted(pairs)


def needed(n: int) -> int:
    """Words of n that COVERAGE asks for, in whole numbers."""
    return -(-n * round(COVERAGE * 100) // 100)


@cache
def prepared() -> tuple[tuple[str, list[str], frozenset[str], dict[str, list[int]], bool], ...]:
    """identifier, words, naming words, the places of each trigger in the template, and whether it is one sentence.

    Triggers are the longest words; without all of them fewer words than needed are left."""
    out = []
    for name, names, text in TEMPLATES:
        words = _WORD.findall(text.lower())
        counts, triggers, share = Counter(words), [], 0
        for w in sorted(counts, key=lambda w: (-len(w), w)):
            if len(words) - share < needed(len(words)):
                break
            triggers.append(w)
            share += counts[w]
        one = all(m.end() == len(text) for m in _END.finditer(text))
        out.append((name, words, frozenset(names.split()), {w: [i for i, x in enumerate(words) if x == w] for w in triggers}, one))
    return tuple(out)


@cache
def triggers() -> tuple[str, ...]:
    """All triggers, without those that hold another one."""
    found = {w for *_, t, _ in prepared() for w in t}
    return tuple(sorted(w for w in found if not any(v != w and v in w for v in found)))


class Words:
    """The words of a text, and its sentences as ranges of words."""

    def __init__(self, text: str):
        self.text, self.marks = text, list(_WORD.finditer(text))
        self.low = [m.group().lower() for m in self.marks]
        self.starts = [m.start() for m in self.marks]
        self.ends = [m.end() for m in _END.finditer(text)]

    def sentence(self, i: int) -> tuple[int, int]:
        """The words from .. to of the sentence that word i stands in."""
        k = bisect_right(self.ends, self.starts[i])
        first = bisect_left(self.starts, self.ends[k - 1]) if k else 0
        return first, bisect_left(self.starts, self.ends[k]) if k < len(self.ends) else len(self.starts)

    def around(self, first: int, last: int) -> list[str]:
        """The words from first to last, and the one on each side in its sentence."""
        return self.low[max(self.sentence(first)[0], first - 1) : min(self.sentence(last)[1], last + 2)]

    def denied(self, first: int) -> bool:
        """Whether a word of the same clause takes back what begins at word ``first``, with nothing but its verb between them."""
        i, begin = first - 1, self.sentence(first)[0]
        while i >= begin and not set(",;:") & set(self.text[self.marks[i].end() : self.starts[i + 1]]):
            if self.low[i] in DENIALS:
                return self.low[i + 1] != "only"
            if self.low[i] not in VERB:
                return False
            i -= 1
        return False

    def joined(self, last: int, forms: tuple[tuple[str, str], ...]) -> tuple[str, int, int] | None:
        """(identifier, first, last word) of a license that is named right behind word ``last``, in its sentence."""
        end, i = self.sentence(last)[1], last + 1
        while i < end and self.low[i] in BETWEEN:
            i += 1
        if not JOINING & set(self.low[last + 1 : i]):
            return None
        fits = [(len(w), name) for name, form in forms if self.low[i : i + len(w := form.split())] == w and i + len(w) <= end]
        return (max(fits)[1], i, i + max(fits)[0] - 1) if fits else None


def scan(text: str) -> list[tuple[str, float, int, int, int, int]]:
    """(identifier, coverage, aligned words, template words, first and last character) of each find."""
    low = text.lower()
    if not any(w in low for w in triggers()):
        return []
    t = Words(text)
    words = t.low
    where: dict[str, list[int]] = {}
    wanted = {w for *_, mine, _ in prepared() for w in mine}
    for i, w in enumerate(words):
        if w in wanted:
            where.setdefault(w, []).append(i)
    known = set(words)
    finds = []
    for name, template, names, mine, one in prepared():
        if not names <= known:
            continue
        size, own = len(template), frozenset(template)
        slack = size // 4 + 1
        # a version counts where the template names it first
        named = {template.index(w) for w in names if w.isdigit()}
        starts = sorted({(p - k, *(t.sentence(p) if one else (0, len(words)))) for w, places in mine.items() for p in where.get(w, ()) for k in places})
        tried = None
        for s, least, most in starts:
            if tried is not None and s - tried[0] < slack and tried[1] == least:
                continue
            tried = s, least
            # a notice that follows itself has no unique words in the wider stretches
            lo, pairs = 0, []
            for left, right in ((slack, 2 * slack), (0, slack), (0, 0)):
                begin = max(least, s - left)
                if len(found := align(template, words[begin : min(most, max(0, s + size + right))])) > len(pairs):
                    lo, pairs = begin, found
                if len(pairs) == size:
                    break
            aligned = {i for i, _ in pairs}
            if len(pairs) < needed(size) or not names <= {template[i] for i in aligned} or not named <= aligned:
                continue
            first, last = lo + pairs[0][1], lo + pairs[-1][1]
            if any(w in TELLING and w not in own for w in t.around(first, last)) or t.denied(first) or one and DENIALS & set(words[first : last + 1]) - own:
                continue
            finds.append((name, len(pairs) / size, len(pairs), size, t.starts[first], t.marks[last].end(), last))
    finds.sort(key=lambda f: (-f[2], -f[1], f[0], f[4]))
    kept: list = []
    for f in finds:
        if all(f[5] <= k[4] or k[5] <= f[4] for k in kept):
            kept.append(f)
    for f in kept:  # grows while it is read: what follows a follower counts as well
        if more := t.joined(f[6], SPDX_MORE if f[0].endswith("-SPDX") else MORE):
            name, first, last = more
            if all(t.marks[last].end() <= k[4] or k[5] <= t.starts[first] for k in kept):
                n = last - first + 1
                kept.append((name, 1.0, n, n, t.starts[first], t.marks[last].end(), last))
    return sorted((f[:6] for f in kept), key=lambda f: f[4])


def license_finds(df: DataFrame) -> DataFrame:
    """One row for each license found in df(doc_id, text); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ["doc_id", "license_id", "coverage", "aligned_words", "template_words", "start", "end", "found_text"]
        for batch in batches:
            rows = [(i, *f, t[f[4] : f[5]]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for f in scan(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, license_id string, coverage double, aligned_words bigint, template_words bigint, start bigint, end bigint, found_text string")
