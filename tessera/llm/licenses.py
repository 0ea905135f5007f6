"""Fuzzy search for short licence notices.

A notice with at most k edits is found by cutting it into k + 1 pieces: k edits
leave at least one piece as it is.  One Aho-Corasick pass looks for the pieces of all
notices; around every hit the regex library's bounded-error matching decides, and gives span and edits.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Apart

#: (licence, notice); compared without regard to case, any run of white space as a space.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Edits allowed: one for each so many characters of a notice, at least one.
CHARS_PER_EDIT = 12


def edits(notice: str, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    return max(1, len(notice) // chars_per_edit)


_BLANKS = re.compile(r"\s+")


def plain(text: str) -> str:
    """Lower case with one space for a run of white space, none at the ends; otherwise every character has its place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    return " ".join(low.split())


def shifts(text: str) -> tuple[list[int], list[int]]:
    """For places in plain(text), where a shift begins, and how far the text's place is ahead from there on."""
    ahead = len(text) - len(text.lstrip())
    begins, out = [0], [ahead]
    for m in _BLANKS.finditer(text, ahead):
        if (n := m.end() - m.start()) > 1:
            begins.append(m.start() + 1 - ahead)
            ahead += n - 1
            out.append(ahead)
    return begins, out


def places(notice: str) -> tuple[int, dict[str, int]]:
    """What reaches() needs of a notice: its length, and for each character a bit wherever it stands."""
    out: dict[str, int] = {}
    for i, c in enumerate(notice):
        out[c] = out.get(c, 0) | 1 << i
    return len(notice), out


def reaches(n: int, at: dict[str, int], k: int, text: str) -> bool:
    """Whether some part of the text is within k edits of the notice: a column of the edit distances in each step, as bits (Myers 1999)."""
    full, high = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    for c in text:
        eq = at.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq
        right, left = down | ~(x | up) & full, up & x
        score += 1 if right & high else -1 if left & high else 0
        if score <= k:
            return True
        right, left = right << 1 & full, left << 1 & full
        up, down = left | ~((eq | down) | right) & full, right & (eq | down)
    return False


class Finder:
    def __init__(self, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        self.notices, self.patterns, self.places, pieces = notices, [], [], {}
        for i, (_, notice) in enumerate(notices):
            s, k = plain(notice), edits(notice, chars_per_edit)
            self.places.append(places(s))
            self.patterns.append((s, k, regex.compile(f"(?b)(?:{regex.escape(s, literal_spaces=True)}){{e<={k}}}")))
            cuts = [round(j * len(s) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(s[a:b], []).append((i, a, b - a))
        self.seeds = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.seeds.add_word(piece, where)
        self.seeds.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) without overlaps: of two that overlap, the one with fewer edits stays, then the longer, then the earlier notice."""
        s = plain(text)
        # one window for each place that a piece puts the notice at; it has room for one occurrence
        windows, hits = set(), set()
        for end, where in self.seeds.iter(s):
            for i, offset, size in where:
                notice, k, _ = self.patterns[i]
                start = end + 1 - size - offset
                if s.startswith(notice, max(0, start)):
                    hits.add((0, -len(notice), i, max(0, start), max(0, start) + len(notice)))
                else:
                    windows.add((i, max(0, start - k), min(len(s), start + len(notice) + k)))
        for i, a, b in windows:
            notice, k, pattern = self.patterns[i]
            if reaches(*self.places[i], k, s[a:b]) and (m := pattern.search(s, a, b)) and m.end() > m.start():
                hits.add((sum(m.fuzzy_counts), m.start() - m.end(), i, m.start(), m.end()))
        if not hits:
            return []
        chosen, (begins, ahead) = Apart(), shifts(text)
        place = lambda x: x + ahead[bisect_right(begins, x) - 1]
        # a span ends behind its last character, not where white space after it ends
        return sorted((place(a), place(b - 1) + 1, i, e) for e, _, i, a, b in sorted(hits) if chosen.add(a, b))


def _scan(notices, chars_per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(notices, chars_per_edit)
        for batch in batches:
            rows, found = [], []
            for r, text in enumerate(batch.column(1)):
                t = text.as_py()
                for a, b, i, e in find(t):
                    rows.append(r)
                    found.append((notices[i][0], i, a, b, e, t[a:b]))
            cols = list(zip(*found)) or [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]],
                names=["doc_id", "license", "notice", "start", "end", "edits", "span"],
            )

    return run


def scan(docs: DataFrame, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(doc_id, license, notice, start, end, edits, span) of every notice found in docs(doc_id, text).

    start and end count characters of the text as it is, end excluded; notice is the number of the notice.  Null and empty texts have none;
    repeated rows give repeated results; null doc_ids stay null.  A text is searched whole, however long; a notice may be wrapped and
    indented, for white space of any length is one space and no edit.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    return texts.mapInArrow(_scan(tuple(notices), chars_per_edit), f"doc_id {kind}, license string, notice int, start int, end int, edits int, span string")
