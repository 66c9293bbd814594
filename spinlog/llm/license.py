"""License scans by patience alignment of a text's words with license templates.

Regions of a text that hold enough of a template's words are aligned with it: words
that occur once in both are anchors, the longest increasing subsequence of their
places is kept, and the gaps between them are aligned in the same way.  Coverage is
the share of the template's words that are aligned.  Each region with coverage of
`least` or more is one finding; a text may hold several licenses, or one several
times.  The words that name a license and its version (NAMES) must all be aligned, side by side: a short sentence of
another license resembles the template in all other words.  Null and empty texts have none.
Regions are found in one pass over the text, their length is bounded by the
template's, so a very long text costs as much as many short ones.  Repeated rows and null ids are scanned row by row;
other columns are not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

# Notices as their licensors word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
}

# Words of a template that must stand side by side in a text; texts of licenses that don't name them have none.
NAMES = {
    "Apache-2.0": ["Apache License Version 2.0"],
    "Apache-2.0-notice": ["Apache License Version 2.0"],
    "MIT": ["MIT License"],
    "GPL-3.0": ["GNU General Public License version 3"],
    "GPL-2.0": ["GNU General Public License version 2"],
    "GPL-notice": ["GNU General Public License", "version 3"],
    "CC-BY-NC-4.0": ["CC BY NC 4.0"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-SA-4.0": ["CC BY SA 4.0"],
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_increasing(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    below: list[int] = []
    for i, place in enumerate(places):
        k = bisect_left(tops, place)
        below.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(place)
            piles.append(i)
        else:
            tops[k], piles[k] = place, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = _once(a, a0, a1), _once(b, b0, b1)
        shared = sorted((at, in_b[w]) for w, at in in_a.items() if w in in_b)
        anchors = [shared[i] for i in longest_increasing([y for _, y in shared])]
        if not anchors:
            continue
        out += anchors
        last_a, last_b = a0, b0
        for x, y in [*anchors, (a1, b1)]:
            todo.append((last_a, x, last_b, y))
            last_a, last_b = x + 1, y + 1
    return sorted(out)


def _once(words: list[str], begin: int, end: int) -> dict[str, int]:
    seen: dict[str, int] = {}
    for i in range(begin, end):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def _place(phrase: list[str], template: list[str]) -> tuple[int, int]:
    """Where the phrase begins in its template, and its length."""
    for i in range(len(template) - len(phrase) + 1):
        if template[i:i + len(phrase)] == phrase:
            return i, len(phrase)
    raise ValueError(f"not in the template: {' '.join(phrase)}")


class Scanner:
    def __init__(self, templates: dict[str, str], least: float, names: dict[str, list[str]] | None = None) -> None:
        self.least = least
        self.templates = {name: words_of(text) for name, text in templates.items()}
        self.named = {name: [_place(words_of(p), self.templates[name]) for p in phrases]
                      for name, phrases in (names or {}).items() if name in self.templates}
        self.uses: dict[str, list[str]] = {}
        for name, words in self.templates.items():
            for w in set(words):
                self.uses.setdefault(w, []).append(name)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, aligned words, first word, one past the last word), by place; overlapping findings keep the
        one with most aligned words, then the highest coverage, then the first name."""
        words = words_of(text or "")
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.uses:
                for name in self.uses[w]:
                    places.setdefault(name, []).append(i)
        found = []
        for name, at in places.items():
            found += self._regions(name, words, np.array(at))
        found.sort(key=lambda f: (-f[2], -f[1], f[0], f[3]))
        kept: list = []  # by place; they don't overlap, so only neighbours can
        for f in found:
            i = bisect_left(kept, f[3], key=lambda k: k[3])
            if (i == 0 or kept[i - 1][4] <= f[3]) and (i == len(kept) or f[4] <= kept[i][3]):
                insort(kept, f, key=lambda k: k[3])
        return kept

    def _is_named(self, name: str, pairs: list[tuple[int, int]]) -> bool:
        """Every phrase of the name is aligned without a gap."""
        at = {b: a for a, b in pairs}
        return all(all(p + i in at and at[p + i] == at[p] + i for i in range(n)) for p, n in self.named.get(name, ()) if n)

    def _regions(self, name: str, words: list[str], at: np.ndarray) -> list:
        template = self.templates[name]
        need = int(np.ceil(self.least * len(template)))
        span = len(template) + max(3, len(template) // 2)  # room for words put in
        out, begin = [], 0
        dense = np.searchsorted(at, at + span) - np.arange(len(at)) >= need
        for k in np.flatnonzero(dense).tolist():
            if at[k] < begin:
                continue
            first = int(at[k])
            pairs = align(words[first:first + span], template)
            if len(pairs) >= need:  # words that merely resemble a beginning may come first: the best start nearby counts
                last = int(np.searchsorted(at, first + span))
                tried = [(int(at[j]), align(words[int(at[j]):int(at[j]) + span], template)) for j in range(k, last) if dense[j]]
                tried = [t for t in tried if len(t[1]) >= need and self._is_named(name, t[1])]
                if not tried:  # of another license or version; all starts up to here were looked at
                    begin = first + span
                    continue
                first, pairs = max(tried, key=lambda t: (len(t[1]), -t[0]))
                stop = first + pairs[-1][0] + 1
                out.append((name, len(pairs) / len(template), len(pairs), first + pairs[0][0], stop))
                begin = stop
        return out


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST,
         names: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, license, coverage, n_aligned, first_word, end_word: one row per finding.

    `names` are NAMES for the templates of this module, and none for others unless given.
    """
    names = NAMES if names is None and templates is TEMPLATES else names

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, least, names)
        for frame in batches:
            rows = [(doc_id, *f) for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"], strict=True)
                    for f in scanner.scan(text)]
            out = pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "n_aligned", "first_word", "end_word"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        scanned, "doc_id long, license string, coverage double, n_aligned int, first_word long, end_word long")
