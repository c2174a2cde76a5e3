"""License scans by patience alignment.

A text is read as lower-case words (ASCII letters and digits, and all other characters but
ASCII marks and white space). Windows to align are proposed by seeds: runs of three words that
text and template share. Seeds of one copy lie on near diagonals (place in the text less place in the template), so the fullest band of diagonals
is taken first, its longest increasing chain of seeds gives a window, and what the find covers is
left out of the next one. A copy that keeps `least` of a template's words keeps a run of three in a
row unless words are put between nearly all of them. For a template below `SHORT` words every place of
its rarest deciding word is looked at instead.

In a window, words that occur once in both are anchors; the longest increasing run of their
places is kept, and the gaps between anchors are aligned in the same way, after equal words at
their ends. Stray pairs at the ends are let go: a find is the stretch with most aligned words,
with some taken off for unmatched words of the text between them, and of density `dense` at least. Windows
with too few of the template's words, or without its deciding ones, aren't aligned at all.

Coverage is the share of the template's words that are aligned. The words that tell a license
from others must be among them. Each template's finds don't overlap; of finds of two licenses over
the same words the one with more words aligned, less unmatched ones on both sides, is meant, as
a BSD-3-Clause text holds all of BSD-2-Clause; only finds that are meant themselves push others out.

Defined results: null and empty texts, and texts without a license, have no licenses and
coverage 0; texts of any length are scanned whole, also where a notice stands at their end; equal coverages are decided by the template's name; repeated rows are scanned
once each; an empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_texts import TEXTS

#: Least coverage, and least share of aligned words within the part of the text that they span.
LEAST, DENSE = 0.8, 0.6
#: What an unmatched word of the text between aligned ones takes off a stretch of them.
COST = 0.45
#: Words of public license notices. A name is a license, and after a blank the form of its notice.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Released under the BSD License",
    "BSD opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-4.0 short": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-NC-ND-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC-BY-ND-4.0 notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 whole notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-3.0 notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License",
    "MIT notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Reserved": "All rights reserved. No part of this publication may be reproduced without permission",
}
#: Words that decide for a license, by its name's first part or by the whole name: no find without them aligned.
DECIDING = {
    "AGPL-3.0": "affero 3", "Apache-2.0": "apache 2", "Apache-2.0 text": "apache 2 grant", "BSD": "bsd", "BSD opening": "redistribution", "BSD-2-Clause": "redistributions disclaimer", "BSD-3-Clause": "redistributions neither endorse",
    "CC-BY-4.0": "attribution 4", "CC-BY-4.0 short": "cc by 4", "CC-BY-NC-4.0": "nc 4", "CC-BY-NC-4.0 notice": "noncommercial 4", "CC-BY-NC-ND-4.0": "nc nd 4", "CC-BY-NC-ND-4.0 notice": "noncommercial noderivatives 4",
    "CC-BY-NC-SA-4.0": "nc sa 4", "CC-BY-NC-SA-4.0 notice": "noncommercial sharealike 4", "CC-BY-ND-4.0": "nd 4", "CC-BY-ND-4.0 notice": "noderivatives 4", "CC-BY-SA-4.0": "sa 4", "CC-BY-SA-4.0 notice": "sharealike 4",
    "GPL-2.0": "gnu general 2", "GPL-2.0 text": "gnu general 2 1991", "GPL-3.0": "gnu general 3", "GPL-3.0 text": "gnu general 3 june", "LGPL-2.1": "lesser 2 1", "LGPL-3.0": "lesser 3",
    "MIT": "mit", "MIT notice": "permission granted", "MIT text": "permission sublicense", "MPL-2.0": "mozilla 2", "Reserved": "reserved reproduced",
}
#: Templates of fewer words than SHORT have no seeds; seeds are RUN words in a row, which a template has no more often than REPEATS times.
SHORT, RUN, REPEATS = 10, 3, 8
NEAR = 256
#: A window needs a seed for every so many words of the template, one at least.
WORDS_PER_SEED = 20
_MARKS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_MARKS).split()


def _increasing(places: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by piles."""
    ends, tails, before = [], [], []
    for i, x in enumerate(places):
        at = bisect_left(ends, x)
        before.append(tails[at - 1] if at else -1)
        if at == len(ends):
            ends.append(x)
            tails.append(i)
        else:
            ends[at], tails[at] = x, i
    kept, i = [], tails[-1] if tails else -1
    while i >= 0:
        kept.append(i)
        i = before[i]
    return kept[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs of places with equal words, increasing on both sides."""
    pairs, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, a_end, b, b_end = gaps.pop()
        while a < a_end and b < b_end and text[a] == template[b]:
            pairs.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and text[a_end - 1] == template[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            pairs.append((a_end, b_end))
        if a >= a_end or b >= b_end:
            continue
        here, there = Counter(text[a:a_end]), Counter(template[b:b_end])
        place = {text[i]: i for i in range(a, a_end)}
        anchors = [(place[w], j) for j in range(b, b_end) if there[w := template[j]] == 1 and here.get(w) == 1]
        kept = [anchors[k] for k in _increasing([x for x, _ in anchors])]
        if kept:
            pairs += kept
            for (x, j), (x_next, j_next) in zip([(a - 1, b - 1), *kept], [*kept, (a_end, b_end)], strict=True):
                gaps.append((x + 1, x_next, j + 1, j_next))
    return sorted(pairs)


def dense_stretch(pairs: list[tuple[int, int]], dense: float, cost: float = COST) -> list[tuple[int, int]]:
    """The stretch of pairs with the highest worth: 1 for each, less `cost` for each unmatched word of the text between them.

    If that isn't dense enough, the stretch at the cost at which every one is.
    """
    best, worth, first, chosen = 0.0, 0.0, 0, (0, 0)
    for k, (place, _) in enumerate(pairs):
        gap = place - pairs[k - 1][0] - 1 if k else 0
        worth -= gap * cost
        if worth <= 0:
            worth, first = 0.0, k
        worth += 1
        if worth > best:
            best, chosen = worth, (first, k + 1)
    kept, sure = pairs[chosen[0] : chosen[1]], dense / (1 - dense)
    if kept and len(kept) < dense * (kept[-1][0] - kept[0][0] + 1) and cost < sure:
        return dense_stretch(pairs, dense, sure)
    return kept


class Templates:
    """Templates as word ids, and a sorted list of their seeds by size."""

    def __init__(self, words: dict[str, list[bytes]], deciding: dict[str, set[bytes]] | None = None) -> None:
        self.names, self.words = list(words), list(words.values())
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in self.words for w in t}))}
        self.ids = [np.array([self.vocabulary[w] for w in t], np.int64) for t in self.words]
        self.gates = [frozenset((deciding or {}).get(name, ())) for name in self.names]
        self.must = [{self.vocabulary.get(w, -1) for w in (deciding or {}).get(name, ())} for name in self.names]
        self.member = np.zeros((len(self.words), len(self.vocabulary) + 1), bool)
        seeds = []
        for t, ids in enumerate(self.ids):
            self.member[t, ids] = True
            if len(ids) >= SHORT:
                grams = self.grams(ids, RUN)
                often = Counter(grams.tolist())
                seeds += [(g, t, j) for j, g in enumerate(grams.tolist()) if often[g] <= REPEATS]
        self.seeds = np.array(sorted(seeds), np.int64).reshape(-1, 3)
        self.short = [t for t, ids in enumerate(self.ids) if 0 < len(ids) < SHORT]

    def grams(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of words; -1 where a word is none of the templates'."""
        n, width = len(ids) - size + 1, len(self.vocabulary) + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(size):
            out = out * width + ids[k : k + n]
            known &= ids[k : k + n] >= 0
        return np.where(known, out, -1)

    def matches(self, ids: np.ndarray) -> np.ndarray:
        """Rows (template, place in the text, place in the template) of all seeds in a text, in this order."""
        grams = self.grams(ids, RUN)
        low, high = np.searchsorted(self.seeds[:, 0], grams), np.searchsorted(self.seeds[:, 0], grams, "right")
        at = np.flatnonzero(high > low)
        if not len(at):
            return np.zeros((0, 3), np.int64)
        rows = common.ranges(low[at], high[at] - low[at])
        found = np.c_[self.seeds[rows, 1], np.repeat(at, high[at] - low[at]), self.seeds[rows, 2]]
        return found[np.lexsort((-found[:, 2], found[:, 1], found[:, 0]))]


def _alignments(words: list, template: list, same: list[int], spot: int):
    """(first word of a window, pairs) for the windows around a spot; same: all places of the spot's word in the text.

    The first window is wide. A notice that repeats has every word several times there, so the spot is also held against
    each template place of its word, and both sides are aligned apart from it: in windows of the template's length and
    some slack, and in windows that end where the spot's word comes once more than the template has it.
    """
    size = len(template)
    first = max(0, spot - 2 * size)
    yield first, align(words[first : spot + 2 * size], template)
    at, slack = bisect_left(same, spot), max(2, size // 8)
    own = [j for j, w in enumerate(template) if w == words[spot]]
    for k, j in enumerate(own):
        before, after = at - k - 1, at + len(own) - k
        cuts = same[before] + 1 if before >= 0 else 0, same[after] if after < len(same) else len(words)
        for low, high in {(spot - j - slack, spot - j + size + slack), (max(cuts[0], spot - 2 * size), min(cuts[1], spot + 2 * size))}:
            low = max(0, low)
            left, right = align(words[low:spot], template[:j]), align(words[spot + 1 : high], template[j + 1 :])
            yield low, [*left, (spot - low, j), *((x + spot + 1 - low, y + j + 1) for x, y in right)]


def _short_finds(words: list[int], template: list[int], must: set[int], places: dict[int, list[int]], least: float, dense: float) -> list[tuple[int, int, int]]:
    """(aligned words, start, end) of finds of a short template: every place of a word that any find has aligned is looked at."""
    there = {w: len(places.get(w, ())) for w in must or set(template)}
    if must:
        if not all(there.values()):
            return []
        spots = places[min(must, key=lambda w: (there[w], w))]
    else:  # as many of the rarest words as may be missing, and one more
        allowed, spots, missing = int(len(template) - least * len(template) + 1e-9), set(), 0
        for w in sorted(there, key=lambda w: (there[w], w)):
            if missing > allowed:
                break
            spots.update(places.get(w, ()))
            missing += template.count(w)
        spots = sorted(spots)
    finds, seen_to = set(), -1
    for spot in spots:
        if spot < seen_to:
            continue
        for first, pairs in _alignments(words, template, places[words[spot]], spot):
            pairs = dense_stretch(pairs, dense)
            if pairs and len(pairs) >= least * len(template) and must <= {template[b] for _, b in pairs}:
                start, end = first + pairs[0][0], first + pairs[-1][0] + 1
                finds.add((len(pairs), start, end))
                if len(pairs) == len(template) and start <= spot:
                    seen_to = max(seen_to, end)
    kept, taken = [], []
    for n, start, end in sorted(finds, key=lambda f: (-f[0], f[1], f[2])):
        at = bisect_left(taken, (start, end))
        if (not at or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
            kept.append((n, start, end))
            taken.insert(at, (start, end))
    return kept


def _best_alignment(ids: np.ndarray, template: list[int], i: np.ndarray, j: np.ndarray, start: int, end: int, slack: int, dense: float) -> list[tuple[int, int]]:
    """The best of three alignments of a window: as it is, without the slack at its ends, and with the chain's runs of words held fast and the gaps aligned."""
    text = ids[start:end].tolist()

    def whole(a: int, b: int) -> list[tuple[int, int]]:
        return [(x + a, y) for x, y in align(text[a:b], template)]

    def held() -> list[tuple[int, int]]:
        pairs, a, b = [], 0, 0
        for x, y in zip((i - start).tolist(), j.tolist(), strict=True):
            for k in range(RUN):
                if x + k >= a and y + k >= b and x + k < len(text):
                    pairs += [(p + a, q + b) for p, q in align(text[a : x + k], template[b : y + k])]
                    pairs.append((x + k, y + k))
                    a, b = x + k + 1, y + k + 1
        return pairs + [(p + a, q + b) for p, q in align(text[a:], template[b:])]

    best: list[tuple[int, int]] = []
    for aligned in (lambda: whole(0, len(text)), lambda: whole(max(0, int(i[0] - j[0]) - start), min(len(text), int(i[-1] - j[-1]) + len(template) - start)), held):
        best = max(best, dense_stretch(aligned(), dense), key=len)
        if len(best) == len(template):
            break
    return [(x + start, y) for x, y in best]


def _finds(ids: np.ndarray, template: np.ndarray, must: set[int], member: np.ndarray, i: np.ndarray, j: np.ndarray, least: float, dense: float) -> list[tuple[int, int, int]]:
    """(aligned words, start, end) of all finds of one template, which don't overlap. i, j: its seeds."""
    size, found, taken = len(template), [], []
    need, slack = max(1, size // WORDS_PER_SEED), max(2, size // 8)
    if not len(i) or np.count_nonzero(np.bincount(j)) < need:
        return found
    count = np.concatenate([[0], np.cumsum(member[ids])])
    places = {w: np.flatnonzero(ids == w) for w in must}
    if not all(map(len, places.values())):
        return found
    band = max(2, int(size * (1 / dense - least)))  # of diagonals: words put in, and words left out
    order = np.argsort(i - j, kind="stable")
    ranked = (i - j)[order]
    pace = max(1, band // 16)
    tops = np.flatnonzero(np.diff(ranked // pace, prepend=ranked[0] // pace - 1))  # where bands begin
    ends = np.searchsorted(ranked, ranked[tops] + band + pace - 1, "right")
    left = np.ones(len(i), bool)
    heap = [(top - end, top, end) for top, end in zip(tops.tolist(), ends.tolist(), strict=True) if end - top >= need]
    heapify(heap)
    while heap:  # the fullest band comes first; seeds only go, so a count that still holds is the largest
        count_then, top, end_top = heappop(heap)
        within = order[top:end_top]
        within = within[left[within]]
        if len(within) < need:
            continue
        if len(within) < -count_then:
            heappush(heap, (-len(within), top, end_top))
            continue
        done = within[(i - j)[within] <= ranked[top] + band // 2]
        if np.count_nonzero(np.bincount(j[within])) < need:  # too few places of the template for a chain
            left[done] = False
            continue
        within.sort()
        chain = within[_increasing(j[within].tolist())]
        start, end = max(0, int(i[chain[0]] - j[chain[0]]) - slack), min(len(ids), int(i[chain[-1]] + size - j[chain[-1]]) + slack)
        at = bisect_left(taken, (int(i[chain[0]]), 0))  # what a find covers is taken
        if at:
            start = max(start, taken[at - 1][1])
        if at < len(taken):
            end = min(end, taken[at][0])
        if len(chain) >= need and start < end and count[end] - count[start] >= least * size and all(np.searchsorted(p, start) < np.searchsorted(p, end) for p in places.values()):
            pairs = _best_alignment(ids, template.tolist(), i[chain], j[chain], start, end, slack, dense)
            if len(pairs) >= least * size and must <= {int(template[b]) for _, b in pairs}:
                first, last = pairs[0][0], pairs[-1][0] + 1
                found.append((len(pairs), first, last))
                insort(taken, (first, last))
                left[np.searchsorted(i, first) : np.searchsorted(i, last)] = False
                left[chain] = False
        # what is left of a band without a find: its lower half is done, the upper is in later bands too
        left[done] = False
    return found


def find(words: list[bytes], templates: dict[str, list[bytes]] | Templates, least: float = LEAST, dense: float = DENSE, deciding: dict[str, set[bytes]] | None = None) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, end) of each template that is found, at its best place.

    A find needs the template's deciding words aligned. It gives way to a find of another license that is worth more, covers half of it,
    and is meant itself.
    """
    known = templates if isinstance(templates, Templates) else Templates(templates, deciding)
    present = set(words)
    if not any(gate <= present for gate in known.gates):  # no template's deciding words are all there
        return []
    get = known.vocabulary.get
    ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    rows, there = known.matches(ids), set(ids.tolist())
    found = []
    if len(rows):
        cuts = np.flatnonzero(np.diff(rows[:, 0], prepend=-1, append=len(known.words)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            t = int(rows[a, 0])
            if known.must[t] <= there - {-1}:
                found += [(n, start, end, known.names[t], t) for n, start, end in _finds(ids, known.ids[t], known.must[t], known.member[t], rows[a:b, 1], rows[a:b, 2], least, dense)]
    places: dict[int, list[int]] = {}
    for t in known.short:
        if known.must[t] and not known.must[t] <= there:
            continue
        if not places:
            for k, w in enumerate(listed := ids.tolist()):
                places.setdefault(w, []).append(k)
        found += [(n, start, end, known.names[t], t) for n, start, end in _short_finds(listed, known.ids[t].tolist(), known.must[t], places, least, dense)]
    own = lambda name: name.split(" ")[0]
    worth = lambda n, start, end, _, t: 3 * n - (end - start) - len(known.words[t])  # noqa: E731  aligned words less unmatched ones on both sides
    meant: list[tuple] = []
    over: dict[int, list[tuple]] = {}  # finds that are meant, by the stretches of NEAR words they touch
    for x in sorted(found, key=lambda x: (-worth(*x), x[3], x[1])):
        _, start, end, name, _ = x
        stretches = range(start // NEAR, (end - 1) // NEAR + 1)
        if not any(worth(*y) > worth(*x) and own(y[3]) != own(name) and 2 * (min(end, y[2]) - max(start, y[1])) > end - start for k in stretches for y in over.get(k, ())):
            meant.append(x)
            for k in stretches:
                over.setdefault(k, []).append(x)
    best: dict[str, tuple] = {}
    for n, start, end, name, t in meant:
        best[name] = max(best.get(name, (0, 0, 0, 0)), (n, -start, end, t))
    return sorted(((name, n / len(known.words[t]), -start, end) for name, (n, start, end, t) in best.items()), key=lambda x: (-x[1], x[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = {**TEMPLATES, **TEXTS}, least: float = LEAST, dense: float = DENSE, deciding: dict[str, str] = DECIDING) -> DataFrame:
    """For each row: doc_id, licenses (by falling coverage), license (the first, or null), coverage, first_word, end_word."""
    words = {name: words_of(text) for name, text in sorted(templates.items())}
    must = {name: set(words_of(deciding.get(name, deciding.get(name.split(" ")[0], "")))) for name in words}

    known = Templates(words, must)

    def run(batches):
        import pyarrow as pa

        for chunk in common.chunks(batches, "text"):
            found = [find(words_of(t), known, least, dense) for t in chunk["text"].to_pylist()]
            top = [f[0] if f else (None, 0.0, None, None) for f in found]
            yield pa.record_batch({"doc_id": chunk["doc_id"], "licenses": pa.array([[x[0] for x in f] for f in found], pa.list_(pa.string())), "license": pa.array([t[0] for t in top], pa.string()), "coverage": pa.array([t[1] for t in top], pa.float64()), "first_word": pa.array([t[2] for t in top], pa.int64()), "end_word": pa.array([t[3] for t in top], pa.int64())})

    picked = common.take(docs, doc_id=id_col, text=text_col)
    return picked.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, licenses array<string>, license string, coverage double, first_word long, end_word long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.concat_ws(",", "licenses"))
