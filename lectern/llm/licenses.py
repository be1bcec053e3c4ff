"""License scans: winnowed fingerprints of templates in an inverted index, banded alignment of candidates.

Templates and texts are sequences of lower-cased words (runs of letters, digits
and underscores). A text that holds all but m of a template's n words holds one of
any m + 1 of them. Winnowing takes the rarest word of each window of n / (m + 1)
words, which gives at least m + 1 fingerprints; the rarest m + 1 of them are the
template's postings in the index, and only texts with a posting are looked at.
Where a stretch of a text shares enough words with a template, the two are
aligned within a band about the diagonals of the shared fingerprints. The band is
widened until nothing outside it can score as much. So no step loses an alignment
of enough words; the best one gives the share of words that match and the span.
"""

import bisect
import heapq
import math
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import _text

#: Templates have so many words at least; a band reaches so many places beyond the fingerprints' diagonals at first.
LEAST_WORDS, BAND = 3, 8
#: Notices as they stand in files and pages, by SPDX name where there is one; any other set can be given.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}
#: Licenses by SPDX name, as notices call them.
CALLED = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License 2.0", "Apache 2.0 License", "Apache License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "BSD": ["BSD License"],
    "ISC": ["ISC License"],
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License"],
    "PSF-2.0": ["Python Software Foundation License", "PSF License"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"],
    "Artistic-1.0": ["Artistic License", "Artistic License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    **{f"{a}GPL-{v}": [f"GNU {b}General Public License, version {v.removesuffix('.0')}", f"GNU {b}General Public License v{v}", f"GNU {b}General Public License v{v.removesuffix('.0')}", f"GNU {b}GPL version {v.removesuffix('.0')}", f"{a}GPL v{v.removesuffix('.0')}", f"{a}GPLv{v.removesuffix('.0')}", f"{a}GPL-{v}", f"GNU {b}General Public License, version {v.removesuffix('.0')} or later"] for a, b, versions in (("", "", ("1.0", "2.0", "3.0")), ("L", "Lesser ", ("2.1", "3.0")), ("A", "Affero ", ("3.0",))) for v in versions},
    "GPL": ["GNU General Public License", "GPL"],
    "LGPL": ["GNU Lesser General Public License", "LGPL"],
    "AGPL": ["GNU Affero General Public License", "AGPL"],
    "LGPL-2.0": ["GNU Library General Public License, version 2"],
    "GFDL-1.2": ["GNU Free Documentation License, Version 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3"],
    **{f"MPL-{v}": [f"Mozilla Public License, version {v}", f"Mozilla Public License {v}", f"MPL {v}"] for v in ("1.1", "2.0")},
    **{f"EPL-{v}": [f"Eclipse Public License, version {v}", f"Eclipse Public License {v}", f"EPL {v}"] for v in ("1.0", "2.0")},
    "EUPL-1.2": ["European Union Public License 1.2", "EUPL 1.2"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "CDDL 1.0"],
    "ODbL-1.0": ["Open Database License", "Open Data Commons Open Database License"],
    "CC0-1.0": ["CC0 1.0", "CC0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License"],
    **{f"CC-{k}-{v}": [f"CC {k} {v}", f"Creative Commons {name} {v} {port} License", f"Creative Commons {name} {v} License"] for k, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v, port in (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))},
}
FORMS = ("Released under the {}", "Licensed under the {}", "Licensed under {}", "Distributed under the {}", "Available under the {}", "This work is licensed under a {}", "This work is licensed under the {}", "This project is licensed under the {}", "This software is licensed under the {}")
_GNU = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{version}"
#: The usual headers of source files.
HEADERS = {
    **{f"{x}{'-or-later' if later else '-only'}-header": _GNU.format(what=what, mark=":" if v in ("3", "2.1") else ";", name=name, version=f"; either version {v} of the License, or (at your option) any later version." if later else f", version {v} of the License.") for x, what, name, v in (("GPL-1.0", "program", "General Public License", "1"), ("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"), ("LGPL-2.0", "library", "Library General Public License", "2"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3")) for later in (True, False) if (x, later) != ("GPL-3.0", True)},
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSL-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSD-header": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT-header": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
}
#: Words of any text; a template's other words are its first keys.
COMMON = frozenset("a all also an and any are as at be by can do each either for from has have if in into is it its may must no not of on one only or other out shall so such that the their then there these they this to under up use used was when where which who will with within you your".split())
#: The templates travel to every task.
MOST_TEMPLATE_BYTES = 8 << 20
#: An aligned stretch is up to six times as long; its places and scores share 64 bits.
MOST_TEMPLATE_WORDS = (1 << 20) // 6


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, bounds) of the words of a batch of texts."""
    start, end, bounds = _text.spans_of(_text.is_word(data), offsets)
    return _text.span_hashes(data, start, end), start, end, bounds


def winnow(order: np.ndarray, window: int) -> np.ndarray:
    """The places of the smallest value of each window, the last of equal ones; of a shorter sequence, of it all."""
    if not len(order):
        return np.zeros(0, np.int64)
    n = min(window, len(order))
    views = np.lib.stride_tricks.sliding_window_view(order, n)
    return np.unique(np.arange(len(views)) + n - 1 - views[:, ::-1].argmin(axis=1))


def known() -> dict[str, str]:
    """TEMPLATES, HEADERS, a notice of each form for each name of CALLED, and the whole texts of license_texts by their SPDX names; those of no more than LEAST_WORDS words and repeated ones are left out."""
    out = TEMPLATES | HEADERS
    size = lambda t: len(re.findall(r"\w+", t))
    seen = {" ".join(re.findall(r"\w+", t.lower())) for t in out.values()}
    for spdx, names in CALLED.items():
        for k, line in enumerate(form.format(name) for name in names for form in FORMS):
            key = " ".join(re.findall(r"\w+", line.lower()))
            if size(line) > LEAST_WORDS and key not in seen:
                seen.add(key)
                out[f"{spdx}-notice-{k}"] = line
    return out | {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


class Index:
    """The templates' words, how many of them a hit needs, and the postings of their fingerprints."""

    def __init__(self, templates: dict[str, str], least: float = 0.75) -> None:
        if sum(len(t.encode()) for t in templates.values()) > MOST_TEMPLATE_BYTES:
            raise ValueError("the templates are too large to send to every task")
        self.names, self.words, spelled = list(templates), [], []
        for name, text in templates.items():
            raw = np.frombuffer(text.encode(), np.uint8)
            hashes, start, end, _ = words(raw, np.array([0, len(raw)]))
            if len(hashes) < LEAST_WORDS:
                raise ValueError(f"template {name} has fewer than {LEAST_WORDS} words")
            if len(hashes) > MOST_TEMPLATE_WORDS:
                raise ValueError(f"template {name} has more than {MOST_TEMPLATE_WORDS} words")
            self.words.append(hashes)
            spelled.append({int(h): raw[s:e].tobytes().decode().lower() for h, s, e in zip(hashes, start, end, strict=True)})
        self.lengths = [len(w) for w in self.words]
        self.need = np.array([max(1, math.ceil(least * n - 1e-9)) for n in self.lengths])
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.bags = [(np.searchsorted(self.vocabulary, w), n) for w, n in self.bags]
        self.flat = np.concatenate([w for w, _ in self.bags]), np.concatenate([n for _, n in self.bags]), np.cumsum([0, *(len(w) for w, _ in self.bags[:-1])])
        within = np.bincount(np.concatenate([w for w, _ in self.bags]), minlength=len(self.vocabulary))
        postings, self.seeds = [], []
        for t, hashes in enumerate(self.words):
            ids, places = np.unique(np.searchsorted(self.vocabulary, hashes), return_inverse=True)
            names = [spelled[t][int(self.vocabulary[i])] for i in ids]
            order = sorted(range(len(ids)), key=lambda k: (names[k] in COMMON or names[k].isdigit(), within[ids[k]] / len(self.names) > 0.5, -len(names[k]), names[k]))
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            spare = self.lengths[t] - int(self.need[t])
            prints = winnow(rank[places], self.lengths[t] // (spare + 1))
            word, found = np.unique(places[prints], return_counts=True)
            by_rank = np.argsort(rank[word])
            word = word[by_rank][: np.searchsorted(np.cumsum(found[by_rank]), spare + 1) + 1]
            word.sort()
            at = [np.flatnonzero(places == w) for w in word]
            self.seeds.append((ids[word], np.array([x[0] for x in at]), np.array([x[-1] for x in at])))
            postings += [(int(i), t) for i in ids[word]]
        self.posted = np.array(sorted(postings), np.int64).reshape(-1, 2)
        self.posted_at = np.searchsorted(self.posted[:, 0], np.arange(len(self.vocabulary) + 1))
        self.key = np.diff(self.posted_at) > 0

    def candidates(self, counts: np.ndarray) -> np.ndarray:
        """The templates with a posting under one of the words counted that share enough words with them."""
        held = np.flatnonzero((counts > 0) & self.key)
        some = np.unique(np.concatenate([self.posted[self.posted_at[i] : self.posted_at[i + 1], 1] for i in held])) if len(held) else np.zeros(0, np.int64)
        n = np.array([self.shared(t, counts) for t in some], np.int64) if len(some) < 64 else self.all_shared(counts)[some]
        return some[n >= self.need[some]]

    def diagonals(self, t: int, ids: np.ndarray) -> tuple[int, int] | None:
        """The least and the greatest text place less template place of template t's fingerprints in the text's words."""
        word, first, last = self.seeds[t]
        k = np.minimum(np.searchsorted(word, ids), len(word) - 1)
        at = np.flatnonzero(word[k] == ids)
        return (int((at - last[k[at]]).min()), int((at - first[k[at]]).max())) if len(at) else None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return np.bincount(ids[ids >= 0], minlength=len(self.vocabulary))

    def all_shared(self, counts: np.ndarray) -> np.ndarray:
        """How many of each template's words are among those counted."""
        ids, n, first = self.flat
        return np.add.reduceat(np.minimum(counts[ids], n), first)

    def shared(self, t: int, counts: np.ndarray) -> int:
        """How many of template t's words are among those counted, each as often as it is in both."""
        mine, n = self.bags[t]
        return int(np.minimum(counts[mine], n).sum())


def align(template: np.ndarray, text: np.ndarray, diagonals: tuple[int, int] | None = None, band: int = BAND, need: int = 0) -> tuple[int, int, int, int]:
    """(matched words, first, last + 1 of them in the text, score): the best local alignment, of those of `need` matches or more.

    A match scores 2, a mismatch and a gap -1 each; of equal scores the one of more
    matches, then of the later start, then of the earlier end. With diagonals, row i
    holds the text places from i plus the least of them to i plus the greatest, and
    `band` more on both sides.
    """
    n, places = len(text), np.arange(len(text), dtype=np.int64)
    one, match, low = np.int64(1 << 42), np.int64(1 << 21), np.int64((1 << 21) - 1)
    if n > 6 * MOST_TEMPLATE_WORDS or len(template) > MOST_TEMPLATE_WORDS:
        raise ValueError("too long to align")
    row, best, end = np.zeros(n + 1, np.int64), 0, 0  # a cell is its score, its matches and its first place, from the highest bits on; 0 is nothing
    for i, w in enumerate(template.tolist()):
        a, b = (0, n) if diagonals is None else (max(0, i + diagonals[0] - band), min(n, i + diagonals[1] + band + 1))
        if a >= b:
            continue
        same, before, at = text[a:b] == np.uint64(w), row[a:b], places[a:b]
        hit = before + np.where(same, 2 * one + match, -one)
        hit += np.where((before == 0) & same, at, 0)
        cell = np.maximum(hit, row[a + 1 : b + 1] - one)
        cell[cell < one] = 0
        cell = np.maximum.accumulate(cell + at * one) - at * one  # gaps in the template
        cell[cell < one] = 0
        good = np.where((cell >> np.int64(21)) & low >= need, cell, 0) if need else cell
        if good.max() > best:
            k = int(good.argmax())
            best, end = int(good[k]), a + k + 1
        row[a + 1 : b + 1] = cell
    return ((best >> 21) & int(low), best & int(low), end, best >> 42) if best else (0, -1, -1, 0)


def _aligned(index: Index, t: int, hashes: np.ndarray, ids: np.ndarray) -> tuple[int, int, int, int]:
    """align() of template t, which takes in a fingerprint of it, within a band that is wide enough.

    What leaves the band has so many gaps, which its score lacks.
    """
    template, shared = index.words[t], index.shared(t, index.counts(ids))
    ends, band = index.diagonals(t, ids), BAND
    if shared < index.need[t] or ends is None:
        return 0, -1, -1, 0
    while True:
        found = align(template, hashes, ends, band, index.need[t])
        if found[3] > 2 * shared - band - 1 or band > 2 * shared:
            return found
        band *= 4


def _places(index: Index, t: int, hashes: np.ndarray, ids: np.ndarray, gaps: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, float]]:
    """(template, first word, last word + 1, coverage) of template t's hits within these runs of words, which do not overlap.

    An alignment's score is above 0, so it spans at most three times as many words as the template has.
    """
    template, need = index.words[t], index.need[t]
    reach, member = 3 * len(template), np.zeros(len(index.vocabulary) + 1, bool)
    member[index.bags[t][0]] = True
    mine = np.flatnonzero(member[ids])
    starts = mine[: len(mine) - need + 1]
    starts = starts[mine[need - 1 :] - starts < reach]
    todo = gaps
    while todo:
        low, high = todo.pop()
        k = np.searchsorted(starts, low)
        if k == len(starts) or starts[k] > high - need:
            continue
        low = int(starts[k])
        stop = min(high, low + 2 * reach)
        n, first, last, _ = _aligned(index, t, hashes[low:stop], ids[low:stop])
        if not n:
            if stop < high:
                todo.append((low + reach, high))
        elif first >= reach and stop < high:  # it may go on behind the stretch
            todo += [(low + first, high), (low, low + first)]
        else:
            yield t, low + first, low + last, n / len(template)
            todo += [(low + last, high), (low, low + first)]


def _hits(index: Index, hashes: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(template, first word, last word + 1, coverage) in one text's words: of overlapping ones the best.

    Templates are searched for from the highest bound of matched less missing words
    on, and only between the places that no later one can better.
    """
    best: list[tuple[int, int, int, float]] = []  # do not overlap, in the text's order
    counts = index.counts(ids)
    todo = [(index.lengths[t] - 2 * index.shared(t, counts), -2.0, 0, t, None) for t in index.candidates(counts).tolist()]
    heapq.heapify(todo)
    while todo:
        *_, t, h = heapq.heappop(todo)
        if h is None:
            if best and index.shared(t, counts) < index.need[t]:
                continue
            gaps = list(zip([0, *(k[2] for k in best)], [*(k[1] for k in best), len(ids)], strict=True))
            for h in _places(index, t, hashes, ids, gaps):
                heapq.heappush(todo, (index.lengths[t] - 2 * round(h[3] * index.lengths[t]), -h[3], h[1], t, h))
        else:
            at = bisect.bisect(best, h[1], key=lambda k: k[1])
            if (not at or best[at - 1][2] <= h[1]) and (at == len(best) or h[2] <= best[at][1]):
                best.insert(at, h)
                counts = counts - index.counts(ids[h[1] : h[2]])
    return best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.75) -> DataFrame:
    """(id, license, coverage, start, end, matched): a row for each place where a text holds at least that share of a template's words.

    Of overlapping places the one stands with the most matched words less those
    missing, then of the best coverage; templates are those of known() unless given.
    start and end are code points, end exclusive. Null and empty texts give no rows;
    repeated rows and null ids each give their own. One narrow pass; the templates,
    at most MOST_TEMPLATE_BYTES, are broadcast.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(known() if templates is None else templates, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = index.value
        for batch in batches:
            rows, out = [], []
            for first, last, data, offsets in _text.slices(batch.column(1)):
                hashes, start, end, bounds = words(data, offsets)
                ids = of.find(hashes)
                near = np.concatenate([[0], np.cumsum((ids >= 0) & of.key[ids])])
                for i in np.flatnonzero(near[bounds[1:]] > near[bounds[:-1]]).tolist():
                    a, b = bounds[i], bounds[i + 1]
                    for t, p, q, coverage in _hits(of, hashes[a:b], ids[a:b]):
                        base, s, e = offsets[i], start[a + p], end[a + q - 1]
                        at = len(data[base:s].tobytes().decode())
                        rows.append(first + i)
                        out.append((of.names[t], coverage, at, at + len(data[s:e].tobytes().decode()), round(coverage * len(of.words[t]))))
            names, *numbers = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(numbers[0], pa.float64()), *(pa.array(x, pa.int64()) for x in numbers[1:])], ["id", "license", "coverage", "start", "end", "matched"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, license string, coverage double, start bigint, `end` bigint, matched bigint").withColumnRenamed("id", id_col)
