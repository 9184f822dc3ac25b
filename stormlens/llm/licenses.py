"""License scans: winnowed template fingerprints find candidates, banded alignment reports what matches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormlens.llm.common import LOWER, NO_LETTER, chunks, run_hashes, span_hashes, word_spans

#: Words in a fingerprint, and fingerprints in a winnowing window: a run of K + WINDOW - 1 shared words is never missed.
K, WINDOW = 3, 4
MIN_COVERAGE, BAND = 0.6, 8
MATCH, MISMATCH, GAP = 2, -1, -1

#: Notices as their licences word them, and short statements in common use.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "All-Rights-Reserved": ["All rights reserved."],
}


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, words per text, starts, ends): lower-cased runs of letters and digits."""
    low = LOWER[buf]
    s, e, n = word_spans(low, off, NO_LETTER)
    return span_hashes(low, s, e), n, s, e


def winnow(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the fingerprints kept: the rightmost least of every window; all of them if there are fewer."""
    if len(g) <= window:
        return np.arange(len(g))
    view = np.lib.stride_tricks.sliding_window_view(g, window)[:, ::-1]
    return np.unique(window - 1 - view.argmin(1) + np.arange(len(view)))


@dataclass
class Index:
    """Inverted index: sorted fingerprints with template and place, and the templates' words."""

    names: list[tuple[str, int]]
    words: list[np.ndarray]
    prints: np.ndarray
    template: np.ndarray
    place: np.ndarray


def index_of(templates: dict[str, list[str]] = TEMPLATES, k: int = K, window: int = WINDOW) -> Index:
    names, words, rows = [], [], []
    for licence, texts in templates.items():
        for v, text in enumerate(texts):
            b = np.frombuffer(text.encode(), np.uint8)
            h = words_of(b, np.array([0, len(b)]))[0]
            g = run_hashes(h, k)
            for p in winnow(g, window).tolist():
                rows.append((int(g[p]), len(names), p))
            names.append((licence, v)), words.append(h)
    rows.sort()
    cols = list(zip(*rows)) if rows else ((), (), ())
    return Index(names, words, np.array(cols[0], np.uint64), np.array(cols[1], np.int64), np.array(cols[2], np.int64))


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int, int]:
    """(score, matched words, start, end in the text) of the best local alignment within `band` of the diagonal
    text place = template place + shift. Of equal scores the first in the text counts."""
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}
    t, x = template.tolist(), text.tolist()
    for i in range(len(t)):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(x), i + shift + band + 1)):
            s, m, a = above.get(j - 1, (0, 0, j))
            cell = (s + MATCH, m + 1, a) if t[i] == x[j] else (s + MISMATCH, m, a)
            for s, m, a in (above.get(j, (0, 0, j)), row.get(j - 1, (0, 0, j))):
                if s + GAP > cell[0]:
                    cell = (s + GAP, m, a)
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0] or cell[0] == best[0] and (cell[2], j + 1) < best[2:]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best


def matches(index: Index, h: np.ndarray, min_coverage: float = MIN_COVERAGE, band: int = BAND, k: int = K,
            memo: dict | None = None) -> list[tuple[int, int, int, int, float]]:
    """(template, first word, end word, matched words, coverage) of one text, in order; matches do not overlap."""
    g = run_hashes(h, k)
    lo, hi = np.searchsorted(index.prints, g), np.searchsorted(index.prints, g, side="right")
    at = np.flatnonzero(hi > lo)
    if not len(at):
        return []
    seeds: dict[int, set[int]] = {}
    for p in at.tolist():
        for r in range(int(lo[p]), int(hi[p])):
            seeds.setdefault(int(index.template[r]), set()).add(p - int(index.place[r]))
    found = []
    for t, shifts in seeds.items():
        m = len(index.words[t])
        width = min(band, max(1, m // 2))
        tried = None
        for d in sorted(shifts):
            if tried is not None and d - tried < width:
                continue
            tried = d
            a, b = max(0, d - width), min(len(h), d + m + width)
            key = (t, d - a, h[a:b].tobytes())
            got = memo.get(key) if memo is not None else None
            if got is None:
                got = align(index.words[t], h[a:b], d - a, width)
                if memo is not None:
                    if len(memo) > 20_000:
                        memo.clear()
                    memo[key] = got
            _, n, s, e = got
            if n >= min_coverage * m:
                found.append((t, a + s, a + e, n, n / m))
    # more matched words first: a long notice beats the short statement that opens it, the nearer licence its sibling
    order = sorted(set(found), key=lambda f: (-f[3], -f[4], f[1], f[0]))
    taken, out = np.zeros(len(h), bool), []
    for f in order:
        if not taken[f[1]:f[2]].any():
            taken[f[1]:f[2]] = True
            out.append(f)
    return sorted(out, key=lambda f: (f[1], f[2], f[0]))


def _scan(index: Index, min_coverage: float, band: int):
    names = ["__row", "license", "variant", "start_word", "end_word", "start_byte", "end_byte", "matched_words", "coverage"]

    def run(batches):
        memo: dict = {}
        for batch in batches:
            rows, cols = [], [[] for _ in names[1:]]
            for lo, hi, buf, off in chunks(batch, "__text"):
                h, n, starts, ends = words_of(buf, off)
                first = np.concatenate([[0], np.cumsum(n)])
                g = run_hashes(h, K)
                at = np.searchsorted(index.prints, g)
                hit = at < len(index.prints)
                hit[hit] = index.prints[at[hit]] == g[hit]
                # only texts with a fingerprint of a template are looked at closely
                for i in np.unique(np.searchsorted(first, np.flatnonzero(hit), side="right") - 1).tolist():
                    own = slice(int(first[i]), int(first[i + 1]))
                    for t, a, b, m, c in matches(index, h[own], min_coverage, band, memo=memo):
                        rows.append(lo + i)
                        base = int(off[i])
                        for col, x in zip(cols, (*index.names[t], a, b, int(starts[own][a]) - base, int(ends[own][b - 1]) - base, m, c)):
                            col.append(x)
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 5, pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)
    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None,
         min_coverage: float = MIN_COVERAGE, band: int = BAND) -> DataFrame:
    """One row per match: id, license, variant of its template, span in words and bytes, matched words, coverage.

    Coverage is the share of the template's words that the alignment matches. Words are lower-cased
    runs of letters and digits. Texts are scanned whole where they lie, without a shuffle; null and
    empty texts match nothing, repeated rows match alike, null ids are carried.
    """
    index = index_of(templates if templates is not None else TEMPLATES)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__row"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(_scan(index, min_coverage, band), f"__row {kind}, license string, variant int, start_word long, end_word long, "
                           "start_byte long, end_byte long, matched_words long, coverage double").withColumnRenamed("__row", id_col)
