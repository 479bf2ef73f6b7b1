"""Licence scans: normalised text against licence templates by Dice coefficient over word bigrams.

Normalised text is the sequence of its runs of ASCII letters and digits, lowered. What is compared with a
template is every run of words of a document, across lines and inside them; the Dice coefficient of the two sets
of bigrams must reach ``percent``. Sizes bound the work: a set that reaches t with b bigrams has between b*t/(2-t)
and b*(2-t)/t of its own, so at least b*t/(2-t) of the template's bigrams are in the document, and a run of words
stops growing when it has too many. Only templates whose bigrams a document holds in that number are candidates.
The best run starts and ends with bigrams of the template, and its first one does not come again in it. Of runs
that overlap and whose templates are of one family only the one that shares most bigrams with its template is
reported, then the more similar one: a version's text is not reported as that of another version too.

Defined cases: null, empty and one-word texts match nothing; of runs as similar the first counts, then the
shorter one; repeated rows are each reported; null doc_ids are reported; columns other than doc_id and text are
ignored. first_line and n_lines are the lines that the run touches.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from knotwork.llm._shared import in_arrow, text_bytes, text_slices
from knotwork.llm._text import U, shingles, word_hashes

# Texts of licences and of the notices that name them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-notice": "Distributed under the BSD 3-Clause License.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, see https://www.gnu.org/licenses/.""",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, see https://www.gnu.org/licenses/.""",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
}


def all_templates() -> dict[str, str]:
    """TEMPLATES, and the whole texts of ``licenses``, named with -text."""
    found = dict(TEMPLATES)
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        found[f"{path.stem}-text"] = path.read_text(encoding="utf-8")
    return found


def family(name: str) -> str:
    """Licences of one family share most of their words: the versions of one, and the GNU ones."""
    first = name.split("-")[0]
    return "GPL" if first in ("LGPL", "AGPL") else first


OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def neighbours(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the same bigram before (or -1) and after (or the length) each place."""
    before, after = np.full(len(grams), -1), np.full(len(grams), len(grams))
    by = np.argsort(grams, kind="stable")
    same = grams[by][1:] == grams[by][:-1]
    before[by[1:][same]] = by[:-1][same]
    after[by[:-1][same]] = by[1:][same]
    return before, after


class Templates:
    """Sets of bigrams of the templates, and one table of all of them."""

    def __init__(self, texts: dict[str, str], percent: int):
        self.names, self.percent = list(texts), percent
        sets = []
        for text in texts.values():
            hashes = word_hashes(*text_bytes(pa.array([text])), OUTSIDE)[0]
            sets.append(np.unique(shingles(hashes, 2)[: max(0, len(hashes) - 1)]))
        self.keys = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.holds = np.stack([np.isin(self.keys, s) for s in sets], 1) if sets else np.zeros((0, 0), bool)
        self.sizes = self.holds.sum(0)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.keys >> U(44)] = True

    def best(self, grams: np.ndarray, known: np.ndarray, unit: np.ndarray, template: int) -> tuple[float, int, int] | None:
        """The most similar run of units (words or lines) of a document: Dice coefficient, first unit and units.

        grams: the document's bigrams; known: their places in ``keys`` or -1; unit: of the word of each bigram,
        and of the last word.
        """
        need, size = self.percent, int(self.sizes[template])
        most = size * (200 - need) // need
        inside = (known >= 0) & self.holds[known, template]
        before, after = neighbours(grams)
        last = np.r_[unit[2:] != unit[1:-1], True]  # a bigram ends in the unit of its second word
        words = bool(last.all())
        starts = np.flatnonzero(inside) if words else np.searchsorted(unit, np.unique(unit[:-1][inside]))
        rest = np.cumsum((inside & (after == len(grams)))[::-1])[::-1]
        found = None
        for a in starts.tolist():
            ahead = int(rest[a])  # no run from here on shares more
            if 200 * ahead < need * (ahead + size) or (found and 2 * ahead / (ahead + size) <= found[0]):
                break
            end, stop = a, int(after[a]) if words else len(grams)
            n = both = 0
            while end < stop and n <= most:
                begin, end = end, min(stop, max(end + 64, 2 * end - a))
                new = before[begin:end] < a
                sizes = n + np.cumsum(new)
                shared = both + np.cumsum(new & inside[begin:end])
                n, both = int(sizes[-1]), int(shared[-1])
                good = np.flatnonzero(last[begin:end] & (sizes <= most) & (200 * shared >= need * (sizes + size)))
                if len(good):
                    dice = 2 * shared[good] / (sizes[good] + size)
                    k = int(dice.argmax())
                    if found is None or dice[k] > found[0]:
                        found = (float(dice[k]), int(unit[a]), int(unit[begin + good[k] + 1] - unit[a]) + 1)
        return found

    def matches(self, data: np.ndarray, offs: np.ndarray, words: bool = False) -> list[tuple[int, str, float, int, int]]:
        """(row, template, Dice coefficient, first line, lines) of all templates found in the rows of a slice.

        Runs of whole lines are compared, or all runs of ``words``.
        """
        hashes, rows, starts, _ = word_hashes(data, offs, OUTSIDE)
        if len(hashes) < 2 or not len(self.keys):
            return []
        grams = shingles(hashes, 2)
        at = np.flatnonzero(self.sieve[grams >> U(44)])
        doc = np.searchsorted(rows, at, "right") - 1
        key = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        good = (self.keys[key] == grams[at]) & (at + 2 <= rows[doc + 1])
        at, doc, key = at[good], doc[good], key[good]
        if not len(at):
            return []
        pair = np.unique(doc * len(self.keys) + key)
        owner, held = pair // len(self.keys), pair % len(self.keys)
        cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        counts = np.add.reduceat(self.holds[held].astype(np.int32), cuts, axis=0)
        enough = counts * (200 - self.percent) >= self.percent * self.sizes
        found = []
        for k in np.flatnonzero(enough.any(1)).tolist():
            d = int(owner[cuts[k]])
            a, b = int(rows[d]), int(rows[d + 1])
            breaks = np.flatnonzero(data[offs[d] : offs[d + 1]] == 10) + offs[d]
            line = np.searchsorted(breaks, starts[a:b])
            known = np.full(b - a - 1, -1)
            mine = slice(*np.searchsorted(doc, [d, d + 1]).tolist())
            known[at[mine] - a] = key[mine]
            runs = []
            for t in np.flatnonzero(enough[k]).tolist():
                if best := self.best(grams[a : b - 1], known, np.arange(b - a) if words else line, t):
                    runs.append((t, *best))
            for t, dice, first, n in self.best_of_families(grams[a:b], runs) if words else runs:
                if words:
                    first, n = int(line[first]), int(line[first + n - 1] - line[first]) + 1
                found.append((d, self.names[t], dice, first, n))
        return found

    def best_of_families(self, grams: np.ndarray, runs: list[tuple[int, float, int, int]]) -> list[tuple[int, float, int, int]]:
        """Runs (template, Dice coefficient, first word, words) without those that overlap a better one of their family."""

        def worth(run: tuple[int, float, int, int]) -> tuple[int, float]:
            t, dice, first, n = run
            return round(dice * (len(np.unique(grams[first : first + n - 1])) + int(self.sizes[t])) / 2), dice

        kept: list[tuple[int, float, int, int]] = []
        for run in sorted(runs, key=worth, reverse=True):
            t, _, first, n = run
            if all(family(self.names[u]) != family(self.names[t]) or first + n <= f or f + m <= first for u, _, f, m in kept):
                kept.append(run)
        return sorted(kept)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80) -> DataFrame:
    """(doc_id, license, dice, first_line, n_lines) for each licence found in each row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(Templates(templates or all_templates(), percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            found = held.value.matches(*text_bytes(part.column("text")), words=True)
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.record_batch([part.column("doc_id").take(pa.array([x[0] for x in found], pa.int64())), *(pa.array([x[k + 1] for x in found], t) for k, t in enumerate(kinds))], ["doc_id", "license", "dice", "first_line", "n_lines"])

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, license string, dice double, first_line long, n_lines long")
