"""Licence scans: passages against licence templates by the Dice coefficient over word bigrams.

Passages are the whole text, its paragraphs and its lines. Text and templates
are normalised alike (A-Z to lower case, runs of anything but a-z and 0-9 are one
gap). With a threshold t, a passage of a bigrams can reach a template of b only
if ``t / (2 - t) <= a / b <= (2 - t) / t``: other templates are pruned by size.
A passage must also share ``t * b / (2 - t)`` bigrams at least, so it holds one
of any ``b`` minus that plus one: those with the longest words serve as anchors,
and a text without an anchor word of any template is done after one look.

A notice inside a longer line, or wrapped over lines among other text, is no
passage: runs of words are compared as well. The best run begins and ends with a
bigram of the template (another end only makes it larger), so runs are tried
from each such place, up to the template's upper size bound. Overlapping runs
count once, as the template they share most with; a run that overlaps a matching
passage counts only if it shares more bigrams. The templates of ``FURTHER`` are
looked for as runs only.

Defined cases: null and blank texts match nothing; of equal scores the template
that sorts first wins, then the earlier passage; repeated rows match alike.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections.abc import Mapping
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import with_columns

#: Short notices of public licences, as they are published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:"
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_GNU = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} Public License as "
    "published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
#: Fixed values as well: notices and texts that are compared with runs of words only.
FURTHER = {
    "AGPL-3.0-notice": _GNU.format("program", ":", "Affero General", ",", "3"),
    "BSD-2-Clause": _BSD,
    "BSD-3-Clause": _BSD + (
        " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "GPL-2.0-notice": _GNU.format("program", ";", "General", ";", "2"),
    "LGPL-2.1-notice": _GNU.format("library", ";", "Lesser General", ";", "2.1"),
    "LGPL-3.0-notice": _GNU.format("program", ":", "Lesser General", ",", "3"),
    "MIT-text": TEMPLATES["MIT-grant"] + (
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "ISC-text": TEMPLATES["ISC"] + (
        " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Unlicense-text": TEMPLATES["Unlicense"] + (
        " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
        "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the "
        "benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
THRESHOLD = 0.8
WORD = re.compile(rb"[a-z0-9]+")


def normalised(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def bigrams(words: list[bytes]) -> frozenset[tuple[bytes, bytes]]:
    return frozenset(zip(words, words[1:], strict=False))


def apart(found: list[tuple], rank) -> list[tuple]:
    """Of (start, end, ...) those that overlap none of a lower ``rank``."""
    out: list[tuple] = []
    starts: list[int] = []
    for x in sorted(found, key=rank):
        at = bisect(starts, x[0])
        if (at == 0 or out[at - 1][1] <= x[0]) and (at == len(out) or x[1] <= out[at][0]):
            out.insert(at, x)
            starts.insert(at, x[0])
    return out


class Scanner:
    """Templates with their bigrams, size bounds and anchors."""

    def __init__(self, templates: Mapping[str, str], threshold: float, further: Mapping[str, str] | None = None) -> None:
        self.threshold = threshold
        self.templates = [self.entry(name, templates[name]) for name in sorted(templates)]
        self.anchors = frozenset().union(*(x[4] for x in self.templates))
        self.runs = self.templates + [self.entry(name, text) for name, text in sorted((further or {}).items())]
        self.run_anchors = frozenset().union(*(x[4] for x in self.runs))
        self.of: dict[tuple[bytes, bytes], list[int]] = {}
        for i, x in enumerate(self.runs):
            for g in x[1]:
                self.of.setdefault(g, []).append(i)

    def entry(self, name: str, text: str) -> tuple:
        """Name, bigrams, least and most bigrams of a match, anchors, places that a run may span."""
        words = normalised(text)
        own = bigrams(words)
        if not own:
            raise ValueError(f"template {name} has fewer than two words")
        b, share = len(own), self.threshold / (2 - self.threshold)
        needed = math.ceil(share * b - 1e-9)
        longest = sorted(own, key=lambda x: (-max(map(len, x)), x))[: b - needed + 1]
        anchors = frozenset(max(x, key=len) for x in longest)
        return name, own, needed, math.floor(b / share + 1e-9), anchors, math.floor((len(words) - 1) / share + 1e-9)

    def passages(self, text: str) -> list[str]:
        """The whole text, then its paragraphs, then its lines; repeated ones once."""
        return list(dict.fromkeys(x for part in self.parts(text) for x in part))

    def parts(self, text: str) -> tuple[list[str], list[str], list[str]]:
        return [text], re.split(r"\n[^\S\n]*\n", text), text.split("\n")

    def matched(self, text: str) -> list[tuple[str, str, float, int]]:
        """(passage, template, Dice, shared bigrams) of every passage that reaches the threshold."""
        out = []
        for passage in self.passages(text):
            words = normalised(passage)
            if self.anchors.isdisjoint(words):
                continue
            own = bigrams(words)
            for name, other, low, high, anchors, _ in self.templates:
                if low <= len(own) <= high and not anchors.isdisjoint(words):
                    shared = len(own & other)
                    score = 2 * shared / (len(own) + len(other))
                    if score >= self.threshold - 1e-12:
                        out.append((passage, name, score, shared))
        return out

    def matches(self, text: str | None) -> list[tuple[str, float]]:
        """(template, Dice) of every passage that reaches the threshold, in order of the passages, then of the templates."""
        if not text or self.anchors.isdisjoint(normalised(text)):
            return []
        return [(name, score) for _, name, score, _ in self.matched(text)]

    def best_runs(self, pairs: list[tuple[bytes, bytes]], places: list[int], i: int) -> list[tuple[int, int, str, float, int]]:
        """(first word, word after the last, template, Dice, shared bigrams) of a template's best runs, none overlapping."""
        name, own, low, high, _, span = self.runs[i]
        found = []
        for first, last in zip(places, places[low - 1 :], strict=False):
            if last - first >= span:
                continue
            seen: set[tuple[bytes, bytes]] = set()
            best, shared = None, 0
            for k in range(first, min(first + span, len(pairs))):
                g = pairs[k]
                if g in seen:
                    continue
                seen.add(g)
                if len(seen) > high:
                    break
                if g in own:
                    shared += 1
                    score = 2 * shared / (len(seen) + len(own))
                    if score >= self.threshold - 1e-12 and (best is None or score > best[3]):
                        best = (first, k + 2, name, score, shared)
            if best:
                found.append(best)
        return apart(found, lambda x: (-x[3], x[1] - x[0], x[0]))

    def notices(self, text: str | None) -> list[tuple[str, float]]:
        """(template, Dice) of the passages as ``matches`` has them, then of the runs of words beside them."""
        words = normalised(text) if text else []
        if self.run_anchors.isdisjoint(words):
            return []
        matched = [] if self.anchors.isdisjoint(words) else self.matched(text)
        out = [(name, score) for _, name, score, _ in matched]
        pairs = list(zip(words, words[1:], strict=False))
        places: dict[int, list[int]] = {}
        for k, g in enumerate(pairs):
            for i in self.of.get(g, ()):
                places.setdefault(i, []).append(k)
        found = [x for i, at in places.items() if len(at) >= self.runs[i][2] for x in self.best_runs(pairs, at, i)]
        if not found:
            return out
        most: dict[str, int] = {}
        for passage, _, _, shared in matched:
            most[passage] = max(shared, most.get(passage, 0))
        if most:
            for part in self.parts(text):
                spans, start = [], 0
                for passage in part:
                    end = start + len(normalised(passage))
                    if passage in most:
                        spans.append((start, end, most[passage]))
                    start = end
                ends = [end for _, end, _ in spans]
                over = lambda x: takewhile(lambda p: p[0] < x[1], (spans[k] for k in range(bisect(ends, x[0]), len(spans))))  # noqa: B023, E731
                found = [x for x in found if all(x[4] > shared for _, _, shared in over(x))]
        return out + [(name, score) for _, _, name, score, _ in apart(found, lambda x: (-x[4], -x[3], x[2], x[0]))]


def scanned(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
    text: str = "text",
    further: Mapping[str, str] = FURTHER,
) -> DataFrame:
    """``docs`` with licence (best template or null), dice and n_matches. No shuffle; the templates travel with the tasks."""
    chosen, more = dict(templates), dict(further)

    def make():
        scanner = Scanner(chosen, threshold, more)

        def run(block: pa.RecordBatch) -> dict[str, object]:
            found = [scanner.notices(t) for t in block.column(text).to_pylist()]
            best = [min(f, key=lambda x: (-x[1], x[0])) if f else (None, None) for f in found]
            return {"licence": [b[0] for b in best], "dice": [b[1] for b in best], "n_matches": [len(f) for f in found]}

        return run

    return with_columns(docs, text, make, "licence string, dice double, n_matches bigint")
