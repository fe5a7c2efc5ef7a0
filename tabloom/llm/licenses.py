"""License scans by patience alignment.

A notice is aligned to the words around each of its seed words in a text: the alignment is anchored on words that are
unique on both sides, of which the longest increasing sequence is taken, and goes on in the gaps between anchors; a gap
without unique words is aligned by its longest common subsequence. The words around a seed are as many as the notice has
on that side and slack() more, so a copy may have as many words put in as slack() tells: a notice of SHORT words or more
may be twice as long as it was, a shorter one must be nearly whole. A notice has so many seeds, its longest words, that a
find must have one of them aligned; so no place is missed that has COVERAGE within the slack. Anchors are unique within
those words and not within the text, as a text may hold a notice twice.

Beside notices, licenses that are named in passing (SPDX identifiers, `GPLv3`, `MIT License`) are found by MENTIONS; they
are no aligned notices, and a notice that has their words goes before them. A short mention after `not` in its sentence is
none.

The share of the notice's words that are aligned is its coverage; COVERAGE or more is a find, unless one of the words that
tell the notice from others of its family (TELLING) is not aligned or a word of another license (FOREIGN) stands among
the aligned ones. Where notices are aligned to the same words, the one with the most of them aligned wins the place;
ties go to the better coverage, then the first place, then the lesser name. All places of a notice are given.

Null and empty texts have no finds. Repeated rows each get their row; an empty table gives an empty one; other columns
are ignored. Long texts take time in proportion to their words, and where all words of a notice are near, to the
notice's length too.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabloom.llm.common import session, table

#: The wording of notices, by the license they name; a name with -line is a short mention, others the usual notice.
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        '(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, '
        "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, "
        "must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
}
_MIT_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_THIRD = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Whole license texts.
NOTICES |= {
    "mit-full": NOTICES["mit"] + _MIT_WARRANTY,
    "bsl-1.0-full": NOTICES["bsl-1.0"] + _MIT_WARRANTY.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE").replace("AND NONINFRINGEMENT", ", TITLE AND NON-INFRINGEMENT"),
    "bsd-2-clause-full": NOTICES["bsd-conditions"] + _BSD_WARRANTY,
    "bsd-3-clause-full": NOTICES["bsd-conditions"] + _BSD_THIRD + _BSD_WARRANTY,
    "isc-full": NOTICES["isc"] + _ISC_WARRANTY,
    "unlicense-full": NOTICES["unlicense"]
    + (
        " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
}
_CC = {"by": (), "by-sa": ("sharealike",), "by-nd": ("noderivatives",), "by-nc": ("noncommercial",), "by-nc-sa": ("noncommercial", "sharealike"), "by-nc-nd": ("noncommercial", "noderivatives")}
_GNU = {"gpl": ("", ("1", "2", "3")), "lgpl": ("Lesser ", ("2.1", "3")), "agpl": ("Affero ", ("3",))}
NOTICES |= {f"cc-{kind}-{v}-line": f"Licensed under CC {kind.upper()} {v}." for kind in _CC for v in ("2.0", "2.5", "3.0", "4.0")}
NOTICES |= {
    f"cc-{kind}-{v}": f"This work is licensed under a Creative Commons {'-'.join(('Attribution', *(w.title() for w in words)))} {v} {port} License."
    for kind, words in _CC.items()
    for v, port in (("3.0", "Unported"), ("4.0", "International"))
}
NOTICES |= {
    f"{name}-{v if '.' in v else v + '.0'}-line": f"This work is licensed under the GNU {word}General Public License, version {v}." for name, (word, versions) in _GNU.items() for v in versions
}
NOTICES |= {
    "lgpl": NOTICES["gpl"].replace("General Public", "Lesser General Public"),
    "agpl": NOTICES["gpl"].replace("General Public", "Affero General Public"),
    "bsd-2-clause-line": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause-line": "Licensed under the BSD 3-Clause License.",
    "bsd-warranty": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "cc0-1.0-line": "Licensed under CC0 1.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-1.0-line": "Licensed under the Eclipse Public License, Version 1.0.",
    "epl-2.0-line": "Licensed under the Eclipse Public License, Version 2.0.",
    "epl-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}
#: The first paragraph of a header of the GNU licenses, whatever the work is called; and the second.
_GRANT = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GRANTS = {"gpl-2.0": ("", "2"), "gpl-3.0": ("", "3"), "lgpl-2.1": ("Lesser ", "2.1"), "lgpl-3.0": ("Lesser ", "3"), "agpl-3.0": ("Affero ", "3")}
NOTICES |= {f"{name}-grant": _GRANT.format(*of) for name, of in _GRANTS.items()}
NOTICES["gnu-warranty"] = (
    "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU General Public License for more details."
)


def _telling() -> tuple[dict[str, set[str]], dict[str, set[str]]]:
    telling = {
        "apache-2.0-line": {"apache", "2"},
        "mit-line": {"mit"},
        "bsd-2-clause-line": {"bsd", "2"},
        "bsd-3-clause-line": {"bsd", "3"},
        "cc0-1.0-line": {"cc0"},
        "epl-1.0-line": {"eclipse", "1"},
        "epl-2.0-line": {"eclipse", "2"},
        "epl-1.0": {"eclipse"},
        "epl-2.0": {"eclipse", "2"},
        "mpl-2.0": {"mozilla"},
        "all-rights-reserved": {"all", "rights", "reserved"},
        "bsd-3-clause-full": {"neither", "endorse"},
    }
    foreign: dict[str, set[str]] = {"epl-1.0": {"2", "v2"}, "bsd-2-clause-full": {"endorse"}}
    short = {"sharealike": "sa", "noderivatives": "nd", "noncommercial": "nc"}
    for name in NOTICES:
        if m := re.fullmatch(r"cc-(by[a-z-]*)-(\d)\.(\d)(-line)?", name):
            words = set(_CC[m[1]])
            own = {short[w] for w in words} if m[4] else words
            telling[name] = {"by" if m[4] else "attribution", m[2], m[3], *own}
            foreign[name] = set(short.values() if m[4] else short) - own
        elif m := re.fullmatch(r"([al]?gpl)(?:-(\d)\.(\d)-line)?", name):
            word = {"gpl": set(), "lgpl": {"lesser"}, "agpl": {"affero"}}[m[1]]
            telling[name] = word | ({m[2]} if m[2] else set()) | ({m[3]} if m[3] and m[3] != "0" else set())
            foreign[name] = {"lesser", "affero", "library"} - word
        elif name.endswith("-grant"):
            word, version = _GRANTS[name.removesuffix("-grant")]
            telling[name] = {*word.lower().split(), *version.split(".")}
            foreign[name] = {"lesser", "affero", "library"} - set(word.lower().split())
    return telling, foreign


#: By notice, words that must be aligned and words that must not stand between the first and the last aligned word.
TELLING, FOREIGN = _telling()
COVERAGE = 0.8
#: Words from which on a notice may be twice as long in a text.
SHORT = 20
WORD = re.compile(r"\w+")
#: How licenses are named in passing, in lower case; the name of a find is that of the pattern with its groups.
MENTIONS = {
    "spdx-{0}": r"spdx-license-identifier:\s*\(?([a-z0-9][a-z0-9.+-]*)",
    "mit-mention": r"\bmit[- ]licen[cs]e\b",
    "{0}-{1}-mention": r"\b([al]?gpl)[- ]?v?\.? ?([123](?:\.[01])?)(?![\w.]*\d)",
    "gnu-{0}gpl-{1}-mention": r"\bgnu (?:(lesser|affero|library) )?general public licen[cs]e,? ?(?:\([al]?gpl\),? )?v(?:ersion)?\.? ?([123](?:\.[01])?)",
    "apache-2.0-mention": r"\bapache(?: software)? licen[cs]e,? ?v?(?:ersion )?2(?:\.0)?\b|\bapache-2\.0\b",
    "bsd-{0}-clause-mention": r"\bbsd[- ]([234])[- ]clause\b|\b([234])[- ]clause bsd\b",
    "boost-1.0-mention": r"\bboost software licen[cs]e\b|\bbsl-1\.0\b",
    "mpl-{0}-mention": r"\bmozilla public licen[cs]e,? ?v?(?:ersion )?([12]\.[01])\b|\bmpl[- ]?v?([12]\.[01])\b",
    "cc-{0}-{1}-mention": r"\bcc[- ](by(?:-(?:nc|sa|nd))*)[- ]v?([1-4]\.0)\b",
}
GNU_VERSIONS = {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0")}
_MENTIONS = [(name, re.compile(pattern)) for name, pattern in MENTIONS.items()]
#: A text without any of these has no mention.
_HINTS = ("licen", "gpl", "apache", "bsd", "bsl", "mpl", "cc-by", "cc by")
#: What before a short mention, in its sentence, turns it round, and how many words before it.
NEGATED, BEFORE = re.compile(r"(?:\bnot\b|\bnever\b|n't\b|n’t\b)[^.;:!?\n]*\Z"), 6


def mentions(text: str) -> Iterator[tuple[str, int, int]]:
    """(name, start, end) of the licenses that a lower-case text names in passing; characters."""
    if not any(hint in text for hint in _HINTS):
        return
    for name, pattern in _MENTIONS:
        for m in pattern.finditer(text):
            groups = [g for g in m.groups() if g is not None]
            if "gpl" in pattern.pattern:
                family = f"{ {'lesser': 'l', 'library': 'l', 'affero': 'a'}.get(m[1], '')}gpl" if name.startswith("gnu") else m[1]
                if _version(m[2]) in GNU_VERSIONS[family]:
                    yield f"{family}-{_version(m[2])}-mention", m.start(), m.end()
            else:
                yield name.format(*groups), m.start(), m.end()


def _version(v: str) -> str:
    return v if "." in v else f"{v}.0"


def slack(n: int) -> int:
    """The words that a copy of a notice of n words may have more than the notice on either side of a seed."""
    return n if n >= SHORT else n // 5


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sequence of pairs, in the order of their first parts, whose second parts increase."""
    piles: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(piles, b)
        back.append(last[at - 1] if at else -1)
        if at == len(piles):
            piles.append(b)
            last.append(k)
        else:
            piles[at], last[at] = b, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of equal words, increasing in both."""
    if not a or not b:
        return []
    in_a, in_b = Counter(a), Counter(b)
    where = {w: j for j, w in enumerate(b) if in_b[w] == 1}
    anchors = _increasing([(i, where[w]) for i, w in enumerate(a) if in_a[w] == 1 and w in where])
    if not anchors:
        return _common(a, b)
    out: list[tuple[int, int]] = []
    i = j = 0
    for x, y in [*anchors, (len(a), len(b))]:
        out += [(i + p, j + q) for p, q in align(a[i:x], b[j:y])]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def _tight(pairs: list[tuple[int, int]], at: int, b: list[str]) -> list[tuple[int, int]]:
    """The same words of the notice, aligned to those of their places in b that are nearest to the middle one's, `at`."""
    out = list(pairs)
    for k in range(at - 1, -1, -1):
        word, end = b[out[k][1]], out[k + 1][1]
        out[k] = out[k][0], next(y for y in range(end - 1, -1, -1) if b[y] == word)
    for k in range(at + 1, len(out)):
        word, start = b[out[k][1]], out[k - 1][1]
        out[k] = out[k][0], next(y for y in range(start + 1, len(b)) if b[y] == word)
    return out


def _ends(pairs: list[tuple[int, int]], least: float) -> list[tuple[int, int]]:
    """pairs without a few at either end that stand far off and so belong to the text around, if `least` are left."""
    first, last = 0, len(pairs)
    for k in range(len(pairs) - 1):
        put_in = (pairs[k + 1][1] - pairs[k][1]) - (pairs[k + 1][0] - pairs[k][0])
        if put_in > max(4, 3 * (k + 1)) and len(pairs) - (k + 1) >= least:
            first = k + 1
        if put_in > max(4, 3 * (len(pairs) - k - 1)) and k + 1 - first >= least:
            last = k + 1
            break
    return pairs[first:last]


class Scanner:
    """Finds notices. Seeds are a notice's longest words, so many that a find must have one of them aligned."""

    def __init__(self, notices: dict[str, str], coverage: float = COVERAGE) -> None:
        self.words = {name: WORD.findall(text.lower()) for name, text in sorted(notices.items())}
        self.counts = {name: Counter(ws) for name, ws in self.words.items()}
        self.coverage = coverage
        #: Licenses named in passing are looked for beside our own notices only.
        self.named = notices is NOTICES or notices == NOTICES
        self.short = {name for name, ws in self.words.items() if len(ws) < SHORT}
        # of notices of the caller's, only those worded as here
        same = {name for name, text in notices.items() if NOTICES.get(name) == text}
        self.telling = {name: TELLING.get(name, set()) if name in same else set() for name in notices}
        self.foreign = {name: FOREIGN.get(name, set()) if name in same else set() for name in notices}
        self.seeds: dict[str, list[tuple[str, int]]] = {}
        for name, ws in self.words.items():
            places = sorted(range(len(ws)), key=lambda at: (-len(ws[at]), at))
            for at in places[: int(len(ws) * (1 - coverage) + 1e-9) + 1]:
                self.seeds.setdefault(ws[at], []).append((name, at))
        self.seed = re.compile(r"\b(?:" + "|".join(map(re.escape, self.seeds)) + r")\b") if self.seeds else None
        # which bits of a row stand for a word, for the length of a longest common subsequence
        self.bits: dict[str, dict[str, int]] = {name: {} for name in self.words}
        for name, ws in self.words.items():
            for k, w in enumerate(ws):
                self.bits[name][w] = self.bits[name].get(w, 0) | 1 << k

    def _enough(self, name: str, lows: np.ndarray, highs: np.ndarray, where: dict[str, np.ndarray]) -> np.ndarray:
        """Which of the windows have the telling words and enough words of the notice in any order."""
        left, least = len(self.words[name]), self.coverage * len(self.words[name]) - 1e-9
        have, kept = np.zeros(len(lows), np.int64), np.arange(len(lows))
        # rare words first, as they soon leave few windows that can still have enough
        for w, n in sorted(self.counts[name].items(), key=lambda c: len(where.get(c[0], ()))):
            left -= n
            if w in where:
                there = np.searchsorted(where[w], highs[kept]) - np.searchsorted(where[w], lows[kept])
                have[kept] += np.minimum(there, n)
                kept = kept[(have[kept] + left >= least) & ((there > 0) | (w not in self.telling[name]))]
            else:
                kept = kept[(have[kept] + left >= least) & (w not in self.telling[name])]
            if not len(kept):
                break
        return kept

    def _common(self, name: str, window: list[str]) -> int:
        """The length of the longest common subsequence, a row of bits at a time: no alignment has more."""
        bits, full = self.bits[name], (1 << len(self.words[name])) - 1
        row = full
        for w in window:
            if m := bits.get(w):
                row = ((row + (row & m)) | (row & ~m)) & full
        return (full & ~row).bit_count()

    def _aligned(self, name: str, at: int, k: int, low: int, window: list[str]) -> list[tuple[int, int]]:
        """The pairs (word of the notice, word of the text), if they are a find."""
        notice, least = self.words[name], self.coverage * len(self.words[name]) - 1e-9
        if self._common(name, window) < least:
            return []
        pairs = align(notice, window)
        if len(pairs) < least:
            return []
        near = min(range(len(pairs)), key=lambda p: (abs(pairs[p][0] - at), abs(low + pairs[p][1] - k)))
        pairs = _ends(_tight(pairs, near, window), least)
        if not self.telling[name] <= {notice[x] for x, _ in pairs} or not self.foreign[name].isdisjoint(window[pairs[0][1] : pairs[-1][1]]):
            return []
        return [(x, low + y) for x, y in pairs]

    @staticmethod
    def _negated(text: str, starts: list[int], first: int) -> bool:
        return NEGATED.search(text[starts[max(0, first - BEFORE)] : starts[first]]) is not None

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(name, coverage, first and last word) of each place of a notice, by name and place."""
        text = (text or "").lower()
        named = list(mentions(text)) if self.named else []
        if not named and (not self.seed or not self.seed.search(text)):
            return []
        ws = WORD.findall(text)
        todo: dict[str, set[tuple[int, int]]] = {}
        where: dict[str, list[int]] = {}
        for k, w in enumerate(ws):
            where.setdefault(w, []).append(k)
            for name, at in self.seeds.get(w, ()):
                todo.setdefault(name, set()).add((k - at, at))
        places = {w: np.array(at) for w, at in where.items()}
        finds: list[tuple[int, float, str, list[int]]] = []
        for name, seeds in todo.items():
            n = len(self.words[name])
            # of seeds that mean the same place, the first
            starts = dict(sorted(seeds, reverse=True))
            begin, at = np.array(sorted(starts)), np.array([starts[b] for b in sorted(starts)])
            lows, highs = np.maximum(0, begin - slack(n)), np.minimum(len(ws), begin + n + slack(n))
            known: set[tuple[int, int]] = set()
            whole: set[int] = set()
            for first in begin.tolist():
                if first >= 0 and ws[first] == self.words[name][0] and ws[first : first + n] == self.words[name]:
                    whole.update(range(first, first + n))
                    finds.append((n, 1.0, name, list(range(first, first + n))))
            for j in self._enough(name, lows, highs, places).tolist():
                low, seed = int(lows[j]), int(at[j])
                k = int(begin[j]) + seed
                # a word of a whole copy is a word of no better place
                if k in whole or (seed, k) in known:
                    continue
                if pairs := self._aligned(name, seed, k, low, ws[low : int(highs[j])]):
                    known.update(pairs)
                    finds.append((len(pairs), len(pairs) / n, name, [y for _, y in pairs]))
        if named or any(name in self.short for _, _, name, _ in finds):
            starts_at = [m.start() for m in WORD.finditer(text)]
            for name, a, b in named:
                at = list(range(bisect_left(starts_at, a), bisect_left(starts_at, b)))
                finds.append((len(at), 1.0, name, at))
            finds = [f for f in finds if not (f[2] in self.short or f[2] not in self.words) or not self._negated(text, starts_at, f[3][0])]
        out: set[tuple[str, float, int, int]] = set()
        won: dict[int, int] = {}
        for number, (n, share, name, at) in enumerate(sorted(finds, key=lambda f: (-f[0], -f[1], f[3][0], f[2]))):
            if 2 * sum(won.get(y, number) != number for y in at) <= n:
                for y in at:
                    won.setdefault(y, number)
                out.add((name, share, at[0], at[-1]))
        return sorted(out, key=lambda f: (f[0], f[2]))


def _scanned(notices: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(notices).scan
        for batch in batches:
            found = [scan(t) for t in batch.column("text").to_pylist()]
            columns = [
                pa.array([",".join(sorted({f[0] for f in fs})) for fs in found], pa.string()),
                pa.array([max((f[1] for f in fs), default=0.0) for fs in found], pa.float64()),
                pa.array([",".join(f"{f[0]}:{f[2]}:{f[3]}" for f in fs) for fs in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "licenses", "coverage", "places"])

    return run


def scan(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, licenses, coverage, places) of every document: names of the notices found, the best coverage, and name:first word:last word of all their places."""
    session(docs)
    return docs.select("doc_id", "text").mapInArrow(_scanned(notices or NOTICES), f"doc_id {dict(docs.dtypes)['doc_id']}, licenses string, coverage double, places string")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
