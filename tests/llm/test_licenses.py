import random
import time
from itertools import pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import licenses


def test_align_and_scan(spark, small_dir):
    assert licenses.align("a b c d".split(), "x a c b d d".split())[0] == (0, 1)
    scan = licenses.Scanner(licenses.NOTICES).scan
    assert [f[0] for f in scan("Some text. Licensed under the Apache License, Version 2.0. More.\nAll rights reserved.")] == ["all-rights-reserved", "apache-2.0-line"]
    assert [f[0] for f in scan("this work was licensed under the new GNU general public license version 3")] == ["gpl-3.0-line"]
    assert scan("all of the rights that were lost") == [] == scan(None) == scan("")
    two = "Released under the MIT License. Released under the MIT License."
    assert scan(two) == [("mit-line", 1.0, 0, 4), ("mit-line", 1.0, 5, 9)]
    assert scan("all of the rights that were reserved") == []
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in licenses.query(spark, small_dir).collect()}
    for r in docs.select("doc_id", "text").collect():
        assert {n for n, t in licenses.NOTICES.items() if t in r.text} <= got[r.doc_id]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_families_and_versions():
    scan = licenses.Scanner(licenses.NOTICES).scan
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    for text, name in {
        "Licensed under CC BY 4.0.": "cc-by-4.0-line",
        "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0-line",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-line",
        "Licensed under CC BY-NC-ND 3.0.": "cc-by-nc-nd-3.0-line",
        gnu.format("", "2"): "gpl-2.0-line",
        gnu.format("", "3"): "gpl-3.0-line",
        gnu.format("Lesser ", "2.1"): "lgpl-2.1-line",
        gnu.format("Lesser ", "3"): "lgpl-3.0-line",
        gnu.format("Affero ", "3"): "agpl-3.0-line",
        "Licensed under the BSD 3-Clause License.": "bsd-3-clause-line",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0",
    }.items():
        assert [f[0] for f in scan("Some prose. " + text + " More prose.")] == [name]
    for text in ("Licensed under CC BY 9.0.", "Released under the Foo License.", "Licensed under the Apache License, Version 1.0.", gnu.format("Affero ", "2")):
        assert scan(text) == []
    both = scan(gnu.format("Lesser ", "3") + " Much other prose stands between the two of them here. " + gnu.format("", "3"))
    assert [f[0] for f in both] == ["gpl-3.0-line", "lgpl-3.0-line"] and both[0][2] > both[1][3]
    assert [f[0] for f in scan("x " + licenses.NOTICES["lgpl"])] == ["lgpl"]


def test_full_notices():
    """Each notice is found in a long text around it, also with words left out, changed or put in, and only there."""
    scan = licenses.Scanner(licenses.NOTICES).scan
    prose = "the river and the software of a program that was distributed to any person in the version of the work " * 40
    assert scan(prose) == []
    for name, text in licenses.NOTICES.items():
        found = {f[0]: f for f in scan(prose + text + " " + prose)}
        n = len(licenses.WORD.findall(text.lower()))
        assert found[name][1:] == (1.0, 800, 800 + n - 1)
        if n > 20:
            words = text.split()
            telling = licenses.TELLING.get(name, set())  # without these it is another license
            changed = " ".join("other" if k % 12 == 5 and telling.isdisjoint(licenses.WORD.findall(w.lower())) else w + " extra" if k % 15 == 7 else w for k, w in enumerate(words))
            assert 0.8 <= {f[0]: f for f in scan(prose + changed + prose)}[name][1] < 1
            assert name not in {f[0] for f in scan(" ".join(words[: len(words) // 2]) + " " + prose)}


def test_every_place():
    """Copies of notices, with words put in, left out and changed, are found at each of their places, and nothing between them."""
    rng = random.Random(4)
    scan = licenses.Scanner(licenses.NOTICES).scan
    names = [n for n, t in licenses.NOTICES.items() if len(licenses.WORD.findall(t)) > 25]
    for _ in range(12):
        text, want = [], []
        for name in rng.choices(names, k=5):
            text += [f"prose{rng.randrange(99)}" for _ in range(rng.randrange(5, 300))]
            copy = licenses.WORD.findall(licenses.NOTICES[name].lower())
            telling = licenses.TELLING.get(name, set())
            loose = [k for k in range(1, len(copy) - 1) if copy[k] not in telling and copy[k] not in ("endorse", "neither")]
            for k in rng.sample(loose, len(copy) // 8):
                copy[k] = "changed"
            at = rng.randrange(len(copy) // 3, len(copy) // 2)
            copy[at:at] = [f"put{k}" for k in range(rng.randrange(len(copy) // 2))]
            want.append((name, len(text), len(text) + len(copy) - 1))
            text += copy
        got = scan(" ".join(text))
        # a family's shorter notice may be the one that is named, where words of the longer are changed
        for name, first, end in want:
            assert any(abs(f[2] - first) + abs(f[3] - end) <= 8 or f[0].split("-")[0] == name.split("-")[0] and first <= f[2] and f[3] <= end for f in got), (name, first, end, got)
        assert all(any(min(f[3], end) > max(f[2], first) for _, first, end in want) for f in got)


def test_long_and_repeated(spark):
    """A text of 100,000 seed words and one of 200 notices are scanned in time; odd rows and names don't matter."""
    scan = licenses.Scanner(licenses.NOTICES).scan
    began = time.time()
    assert scan(" ".join(["license merchantability redistribution"] * 33_000)) == []
    found = scan(" ".join([licenses.NOTICES["mit-full"]] * 200))
    assert len(found) == 200 and {f[0] for f in found} == {"mit-full"}
    assert time.time() - began < 20
    rows = [(1, None, "x", "l"), (2, "", "x", "l"), (3, "Released under the MIT License.", "x", "l"), (3, "Released under the MIT License.", "x", "l"), (None, "Licensed under CC0 1.0.", "x", "l")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string, places string"))
    assert sorted((r.doc_id or 0, r.licenses, r.places) for r in got.collect()) == [(0, "cc0-1.0-line", "cc0-1.0-line:0:4"), (1, "", ""), (2, "", ""), (3, "mit-line", "mit-line:0:4"), (3, "mit-line", "mit-line:0:4")]


def test_common_length():
    rng = random.Random(1)
    scanner = licenses.Scanner({"x": "a b a c d e b f"})
    for _ in range(300):
        window = [rng.choice("abcdefgh") for _ in range(rng.randrange(14))]
        assert scanner._common("x", window) == len(licenses._common(scanner.words["x"], window))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=14), st.lists(st.sampled_from("abcdefg"), max_size=14))
def test_align_is_common_and_increasing(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in pairwise(pairs))
    assert len(licenses.align(a, a)) == len(a)


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("SPDX-License-Identifier: MIT", ["spdx-mit"]),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", ["spdx-gpl-2.0-or-later"]),
        ("(c) 2020 Foo. MIT License", ["mit-mention"]),
        ("GPLv3", ["gpl-3.0-mention"]),
        ("This is LGPL v2.1 code.", ["lgpl-2.1-mention"]),
        ("see the GNU Affero General Public License, version 3", ["agpl-3.0-mention"]),
        ("Boost Software License - Version 1.0", ["boost-1.0-mention"]),
        ("under the 3-clause BSD license", ["bsd-3-clause-mention"]),
        ("Apache License 2.0", ["apache-2.0-mention"]),
        ("CC BY-SA 4.0", ["cc-by-sa-4.0-mention"]),
        ("This code is **not** released under the MIT License.", []),
        ("It isn't licensed under the GPLv3", []),
        ("Do not remove this line. Released under the MIT License.", ["mit-line"]),
        ("Released under the MIT License.", ["mit-line"]),
        ("a gpl 35 part, the mpl of 2.05 and no license at all", []),
        (
            "This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            ["gpl-3.0-grant"],
        ),
        (
            "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
            ["lgpl-2.1-grant"],
        ),
    ],
)
def test_names_in_passing(text, names):
    assert sorted({f[0] for f in licenses.Scanner(licenses.NOTICES).scan(text)}) == names


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string, licenses string")).count() == 0
