"""Noise, smoke tables and the index of words, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.operators import lookup, prep


def noised(text, key, seed):
    after = lambda x: (x * 48271 + 11) % 2147483647
    x = (key * 48271 + seed) % 2147483647
    kind, chars = x % 4, list(text)
    left = [p for p, c in enumerate(chars) if c.isalpha()]
    n = len(chars) if kind == 2 else len(left)
    edits = min(1 + after(x) % max(1, n // 4), n - 1 if kind == 1 else n) if kind else 0
    x = after(after(x))
    for _ in range(edits):
        new = chr(97 + after(x) % 26)
        if kind == 2:
            chars.insert(x % (len(chars) + 1), new)
        else:
            p = left.pop(x % len(left))
            chars[p] = "" if kind == 1 else new.upper() if chars[p] != chars[p].lower() else new
        x = after(after(x))
    return "".join(chars), prep.NOISE[kind]


def test_noise(spark):
    rng = random.Random(4)
    texts = ["", "x", "Ab", "12-3", "é ß Ñ 中文", " spaced  out ", "Éclair 7"] + ["".join(rng.choice("abcDEFé 12") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts * 4)]
    frame = spark.createDataFrame([*rows, (5, None)], "k long, t string")
    got = {(r["k"], r["t"]): r["n"] for r in frame.select("k", "t", prep.noise(F.col("t"), F.col("k"), 3).alias("n")).collect()}
    assert got.pop((5, None)) is None
    assert all(tuple(got[k, t]) == noised(t, k, 3) for k, t in rows)
    kinds = Counter(got[r]["kind"] for r in rows)
    assert all(abs(kinds[k] / len(rows) - 0.25) < 0.06 for k in prep.NOISE)
    for k, t in rows:
        text, kind = got[k, t]
        letters = sum(c.isalpha() for c in t)
        if kind == "delete" and letters:
            assert 1 <= sum(c.isalpha() for c in text) and letters - sum(c.isalpha() for c in text) <= max(1, letters // 4)
        if kind == "insert":
            assert 0 <= len(text) - len(t) <= max(1, len(t) // 4)


def test_smoke_tables(spark):
    of = lambda rows: spark.createDataFrame([(t, 1) for t in rows], "tab_id string, col_id int")
    cea, cta, cpa = of("aaabbcddde"), of("abdx"), of("aadyx")
    got = [tuple(r) for r in prep.smoke_tables(cea, cta, cpa, 4).collect()]
    assert got == [("a", 3, True), ("d", 3, True), ("c", 1, False), ("e", 1, False)]  # two complete ones, the rest is filled up
    assert [r["tab_id"] for r in prep.smoke_tables(cea, cta, cpa, 1).collect()] == ["a"]
    assert [r["tab_id"] for r in prep.smoke_tables(cea, cta, cpa, 9, of("bexx")).collect()] == ["e", "b"]
    assert prep.smoke_tables(cea.limit(0), cta, cpa, 3).count() == 0


@pytest.mark.parametrize("frequent", [0, 3, 25, 10_000])
def test_words_in_every_name(spark, frequent):
    rng = random.Random(frequent)
    some = lambda n: " ".join(rng.choice(["b", "c", "d", "E", *[f"w{k}" for k in range(60)]]) for _ in range(n))
    names = [(k, f"the {some(rng.randrange(1, 6))}") for k in range(400)] + [(400, None), (401, ""), (402, "The w1  w1")]
    terms = ["the", "the the", "nowhere", "", " ", "THE w1", *[some(rng.randrange(1, 6)) for _ in range(60)], "the b c d"]
    queries, table = spark.createDataFrame([(t,) for t in [*terms, "the"]], "term string"), spark.createDataFrame(names, "id long, name string")
    got = sorted(map(tuple, lookup.search_rare_words(queries, table, 5, frequent).collect()))
    words = lambda t: {w for w in (t or "").lower().split(" ") if w}
    want = []
    for t in set(terms):
        shared = Counter()
        for i, name in names:
            shared[i] += len(words(t) & words(name))
        best = sorted(((-n, i) for i, n in shared.items() if n), key=lambda x: x)[:5]
        want += [(t, i, -n, k + 1) for k, (n, i) in enumerate(best)]
    assert got == sorted(want)
