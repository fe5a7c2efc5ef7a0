"""Runs against a search of all periods at all places."""

import hashlib
import random
import zlib

import pytest

from tabloom.llm import periodic


def brute(words, least=12):
    """Every maximal stretch for every period, kept for the smallest period alone."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        s = 0
        while s + p < n:
            if words[s] != words[s + p]:
                s += 1
                continue
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e + p - s >= max(least, 2 * p):
                found.setdefault((s, e + p), p)
            s = e
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def test_factors():
    word = [0, 0, 1, 0, 0, 1, 0, 2, 0, 0, 1]
    assert [(s, n) for s, n, _ in periodic.factors(word)] == [(0, 1), (1, 1), (2, 1), (3, 4), (7, 1), (8, 3)]
    for s, n, source in periodic.factors(word):
        assert source < s and (source < 0 or word[source : source + n] == word[s : s + n])


@pytest.mark.parametrize("least", [2, 3, 4, 7, 12])
def test_random_words(least):
    rng = random.Random(least)
    for _ in range(600):
        n, k = rng.randrange(0, 70), rng.choice((1, 2, 2, 3, 4))
        words = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n:
            a, p = rng.randrange(n), rng.randrange(1, n + 1)
            words = words[:a] + (words[a : a + p] * n)[: n - a]
        if rng.random() < 0.3:
            words = words + words[: rng.randrange(n + 1)] + words
        assert periodic.runs_of(words, least) == brute(words, least), (words, least)


def test_fibonacci_and_long():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert periodic.runs_of(b, 2) == brute(b, 2)
    one = [b"x"] * 200_000
    assert periodic.runs_of(one) == [(0, 200_000, 1)]
    assert periodic.collapsed(one, [(0, 200_000, 1)]) == [b"x"]


def test_query(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in periodic.query(spark, small_dir).collect()}
    assert len(got) == len(rows)
    planted = 0
    for doc, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute(words) if n < 900 else periodic.runs_of(words)
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
        r = got[doc]
        assert r["n_runs"] == len(runs)
        assert r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        if runs:
            top = sorted(runs, key=lambda x: (-x[1], x[0], x[2]))[0]
            assert (r["start"], r["length"], r["period"]) == top and r["exponent_milli"] == 1000 * top[1] // top[2]
        else:
            assert r["start"] is r["length"] is r["period"] is r["exponent_milli"] is None
    assert planted > 5


def test_cases(spark):
    docs = spark.createDataFrame([(None, None, 1), (3, "", 2), (3, "a b " * 10 + "c", 3), (3, "a b " * 10 + "c", 3), (4, " x\ty\nx y", 4)], "doc_id long, text string, runs int")
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]]) for r in periodic.runs(docs).collect())
    assert got == [(0, 0, []), (3, 0, []), (3, 21, [(0, 20, 2)]), (3, 21, [(0, 20, 2)]), (4, 4, [])]
    out = periodic.collapse(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["runs"]) for r in out.collect() if r["text"]) == [(3, "a b c", 3), (3, "a b c", 3), (4, " x\ty\nx y", 4)]
    assert periodic.runs(docs.limit(0)).count() == 0
