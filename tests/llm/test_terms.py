"""Terms that give entities away, and texts without them, against brute force."""

import random
import struct
import time
from math import log2

import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import contamination, quality, sanitise
from test_llm import base

NAMES = ["Zarathon", "Kim", "Quibbleton", "Lee"]


def spark_hash(words, seed=42):
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def entities(text):
    out = set()
    for s in filter(None, base(text).split(",")):
        kind, a, b = s.split(":")
        value = text[int(a) : int(b)]
        out.add(f"{kind}:" + (value.lower() if kind in ("email", "ip") else regex.sub("[^0-9]", "", value)))
    return out


def terms(texts):
    """Of all texts, the words that tell too much, by the definition of the operator."""
    texts = [t or "" for t in texts]
    of = {}
    for t in texts:
        if t not in of:
            words = [w.lower() for w in regex.findall(rf"{sanitise.EMAIL}|{sanitise.WORD}", t) if "@" not in w]
            contexts = {}
            for k, w in enumerate(words):
                h = signed(spark_hash(words[max(0, k - 5) : k + 6]))
                contexts[w] = min(contexts.get(w, h), h)
            shingles = [signed(spark_hash(words[k : k + 5])) for k in range(max(1, len(words) - 4))]
            sketches = [min(signed(xxhash.xxh64_intdigest(struct.pack("<q", h), xxhash.xxh64_intdigest(struct.pack("<i", i), 42))) for h in shingles) for i in (1, 2, 3)]
            of[t] = entities(t), contexts, sketches
    n, n_e, n_t, both = len(texts), {}, {}, {}
    for t in texts:
        found, contexts, _ = of[t]
        for e in found:
            n_e[e] = n_e.get(e, 0) + 1
        for w in contexts:
            n_t[w] = n_t.get(w, 0) + 1
            for e in found:
                both.setdefault((w, e), []).append(t)
    out = set()
    for (w, e), docs in both.items():
        different = set(docs)
        seen = [[of[t][1][w] for t in different], *[[of[t][2][i] for t in different] for i in range(3)]]
        if len(different) < 2 or n_e[e] >= n or any(len(set(s)) < 2 for s in seen) or any(len(set(s)) < 0.75 * len(different) for s in seen[:2]):
            continue
        if log2(len(docs) * n / (n_t[w] * n_e[e])) >= 0.9 * log2(n / n_e[e]):
            out.add(w)
    return out


def all_spans(text, bad):
    order = {k: i for i, k in enumerate(["email", "ip", "card", "phone", "term"])}
    found = [(int(a), order[k], k, int(b)) for k, a, b in (s.split(":") for s in filter(None, base(text).split(",")))]
    for m in regex.finditer(rf"{sanitise.EMAIL}|{sanitise.WORD}", text or ""):
        if "@" not in m[0] and m[0].lower() in bad and not any(a < m.end() and m.start() < b for a, _, _, b in found):
            found.append((m.start(), 4, "term", m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def corpus():
    rng = random.Random(5)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(900)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [" ".join(some(rng.randrange(1, 60))) for _ in range(300)]
    for k, name in enumerate(NAMES):
        for _ in range(rng.randrange(2, 6)):  # far from each other, in unlike texts
            texts.append(" ".join([*some(30), name, *some(rng.randrange(5, 80)), f"mail{k}@x.example.com", *some(20)]))
        texts.append(" ".join([*some(9), name.upper(), *some(9)]))
    passage = " ".join(["Oneplace", *some(40), "desk@help.example.com"])
    texts += [passage, *[" ".join([*some(3), passage]) for _ in range(4)]]
    near = [*some(200), "Onlyhere", "near@copy.example.com"]
    for _ in range(30):
        edited = list(near)
        edited[rng.randrange(200)] = rng.choice(words)
        texts.append(" ".join(edited))
    return [*texts, *texts[300:310], "twice@one.example.com Solo twice@one.example.com Solo", None, "", "é@b.c éfoo@bar.com Kim"]


@pytest.mark.parametrize("which", ["made up", "table"])
def test_terms(spark, small_dir, which):
    texts = corpus() if which == "made up" else pd.read_parquet(f"{small_dir}/documents.parquet").text.tolist()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.h1, r.h2): sanitise_line(r.spans) for r in sanitise.spans(table).collect()}
    keys = table.select("doc_id", *contamination.text_key(F.col("text"))).collect()
    bad = terms(texts)
    assert {r.doc_id: found.get((r.h1, r.h2), "") for r in keys} == {k: all_spans(t, bad) for k, t in enumerate(texts)}
    if which == "made up":
        assert {n.lower() for n in NAMES} <= bad and not bad & {"onlyhere", "oneplace", "solo"}


def sanitise_line(spans):
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def test_one_document_is_no_evidence(spark):
    """A document that names an entity twice counts once, and a term of many other documents stays."""
    rows = [f"plain text {k} about harvests and other things" for k in range(200)]
    rows += ["Meeting Zarathon at z@x.example.com and later Zarathon again at z@x.example.com", "Zarathon is a river", "all boats of Zarathon are blue"]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sorted(r.text for r in sanitise.redact(table).collect() if "[TERM]" in r.text) == []


def test_merged_spans(spark):
    """Terms that overlap other spans are dropped, wherever the blocks of the fold end."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 127, 128, 129, 700):
        starts = np.cumsum(rng.integers(1, 9, n)).tolist()
        base_ = [(a, int(rng.integers(4)), "ip", a + int(rng.integers(1, 12))) for a in starts if rng.random() < 0.5]
        at, words = 0, []
        while at < (starts or [0])[-1]:
            end = at + int(rng.integers(1, 6))
            words.append((at, 4, "term", end))
            at = end + int(rng.integers(1, 4))
        want = sorted([*base_, *[t for t in words if not any(s[0] < t[3] and t[0] < s[3] for s in base_)]])
        kind = "array<struct<start:int,number:int,kind:string,end:int>>"
        got = spark.createDataFrame([(base_, words)], f"a {kind}, b {kind}").select(sanitise._merged(F.col("a"), F.col("b")).alias("m")).first().m
        assert list(map(tuple, got)) == want


def test_very_long_texts(spark):
    """120,000 words: what is taken out is right, and time does not grow with the square."""
    mails = " ".join(f"user{k}@host{k % 7}.example.com wrote" for k in range(30_000))
    words = [f"b{k % 60}" if k % 60 < 20 else f"w{k}" for k in range(120_000)]
    lines = "\n".join("menu of the site" if k % 2 else f"l{k}a l{k}b l{k}c l{k}d l{k}e" for k in range(60_000))
    table = spark.createDataFrame([(1, mails), (2, " ".join(words))], "doc_id long, text string")
    began = time.time()
    out = {r.doc_id: r.text for r in sanitise.redact(table).collect()}
    assert out[1] == " ".join(["[EMAIL] wrote"] * 30_000) and out[2] == " ".join(words)
    items = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(20)))], "item_id long, text string")
    left = {r.doc_id: r.text for r in contamination.decontaminate(table, items).collect()}
    assert left[1] == mails and left[2].split() == [w for w in words if w[0] == "w"]
    hosts = spark.createDataFrame([(k, f"menu of the site\n{' '.join(f'v{k}x{j}' for j in range(30))}", "h") for k in range(30)] + [(99, lines, "h")], "doc_id long, text string, source string")
    cleaned = {r.doc_id: r.text for r in quality.clean(hosts).collect()}
    assert cleaned[99] == "\n".join(f"l{k}a l{k}b l{k}c l{k}d l{k}e" for k in range(0, 60_000, 2)) and len(cleaned) == 31
    assert time.time() - began < 120


def test_null_host(spark):
    """A null source is a host of its own, apart from an empty one."""
    rows = [(k, f"menu of the site\n{' '.join(f'w{k}x{j}' for j in range(30))}", None if k < 8 else "") for k in range(16)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert quality.decisions(table).where("n_removed > 0").count() == 0
    assert quality.decisions(table.withColumn("source", F.lit("one"))).where("n_removed = 4").count() == 16
