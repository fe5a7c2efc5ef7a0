"""Near-duplicates of similarity 0.8 or more over five-word shingles, against all pairs."""

import random

import pandas as pd
import pytest

from tabloom.llm import simhash


def sets(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def clusters(texts, at=0.8):
    """Lists of places of texts that are connected by pairs of at least that similarity."""
    of, parent = [sets(t) for t in texts], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(of[i], of[j]) >= at:
                parent[root(i)] = root(j)
    return [root(k) for k in range(len(texts))]


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for _ in range(40):
        first = some(rng.randrange(60, 400))
        texts.append(" ".join(first))
        for _ in range(rng.randrange(5)):
            edited = list(first)
            for _ in range(rng.randrange(1 + len(first) // 60)):
                edited[rng.randrange(len(first))] = "new%d" % rng.randrange(9999)
            texts.append(" ".join(edited))
    half = some(150)  # a template that fills half of its texts joins none of them
    texts += [" ".join([*half, *some(150)]) for _ in range(40)]
    base = some(300)
    for _ in range(120):  # one large group
        edited = list(base)
        edited[rng.randrange(300)] = "new%d" % rng.randrange(9999)
        texts.append(" ".join(edited))
    return [*texts, *texts[:5], None, "", " \n", "one two", "One  TWO", "three"]


@pytest.mark.parametrize(("shard", "pass_nodes"), [(20_000, 10_000), (16, 40)])
def test_alike_groups(spark, shard, pass_nodes):
    texts = corpus(1)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.label) for r in simhash.alike_groups(table, shard=shard, pass_nodes=pass_nodes).collect()}
    want = clusters(texts)
    assert len(got) == len(texts)
    joined = [(i, j) for i in range(len(texts)) for j in range(i) if (got[i] == got[j]) != (want[i] == want[j])]
    assert not joined


def test_recall_of_pairs(spark):
    """Of pairs just above 0.8 nearly all are linked, of pairs just below none."""
    rng = random.Random(2)
    texts, above = [], 0
    while len(texts) < 1200:
        first = [f"w{rng.randrange(5000)}" for _ in range(300)]
        edited = list(first)
        for at in rng.sample(range(300), rng.randrange(5, 9)):
            edited[at] = "x%d" % rng.randrange(10**6)
        texts += [" ".join(first), " ".join(edited)]
    got = {r.doc_id: bytes(r.label) for r in simhash.alike_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    right = 0
    for k in range(0, len(texts), 2):
        same = jaccard(sets(texts[k]), sets(texts[k + 1])) >= 0.8
        above += same
        right += same and got[k] == got[k + 1]
        assert same or got[k] != got[k + 1]
    assert above > 200 and right >= 0.98 * above


def test_shared_ids(spark):
    """Rows that share a doc_id are told apart by their texts; of a group one row stays, whatever is null or repeated."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    rows = [(1, a, "p"), (5, a, "q"), (5, b, "r"), (None, b, "s"), (7, c, "t"), (7, c, "t"), (None, "alone", "u"), (None, "alone", "v"), (9, None, "w"), (10, "", "x"), (5, "other words", "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, __hash string")
    got = simhash.near_dedup(table)
    assert got.columns == table.columns
    kept = sorted((r.doc_id or 0, r.text or "", r["__hash"]) for r in got.collect())
    assert len(kept) == 6 and {k[2] for k in kept} - {"u", "v"} == {"p", "r", "t", "w", "y"}
    for ids in ([(5, a), (5, b)], [(1, a), (5, a), (5, b)]):
        left = simhash.near_dedup(spark.createDataFrame(ids, "doc_id long, text string")).collect()
        assert sorted(map(tuple, left)) == sorted({(ids[0][0], a), (5, b)})
    assert simhash.near_dedup(table.limit(0)).count() == 0


def test_near_dedup_of_table(spark, small_dir):
    docs = pd.read_parquet(f"{small_dir}/documents.parquet").sort_values("doc_id")
    ids, groups = docs.doc_id.tolist(), clusters(docs.text.tolist())
    first = {}
    for k, g in zip(ids, groups, strict=True):
        first.setdefault(g, k)
    got = simhash.near_dedup(spark.read.parquet(f"{small_dir}/documents.parquet"))
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(first.values())


def test_templated_pages_are_not_compared():
    """Thousands of pages of one template drop out of a shard before they are compared; those that are alike stay."""
    import time

    import numpy as np

    rng = np.random.default_rng(8)
    template = rng.integers(0, 1 << 32, 300, np.uint32)
    pages = [np.unique(np.concatenate([template, rng.integers(0, 1 << 32, 114, np.uint32)])) for _ in range(20_000)]
    pages.append(np.unique(np.concatenate([pages[7][:-3], rng.integers(0, 1 << 32, 2, np.uint32)])))
    began = time.time()
    assert simhash.may_be_alike(pages, 0.8) == [7, 20_000]
    assert time.time() - began < 60
    cut_off = [rng.integers(0, 1 << 32, simhash.LEAST, np.uint32) for _ in range(3)]
    assert simhash.may_be_alike(cut_off, 0.8) == [0, 1, 2] and simhash.may_be_alike(cut_off, 0.8, None) == []


def test_long_texts_over_whole_sets(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        first = [f"w{rng.randrange(9000)}" for _ in range(3000)]
        texts.append(" ".join(first))
        for k in (55, 62, 66, 70, 75):  # around the limit
            edited = list(first)
            for at in rng.sample(range(3000), k):
                edited[at] = "new%d" % rng.randrange(99999)
            texts.append(" ".join(edited))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.label) for r in simhash.alike_groups(table, most=None).collect()}
    want = clusters(texts)
    assert not [(i, j) for i in range(len(texts)) for j in range(i) if (got[i] == got[j]) != (want[i] == want[j])]
