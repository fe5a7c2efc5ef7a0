"""The corpus operators against brute force, and their cases: nulls, empty and very long texts, repeated rows, empty tables, other columns."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tabloom.llm import bitplanes, catalog, contamination, html_text, packing, quality, sanitise, shuffle, simhash, tokens, toxicity

ODD = [None, "", " \n", "one", "Word " * 5000, "same text here for all to see", "same text here for all to see", "é ñ ß 中文 \x00 \u00a0x", "a@b.co +1 (234) 555-1234", "x" * 60000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, h1 string, count string, __id string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", None if k == 3 else "s", len(t or ""), 1, "x", "y", "z") for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "no id at all", "en", "s", 1, 1, "x", "y", "z")], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small_dir):
    return pd.read_parquet(f"{small_dir}/documents.parquet").sort_values("doc_id")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_simhash(spark, small_dir, docs):
    def brute(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))

    got = {r.doc_id: r for r in simhash.query(spark, small_dir).collect()}
    fps = {k: brute(t) for k, t in zip(docs.doc_id, docs.text)}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == fps
    assert {k: r.component_id for k, r in got.items()} == reach(fps)


def reach(fps):
    ids, seen = sorted(fps), {}
    for k in ids:
        if k not in seen:
            todo = [k]
            seen[k] = k
            while todo:
                x = todo.pop()
                for y in ids:
                    if y not in seen and ((fps[x] ^ fps[y]) & (2**64 - 1)).bit_count() <= 4:
                        seen[y] = k
                        todo.append(y)
    return seen


@pytest.mark.parametrize("shard", [20000, 8])
def test_split_shards(spark, shard):
    rng = np.random.default_rng(1)
    values = {int(v) for v in rng.integers(-(2**63), 2**63 - 1, 60)}
    for _ in range(150):
        v = sorted(values)[int(rng.integers(40))] & (2**64 - 1)
        for j in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            v ^= 1 << int(j)
        values.add(v - (v >> 63 << 64))
    got = {r.node: r.label for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), shard=shard, pass_nodes=5000).collect()}
    want = reach({v: v for v in values})
    assert {v: got.get(v, v) for v in values} == want


def test_simhash_odd(odd, none):
    got = simhash.near_groups(odd)
    assert got.count() == 12 and got.where("doc_id in (0, 1, 2) and component_id = 0 and fp = 0").count() == 3
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 3, 4, 5, 7, 8, 9]
    assert simhash.near_groups(none).count() == 0


def test_main_text():
    page = '<html><head><title>t</title></head><body><nav><a href="/">menu, menu</a></nav><div class="ad">buy, now</div><article><h1>Head</h1><p>One &amp; <b>t</b>wo,<br>three.<p>Four\n five</article><div id="comments"><p>Nice, post, really</p></div><aside>side</aside><footer>&copy;</footer></body></html>'
    assert html_text.main_text(page) == "Head One & two, three. Four five"
    plain = "<div id=main><p>" + "Some long text, with commas, here. " * 9 + "</p><p>Short.</p></div><div class=sidebar><ul><li><a href=x>a</a></ul></div>"
    assert html_text.main_text(plain) == ("Some long text, with commas, here. " * 9).strip() + " Short."
    assert [html_text.main_text(x) for x in (None, "", "<p", "<script>x</script>")] == [""] * 4


def test_main_text_of_pages(spark, small_dir):
    pages = pd.read_parquet(f"{small_dir}/pages.parquet")
    got = {r.page_id: r for r in html_text.query(spark, small_dir).collect()}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got.values())
    assert not any("<" in r.text and "</" in r.text or "&copy;" in r.text for r in got.values())


def test_quality(spark, small_dir, docs):
    got = {r.doc_id: r for r in quality.query(spark, small_dir).collect()}
    for k, t in zip(docs.doc_id, docs.text):
        w, r = words(t), got[k]
        windows = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = {j + x for j in range(len(w) - 7) if windows[tuple(w[j : j + 8])] > 1 for x in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_frequent_lines(spark, odd, none):
    own = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(40)]
    rows = [(k, f"Menu  of the SITE\n{t}" if k < 20 else t, "h") for k, t in enumerate(own)] + [(100, "\n".join(["menu of the site"] * 8), "h")]
    base = " ".join(f"v{j}" for j in range(200))
    near = [(200 + k, base.replace(f"v{k * 3} ", f"u{k} ") + "\na line that all the near copies share with each other", "h") for k in range(30)]
    table = spark.createDataFrame([*rows, *near], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in quality.decisions(table).collect()}
    assert got[0].n_removed == 4 and got[0].kept and got[30].n_removed == 0 and not got[100].kept
    assert all(got[200 + k].n_removed == 0 and got[200 + k].kept for k in range(30))
    cleaned = {r.doc_id: r.text for r in quality.clean(table).collect()}
    assert cleaned[3] == own[3] and 100 not in cleaned
    assert quality.decisions(odd).count() == 12 and quality.clean(odd).columns == odd.columns and quality.decisions(none).count() == 0


@pytest.mark.parametrize("share", [60, 75, 90])
def test_lines_that_fill_their_pages(spark, share):
    """A template of 60 to 90 % of every page goes, and its pages with it; near copies with a word changed in any line stay whole."""
    menu = [" ".join(f"menu{j}x{i}" for i in range(10)) for j in range(share // 5)]
    pages = [(k, "\n".join([*menu, *[" ".join(f"w{k}x{j}x{i}" for i in range(10)) for j in range(20 - share // 5)]]), "h") for k in range(60)]
    copies = []
    for k in range(48):
        width, host = ((10, "h"), (5, "g"))[k % 2]
        mine = [[f"{host}{j}x{i}" for i in range(width)] for j in range(20)]
        mine[k // 2 % 20][2 + k // 40] = f"other{k}"
        copies.append((1000 + k, "\n".join(map(" ".join, mine)), host))
    got = {r.doc_id: r for r in quality.decisions(spark.createDataFrame([*pages, *copies], "doc_id long, text string, source string")).collect()}
    assert all(got[k].n_removed == 2 * share and not got[k].kept for k in range(60))
    assert all(got[1000 + k].n_removed == 0 and got[1000 + k].kept for k in range(48))


def test_limit_of_a_line(spark, monkeypatch):
    """A host's copies don't raise the limit of its lines, and the absolute limit holds on a large host."""
    own = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(100)]
    rows = [(k, f"menu of the site\n{t}" if k < 20 else t, "h") for k, t in enumerate(own)] + [(1000 + k, own[-1], "h") for k in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.n_removed for r in quality.decisions(table).collect()}
    assert all(got[k] == (4 if k < 20 else 0) for k in range(100)) and got[1000] == 0
    big = spark.createDataFrame([(k, ("menu of the site\n" if k < 20 else "") + " ".join(f"w{k}x{j}" for j in range(30)), "h") for k in range(3000)], "doc_id long, text string, source string")
    monkeypatch.setattr(quality, "MOST_DOCS", 15, raising=False)
    assert quality.decisions(big).where("n_removed = 4").count() == 20 == quality.decisions(big).where("n_removed > 0").count()


def test_shuffle(spark, tmp_path, odd, none, docs, small_dir):
    got = shuffle.query(spark, small_dir).toPandas()
    assert dict(zip(got.doc_id, got["size"])) == {k: len(t.encode()) + 1 for k, t in zip(docs.doc_id, docs.text)}
    assert dict(zip(got.doc_id, got.text_crc32)) == {k: zlib.crc32(t.encode()) for k, t in zip(docs.doc_id, docs.text)}
    sizes = got.groupby("shard").slot.agg(lambda s: sorted(s) == list(range(len(s)))), got.groupby("shard").size()
    assert sizes[0].all() and sizes[1].max() - sizes[1].min() <= 1 and sizes[1].sum() == len(docs)
    out = shuffle.external_shuffle(odd, str(tmp_path / "a"), shards=3, bucket_bytes=1000)
    assert out.count() == 12 and "lang" in out.columns and shuffle.external_shuffle(none, str(tmp_path / "b")).count() == 0


def test_contamination(spark, small_dir, odd, none):
    with duckdb.connect() as con:
        for t in ("documents", "benchmark"):
            con.sql(f"create view {t} as select * from '{small_dir}/{t}.parquet'")
        want = con.sql(catalog.SQL["op6_benchmark_decontamination"]).df()
    got = contamination.query(spark, small_dir).toPandas()[want.columns]
    key = lambda f: sorted(map(tuple, f.astype(str).values.tolist()))
    assert key(got) == key(want) and got.contaminated.any()
    items = spark.createDataFrame([(1, "See, all of"), (2, "Text here"), (2, "TEXT here"), (3, None), (4, "one")], "item_id long, text string")
    r = {x.doc_id: x for x in contamination.hits(odd, items).collect()}
    assert (r[5].n_hit, r[5].n_items, r[5].items_sha256) == (2, 1, hashlib.sha256(b"2").hexdigest()) and r[3].n_hit == 1 and r[0].n_words == 0
    left = {x.doc_id: x.text for x in contamination.decontaminate(odd, items).collect()}
    assert left[5] == "same for all to see" and 3 not in left and left[0] is None
    assert contamination.hits(none, items).count() == 0 and contamination.hits(odd, items.limit(0)).where("n_hit > 0").count() == 0


def test_toxicity(spark, odd, none):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 90}" for j in range(40)) + (" awful rubbish" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.drop("toxic"), table.select("doc_id", "toxic"))
    out = toxicity.score(table, model).join(table, "doc_id").where(toxicity.held_out()).collect()
    assert len(out) > 80 and sum((r.score >= 0.3) == r.toxic for r in out) >= 0.95 * len(out) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(odd, model).count() == 12 and toxicity.train(none, table.select("doc_id", "toxic"))[2] < 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens(name, docs):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    rng = np.random.default_rng(0)
    signs = [" ", "  ", "\n", "\t", "a", "B", "'s", "é", "1", "!", ",", ".", "<|", "|>", "\u0301", "\x1c", "\u3000", "Σ", "中", "İ", "\x00", "😀", "endoftext"]
    texts = [*docs.text, *[t or "" for t in ODD], *["".join(rng.choice(signs, int(rng.integers(1, 15)))) for _ in range(1500)]]
    assert [i.tolist() for i in tokens.Encoder(public_tokenizers.path(name)).all_ids(pd_to_arrow(texts))] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def pd_to_arrow(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())


def test_planes():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, "<u4"), np.zeros(7, "<u4"), rng.integers(0, 2**32, 1001).astype("<u4"), rng.integers(0, 50000, 65536).astype("<u4")):
        assert (bitplanes.from_planes(bitplanes.to_planes(ids), len(ids)) == ids).all()


def test_bit_planes(spark, small_dir, docs, odd, none, tmp_path):
    plain, at = Tokenizer.from_file(public_tokenizers.path(bitplanes.VOCABULARY)), 0
    for r, (k, t) in zip(bitplanes.query(spark, small_dir).orderBy("doc_id").collect(), zip(docs.doc_id, docs.text), strict=True):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    bitplanes.write(odd, str(tmp_path / "a"), block=64)
    back = bitplanes.read(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert len(back) == 12 and back[0].doc_id is None and all(len(r.ids) == 4 * r.n_tokens for r in back)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(back, back[1:]))
    bitplanes.write(none, str(tmp_path / "b"))
    assert bitplanes.read(spark, str(tmp_path / "b")).count() == 0


def test_packing(spark, small_dir, docs, odd, none, tmp_path):
    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    got = packing.query(spark, small_dir).toPandas()
    assert sorted(got.sequence_id) == list(range(len(got))) and (got.offset == 0).all() and all(n & (n - 1) == 0 and n <= 2048 for n in got.length)
    by = {k: g.sort_values("start") for k, g in got.groupby("doc_id")}
    for k, t in zip(docs.doc_id, docs.text):
        ids, at = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for r in by[k].itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    out = packing.pack(odd, str(tmp_path / "a")).where("doc_id in (0, 1)").collect()
    assert [(r.start, r.length, r.doc_tokens) for r in out] == [(0, 1, 1)] * 2 and packing.pack(none, str(tmp_path / "b")).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(t):
    def luhn(x):
        return sum((v := int(c) * (1 + k % 2)) - 9 * (v > 9) for k, c in enumerate(reversed(x))) % 10 == 0

    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if name == "email" or name == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or name == "card" and 12 <= len(d) <= 19 and luhn(d) or name == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, name, m.end()))
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(out))


def test_base_spans(spark, docs):
    texts = [*docs.text, *ODD, "a@b.com_x@y.org a@b.c@d.e 1.2.3.4.5 256.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1112 +1 (234) 555-1234. ++49 30 12345678+49", "☃a%b@c-d.e.f 4111111111111111x@y.zz", "1" * 30000, "a" * 30000 + "@" + "b." * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("text", F.coalesce("text", F.lit("")))
    got = {r.k: r.s for r in rows.select("k", sanitise._lines(sanitise.base_spans(F.col("text"))).alias("s")).collect()}
    assert got == {k: base(t) for k, t in enumerate(texts)}


def test_disclosing_terms(spark, odd, none):
    rows = [f"Some plain text number {k} about the weather and the harvest" for k in range(200)]
    rows += [f"Meeting {a} with Zarathon at zara@x.example.com about {b}" for a, b in (("alpha", "wheat"), ("later", "barley"), ("never", "maize"))]
    rows += ["Zarathon went home", *["copy of Quibbleton by q@z.example.com in one passage"] * 9]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in sanitise.redact(table).collect()}
    assert "[EMAIL]" in out[200] and "[TERM]" in out[200] and out[203] == "[TERM] went home" and "Quibbleton" in out[204] and out[5] == rows[5]
    assert sanitise.redact(odd).columns == odd.columns and sanitise.redact(odd).count() == 12 and sanitise.spans(none).count() == 0


def test_pipeline(spark, small_dir, docs):
    out = corpus_pipeline.run(spark, small_dir).drop("ids").toPandas()
    assert 0 < out.doc_id.nunique() < len(docs) and sorted(out.sequence_id) == list(range(len(out)))
    good = quality.query(spark, small_dir).where("kept").count()
    assert out.doc_id.nunique() >= 0.8 * good
