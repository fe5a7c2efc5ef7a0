"""Periodic runs of words, by the method of Kolpakov and Kucherov.

A run is a stretch of words with smallest period q (words q apart are identical) and a length of `least` and 2q at
least that no neighbouring word extends. A text is cut into its Lempel-Ziv factors by a suffix automaton. Main's
algorithm then finds, at the boundary of each two factors, the runs that touch or cross it; a run strictly within a
factor is a copy of one within the factor's earlier occurrence. All of it takes time and memory linear in the text.

Every word of a run lies in a window of least // 2 words that occurs twice. So only stretches of such words are searched,
which in most texts are few; this loses no run.

A null or empty text has no words and no runs; a null doc_id counts as an empty one where it decides what is planted;
repeated rows each give a row; an empty table gives an empty one; other columns are ignored by runs() and kept by collapse().
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import give_back, packed, session, table, unpacked

LEAST = 12
Run = tuple[int, int, int]
_MIX = np.random.default_rng(20240612).integers(1, 1 << 62, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: only ASCII white space


class Automaton:
    """The suffix automaton of a sequence of integers from 0: each state's first transition lies in arrays, others in a dict."""

    def __init__(self, word: list[int]) -> None:
        self.on, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        self.first = array("i", [-1])  # where the earliest occurrence of the state's factors ends
        link, length = array("i", [-1]), array("i", [0])
        on, to, more, first = self.on, self.to, self.more, self.first
        last = 0
        for i, c in enumerate(word):
            new = len(on)
            for a, x in ((on, -1), (to, -1), (first, i), (link, 0), (length, i + 1)):
                a.append(x)
            p, q = last, -1
            while p >= 0:
                if on[p] < 0:
                    on[p], to[p] = c, new
                elif on[p] == c:
                    q = to[p]
                    break
                elif c in (rest := more.setdefault(p, {})):
                    q = rest[c]
                    break
                else:
                    rest[c] = new
                p = link[p]
            if p >= 0:
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(on)
                    for a, x in ((on, on[q]), (to, to[q]), (first, first[q]), (link, link[q]), (length, length[p] + 1)):
                        a.append(x)
                    if q in more:
                        more[clone] = dict(more[q])
                    link[q] = link[new] = clone
                    while p >= 0:
                        if on[p] == c and to[p] == q:
                            to[p] = clone
                        elif p in more and more[p].get(c) == q:
                            more[p][c] = clone
                        else:
                            break
                        p = link[p]
            last = new

    def step(self, state: int, c: int) -> int:
        return self.to[state] if self.on[state] == c else self.more[state][c]


def factors(word: list[int]) -> Iterator[tuple[int, int, int]]:
    """(start, length, earlier start) of the Lempel-Ziv factors: the longest stretch that starts earlier too, or a new letter with earlier start -1."""
    known, n, i = Automaton(word), len(word), 0
    first = known.first
    while i < n:
        state, j = 0, i
        while j < n and first[after := known.step(state, word[j])] < j:
            state, j = after, j + 1
        if j == i:
            yield i, 1, -1
            i += 1
        else:
            yield i, j - i, first[state] - (j - i) + 1
            i = j


def prefixes(s: list[int]) -> list[int]:
    """For each place of s, how many letters from there on equal the letters from the start."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def crossing(word: list[int], start: int, at: int, end: int, least: int) -> Iterator[Run]:
    """(start, end, period) of the runs in word[start:end] that touch or cross `at` and that no neighbour in the whole word extends; also with multiples of the period."""
    t, v, n = word[start:at], word[at:end], len(word)
    ahead = prefixes([*v, -1, *t, *v])
    back = prefixes([*t[::-1], -1, *v[::-1], *t[::-1]])
    a, b = len(t), len(v)
    for p in range(1, b + 1):  # a whole period to the right
        left, right = min(back[a + 1 + b - p], a), ahead[p] if p < b else 0
        if left + right >= p and p + left + right >= least:
            yield from _whole(word, n, at - left, at + p + right, p, start, end)
    for p in range(1, a + 1):  # a whole period to the left
        left, right = back[p] if p < a else 0, min(ahead[b + 1 + a - p], b)
        if left + right >= p and p + left + right >= least:
            yield from _whole(word, n, at - p - left, at + right, p, start, end)


def _whole(word: list[int], n: int, s: int, e: int, p: int, start: int, end: int) -> Iterator[Run]:
    if not (s == start and s and word[s - 1] == word[s - 1 + p]) and not (e == end and e < n and word[e] == word[e - p]):
        yield s, e, p


def runs_of_ids(word: list[int], least: int = LEAST) -> dict[tuple[int, int], int]:
    """(start, end): period of all runs."""
    found: dict[tuple[int, int], int] = {}
    at: dict[int, list[tuple[int, int]]] = {}

    def add(s: int, e: int, p: int) -> None:
        if (s, e) not in found:
            at.setdefault(s, []).append((s, e))
        found[s, e] = min(p, found.get((s, e), p))

    before, n = 0, len(word)
    for b, length, source in [*factors(word), (n, 0, -1)]:
        for run in crossing(word, max(0, b - 2 * before - length), b, b + length, least):
            add(*run)
        if source >= 0 and length >= least + 2:
            shift = b - source
            for s in range(b + 1, b + length - least):
                for of in at.get(s - shift, ()):
                    if of[1] + shift < b + length:
                        add(s, of[1] + shift, found[of])
        before = length
    return found


def runs_of(words: list, least: int = LEAST) -> list[Run]:
    """(start, length, period) of all runs of the words, by start, then period."""
    n, gram = len(words), min(least // 2, len(_MIX))
    if least < 2:
        raise ValueError("a run has two words at least")
    if n < least:
        return []
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    x = ids.view(np.uint64)
    windows = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        windows += x[k : k + len(windows)] * _MIX[k]
    windows ^= windows >> np.uint64(31)
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    again = np.isin(windows, twice)
    step = np.zeros(n + 1, np.int64)
    step[:-gram] += again
    step[gram:] -= again
    inside = np.concatenate(([0], (np.cumsum(step)[:-1] > 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(inside))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= least:
            part = np.unique(ids[a:b], return_inverse=True)[1].tolist()
            out += [(a + s, e - s, p) for (s, e), p in runs_of_ids(part, least).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[Run]) -> list:
    """The words but for those that come after the first period of a run they are in."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    at = np.array(runs, np.int64)
    np.add.at(step, at[:, 0] + at[:, 2], 1)
    np.add.at(step, at[:, 0] + at[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(step)[:-1] == 0).tolist()]


def _found(least: int, change: Callable[[object, list[bytes]], list[bytes]] | None, of: Callable[[list[bytes], list[Run]], tuple], names: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                words = change(doc, words) if change else words
                rows.append(of(words, runs_of(words, least)))
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            old = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in old), *new], names=[*old, *names])
        give_back()

    return run


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs) of every row; runs: array of (start, length, period) by start, then period."""
    session(docs)

    def of(words: list[bytes], found: list[Run]) -> tuple:
        return len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found]

    return docs.select("doc_id", "text").mapInArrow(_found(least, None, of, ["n_words", "runs"], [pa.int64(), pa.list_(_RUN)]), f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, runs array<struct<start:long,length:long,period:long>>")


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs, each text with runs cut to the first period of each, its words then joined by one space; texts without runs stay as they are."""
    session(docs)
    rows = packed(docs)

    def of(words: list[bytes], found: list[Run]) -> tuple:
        return (b" ".join(collapsed(words, found)).decode() if found else None,)

    rest = rows.schema["__rest"].dataType.simpleString()
    new = rows.select("doc_id", "text", F.struct("text", "__rest").alias("__row")).mapInArrow(_found(least, None, of, ["__new"], [pa.string()]), f"doc_id {dict(docs.dtypes)['doc_id']}, __row struct<text:string,__rest:{rest}>, __new string")
    return unpacked(new.select("doc_id", F.coalesce("__new", "__row.text").alias("text"), F.col("__row.__rest").alias("__rest")), docs)


def planted(doc: object, words: list[bytes]) -> list[bytes]:
    """The words, of every tenth document or so with a periodic end, as the query's contract has it."""
    h = zlib.crc32(b"" if doc is None else str(doc).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def _digests(words: list[bytes], found: list[Run]) -> tuple:
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    text = b" ".join(collapsed(words, found))
    return len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    session(docs)
    longs, texts = ["n_runs", "start", "length", "period", "exponent_milli"], ["runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * len(longs) + [pa.string()] * len(texts)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join([f"{c} long" for c in longs] + [f"{c} string" for c in texts])
    return docs.select("doc_id", "text").mapInArrow(_found(LEAST, planted, _digests, [*longs, *texts], kinds), schema)
