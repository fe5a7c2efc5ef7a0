"""Encoding with the tokenizers library, a piece of text at a time.

The vocabularies used here split a text into words, numbers, signs and white space before they look for merges. Texts
are cut where they split whatever stands around: before a single space, around a single line break, and before a comma
or full stop that follows a Latin letter or digit. The distinct pieces of many texts are found by Arrow, encoded once
and looked up by a 128-bit hash after that, and the ids are gathered by numpy. A text with white space, signs or special
tokens for which these cuts might not hold is encoded whole. Texts are taken CHUNK bytes at a time; a longer one is
encoded in parts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from tokenizers import Tokenizer

from tabloom.llm.common import give_back

# A Python worker has one core; threads of the library would each keep memory of their own.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

_LATIN = "A-Za-z0-9À-ÖØ-öø-ɏ"
#: Special tokens, the mark that is used for cuts, white space that isn't ASCII, and signs before a comma or full stop.
_NEVER = rf"<\||\x00|[\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{180e}}\x{{2000}}-\x{{200b}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]|[^{_LATIN} \n][,.]"
_SPACES = _NEVER + r"|[ \t\n\r\f\v][ \t\n\r\f\v]|[ \n][,.]"
#: Letters whose lower case may depend on what follows, or that compose with it.
_CASE = _NEVER + r"|[\x{130}\x{300}-\x{10ffff}]"
OTHER = re.compile(rf"[^{_LATIN} ]")
#: Words that are learnt in one text.
TOGETHER = 256
#: Bytes of known pieces at which all are forgotten.
CACHE = 48 << 20
#: Characters; longer pieces are encoded but not kept.
KEPT = 64
#: Bytes of text that are cut at once, and characters of a part of a longer text.
CHUNK = 2 << 20
PART = 1 << 20
#: The end of a word before a single space and another word: no vocabulary has a token across it.
SAFE = re.compile(r"[A-Za-z0-9] (?=[A-Za-z])")


class _Store:
    """The ids of known pieces, in numpy arrays of some 40 bytes a piece: sorted 128-bit hashes, and where a piece's ids lie in one buffer.

    New pieces are a sorted run of their own; a run is merged with the one before it once it is a quarter as long.
    """

    def __init__(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids, self.used = np.empty(1 << 16, "<u4"), 0

    def nbytes(self) -> int:
        return 24 * sum(len(run[0]) for run in self.runs) + 4 * self.used

    def find(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece start and how many there are; -1 and 0 for one that isn't known."""
        starts, sizes = np.full(len(high), -1, np.int32), np.zeros(len(high), np.int32)
        todo = np.argsort(high)
        for known, tail, at, n in self.runs:
            place = np.minimum(np.searchsorted(known, high[todo]), len(known) - 1)
            same = (known[place] == high[todo]) & (tail[place] == low[todo])
            place, hit = place[same], todo[same]
            starts[hit], sizes[hit] = at[place], n[place]
            todo = todo[~same]
        return starts, sizes

    def put(self, ids: np.ndarray) -> int:
        """Appends to the buffer and tells where."""
        start, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            more = np.empty(max(self.used, len(self.ids) * 3 // 2), "<u4")
            more[:start] = self.ids[:start]
            self.ids = more
        self.ids[start : self.used] = ids
        return start

    def keep(self, high: np.ndarray, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        if not len(high):
            return
        run = (high, low, starts, sizes)
        while True:
            order = np.argsort(run[0], kind="stable")
            run = tuple(a[order] for a in run)
            if not self.runs or 4 * len(run[0]) < len(self.runs[-1][0]):
                break
            run = tuple(map(np.concatenate, zip(self.runs.pop(), run, strict=True)))
        self.runs.append(run)


class Encoder:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.store = _Store()
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.spaces = ids(" a") != ids("a")
        self.lower = ids("A") == ids("a")

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        if self.spaces:
            cuts = ((" ", "\0 "), ("\n", "\0\n\0"), (",", "\0,"), (".", "\0."))
        else:
            cuts = ((" ", "\0"), ("\n", "\0"), (",", "\0,"), (".", "\0."))
            texts = pc.ascii_lower(texts) if self.lower else texts
        for sign, cut in cuts:
            texts = pc.replace_substring(texts, sign, cut)
        return pc.split_pattern(texts, "\0")

    def _words_together(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[str]]:
        """Ids and sizes of words of letters, encoded many in one text, which costs half as much as one by one; words for which that fails."""
        out, sizes, failed = [], [], []
        parts = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for first in range(0, len(parts), 64):
            some = parts[first : first + 64]
            texts = ["".join(w if self.spaces and w[0] == " " else "\n" + w for w in part) for part in some]
            for part, e in zip(some, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                # a line break is a word of its own where white space counts
                at = np.cumsum([1 + (self.spaces and w[0] != " ") for w in part]) - 1
                of, ids = np.array(e.word_ids, np.int64), np.array(e.ids, "<u4")
                if not len(of) or of[-1] != at[-1]:
                    failed += part
                    out.append(np.empty(0, "<u4"))
                    sizes.append(np.full(len(part), -1, np.int32))
                    continue
                starts, ends = np.searchsorted(of, at, "left"), np.searchsorted(of, at, "right")
                out.append(ids[_ranges(starts, ends - starts)])
                sizes.append((ends - starts).astype(np.int32))
        return out, sizes, failed

    def _learn(self, words: list[str], places: np.ndarray, high: np.ndarray, low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> int:
        """Encodes the words at the places and fills in where their ids lie; returns how much of the buffer is to stay."""
        together = [k for k in places.tolist() if (w := words[k]).removeprefix(" ").isalpha() and not OTHER.search(w)]
        out, n, failed = self._words_together([words[k] for k in together])
        n = np.concatenate([*n, np.zeros(0, np.int32)])
        at = np.array(together, np.int64)
        good = n >= 0
        alone = np.setdiff1d(places, at[good])
        at, n = at[good], n[good]
        starts[at] = self.store.put(np.concatenate([*out, np.zeros(0, "<u4")])) + np.cumsum(n) - n
        sizes[at] = n
        stay = self.store.used
        # short ones first, as long ones aren't kept
        long = np.fromiter((len(words[k]) > KEPT for k in alone.tolist()), bool, len(alone))
        for some in (alone[~long], alone[long]):
            stay = self.store.used
            for first in range(0, len(some), 1024):
                of = some[first : first + 1024]
                found = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in of.tolist()], add_special_tokens=False)]
                n = np.fromiter(map(len, found), np.int32, len(found))
                starts[of] = self.store.put(np.fromiter(chain.from_iterable(found), "<u4", int(n.sum()))) + np.cumsum(n) - n
                sizes[of] = n
        kept = np.concatenate([at, alone[~long]])
        self.store.keep(high[kept], low[kept], starts[kept], sizes[kept])
        return stay

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def all_ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none), as little-endian unsigned 32-bit integers. A few megabytes of texts at a time need some fifty times as much memory at most."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        whole = pc.match_substring_regex(texts, _SPACES if self.spaces else _CASE if self.lower else _NEVER)
        pieces = self._pieces(pc.if_else(whole, "", texts))
        flat = pieces.flatten().dictionary_encode()
        words, codes, offsets = flat.dictionary.to_pylist(), flat.indices.to_numpy(), pieces.offsets.to_numpy()
        del flat, pieces
        if self.store.nbytes() > CACHE:
            self.store = _Store()
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
        high, low = hashes[:, 0].copy(), hashes[:, 1].copy()
        starts, sizes = self.store.find(high, low)
        stay = self._learn(words, np.flatnonzero(starts < 0), high, low, starts, sizes)
        # each id of each piece
        counts = sizes[codes]
        every = self.store.ids[_ranges(starts[codes], counts)]
        self.store.used = stay
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)))[offsets]
        out = [every[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self._whole(texts[k].as_py())
        return out

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of one text, however long: it is encoded in parts."""
        parts = [self.all_ids(pa.array([part], pa.string()))[0] for part in text_parts(text or "")]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then the same from starts[1] and so on."""
    ends = np.cumsum(counts, dtype=np.int32)
    total = int(ends[-1]) if len(ends) else 0
    out = np.repeat((starts - (ends - counts)).astype(np.int32), counts)
    out += np.arange(total, dtype=np.int32)
    return out


def text_parts(text: str, part: int = PART) -> Iterator[str]:
    """A text in parts of about `part` characters, cut before single spaces between ASCII letters or digits, where every vocabulary splits."""
    at = 0
    while len(text) - at > part and (m := SAFE.search(text, at + part)):
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in order, in tables of about CHUNK bytes of text; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        first = 0
        for k, n in enumerate(lengths.tolist()):
            if size and size + n > CHUNK:
                held.append(batch.slice(first, k - first))
                yield pa.Table.from_batches(held)
                held, size, first = [], 0, k
            size += n + 1
        held.append(batch.slice(first))
    if sum(map(len, held)):
        yield pa.Table.from_batches(held)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The doc_ids and ids, with the end id, of a few megabytes of texts at a time."""
    last, of = np.array([end], "<u4"), encoder(path)
    for table in _bounded(batches):
        texts = table.column("text").combine_chunks()
        found = [of.ids(texts[0].as_py())] if len(texts) == 1 else of.all_ids(texts)
        yield table.column("doc_id").to_pylist(), [np.concatenate((ids, last)) for ids in found]
    give_back()
