"""Quality rules: counts of each text, and lines that are frequent across the documents of a host.

A text fails the base rules if it has fewer than MIN_WORDS words or if words in repeated 8-word windows make up more
than MAX_REPEATED percent. The method then hashes the normalised lines (lower case, single spaces) of all texts and
counts for each host, which is the column `source`, the distinct documents a line is in. Lines in more than LEAST_DOCS
documents and in more than SHARE of the host's documents, or in more than MOST_DOCS, are removed, and documents that
keep less than LEFT of their words or fewer than MIN_WORDS are rejected. Equal texts count as one document. Near copies share all their lines without
any of them being boilerplate; so a line's documents must also differ in content: of two min-hashes over 3-word
shingles, at least one must have DIVERSE as many values among them as there are documents. The min-hashes are taken over
a document's own lines: those that are not themselves candidates for removal on the host and share no min-hash with one,
as an edited copy of a candidate does. A document without lines of its own counts by the min-hashes of its whole text.

Null and empty texts have no words and are rejected by the base rules. A null source is a host of its own. Repeated rows
each get their row. An empty table gives an empty one. Other columns are ignored by decisions() and kept by clean().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import cut, few, give_back, packed, session, small, table, unpacked, without

MIN_WORDS = 20
MAX_REPEATED = 30
WINDOW = 8
PAIRS = 8
LEAST_DOCS = 10
SHARE = 0.01
#: A line in more documents than this goes however large its host is.
MOST_DOCS = 1000
DIVERSE = 0.5
LEFT = 0.5
SYMBOLS = "#*$%&|<>"
CACHE = 100_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _repeated(h: np.ndarray) -> int:
    """Words in windows that are found twice or more."""
    n = len(h) - WINDOW + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolled = rolled * _MIX[:1] + h[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order[1:]] == rolled[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    places: dict[bytes, list[int]] = {}
    for k in np.flatnonzero(hit).tolist():
        places.setdefault(h[k : k + WINDOW].tobytes(), []).append(k)
    covered = np.zeros(len(h) + 1, np.int64)
    for found in places.values():
        if len(found) > 1:
            at = np.array(found)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def _sketches(h: np.ndarray) -> tuple[int, int]:
    """Two min-hashes over the shingles of three words, or over the words if there are fewer."""
    if not len(h):
        return 0, 0
    s = h if len(h) < 3 else h[:-2] * _MIX[0] + h[1:-1] * _MIX[1] + h[2:] * _MIX[2]
    s = (s ^ (s >> np.uint64(29))) * _MIX[3]
    t = (s ^ (s >> np.uint64(32))) * _MIX[2]
    return int((s ^ (s >> np.uint64(31))).min().view(np.int64)), int((t ^ (t >> np.uint64(29))).min().view(np.int64))


def _line_sketches(h: np.ndarray, sizes: list[int]) -> list[list[int | None]]:
    """Min-hashes of 32 bits for each line, null for one without words: two over shingles of three words (words, if there
    are fewer) and two that an edited copy of the line shares, over pairs of words (words, below PAIRS of them)."""
    of = np.array(sizes, np.int64)
    full = np.flatnonzero(of)
    outs: list[list[int | None]] = [[None] * len(sizes) for _ in range(4)]
    if not len(full):
        return outs
    n, ends = of[full], np.cumsum(of[full])
    size, rest = np.repeat(n, n), np.repeat(ends, n) - np.arange(len(h))
    one, three = h * _MIX[0], h * _MIX[0]
    two = one.copy()
    two[:-1] += h[1:] * _MIX[1]
    three[:-2] += h[1:-1] * _MIX[1] + h[2:] * _MIX[2]
    for at, s, across in ((0, np.where(size < 3, one, three), (size >= 3) & (rest < 3)), (2, np.where(size < PAIRS, one, two), (size >= PAIRS) & (rest < 2))):
        s = (s ^ (s >> np.uint64(29))) * _MIX[3]
        t = (s ^ (s >> np.uint64(32))) * _MIX[2]
        for out, x in ((outs[at], s ^ (s >> np.uint64(31))), (outs[at + 1], t ^ (t >> np.uint64(29)))):
            x = (x >> np.uint64(32)).astype(np.uint32)
            x[across] = 0xFFFFFFFF
            for k, v in zip(full.tolist(), np.minimum.reduceat(x, ends - n).view(np.int32).tolist(), strict=True):
                out[k] = v
    return outs


def _signed(h: int) -> int:
    """As Spark's xxhash64 gives it."""
    return h - (1 << 64) if h >> 63 else h


def measures(text: str | None, hashes: dict[bytes, int]) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    seen, n_dup, lines, sizes = set(), 0, [], []
    for line in data.split(b"\n"):
        tokens = line.lower().split()
        if tokens:
            n_dup += line in seen
            seen.add(line)
            lines.append(_signed(xxhash.xxh64_intdigest(b" ".join(tokens), 42)))
        else:
            lines.append(None)
        sizes.append(len(tokens))
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), n_dup, _repeated(h), _signed(xxhash.xxh64_intdigest(data, 42)), *_sketches(h), lines, sizes, *_line_sketches(h, sizes)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash", "sketch_a", "sketch_b")
LINE_SKETCHES = ("own_a", "own_b", "near_a", "near_b")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _Hashes()
    for batch in batches:
        rows = [measures(t, hashes) for t in batch.column("text").to_pylist()]
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(8)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), *columns, pa.array([r[8] for r in rows], pa.list_(pa.int64())), *[pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(9, 14)]],
            names=["doc_id", "source", *NAMES, "lines", "sizes", *LINE_SKETCHES],
        )
    hashes.clear()
    give_back()


def measured(docs: DataFrame) -> DataFrame:
    """A row for each document: the counts, its hash and sketches, and the hash (null: no word), words and sketches of each line."""
    session(docs)
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, source {kinds['source']}, {', '.join(f'{n} long' for n in NAMES)}, lines array<long>, sizes array<int>, {', '.join(f'{n} array<int>' for n in LINE_SKETCHES)}"
    return docs.select("doc_id", "source", "text").mapInArrow(_measured, schema)


def _host():
    """The source, marked so that a null one is apart from an empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def frequent_lines(rows: DataFrame, diverse: float = DIVERSE) -> DataFrame:
    """(host, line) of the lines above the limits, from measured(); with diverse 0 whatever documents they are in."""
    host = _host().alias("host")
    texts = rows.select(host, "text_hash").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    limits = cut(texts.select("host", F.least(F.lit(float(MOST_DOCS)), F.greatest(F.lit(LEAST_DOCS), F.col("n") * SHARE)).alias("most")))
    # rows of a line are at least its documents; only the few lines above that are counted exactly
    lines = rows.select(host, "text_hash", F.explode("lines").alias("line")).where("line is not null")
    often = lines.groupBy("host", "line").count().join(small(limits), "host").where("count > most").select("host", "line", "most")
    often = cut(often)
    if not diverse:
        found = lines.distinct().join(small(often), ["host", "line"]).groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"), F.min("most").alias("most"))
        return found.where("docs > most").select("host", "line")
    zipped = F.arrays_zip(F.col("lines").alias("line"), *LINE_SKETCHES)
    each = rows.select(host, "text_hash", "sketch_a", "sketch_b", F.explode(zipped).alias("z")).select("host", "text_hash", "sketch_a", "sketch_b", "z.*").where("line is not null")
    few = small(often)
    near = cut(each.join(few, ["host", "line"]).select("host", "near_a", "near_b").distinct())
    own = each.join(few.select("host", "line"), ["host", "line"], "left_anti")
    for s in ("near_a", "near_b"):
        own = own.join(small(cut(near.select("host", s).distinct())), ["host", s], "left_anti")
    own = own.groupBy("host", "text_hash").agg(F.min("own_a").cast("long").alias("own_a"), F.min("own_b").cast("long").alias("own_b"))
    found = each.join(few, ["host", "line"]).groupBy("host", "line", "text_hash").agg(F.min("sketch_a").alias("sketch_a"), F.min("sketch_b").alias("sketch_b"), F.min("most").alias("most"))
    found = cut(found.join(own, ["host", "text_hash"], "left").withColumns({f"sketch_{s}": F.coalesce(f"own_{s}", f"sketch_{s}") for s in ("a", "b")}).drop("own_a", "own_b"))
    # distinct values by summing in two steps, so that no task holds all documents of a line
    docs = found.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"), F.min("most").alias("most"))
    for s in ("sketch_a", "sketch_b"):
        docs = docs.join(found.groupBy("host", "line", s).agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("one").alias(s)), ["host", "line"])
    return docs.where((F.col("docs") > F.col("most")) & (F.greatest("sketch_a", "sketch_b") >= diverse * F.col("docs"))).select("host", "line")


def decisions(docs: DataFrame, diverse: float = DIVERSE) -> DataFrame:
    """Of every document: the counts, base_failed, n_removed (words in removed lines), removed (places of those lines), kept."""
    rows = cut(measured(docs))
    bad = cut(frequent_lines(rows, diverse))
    # by the text, so that copies' rows meet before the shuffle
    host = _host().alias("host")
    each = rows.select(host, "text_hash", F.posexplode("lines").alias("at", "line"), "sizes").select("host", "text_hash", "at", "line", F.element_at("sizes", F.col("at") + 1).alias("size"))
    cut_lines = each.join(small(bad), ["host", "line"]).select("host", "text_hash", "at", "size").distinct()
    removed = cut_lines.groupBy("host", "text_hash").agg(F.sum("size").alias("n"), F.sort_array(F.collect_list("at")).alias("removed"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = rows.drop("lines", "sizes", *LINE_SKETCHES).withColumn("host", _host()).join(cut(removed), ["host", "text_hash"], "left")
    left = F.col("n_words") - F.col("n_removed")
    return out.withColumns({"n_removed": F.coalesce("n", F.lit(0).cast("long")), "base_failed": base}).withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= LEFT * F.col("n_words")))


def clean(docs: DataFrame, diverse: float = DIVERSE) -> DataFrame:
    """The kept documents, all columns, without the removed lines; n_chars, if there, is the new text's.

    Decisions go back to the rows by doc_id and the text's hash, so rows that share a doc_id are told apart.
    """
    found = cut(decisions(docs, diverse).where("not kept or n_removed > 0").select("doc_id", "text_hash", "removed", "kept"))
    marks = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.first("removed").alias("__removed"), F.first("kept").alias("__kept"))
    key = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    marks = cut(marks)
    rows = packed(docs).join(F.broadcast(marks) if few(marks, "__removed") else marks, key, "left").where("coalesce(__kept, true)")
    stays = without(F.split("text", "\n", -1), F.col("__removed"))
    rows = rows.withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")))
    return unpacked(rows, docs)


def query(spark, sf_dir: str) -> DataFrame:
    found = decisions(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")
