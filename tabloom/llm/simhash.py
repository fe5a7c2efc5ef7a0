"""SimHash near-duplicate groups, linked by searching BK-trees.

Two fingerprints of 64 bits that differ in at most `radius` bits agree on some BLOCKS - radius of the BLOCKS blocks.
So every distinct fingerprint goes to one small shard for each choice of that many blocks, by the bits in them; each
shard is a BK-tree whose children are keyed by their Hamming distance to the parent, and a search follows only edges
within the radius. A shard with more than SHARD members is split into chunks; what the chunks leave apart is found
by broadcasting the trees of its smaller components, a bounded number of nodes at a time, to all its rows.

That finds fingerprints a few bits apart. Texts whose shingles have a Jaccard similarity of 0.8 are some 10 bits apart, and
no choice of blocks finds such pairs without comparing nearly all. So near_dedup(), which looks for texts of that
similarity, takes its shards from min-hashes: BANDS keys of ROWS min-hashes each, of which two texts of similarity 0.8
share one with a probability of 0.998. In a shard the BK-tree is searched as above, within WIDE bits, and a pair that is
found is linked if its similarity, counted over the shingles, is SIMILARITY or more; a text that has too many shingles of
its own in a shard to be that alike with any is left out before. Texts of more than LEAST shingles are compared by the
LEAST least hashes of both, with a standard error of 0.0125; with most=None all are compared over whole sets.

Nulls and texts without words have fingerprint zero and are linked like any other; repeated rows each keep their row in
near_groups(); a null doc_id never is a component's id unless all are null; an empty table gives an empty one; other
columns are ignored by near_groups() and kept by near_dedup().
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import components, cut, few, give_back, packed, session, small, table, unpacked

SEED = 42
SHINGLE = 4
RADIUS = 4
BLOCKS = 6
SHARD = 20_000
#: Nodes at most in the trees that one pass over a split shard broadcasts, and if they have shingles.
PASS_NODES, PASS_SETS = 100_000, 10_000
#: near_dedup(): words in a shingle, similarity, bits within which it is counted, shards of a text and min-hashes for each.
WIDTH, SIMILARITY, WIDE, BANDS, ROWS = 5, 0.8, 20, 16, 5
LEAST = 1024
_RNG = np.random.default_rng(20240611)
_TIMES, _PLUS = _RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1), _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_KEYS = _RNG.integers(0, 1 << 62, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, and only ASCII white space


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """The hash of each run of `width` words, or of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    return majority(shingles(_words(text), width))


def bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of its own ROWS min-hashes of shingles."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(hashes), 4096):
        x = (hashes[k : k + 4096] >> np.uint64(32)).astype(np.uint32)[None, :] * _TIMES[:, None] + _PLUS[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(axis=1), out=least)
    keys = (least.reshape(BANDS, ROWS).astype(np.uint64) * _KEYS + (_KEYS >> np.uint64(7))).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * _KEYS[0]
    return ((keys ^ (keys >> np.uint64(29))) * _KEYS[1]).view(np.int64)


def least(hashes: np.ndarray, most: int | None = LEAST) -> np.ndarray:
    """The least of the distinct hashes, of which 32 bits are taken: `most` of them, or all."""
    return np.unique((hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32))[:most]


def similarity(a: np.ndarray, b: np.ndarray, most: int | None = LEAST) -> float:
    """Jaccard similarity of what least() gave: exact for whole sets, an estimate if one was cut off."""
    if most in (len(a), len(b)):
        both = np.union1d(a, b)[:most]
        return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True)) / len(both)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / max(1, len(a) + len(b) - shared)


def may_be_alike(sets: list[np.ndarray], alike: float, most: int | None = LEAST) -> list[int]:
    """Places of the sets that may be alike with another one: so few of a set's hashes are its own that the rest can be the share that is asked for.

    Pages that have a template in common and a fifth or more of their own text drop out here, before they are compared. A
    set that was cut off always stays.
    """
    every = np.sort(np.concatenate(sets))
    out = []
    for k, s in enumerate(sets):
        shared = len(s) if len(s) == most else int((np.searchsorted(every, s, "right") - np.searchsorted(every, s) > 1).sum())
        if shared >= alike * len(s) - 1e-9:
            out.append(k)
    return out


class Tree:
    """A BK-tree of integers. Nodes can be taken out; subtrees without nodes are skipped."""

    def __init__(self, values: Iterable[int]) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        for v in values:
            self._add(v)
        self.left = [1] * len(self.value)
        for k in range(len(self.value) - 1, 0, -1):
            self.left[self.parent[k]] += self.left[k]
        self.there = [True] * len(self.value)

    def _add(self, v: int) -> None:
        k = len(self.value)
        at = -1
        if k:
            at = 0
            while True:
                d = (self.value[at] ^ v).bit_count()
                if d not in self.children[at]:
                    self.children[at][d] = k
                    break
                at = self.children[at][d]
        self.value.append(v)
        self.children.append({})
        self.parent.append(at)

    def search(self, v: int, radius: int) -> list[int]:
        """Places of the nodes within the radius that are still there."""
        found, todo = [], [0] if self.value else []
        value, children, left, there = self.value, self.children, self.left, self.there
        while todo:
            k = todo.pop()
            if not left[k]:
                continue
            d = (value[k] ^ v).bit_count()
            if d <= radius and there[k]:
                found.append(k)
            todo += [c for e, c in children[k].items() if d - radius <= e <= d + radius]
        return found

    def take(self, k: int) -> None:
        self.there[k] = False
        while k >= 0:
            self.left[k] -= 1
            k = self.parent[k]


def groups(values: list[int], radius: int, alike: Callable[[int, int], bool] | None = None) -> Iterator[list[int]]:
    """The connected components, of two at least, of places whose values differ in at most radius bits, and are alike if that is given."""
    tree = Tree(values)
    for k, v in enumerate(values):
        if not tree.there[k]:
            continue
        tree.take(k)
        group, todo = [k], [k]
        while todo and tree.left[0]:
            i = todo.pop()
            for j in tree.search(values[i], radius):
                if alike is None or alike(i, j):
                    tree.take(j)
                    group.append(j)
                    todo.append(j)
        if len(group) > 1:
            yield group


def masks(radius: int, blocks: int) -> list[int]:
    """For each choice of blocks - radius blocks, the bits in them, as a signed integer."""
    if not radius < blocks <= 64:
        raise ValueError("blocks must be more than the radius and at most 64")
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(bits, blocks - radius))]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fp"])
    give_back()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row."""
    session(docs)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _runs(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((3, 0), np.int64)
        for batch in chain(batches, [None]):
            found, rest = _linked(rest, batch, radius)
            yield from found

    return run


def _linked(rest: np.ndarray, batch: pa.RecordBatch | None, radius: int) -> tuple[list[pa.RecordBatch], np.ndarray]:
    """Edges of the whole shards in what was left over and a batch; the last shard, which may go on, is left over."""
    rows = rest if batch is None else np.concatenate([rest, np.array([batch.column(c).to_numpy() for c in ("key", "chunk", "fp")])], axis=1)
    cuts = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
    cuts = np.concatenate(([0], cuts, [rows.shape[1]])) if batch is None else np.concatenate(([0], cuts))
    rest = rows[:, cuts[-1] :]
    fps, sizes = rows[2], np.diff(cuts)
    pairs = cuts[:-1][sizes == 2]
    near = pairs[np.bitwise_count((fps[pairs] ^ fps[pairs + 1]).view(np.uint64)) <= radius]  # a tree of two nodes has one edge
    a, b = list(fps[near]), list(fps[near + 1])
    for k in np.flatnonzero(sizes > 2):
        of = fps[cuts[k] : cuts[k + 1]]
        for group in groups(of.view(np.uint64).tolist(), radius):
            signed = of[group]
            a += [signed.min()] * len(group)
            b += list(signed)
    edges = pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])
    return [edges] if a else [], rest


def _set_runs(radius: int, alike: float, most: int | None):
    """As _runs, of nodes with shingles: pairs within the radius are linked if they are alike enough."""

    def edges(shard: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch | None:
        sets = [np.frombuffer(r[2], np.uint32) for r in shard]
        some = may_be_alike(sets, alike, most)
        nodes, fps, sets = [shard[k][0] for k in some], [shard[k][1] & 0xFFFFFFFFFFFFFFFF for k in some], [sets[k] for k in some]
        pairs = [(min(nodes[k] for k in group), nodes[j]) for group in groups(fps, radius, lambda i, j: similarity(sets[i], sets[j], most) >= alike) for j in group]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"]) if pairs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for key, chunk, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "node", "fp", "set")), strict=True):
                if (key, chunk) != at:
                    if len(held) > 1 and (found := edges(held)):
                        yield found
                    at, held = (key, chunk), []
                held.append(row)
        if len(held) > 1 and (found := edges(held)):
            yield found
        give_back()

    return run


def _search(keys: DataFrame, radius: int, shard: int, pass_nodes: int, alike: float | None = None, most: int | None = LEAST) -> DataFrame:
    """(a, b): edges that connect the members of shards that are within the radius of each other, and alike if that is asked for.

    keys: key, fp (long), a row for each member of a shard; fp is the node, or with `alike` the column node (binary), and set holds its shingles.
    """
    node, kind, mine = ("node", "binary", ["node", "fp", "set"]) if alike else ("fp", "long", ["fp"])
    hot = cut(keys.groupBy("key").count().where(F.col("count") > shard))
    n_hot = hot.count()
    if n_hot:
        parts = F.coalesce(F.ceil(F.col("count") / shard), F.lit(1)).cast("long")
        keys = keys.join(small(hot, n_hot), "key", "left").select("key", F.pmod(F.xxhash64(node, "key"), parts).alias("chunk"), *mine)
    else:
        keys = keys.select("key", F.lit(0).cast("long").alias("chunk"), *mine)
    run = _set_runs(radius, alike, most) if alike else _runs(radius)
    edges = cut(keys.repartition("key", "chunk").sortWithinPartitions("key", "chunk", node).mapInArrow(run, f"a {kind}, b {kind}"))
    if not n_hot:
        return edges
    labels = components(edges).withColumnRenamed("node", "__node")
    rows = cut(keys.join(small(hot.select("key"), n_hot), "key", "left_semi").join(labels, F.col(node) == F.col("__node"), "left").select("key", *mine, F.coalesce("label", node).alias("label")))
    top = rows.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("top"))
    minor = cut(rows.join(top, "key").where("label <> top").select("key", *mine, "label"))
    passes = -(-minor.count() // max(1, pass_nodes // 2))
    number = lambda: F.pmod(F.xxhash64(node, "key"), F.lit(passes))
    while passes and minor.groupBy(number().alias("pass")).count().agg(F.max("count")).first()[0] > pass_nodes:
        passes *= 2
    for k in range(passes):
        shards: dict[int, list[dict]] = {}
        for r in minor.where(number() == k).toArrow().to_pylist():  # at most pass_nodes rows
            shards.setdefault(r["key"], []).append(r)
        trees = rows.sparkSession.sparkContext.broadcast({key: (Tree(r["fp"] & 0xFFFFFFFFFFFFFFFF for r in of), [r["label"] for r in of], [r.get("set") for r in of]) for key, of in shards.items()})
        edges = edges.union(cut(rows.mapInArrow(_against(trees, radius, alike, most), f"a {kind}, b {kind}").distinct()))
        trees.unpersist()
    return edges.union(labels.select("__node", "label"))


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD, pass_nodes: int = PASS_NODES) -> DataFrame:
    """(node, label) of every fingerprint (column fp, long) that is linked to another one, label the least of its component."""
    session(fps)

    def key(t: int, mask: int) -> Column:
        return F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(mask)))

    keys = fps.select("fp").distinct().select(F.explode(F.array(*[key(t, m) for t, m in enumerate(masks(radius, blocks))])).alias("key"), "fp")
    return components(_search(keys, radius, shard, pass_nodes))


def _against(trees, radius: int, alike: float | None, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for r in batch.to_pylist():
                tree, labels, sets = trees.value.get(r["key"], (None, None, None))
                for j in tree.search(r["fp"] & 0xFFFFFFFFFFFFFFFF, radius) if tree else ():
                    if labels[j] != r["label"] and (alike is None or similarity(np.frombuffer(r["set"], np.uint32), np.frombuffer(sets[j], np.uint32), most) >= alike):
                        out.add((min(r["label"], labels[j]), max(r["label"], labels[j])))
            kind = batch.schema.field("label").type
            a, b = zip(*sorted(out), strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])
        give_back()

    return run


def near_groups(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least doc_id that links reach."""
    fps = cut(fingerprints(docs))
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = links(firsts, **how)
    of = firsts.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    of = cut(of)
    least = of.groupBy("label").agg(F.min("first").alias("component_id"))
    return fps.join(cut(of.join(least, "label").select("fp", "component_id")), "fp").select("doc_id", "fp", "component_id")


def _described(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = _words(text)
                h = shingles(words, width)
                rows.append((xxhash.xxh3_128_digest(b" ".join(words)), majority(h), bands(h) if words else None))
            columns = [pa.array([r[0] for r in rows], pa.binary()), pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)), pa.array([r[2] for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *columns], names=["doc_id", "hash", "node", "fp", "keys"])
        give_back()

    return run


def _sets(width: int, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_words(text) for text in batch.column("text").to_pylist()]
            nodes = pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([nodes, pa.array([least(shingles(w, width), most).tobytes() for w in words], pa.binary())], names=["node", "set"])
        give_back()

    return run


def alike_groups(docs: DataFrame, width: int = WIDTH, alike: float = SIMILARITY, radius: int = WIDE, shard: int = SHARD, pass_nodes: int = PASS_SETS, most: int | None = LEAST) -> DataFrame:
    """(doc_id, hash, label) of every row: the text's hash and its group. Texts of the same words are alike, others by their shingles."""
    session(docs)
    kind = dict(docs.dtypes)["doc_id"]
    hash_ = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = cut(docs.select("doc_id", hash_.alias("hash"), "text").mapInArrow(_described(width), f"doc_id {kind}, hash long, node binary, fp long, keys array<long>"))
    nodes = cut(rows.groupBy("node", "fp", "keys").agg(F.min("hash").alias("hash")))
    each = nodes.select("node", "fp", "hash", F.explode("keys").alias("key"))
    # first by fingerprints alone: only what has company needs its shingles
    near = _search(each.select("key", "fp").distinct(), radius, shard, PASS_NODES)
    company = near.select(F.col("a").alias("fp")).union(near.select("b")).union(nodes.groupBy("fp").count().where("count > 1").select("fp")).distinct()
    company = cut(company)
    some = cut(nodes.join(small(company), "fp", "left_semi").select("hash").distinct())
    sets = docs.select("text").where("text is not null").join(small(some).withColumnRenamed("hash", "__hash"), hash_ == F.col("__hash"), "left_semi")
    sets = cut(sets.mapInArrow(_sets(width, most), "node binary, set binary").dropDuplicates(["node"]))
    keys = each.join(small(company), "fp", "left_semi").join(sets, "node").select("key", "node", "fp", "set")
    labels = components(_search(keys, radius, shard, pass_nodes, alike, most)).withColumnRenamed("node", "__node")
    return rows.join(labels, F.col("node") == F.col("__node"), "left").select("doc_id", "hash", F.coalesce("label", "node").alias("label"))


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, without those that another document of their group stands for.

    Of a group, the row with the least doc_id stays (rows without one come last), of those with the same the one with the
    least hash of its text, and of rows alike in both any one. Rows that share a doc_id are told apart by their texts.
    """
    found = cut(alike_groups(docs, **how))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    firsts = found.groupBy("label").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("label", "first")
    each = cut(found.join(firsts, "label").groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n"), F.first(order == F.col("first")).alias("stays")))

    def mark(rows: DataFrame) -> DataFrame:
        rows = cut(rows.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash")))
        return F.broadcast(rows) if few(rows) else rows

    key = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    rest = packed(docs).join(mark(each.where("not stays")), key, "left_anti")
    again = each.where("stays and n > 1")
    if again.isEmpty():
        return unpacked(rest, docs, False)
    again = mark(again)
    once = rest.join(again, key, "left_semi").withColumn("__hash", F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return unpacked(rest.join(again, key, "left_anti").unionByName(once), docs, False)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
