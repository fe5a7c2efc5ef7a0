"""Token ids as bit planes.

Texts are encoded in ascending doc_id order, an end id after each, and cut into blocks of BLOCK ids. A block is turned
into bit planes (plane k holds bit k of every id), and each plane is compressed by zstandard; planes above the highest
bit are left out. The files are Parquet: a row is a block, with its place as the index (file, chunk, first id) and the
documents that start in it; so a task that is repeated leaves no half-written file, and any block can be read alone.

Null texts are empty and have the end id alone. Null doc_ids come first; repeated rows and rows that share a doc_id
follow each other, in the order of their texts' checksums. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabloom.llm.common import cut, give_back, partitions, scratch, session, small, table
from tabloom.llm.tokens import encoded

BLOCK = 1 << 16
END = 1
VOCABULARY = "word_bpe_49k.json"
LEVEL = 3


def to_planes(ids: np.ndarray) -> list[bytes]:
    """The compressed bit planes of unsigned 32-bit ids, lowest bit first."""
    pack = zstandard.ZstdCompressor(level=LEVEL)
    return [pack.compress(np.packbits((ids >> np.uint32(k)) & np.uint32(1), bitorder="little").tobytes()) for k in range(int(ids.max(initial=0)).bit_length())]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor()
    ids = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(unpack.decompress(plane), np.uint8), count=n, bitorder="little").astype("<u4") << np.uint32(k)
    return ids


def _encoded(path: str, block: int, end: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = TaskContext.get().partitionId()
        held, size, chunk, docs, lengths = [], 0, 0, [], []

        def row(ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int32()), pa.array([chunk], pa.int32()), pa.array([chunk * block], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([docs], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int64())), pa.array([to_planes(ids)], pa.list_(pa.binary()))],
                names=["file", "chunk", "first", "n_ids", "doc_ids", "n_tokens", "planes"],
            )

        for some, all_ids in encoded(batches, path, end):
            for doc, ids in zip(some, all_ids, strict=True):
                docs.append(doc)
                lengths.append(len(ids))
                held.append(ids)
                size += len(ids)
                if size >= block:
                    all_ids = np.concatenate(held)
                    for k in range(0, size - size % block, block):
                        yield row(all_ids[k : k + block])
                        chunk, docs, lengths = chunk + 1, [], []
                    held, size = [all_ids[size - size % block :]], size % block
        if size or docs:
            yield row(np.concatenate(held))

    return run


def write(docs: DataFrame, out: str, vocabulary: str = VOCABULARY, block: int = BLOCK, end: int = END) -> None:
    """Writes the ids of docs to the folder out."""
    session(docs)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"file int, chunk int, first long, n_ids int, doc_ids array<{dict(docs.dtypes)['doc_id']}>, n_tokens array<long>, planes array<binary>"
    # rows that share a doc_id are dealt by their texts, and rows alike in both by their place in the input
    keys = [F.col("doc_id"), F.crc32(F.coalesce("text", F.lit(""))), F.col("__row")]
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row"))
    ordered = rows.repartitionByRange(partitions(docs), *keys).sortWithinPartitions(*keys).drop("__row")
    ordered.mapInArrow(_encoded(public_tokenizers.path(vocabulary), block, end, kind), schema).write.option("compression", "zstd").parquet(out)


def _in_file(content: pa.Buffer) -> Iterator[tuple[int, list[tuple]]]:
    """(file, its documents that end in a block: doc_id, place, ids) of each block of a file."""
    held, size, todo, place = [], 0, deque(), 0
    for batch in pq.ParquetFile(pa.BufferReader(content)).iter_batches(8):
        for r in batch.to_pylist():
            held.append(from_planes(r["planes"], r["n_ids"]))
            size += r["n_ids"]
            todo.extend(zip(r["doc_ids"], r["n_tokens"], strict=True))
            out = []
            if todo and size >= todo[0][1]:
                ids, at = np.concatenate(held), 0
                while todo and at + todo[0][1] <= size:
                    doc, n = todo.popleft()
                    out.append((doc, place, ids[at : at + n]))
                    at, place = at + n, place + n
                held, size = [ids[at:].copy()], size - at
            yield r["file"], out


def _documents(kind: pa.DataType, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for file, docs in _in_file(content.as_buffer()):
                    last = pa.array([zlib.crc32(ids) for *_, ids in docs], pa.int64()) if digests else pa.array([ids.tobytes() for *_, ids in docs], pa.binary())
                    columns = [pa.array([d[0] for d in docs], kind), pa.array([file] * len(docs), pa.int32()), pa.array([d[1] for d in docs], pa.int64()), pa.array([len(d[2]) for d in docs], pa.int64()), last]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "file", "place", "n_tokens", "ids_crc32" if digests else "ids"])
        give_back()

    return run


def read(spark: SparkSession, out: str, digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files; ids_crc32 in place of ids if digests is set.

    A file holds about partitions() bytes of text and is read whole by one task, so that nothing is shuffled.
    """
    blocks = spark.read.parquet(out)
    session(blocks)
    name = dict(blocks.dtypes)["doc_ids"][6:-1]
    kind = to_arrow_type(blocks.schema["doc_ids"].dataType.elementType)
    last = "ids_crc32 long" if digests else "ids binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(out).select("content")
    rows = files.mapInArrow(_documents(kind, digests), f"doc_id {name}, file int, place long, n_tokens long, {last}")
    # one row a file
    sums = blocks.groupBy("file").agg(F.sum("n_ids").alias("n"))
    before = cut(sums.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before")))
    return rows.join(small(before), "file").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", last.split()[0])


def query(spark, sf_dir: str) -> DataFrame:
    out = scratch(spark, "planes")
    write(table(spark, sf_dir, "documents"), out)
    return read(spark, out, digests=True)
