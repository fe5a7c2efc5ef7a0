"""Packing by powers of two.

A document's ids, with an end id, are cut into pieces of the longest sequence and then into one piece for each bit of
the rest. Each piece is a sequence of its own, so none crosses documents and none needs padding; sequences of equal
length lie in one folder and are numbered one after the other, folder by folder.

Null texts are empty and have the end id alone. Repeated rows are packed each; an empty table gives an empty one. Other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabloom.llm.common import scratch, session, small, table
from tabloom.llm.tokens import encoded

LONGEST = 2048
END = 1
VOCABULARY = "byte_bpe_50k.json"


def cuts(n: int, longest: int = LONGEST) -> list[int]:
    """Powers of two, longest first, that sum to n; none above longest, which is a power of two."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def _pieces(path: str, longest: int, end: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks = TaskContext.get().partitionId(), Counter()
        for docs, all_ids in encoded(batches, path, end):
            rows = []
            for doc, ids in zip(docs, all_ids, strict=True):
                data, start = ids.tobytes(), 0
                for n in cuts(len(ids), longest):
                    piece = data[4 * start : 4 * (start + n)]
                    rows.append((doc, start, n, zlib.crc32(piece), len(ids), part, ranks[n], piece))
                    ranks[n] += 1
                    start += n
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [kind, *[pa.int64()] * 4, pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", "ids"])

    return run


def pack(docs: DataFrame, out: str, longest: int = LONGEST, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Writes the sequences to the folder out, in folders bucket=length, and returns them with their numbers."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    spark = session(docs)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long, ids binary"
    rows = docs.select("doc_id", "text").mapInArrow(_pieces(public_tokenizers.path(vocabulary), longest, end, to_arrow_type(docs.schema["doc_id"].dataType)), schema)
    rows.withColumn("bucket", F.col("length")).write.partitionBy("bucket").option("compression", "zstd").parquet(out)
    pieces = spark.read.schema(rows.schema).parquet(out)
    # a row for each length and part: what comes before it
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    inside = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n")).select("length", (F.sum("n").over(Window.orderBy("length")) - F.col("n")).alias("base"))
    starts = inside.join(F.broadcast(lengths), "length")  # as many lengths as longest has bits
    starts = starts.select("length", "part", (F.col("base") + F.col("before")).alias("first"))
    numbered = pieces.join(small(starts), ["length", "part"])
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), scratch(spark, "packed")).drop("ids")
