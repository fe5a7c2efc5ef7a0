"""Sharding by a two-pass external shuffle.

The first pass scatters the records by a seeded hash into buckets that fit in memory; the second shuffles each bucket
by Fisher and Yates with a seed of its own and writes it. The buckets in turn are one random order of all records.
The law is `rows`: shard s takes the places of that order from its start on, so that the shards' counts are at most one
apart and a shard's slots have no gaps.

A record is scattered by its doc_id and text, so rows that share a doc_id or have none are spread by their texts, and
copies of a text by their doc_ids; rows that share both meet in one bucket and get a slot each. Null texts have no
bytes. An empty table gives an empty one. Columns named like the new ones are replaced; all others are kept in the files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import scratch, session, table

SHARDS = 16
BUCKET_BYTES = 32 << 20
SEED = 20240607


def _shuffled(seed: int, starts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            buckets = batch.column("__bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column("__bucket")[0].as_py() != buckets[a]:
                    yield from _fisher_yates(held, seed, starts.value)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from _fisher_yates(held, seed, starts.value)

    return run


def _fisher_yates(held: list[pa.RecordBatch], seed: int, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held)
    bucket = held[0].column("__bucket")[0].as_py()
    rng = np.random.default_rng([seed, bucket])
    order = np.arange(rows.num_rows)
    rng.shuffle(order)  # Fisher-Yates
    for k in range(0, len(order), 1024):
        part = rows.take(pa.array(order[k : k + 1024])).combine_chunks()
        at = pa.array(starts[bucket] + np.arange(k, k + part.num_rows, dtype=np.int64))
        yield from part.set_column(part.schema.get_field_index("__place"), "__place", at).to_batches()


def external_shuffle(docs: DataFrame, path: str, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Writes docs to path, in folders shard=s, and returns what was written, with columns shard, slot, size and text_crc32."""
    session(docs)
    docs = docs.drop("shard", "slot", "size", "text_crc32", "__bucket", "__place")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    buckets = max(1, -(-int(total) // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(seed)), F.lit(buckets))
    # 8 bytes for each bucket_bytes of text go to the driver and into the broadcast: where a bucket starts in the order
    counts = docs.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    ends = np.zeros(buckets, np.int64)
    ends[counts["__bucket"].to_numpy()] = counts["n"].to_numpy()
    ends = np.cumsum(ends)
    n = int(ends[-1])
    spark = docs.sparkSession
    starts = spark.sparkContext.broadcast(np.concatenate(([0], ends[:-1])))
    rows = docs.withColumns({"__bucket": bucket, "__place": F.lit(0).cast("long"), "size": size, "text_crc32": F.crc32(F.coalesce("text", F.lit("")))})
    ordered = rows.repartition(buckets, "__bucket").sortWithinPartitions("__bucket", "doc_id", "text_crc32")
    shuffled = ordered.mapInArrow(_shuffled(seed, starts), ordered.schema)
    rank = F.col("__place")
    base, more = n // shards, n % shards  # the first `more` shards have one row more
    edge = more * (base + 1)
    shard = F.when(rank < edge, F.floor(rank / F.lit(base + 1))).otherwise(more + F.floor((rank - edge) / F.lit(max(base, 1)))).cast("int")
    first = F.least(F.col("shard"), F.lit(more)) + F.col("shard") * F.lit(base)
    placed = shuffled.withColumn("shard", shard).withColumn("slot", (rank - first).cast("long")).drop("__bucket", "__place")
    placed.write.partitionBy("shard").parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    out = external_shuffle(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
