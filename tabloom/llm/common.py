"""What the corpus operators share: readers, lineage cuts, size-checked broadcasts, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch that goes to Python; a single longer row makes a batch of its own.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: A side with more rows than this is shuffled, never broadcast; callers broadcast rows of a few dozen bytes.
BROADCAST_ROWS = 100_000

#: The same for a side that whole documents are joined with; beyond it the plan is alike at all sizes.
TEXT_ROWS = 1000
#: Parts into which the rows of one text are dealt when they are joined by their text.
SALTS = 16


def session(df: DataFrame) -> SparkSession:
    """The session of df, with small Arrow batches. The setting stays: a lazy result needs it when the caller computes it."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def partitions(df: DataFrame, each: int = 32 << 20) -> int:
    """How many partitions of about `each` bytes df makes, by the plan's estimate of its size, but no fewer than the session's."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // each), 1_000_000))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, or on a single machine a folder of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the shared folder, so that losing executors costs nothing that lies before it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def give_back() -> None:
    """Gives what a Python worker has freed back to the system; an idle worker else keeps the memory of its last task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is counted to have few rows; else as it is, for a shuffled join. df should be cheap to count."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def few(df: DataFrame, column: str | None = None, most: int = TEXT_ROWS) -> bool:
    """Whether df has at most so many rows, where every item of an array in the column counts as another."""
    rows = F.lit(1) if column is None else 1 + F.coalesce(F.size(column), F.lit(0))
    return df.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("n")).first()["n"] <= most


def with_marks(docs: DataFrame, key: list[Column], marks: DataFrame, names: list[str], column: str) -> DataFrame:
    """packed docs, each with the marks (or nulls) of its text: key are the columns of docs that the names of marks equal.

    A text's rows are dealt into SALTS parts by their doc_id, so that many copies of one don't meet in one task.
    """
    rows, marks = packed(docs), cut(marks)
    same = reduce(lambda a, b: a & b, [k == F.col(n) for k, n in zip(key, names, strict=True)])
    if few(marks, column):
        return rows.join(F.broadcast(marks), same, "left")
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    marks = marks.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return rows.join(marks, same & (F.col("__part") == F.col("__salt")), "left")


#: A key with more than one in so many of all rows is hot; there are fewer such keys than that.
HOT_KEYS = 10_000


def hot_join(rows: DataFrame, side: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """rows joined with side, which has a row for each key and in `weight` how many of rows have it; hot keys are broadcast.

    No key that is shuffled has more than one in HOT_KEYS of the rows. Both sides should be cheap to read again.
    """
    limit = (side.agg(F.sum(weight)).first()[0] or 0) // HOT_KEYS + 1
    of = [c for c in rows.columns if c != key]
    hot = side.where(F.col(weight) > limit).withColumn("__hot", F.lit(True))
    if hot.isEmpty():
        return rows.join(side, key, how)
    marked = rows.join(F.broadcast(hot), key, "left")
    rest = marked.where("__hot is null").select(key, *of).join(side.where(F.col(weight) <= limit), key, how)
    return marked.where("__hot").drop("__hot").unionByName(rest)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is found once however often body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Items in a block of fold().
FOLD = 128


def fold(items: Column, state: dict[str, Column], kind: str, step: Callable[[Column, Column], tuple[Column, dict[str, Column]]], last: Callable[[Column], Column] | None = None) -> Column:
    """All that step(state, item) puts out, an array of `kind` each time, over the items from left to right; last(state) puts out more at the end.

    What is put out is gathered block by block, as appending to one long array for each item takes quadratic time.
    """
    none, fields = F.array().cast(f"array<{kind}>"), list(state)

    def inner(acc: Column, item: Column) -> Column:
        out, new = step(acc, item)
        return F.struct(F.concat(acc["out"], out).alias("out"), *[new[f].alias(f) for f in fields])

    def outer(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(none.alias("out"), *[acc[f].alias(f) for f in fields]), inner)
        return let(done, lambda r: F.struct(F.concat(acc["out"], F.array(r["out"])).alias("out"), *[r[f].alias(f) for f in fields]))

    def blocks(x: Column) -> Column:
        starts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), F.lit(FOLD))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.slice(x, k, FOLD))

    start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("out"), *[state[f].alias(f) for f in fields])
    end = (lambda acc: F.flatten(acc["out"])) if last is None else (lambda acc: F.concat(F.flatten(acc["out"]), last(acc)))
    return F.aggregate(let(items, blocks), start, outer, end)


def without(items: Column, places: Column) -> Column:
    """items but for those at the places, which count from 0."""

    def left(all_: Column) -> Column:
        at = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.size(all_) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.array_except(at, places), lambda k: F.get(all_, k))

    return let(items, left)


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, __rest): all other columns in one, so that their names clash with none."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None)).alias("__rest"))


def unpacked(rows: DataFrame, docs: DataFrame, new: bool = True) -> DataFrame:
    """The columns of docs from packed rows, whose text may be new: n_chars, if there, then is the new text's length."""
    kinds = dict(docs.dtypes)

    def column(c: str):
        if c in ("doc_id", "text"):
            return F.col(c)
        old = F.col("__rest").getField(c)
        return (F.coalesce(F.length("text").cast(kinds[c]), old) if new and c == "n_chars" else old).alias(c)

    return rows.select(*[column(c) for c in docs.columns])


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike lower()."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in edges (a, b); label is the smallest node of the connected component.

    Each round takes the least label of all neighbours, then the label of the label, until nothing changes; every
    join keeps one row for each node on one side, so that a hub's rows can be split, and sums are pre-aggregated.
    Nulls are dropped; an empty table gives an empty one.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = cut(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = cut(new.join(up, "label").select("node", "old", F.least("label", "top").alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
