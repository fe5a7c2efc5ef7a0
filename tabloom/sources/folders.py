"""Folders of table files that are worked through step by step: what lies there, what is done, and reading what isn't.

A listing is a table of files. A folder that isn't there has none. Null ids match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.sources.files import statuses
from tabloom.sources.tables import parsed

CANDIDATES = "_candidates.csv"


def listing(spark: SparkSession, path: str, suffix: str = ".csv", without: str | None = None) -> DataFrame:
    """(tab_id, path, length, modified) of the files of a folder whose names end in suffix, but for those that end in `without`.

    The driver lists them, as Spark's readers pass over files without bytes; it holds a few hundred bytes for each.
    """
    rows = [(n[: -len(suffix)], p, size, at) for n, p, size, at in statuses(spark, path) if n.endswith(suffix) and not (without and n.endswith(without))]
    frame = spark.createDataFrame(rows, "tab_id string, path string, length long, modified long")
    return frame.withColumn("modified", F.timestamp_millis("modified"))


def states(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """inputs with state: new (no output), broken (an output without bytes), stale (older than its input) or done."""
    made = outputs.groupBy("tab_id").agg(F.min("length").alias("__length"), F.min("modified").alias("__made"))
    state = F.when(F.col("__length").isNull(), "new").when(F.col("__length") == 0, "broken").when(F.col("__made") < F.col("modified"), "stale").otherwise("done")
    return inputs.join(made, "tab_id", "left").withColumn("state", state).drop("__length", "__made")


def pending(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    return states(inputs, outputs).where("state <> 'done'")


def paired(candidates: DataFrame, prepared: DataFrame) -> DataFrame:
    """(tab_id, path, prepared, reason) of each file of candidates; reason says why one can't be ranked, null if it can."""
    known = prepared.groupBy("tab_id").agg(F.min_by("path", F.struct(-F.col("length"), "path")).alias("prepared"), F.max("length").alias("__length"))
    reason = F.when(F.col("prepared").isNull(), "no prepared table").when(F.col("__length") == 0, "the prepared table is empty").when(F.col("length") == 0, "no candidates")
    return candidates.join(known, "tab_id", "left").select("tab_id", "path", "prepared", reason.alias("reason"))


def read_listed(spark: SparkSession, files: DataFrame, most: int = 10_000) -> Iterator[DataFrame]:
    """parsed() cells of the files of a listing, `most` files at a time: the driver holds the paths of one batch, and no file outside the listing is opened."""
    rows = ((r["path"], r["length"]) for r in files.select("path", "length").orderBy("path").toLocalIterator())
    while batch := list(islice(rows, most)):
        full, empty = [p for p, n in batch if n], [(p, b"") for p, n in batch if not n]
        parts = [spark.read.format("binaryFile").load(full).select("path", "content")] if full else []
        parts += [spark.createDataFrame(empty, "path string, content binary")] if empty else []
        yield parsed(reduce(DataFrame.union, parts))
