"""Ranks, first rows and quantiles over all rows, or within groups of any size, without a task that holds them all.

Rows are dealt by ranges of the order, so that equal rows meet; each range's total is counted, totals of the ranges before it
are added, and only then rows are counted within their range. Values that many rows share are summed up first. Ranges are
drawn from a sample, so the dealt rows are kept in the shared folder, and all counts see the same ranges.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep(df: DataFrame) -> DataFrame:
    """df, computed now and kept in spark.checkpoint.dir; on a single machine in a folder of our own where that is unset."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_folder(spark))
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="tabloom-")


def running(rows: DataFrame, order: list[str], keys: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """rows with before, the sum of the weights (1 where none is given) of the rows of the same keys that come earlier; nulls come first.

    Rows that are alike in keys and order come in any order, but no two at the same place.
    """
    n = F.lit(1).cast("long") if weight is None else F.col(weight)
    dealt = keep(rows.withColumn("__n", n).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "__part").agg(F.sum("__n").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__of"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__earlier"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__part") == F.col("__of"))
    within = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(sums, same).withColumn("before", F.col("__earlier") + F.coalesce(F.sum("__n").over(within), F.lit(0))).select(*rows.columns, "before")


def first_rows(rows: DataFrame, n: int, order: list[Column], ties: str) -> DataFrame:
    """The first n rows by the order, then by the column of ties."""
    names = [f"__o{k}" for k in range(len(order))]
    placed = running(rows.withColumns(dict(zip(names, order, strict=True))), [*names, ties])
    return placed.where(F.col("before") < n).select(*rows.columns)


def average_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, rank) of each different value that isn't null: its rank from 1, which equal values share on average."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, [value], weight="n").select(value, "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(pearson, spearman, n) of the rows that have both; one row, with nulls where a correlation isn't defined.

    Rows that are alike in both are counted once, so no value meets in one task more often than it has partners.
    """
    pairs = keep(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n")))
    for c in "xy":
        each = running(pairs.groupBy(c).agg(F.sum("n").alias("__m")), [c], weight="__m").select(F.col(c).alias("__v"), (F.col("before") + (F.col("__m") + 1) / 2).alias(f"r{c}"))
        pairs = pairs.join(each, F.col(c) == F.col("__v")).drop("__v")

    def corr(a: str, b: str, name: str) -> Column:
        of = lambda v: F.sum(F.col("n") * v)
        a, b = F.col(a) - F.col(f"m{a}"), F.col(b) - F.col(f"m{b}")
        return (of(a * b) / F.sqrt(F.nullif(of(a * a) * of(b * b), F.lit(0.0)))).alias(name)

    names = ("x", "y", "rx", "ry")
    means = pairs.agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"m{c}") for c in names])  # one row
    sums = pairs.crossJoin(F.broadcast(means))
    return sums.agg(corr("x", "y", "pearson"), corr("rx", "ry", "spearman"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, share, quantile): exact, between two values in proportion; nulls are left out, a group without values too.

    Only the ranges that hold a wanted value are counted through.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    dealt = keep(counts.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "__part").agg(F.sum("__n").alias("__sum"))
    sums = sums.withColumns({"__before": F.coalesce(F.sum("__sum").over(earlier), F.lit(0)), "__all": F.sum("__sum").over(group)})
    place = (F.col("__all") - 1) * F.col("share")
    ends = F.array(*[F.struct(F.lit(float(s)).alias("share")) for s in shares])
    wanted = sums.select("*", F.inline(ends)).withColumns({"low": F.floor(place), "high": F.ceil(place), "part": place - F.floor(place)})
    held = lambda c: (F.col(c) >= F.col("__before")) & (F.col(c) < F.col("__before") + F.col("__sum"))
    wanted = wanted.where(held("low") | held("high")).groupBy(*keys, "__part", "__before").agg(F.collect_list(F.struct("share", "low", "high", "part")).alias("wanted"))
    wanted = wanted.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__of"), "__before", "wanted")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__part") == F.col("__of"))
    within = Window.partitionBy(*keys, "__part").orderBy("__v")
    found = dealt.join(wanted, same).withColumn("__last", F.col("__before") + F.sum("__n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.select(*keys, "__v", "__last", (F.col("__last") - F.col("__n")).alias("__first"), F.explode("wanted").alias("w"))
    at = lambda c: F.max(F.when((F.col(f"w.{c}") >= F.col("__first")) & (F.col(f"w.{c}") < F.col("__last")), F.col("__v")))
    both = found.groupBy(*keys, "w.share", "w.part").agg(at("low").alias("low"), at("high").alias("high"))
    return both.select(*keys, "share", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("quantile"))
