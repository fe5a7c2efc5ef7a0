"""Scores of annotations against gold, comparisons of runs, and tests of their differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.order import running

CELL = ["tab_id", "row_id", "col_id"]


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.lit(0.0))


def precision_recall_f1(right: str = "n_right", made: str = "n_made", gold: str = "n_gold") -> list[Column]:
    p, r = ratio(F.col(right), F.col(made)), ratio(F.col(right), F.col(gold))
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1")]


def reject_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows; fails where two have the same keys."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return rows.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.lit("a key is annotated twice")).cast("boolean")).otherwise(True)).drop("__n")


def exact_scores(annotations: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """By run: annotations (run, keys, value) of gold keys against gold (keys, values array), in lower case."""
    made = annotations.join(gold, keys).select("run", F.array_contains(F.transform("values", F.lower), F.lower("value")).alias("right"))
    sums = made.groupBy("run").agg(count_if(F.col("right")).alias("n_right"), F.count(F.lit(1)).alias("n_made")).crossJoin(F.broadcast(gold.agg(F.count(F.lit(1)).alias("n_gold"))))
    return sums.select("run", "n_right", "n_made", "n_gold", *precision_recall_f1())


def graded(value: Column, gold: Column, direction: Column, depth: Column) -> Column:
    """1 for the gold type, 0.8 to the power of the depth for an ancestor (5 at most), 0.7 for a descendant (3 at most)."""
    return (
        F.when(F.lower(value) == F.lower(gold), F.lit(1.0))
        .when((direction == "ancestor") & (depth <= 5), F.pow(F.lit(0.8), depth.cast("double")))
        .when((direction == "descendant") & (depth <= 3), F.pow(F.lit(0.7), depth.cast("double")))
        .otherwise(F.lit(0.0))
    )


def type_scores(annotations: DataFrame, gold: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """By run: graded types of columns; all annotated columns count for precision.

    annotations: run, tab_id, col_id, value; gold: tab_id, col_id, type; hierarchy: type, other, direction, depth.
    """
    pairs = annotations.join(gold, ["tab_id", "col_id"]).join(hierarchy, (F.lower("type") == F.lower("h_type")) & (F.lower("value") == F.lower("other")), "left")
    best = pairs.groupBy("run", "tab_id", "col_id").agg(F.max(graded(F.col("value"), F.col("type"), F.col("direction"), F.col("depth"))).alias("score"))
    made = annotations.groupBy("run").agg(F.count(F.lit(1)).alias("n_made"))
    sums = best.groupBy("run").agg(F.sum("score").alias("n_right")).join(made, "run").crossJoin(F.broadcast(gold.select("tab_id", "col_id").distinct().agg(F.count(F.lit(1)).alias("n_gold"))))
    return sums.select("run", F.round("n_right", 6).alias("sum_score"), "n_made", "n_gold", *precision_recall_f1())


def selection_status(has: Column, qid: Column, gold: Column) -> Column:
    """has: 1 or 0, whether a candidate is the gold, null where there are none; qid: what was chosen."""
    return F.when(has.isNull(), "no_candidates").when(has == 0, "not_retrieved").when(qid == gold, "correct").otherwise("wrong_selection")


def gold_status(cells: DataFrame, candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """cells (tab_id, row_id, gold) with status correct, wrong_selection, not_retrieved or no_candidates."""
    found = candidates.groupBy("tab_id", "row_id").agg(F.max((F.col("qid") == F.col("gold")).cast("int")).alias("has"))
    rows = cells.join(found, ["tab_id", "row_id"], "left").join(chosen.select("tab_id", "row_id", "qid"), ["tab_id", "row_id"], "left")
    status = selection_status(F.col("has"), F.col("qid"), F.col("gold"))
    return rows.withColumn("status", status)


def transitions(hits: DataFrame, base: str) -> DataFrame:
    """Each other run against the base: cells whose choice changed, was fixed or broken, stayed wrong."""
    cell = hits.groupBy("tab_id", "row_id").agg(F.collect_list(F.struct("run", "hit", "qid")).alias("of"))  # a cell has few runs
    b = F.get(F.filter("of", lambda r: r["run"] == base), F.lit(0))
    others = F.inline(F.filter("of", lambda r: r["run"] != base))
    rows = cell.select(b.alias("b"), "of").where("b is not null").select(F.col("b.hit").alias("b_hit"), F.col("b.qid").alias("b_qid"), others)
    changed = ~F.col("qid").eqNullSafe(F.col("b_qid"))
    out = rows.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), count_if(changed).alias("n_changed"), count_if(~F.col("b_hit") & F.col("hit")).alias("n_fixed"),
        count_if(F.col("b_hit") & ~F.col("hit")).alias("n_broken"), count_if(changed & ~F.col("b_hit") & ~F.col("hit")).alias("n_wrong_to_wrong"),
    )
    return out.withColumns({"net": F.col("n_fixed") - F.col("n_broken"), "pct_changed": F.round(100.0 * F.col("n_changed") / F.col("n"), 4)})


def discordant(hits: DataFrame, runs: list[str]) -> DataFrame:
    """(run_a, run_b, b, c) of each pair of runs: cells of both that only the first has right, and only the second.

    One aggregation brings a cell's runs together; no cell is joined with itself.
    """
    names = sorted(runs)
    cell = hits.groupBy("tab_id", "row_id").agg(*[F.max(F.when(F.col("run") == r, F.col("hit").cast("int"))).alias(f"__{k}") for k, r in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    each = F.explode(F.array(*[F.struct(F.lit(names[i]).alias("run_a"), F.lit(names[j]).alias("run_b"), F.col(f"__{i}").alias("x"), F.col(f"__{j}").alias("y")) for i, j in pairs])).alias("p")
    rows = cell.select(each).where("p.x is not null and p.y is not null")
    return rows.groupBy("p.run_a", "p.run_b").agg(count_if(F.col("p.x") > F.col("p.y")).alias("b"), count_if(F.col("p.x") < F.col("p.y")).alias("c"))


def exact_p(b: Column, c: Column) -> Column:
    """Two-sided exact p of b and c discordant pairs, not clipped at 1; 1 if there are none.

    Twice the lower tail of a fair binomial at min(b, c), summed by ratios of neighbouring terms in logs.
    """
    n, low = b + c, F.least(b, c)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("total"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.log((n - k + 1).cast("double")) - F.log(k.cast("double"))
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    steps = F.when(low >= 1, F.sequence(F.lit(1).cast("long"), low)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, F.lit(1.0)).otherwise(2 * F.aggregate(steps, start, step, lambda acc: acc["total"]))


def holm(rows: DataFrame, p: str = "p", ties: tuple[str, ...] = ()) -> DataFrame:
    """rows, of which there are few, with holm: step-down adjusted p."""
    order = Window.orderBy(p, *ties)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    raised = rows.withColumn("__raw", F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1)))
    return raised.withColumn("holm", F.max("__raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__raw")


def cluster_sums(hits: DataFrame, cluster: str) -> DataFrame:
    """(run, cluster, hits, n): all that bootstrap replicates need."""
    return hits.groupBy("run", F.col(cluster).alias("cluster")).agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count(F.lit(1)).alias("n"))


def mixed(rows: DataFrame, name: str) -> DataFrame:
    """rows with the column, an integer of 32 bits, turned into a hash of as many, by multiplying and shifting.

    Each step is a column of its own, as one expression would hold the first one many times over.
    """
    x = F.col(name)
    for _ in range(2):
        rows = rows.withColumn(name, (F.shiftright(x, 16).bitwiseXOR(x) * 73244475) % 4294967296)
    return rows.withColumn(name, F.shiftright(x, 16).bitwiseXOR(x))


#: Clusters that are broadcast and numbered in one task, at a few dozen bytes each.
MOST_CLUSTERS = 200_000
#: Clusters in a block, of which a task holds one at a time; each block takes another pass over the draws.
BLOCK = 500_000
#: Draws that are hashed at once.
SLICE = 1 << 18


def draws(reps: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """(rep, k): m draws with replacement from 0 to m - 1 for each rep (rep, j), a row for each j.

    A draw is a hash of j under two keys of its replicate: j is hashed with the first, and the second is added before it is
    hashed again. The second differs for all replicates, so two that happen to hash the same numbers first don't end in the
    same sample.
    """
    rows = mixed(reps.select("rep", "j", *[((F.col("rep") * odd + seed) % 4294967296).alias(x) for x, odd in (("x", 40503), ("y", 60493))]), "x")
    rows = mixed(mixed(rows, "y").select("rep", F.col("x").bitwiseXOR(F.col("j")).alias("x"), "y"), "x")
    rows = mixed(rows.select("rep", ((F.col("x") + F.col("y")) % 4294967296).alias("x")), "x")
    return rows.select("rep", (F.col("x") % max(m, 1)).alias("k"))


def _mixed_in(x: np.ndarray) -> np.ndarray:
    """mixed() of numbers of 32 bits, in place."""
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(73244475)
    x ^= x >> np.uint32(16)
    return x


def _drawn_sums(m: int, replicates: int, share: int, columns: int, seed: int):
    """(rep, sums) of draws() for the `share` replicates from each row's `first` on, over the clusters of the row's block, which start at `low`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [batch.column(f"of_{k}") for k in range(columns)]
            for row, (first, low) in enumerate(zip(batch.column("first").to_pylist(), batch.column("low").to_pylist(), strict=True)):
                values = np.stack([c[row].values.to_numpy() for c in of])
                reps, size = range(first, min(first + share, replicates)), values.shape[1]
                sums = np.empty((columns, len(reps)), np.int64)
                for at, rep in enumerate(reps):
                    x, y = (_mixed_in(np.array([rep * odd + seed & 0xFFFFFFFF], np.uint32)) for odd in (40503, 60493))
                    times = np.zeros(size, np.int64)
                    for start in range(0, m, SLICE):
                        k = _mixed_in(_mixed_in(np.arange(start, min(start + SLICE, m), dtype=np.uint32) ^ x) + y)
                        k -= k // np.uint32(m) * np.uint32(m)  # k % m, which numpy divides for one by one
                        if size < m:
                            k = k[(k >= low) & (k < low + size)] - np.uint32(low)
                        times += np.bincount(k, minlength=size)
                    sums[:, at] = values @ times
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), *map(pa.array, sums)], names=["rep", *[f"of_{k}" for k in range(columns)]])

    return run


def bootstrap(sums: DataFrame, replicates: int, runs: list[str], seed: int = 0) -> DataFrame:
    """(run, rep, rate): clusters drawn with replacement, the same for all runs; draw j of replicate r is a hash of both and the seed, see draws().

    Replicates are dealt to tasks, which get the clusters in blocks, broadcast up to MOST_CLUSTERS of them; a draw is a number
    in an array and never a row.
    """
    spark = sums.sparkSession
    of = lambda r, c: F.sum(F.when(F.col("run") == r, F.col(c)).otherwise(0))
    columns = [(r, c) for r in runs for c in ("hits", "n")]
    names = [f"of_{k}" for k in range(len(columns))]
    wide = sums.groupBy("cluster").agg(*[of(r, c).cast("long").alias(name) for name, (r, c) in zip(names, columns, strict=True)])
    m = wide.count()
    if m >= 1 << 32:
        raise ValueError("a draw has 32 bits")
    if m <= MOST_CLUSTERS:
        at = wide.withColumn("k", F.row_number().over(Window.orderBy("cluster")).cast("long") - 1)
    else:
        at = running(wide, ["cluster"]).withColumnRenamed("before", "k")
    at = at.withColumn("block", F.floor(F.col("k") / BLOCK)).repartition(-(-m // BLOCK) or 1, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("k", *names))).alias("of"))
    blocks = at.select((F.col("block") * BLOCK).alias("low"), *[F.col(f"of.{n}") for n in names])
    share = max(-(-replicates // int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    each = spark.range(0, replicates, share, max(-(-replicates // share), 1)).select(F.col("id").alias("first")).crossJoin(F.broadcast(blocks) if m <= MOST_CLUSTERS else blocks)
    rows = each.mapInArrow(_drawn_sums(m, replicates, share, len(names), seed), "rep long, " + ", ".join(f"{n} long" for n in names))
    rows = rows.groupBy("rep").agg(*[F.sum(n).alias(n) for n in names])
    every = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.col(names[2 * k]).alias("h"), F.col(names[2 * k + 1]).alias("n")) for k, r in enumerate(runs)])).alias("x")
    return rows.select("rep", every).where("x.n > 0").select("x.run", "rep", (F.col("x.h") / F.col("x.n")).alias("rate"))


def interval(replicates: DataFrame, value: str = "rate") -> DataFrame:
    """By run: mean, percentile interval of 95 %, standard error and half width."""
    out = replicates.groupBy("run").agg(F.avg(value).alias("mean"), F.percentile(value, F.lit(0.025)).alias("low"), F.percentile(value, F.lit(0.975)).alias("high"), F.stddev_samp(value).alias("se"))
    return out.select("run", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high", "se")], F.round((F.col("high") - F.col("low")) / 2, 6).alias("half"))


def deltas(replicates: DataFrame, base: str) -> DataFrame:
    """By run: paired differences from the base run, and their two-sided bootstrap p."""
    b = F.max(F.when(F.col("run") == base, F.col("rate"))).over(Window.partitionBy("rep"))  # a row for each run
    d = replicates.withColumn("b", b).where((F.col("run") != base) & F.col("b").isNotNull()).withColumn("d", F.col("rate") - F.col("b"))
    out = d.groupBy("run").agg(F.avg("d").alias("delta"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.avg((F.col("d") <= 0).cast("int")).alias("under"), F.avg((F.col("d") >= 0).cast("int")).alias("over"))
    p = F.least(F.lit(1.0), 2 * F.least("under", "over"))
    return out.select("run", *[F.round(c, 6).alias(c) for c in ("delta", "low", "high")], F.round(p, 6).alias("p"), ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))
