"""Reports on annotations: kinds of types by the hierarchy, misses of candidates, outcomes of properties, accuracy in bins, running costs.

Texts of types, ids and properties are compared in lower case. Null keys match nothing; empty tables give empty reports,
and a report of one row gives zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.evaluation import count_if, ratio
from tabloom.operators.order import running

FAR = {"ancestor": (0.8, 5), "descendant": (0.7, 3)}
#: Bins of a column's share of right cells: name, from, below.
BINS = (("[0.00, 0.25)", 0.0, 0.25), ("[0.25, 0.50)", 0.25, 0.5), ("[0.50, 0.75)", 0.5, 0.75), ("[0.75, 1.00)", 0.75, 1.0), ("1.00", 1.0, 1.01))


def type_details(annotations: DataFrame, gold: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(run, tab_id, col_id, score, kind, depth) of each annotation (run, tab_id, col_id, value) of a gold column.

    gold: tab_id, col_id, types, an array; hierarchy: type, other, direction, depth. Each gold type gives a kind: exact,
    ancestor, ancestor_far, descendant, descendant_far or miss; an ancestor goes before a descendant. Of several gold types the
    best score counts, the first of equals, and a miss only if all miss.
    """
    pairs = annotations.join(gold.select("tab_id", "col_id", F.posexplode("types").alias("pos", "type")), ["tab_id", "col_id"])
    up = F.struct((F.col("direction") != "ancestor").alias("second"), "direction", "depth")
    known = hierarchy.groupBy(F.lower("type").alias("t"), F.lower("other").alias("o")).agg(F.min(up).alias("h"))
    rows = pairs.join(known, (F.lower("type") == F.col("t")) & (F.lower("value") == F.col("o")), "left")
    direction, depth = F.col("h.direction"), F.col("h.depth")
    made = lambda score, kind, d: F.struct(score.cast("double").alias("score"), (-F.col("pos")).alias("early"), kind.alias("kind"), d.cast("int").alias("depth"))
    detail = F.when(F.lower("value") == F.lower("type"), made(F.lit(1.0), F.lit("exact"), F.lit(0)))
    for name, (base, most) in FAR.items():
        detail = detail.when((direction == name) & (depth <= most), made(F.pow(F.lit(base), depth.cast("double")), F.lit(name), depth))
        detail = detail.when(direction == name, made(F.lit(0.0), F.lit(f"{name}_far"), depth))
    best = rows.withColumn("d", detail).groupBy("run", "tab_id", "col_id").agg(F.max("d").alias("d"))
    return best.select("run", "tab_id", "col_id", F.coalesce("d.score", F.lit(0.0)).alias("score"), F.coalesce("d.kind", F.lit("miss")).alias("kind"), "d.depth")


def type_breakdown(details: DataFrame) -> DataFrame:
    """By run: how many annotations are of which kind, the percentages of exact and partial ones, and the mean score."""
    n, kind = F.count(F.lit(1)), lambda *names: count_if(F.col("kind").isin(*names))
    partial = kind("ancestor", "descendant")
    percent = lambda x: F.round(100 * ratio(x, n), 2)
    return details.groupBy("run").agg(
        n.alias("annotations"), *[kind(k).alias(k) for k in ("exact", "ancestor", "descendant")], kind("ancestor_far", "descendant_far").alias("far"), kind("miss").alias("miss"),
        percent(kind("exact")).alias("exact_pct"), percent(partial).alias("partial_pct"), F.round(F.avg("score"), 4).alias("mean_score"),
    )


def depth_counts(details: DataFrame) -> DataFrame:
    """(run, kind, depth, n) of partial matches, 0 where another run has some."""
    some = details.where(F.col("kind").isin("ancestor", "descendant"))
    counts = some.groupBy("run", "kind", "depth").agg(F.count(F.lit(1)).alias("n"))
    every = details.select("run").distinct().join(F.broadcast(some.select("kind", "depth").distinct()))  # eight depths at most
    return every.join(counts, ["run", "kind", "depth"], "left").fillna(0, ["n"])


def candidate_misses(gold: DataFrame, candidates: DataFrame, qualities: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(measure, quality, n): what candidates hold of gold (tab_id, row_id, col_id, qid), by cells and qualities.

    candidates: tab_id, row_id, col_id, ord, qid, quality; one without qid is a placeholder. Where a cell has an id twice
    the last one's quality counts. quality is 0 for the measures of all.
    """
    cell = ["tab_id", "row_id", "col_id"]
    named = F.coalesce(F.col("qid"), F.lit("")) != ""
    ids = candidates.where(named).groupBy(*cell, "qid").agg(F.max_by("quality", "ord").alias("quality"))
    cells = ids.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    right = gold.join(cells, cell, "left").join(ids, [*cell, "qid"], "left").select(F.coalesce("n", F.lit(0)).alias("n"), "quality")
    missed = F.col("quality").isNull()
    sums = {"gold": F.count(F.lit(1)), "with_candidates": count_if(F.col("n") > 0), "found": count_if(~missed), "only_one_wrong": count_if(missed & (F.col("n") == 1)), "over_five_wrong": count_if(missed & (F.col("n") > 5))}
    of_gold = right.agg(*[x.alias(m) for m, x in sums.items()], *[count_if(F.col("quality") == q).alias(f"q{q}") for q in qualities])
    per_cell = candidates.groupBy(*cell).agg(*[count_if(named & (F.col("quality") == q)).alias(f"q{q}") for q in qualities], count_if(~named).alias("empty"))
    of_cells = per_cell.agg(*[F.coalesce(F.sum(f"q{q}"), F.lit(0)).alias(f"rows{q}") for q in qualities], *[count_if(F.col(f"q{q}") == 0).alias(f"without{q}") for q in qualities], F.coalesce(F.sum("empty"), F.lit(0)).alias("empty"))
    one = lambda m, q, c: F.struct(F.lit(m).alias("measure"), F.lit(q).cast("int").alias("quality"), F.col(c).cast("long").alias("n"))
    first = of_gold.select(F.inline(F.array(*[one(m, 0, m) for m in sums], *[one("found", q, f"q{q}") for q in qualities])))
    second = of_cells.select(F.inline(F.array(one("placeholders", 0, "empty"), *[one(m, q, f"{c}{q}") for m, c in (("rows", "rows"), ("cells_without", "without")) for q in qualities])))
    return first.unionByName(second)


def candidate_misses_of_cells(cells: DataFrame, qualities: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The same of cells (gold, of) with their candidates in an array; a cell whose array is empty or null has a placeholder. One pass, no shuffle of cells."""
    named = F.filter("of", lambda c: F.coalesce(c["qid"], F.lit("")) != "")
    size = lambda of: F.greatest(F.coalesce(F.size(of), F.lit(0)), F.lit(0))
    of_quality = lambda q: F.filter(named, lambda c: c["quality"] == q)
    right = F.array_max(F.transform(F.filter("of", lambda c: c["qid"] == F.col("gold")), lambda c: F.struct(c["ord"], c["quality"].alias("quality"))))["quality"]
    rows = cells.select(
        size(F.array_distinct(F.transform(named, lambda c: c["qid"]))).alias("n"), right.alias("quality"), F.when(size("of") == 0, 1).otherwise(size("of") - size(named)).alias("empty"),
        *[size(of_quality(q)).alias(f"of{q}") for q in qualities],
    )
    missed = F.col("quality").isNull()
    sums = {("gold", 0): F.count(F.lit(1)), ("with_candidates", 0): count_if(F.col("n") > 0), ("found", 0): count_if(~missed), ("only_one_wrong", 0): count_if(missed & (F.col("n") == 1)), ("over_five_wrong", 0): count_if(missed & (F.col("n") > 5)), ("placeholders", 0): F.sum("empty")}
    for q in qualities:
        sums |= {("found", q): count_if(F.col("quality") == q), ("rows", q): F.sum(f"of{q}"), ("cells_without", q): count_if(F.col(f"of{q}") == 0)}
    total = rows.agg(*[F.coalesce(n, F.lit(0)).cast("long").alias(f"{m}{q}") for (m, q), n in sums.items()])
    return total.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(q).cast("int").alias("quality"), F.col(f"{m}{q}").alias("n")) for m, q in sums])))


def property_outcomes(gold: DataFrame, made: DataFrame) -> DataFrame:
    """(tab_id, sub_col, obj_col, property, outcome) of gold pairs: correct, wrong, pair missing, table absent; and of pairs that aren't gold: extra."""
    pair = ["tab_id", "sub_col", "obj_col"]
    both = gold.withColumn("__g", F.lit(1)).join(made.select(*pair, F.col("property").alias("__p")), pair, "full")
    rows = both.join(made.select("tab_id").distinct().withColumn("__t", F.lit(1)), "tab_id", "left")
    outcome = F.when(F.col("__g").isNull(), "extra").when(F.lower("__p") == F.lower("property"), "correct").when(F.col("__p").isNotNull(), "wrong").when(F.col("__t") == 1, "pair missing").otherwise("table absent")
    return rows.select(*pair, F.coalesce("property", "__p").alias("property"), outcome.alias("outcome"))


def accuracy_bins(columns: DataFrame) -> DataFrame:
    """(bin, n, mean_score, exact_pct, good_pct) of columns (accuracy, score): of each bin of accuracy, empty ones too, the types' mean score, and how many are exact or score 0.7 and more."""
    score = F.col("score")
    name = F.lit(None).cast("string")
    for label, low, high in BINS:
        name = F.when((F.col("accuracy") >= low) & (F.col("accuracy") < high), label).otherwise(name)
    n = F.count(F.lit(1))
    percent = lambda test: F.round(100 * ratio(count_if(test), n), 6)
    sums = columns.groupBy(name.alias("bin")).agg(n.alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), percent(score == 1).alias("exact_pct"), percent(score >= 0.7).alias("good_pct"))
    every = columns.sparkSession.createDataFrame([(b[0],) for b in BINS], "bin string")
    return every.join(sums, "bin", "left").fillna(0, ["n"])


def cost_log(calls: DataFrame, keys: list[str], order: str, amounts: list[str]) -> DataFrame:
    """calls with total_<amount>, the sums up to and with each call of its keys, and total_calls; missing amounts are 0."""
    rows = calls.fillna(0, amounts).withColumn("calls", F.lit(1).cast("long"))
    out = rows
    for a in [*amounts, "calls"]:
        out = running(out, [order], tuple(keys), a).withColumn(f"total_{a}", F.col("before") + F.col(a)).drop("before")
    return out.drop("calls")


def deltas(log: DataFrame, keys: list[str], order: str, totals: list[str]) -> DataFrame:
    """log with <total>_delta: how much each total grew since the line before, from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    grown: dict[str, Column] = {f"{t}_delta": F.col(t) - F.coalesce(F.lag(t).over(w), F.lit(0)) for t in totals}
    return log.withColumns(grown)
