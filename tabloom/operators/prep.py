"""Preparation of datasets: subsets, splits, examples, context windows, noise.

Random choices order rows by an arithmetic hash of their key and a seed, so a run can be repeated anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.order import first_rows, running


def draw(key: Column, seed: int) -> Column:
    return (key * 48271 + seed) % 2147483647


def small_and_random(sizes: DataFrame, n_small: int, most: int, n_random: int, seed: int) -> DataFrame:
    """Of (tab_id, n), with part: n_small tables of at most `most`, and n_random of all that are left, small ones too."""
    small = first_rows(sizes.where(F.col("n") <= most), n_small, [draw(F.col("tab_id"), seed)], "tab_id")
    rest = first_rows(sizes.join(small.select("tab_id"), "tab_id", "left_anti"), n_random, [draw(F.col("tab_id"), seed + 1)], "tab_id")
    return small.withColumn("part", F.lit("small")).unionByName(rest.withColumn("part", F.lit("random")))


def split_tables(tables: DataFrame, ratio: float, seed: int) -> DataFrame:
    """(tab_id, split): the share of tables with the least draws, at least one, is for validation. Each table is given once."""
    most = max(1, int(tables.count() * ratio))
    placed = running(tables.select("tab_id", draw(F.col("tab_id"), seed).alias("__draw")), ["__draw", "tab_id"])
    return placed.select("tab_id", F.when(F.col("before") < most, "valid").otherwise("train").alias("split"))


def cap_nil(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """rows with is_nil: at most the share of nil rows."""
    rest = rows.where(~F.col("is_nil"))
    cap = int(rest.count() * share / (1 - share) + 1e-9)
    return rest.unionByName(first_rows(rows.where("is_nil"), cap, [draw(F.col(key), seed)], key))


def most_examples(examples: DataFrame, most: int | None, order: str) -> DataFrame:
    """The first examples by the order, if there is a limit to them."""
    return examples if most is None else first_rows(examples, most, [], order)


def _status(builder: str, margin: float, review: float, nil: str | None, gold: Column, n: Column, gold_rank: Column, gap: Column, score: Column, several: Column, switched: Column) -> Column:
    is_nil = F.coalesce(gold == nil, F.lit(False)) if nil else F.lit(False)
    gated = F.coalesce(gap < margin, F.lit(False)) | (F.lit(review > 0) & (score < review))
    first = F.when(F.coalesce(gold, F.lit("")) == "", "no_gold")
    first = first.when(F.coalesce(n, F.lit(0)) <= 1, "not_ambiguous") if builder == "limited" else first.when(n.isNull(), "no_candidates")
    status = (
        first.when(F.coalesce(switched, F.lit(False)) & (n > 1), "resolved_by_tiebreak").when(~gated, "not_gated")
        .when(~is_nil & gold_rank.isNull(), "gold_absent").when(~several, "trivial").when(is_nil, "kept_nil").otherwise("kept")
    )
    return status


def example_status_of_cells(builder: str, margin: float, topk: int, review: float = 0.0, nil: str | None = "NIL") -> Column:
    """example_status() over ranked_cells() with gold, from the array of a cell's candidates."""
    first, head = F.get("of", F.lit(0)), F.slice("of", 1, topk)
    n = F.when(F.size("of") > 0, F.size("of"))
    gold_rank = F.get(F.filter(head, lambda c: c["qid"] == F.col("gold")), F.lit(0))["rank"]
    several = F.size(F.array_distinct(F.transform(head, lambda c: c["qid"]))) > 1
    return _status(builder, margin, review, nil, F.col("gold"), n, gold_rank, first["gap"], first["score"], several, F.lit(False))


def example_status(cells: DataFrame, ranked: DataFrame, builder: str, margin: float, topk: int, review: float = 0.0, switched: DataFrame | None = None, nil: str | None = "NIL") -> DataFrame:
    """cells (tab_id, row_id, gold) with the status of a training example.

    A cell without gold has no_gold. builder `limited`: one without several candidates is not_ambiguous; `context`: one without any has no_candidates.
    Then, in this order: resolved_by_tiebreak (in switched), not_gated (neither a lead under the margin nor a score under
    review), gold_absent (of the first topk; a gold of nil never is), trivial (the first topk are one entity), kept_nil, kept.
    """
    head = F.col("rank") <= topk
    of = ranked.groupBy("tab_id", "row_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(head & (F.col("qid") == F.col("gold")), F.col("rank"))).alias("gold_rank"),
        F.max(F.when(F.col("rank") == 1, F.col("gap"))).alias("gap"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        (F.min(F.when(head, F.col("qid"))) != F.max(F.when(head, F.col("qid")))).alias("several"),
    )
    rows = cells.join(of, ["tab_id", "row_id"], "left")
    if switched is not None:
        rows = rows.join(switched.select("tab_id", "row_id", F.lit(True).alias("switched")).distinct(), ["tab_id", "row_id"], "left")
    else:
        rows = rows.withColumn("switched", F.lit(False))
    of_row = [F.col(c) for c in ("gold", "n", "gold_rank", "gap", "score", "several", "switched")]
    return rows.withColumn("status", _status(builder, margin, review, nil, *of_row))


def table_windows(rows: DataFrame, most: int) -> DataFrame:
    """(tab_id, row_id, n_rows, first_row, context): up to `most` rows of text, from half of them before the row on; all rows of a table that has no more.

    rows: tab_id, row_id from 0, text. A frame of neighbours goes along each table, so a row is shuffled once, by its table,
    and no table is held whole.
    """
    table = Window.partitionBy("tab_id")
    near = table.orderBy("row_id").rangeBetween(1 - most, most - 1)
    first = F.when(F.col("n") <= most, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("row_id") - most // 2)).cast("long")
    known = rows.where("tab_id is not null and row_id is not null").select("tab_id", F.col("row_id").cast("long").alias("row_id"), "text")
    around = known.withColumns({"n": F.max("row_id").over(table) + 1, "of": F.collect_list(F.struct(F.col("row_id").alias("near"), "text")).over(near)})
    held = around.withColumn("first", first).withColumn("of", F.sort_array(F.filter("of", lambda r: (r["near"] >= F.col("first")) & (r["near"] < F.col("first") + most)))).dropDuplicates(["tab_id", "row_id"])
    return held.select("tab_id", "row_id", F.size("of").cast("long").alias("n_rows"), F.get("of", F.lit(0))["near"].alias("first_row"), F.array_join(F.transform("of", lambda r: r["text"]), "|").alias("context"))


NOISE = ("clean", "delete", "insert", "substitute")


def noise(text: Column, key: Column, seed: int) -> Column:
    """A struct of the text with misspellings and their kind; a quarter stays clean.

    A walk of draws from the key decides all of it: the kind, how many edits (1 to a quarter of the letters, or of all
    characters for insertions), and each edit's place and letter. Letters are deleted or replaced once each, upper case stays
    upper case, at least one letter is left, and letters are inserted anywhere. A text without letters to edit stays as it
    is; a null one is null.
    """
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    after = lambda x: (x * 48271 + 11) % 2147483647
    start = draw(key, seed)
    kind = (start % 4).cast("int")
    places = F.filter(F.sequence(F.lit(0), F.size(chars)), lambda p: F.coalesce(F.get(chars, p).rlike(r"^\p{L}$"), F.lit(False)))
    n = F.when(kind == 2, F.size(chars)).otherwise(F.size(places))
    edits = 1 + after(start) % F.greatest(F.floor(n / 4), F.lit(1))
    edits = F.when(kind == 1, F.least(edits, n - 1)).otherwise(F.least(edits, n))
    letter = lambda x: F.char((97 + x % 26).cast("int"))
    state = F.struct(after(after(start)).alias("x"), chars.alias("chars"), places.alias("left"))

    def step(acc: Column, _: Column) -> Column:
        where, new = acc["x"], letter(after(acc["x"]))
        inserted = (where % (F.size(acc["chars"]) + 1)).cast("int")
        longer = F.concat(F.slice(acc["chars"], F.lit(1), inserted), F.array(new), F.slice(acc["chars"], inserted + 1, F.size(acc["chars"])))
        at = F.get(acc["left"], (where % F.greatest(F.size(acc["left"]), F.lit(1))).cast("int"))
        edited = lambda c: F.when(kind == 1, "").when(c != F.lower(c), F.upper(new)).otherwise(new)
        changed = F.transform(acc["chars"], lambda c, p: F.when(p == at, edited(c)).otherwise(c))
        return F.struct(after(after(acc["x"])).alias("x"), F.when(kind == 2, longer).otherwise(changed).alias("chars"), F.filter(acc["left"], lambda p: p != at).alias("left"))

    steps = F.when((kind > 0) & (edits > 0), F.sequence(F.lit(1).cast("long"), edits.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    noisy = F.aggregate(steps, state, step, lambda acc: F.array_join(acc["chars"], ""))
    return F.when(text.isNotNull(), F.struct(noisy.alias("text"), F.get(F.array(*map(F.lit, NOISE)), kind).alias("kind")))


def smoke_tables(cea: DataFrame, cta: DataFrame, cpa: DataFrame, most: int, available: DataFrame | None = None) -> DataFrame:
    """(tab_id, n, complete): the tables with the fewest cell targets, first those that have targets of all three kinds, then others with cell targets.

    One aggregation of kinds by table; ties go to the lesser tab_id; with available (tab_id), only those.
    """
    kinds = [t.select("tab_id", F.lit(1 << k).alias("kind")) for k, t in enumerate((cea, cta, cpa))]
    of = kinds[0].union(kinds[1]).union(kinds[2]).groupBy("tab_id").agg(F.bit_or("kind").alias("kinds"), F.count(F.when(F.col("kind") == 1, 1)).alias("n"))
    if available is not None:
        of = of.join(available.select("tab_id"), "tab_id", "left_semi")
    return of.where("n > 0").select("tab_id", "n", (F.col("kinds") == 7).alias("complete")).orderBy(F.desc("complete"), "n", "tab_id").limit(most)
