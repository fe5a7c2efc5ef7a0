"""Two versions of tables compared cell by cell, at the same place.

cells: tab_id, row_id, col_id, value, rows and columns from 0; with_header() of assembly puts the header in row 0. Where the
versions of a table differ in size, what both have room for is compared, and the rest is told apart as of one version
only; so are tables that one version lacks. A missing value or cell is blank; a place that is blank in both is left out.
A place that a version has more than once counts with the greatest of its values. Null tab_ids match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import change

CELL = ["tab_id", "row_id", "col_id"]
KINDS = ("same", "case", "real", "only_before", "only_after")


def extents(cells: DataFrame) -> DataFrame:
    """(tab_id, n_rows, n_cols)."""
    return cells.groupBy("tab_id").agg((F.max("row_id") + 1).alias("n_rows"), (F.max("col_id") + 1).alias("n_cols"))


def shapes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tab_id, side, shared_rows, shared_cols, before_rows, before_cols, after_rows, after_cols): side is both, before or after; what the other lacks has size 0."""
    tagged = [extents(v).select("tab_id", *[F.col(c).alias(f"{n}_{c[2:]}") for c in ("n_rows", "n_cols")], *[F.lit(0).alias(f"{o}_{c}") for c in ("rows", "cols")]) for v, n, o in ((before, "before", "after"), (after, "after", "before"))]
    sizes = ["before_rows", "before_cols", "after_rows", "after_cols"]
    both = tagged[0].unionByName(tagged[1]).where("tab_id is not null").groupBy("tab_id").agg(*[F.max(c).alias(c) for c in sizes])
    side = F.when(F.col("after_rows") == 0, "before").when(F.col("before_rows") == 0, "after").otherwise("both")
    return both.select("tab_id", side.alias("side"), F.least("before_rows", "after_rows").alias("shared_rows"), F.least("before_cols", "after_cols").alias("shared_cols"), *sizes)


def compare(before: DataFrame, after: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(cell, before, after, kind, is_target): kind is same, case (letters' case or white space), real, only_before or only_after.

    One aggregation brings both versions of a place together.
    """
    one = lambda v, name, other: v.select(*CELL, F.coalesce("value", F.lit("")).alias(name), F.lit(None).cast("string").alias(other))
    places = one(before, "before", "after").unionByName(one(after, "after", "before"))
    if targets is not None:
        places = places.withColumn("target", F.lit(False)).unionByName(targets.select(*CELL, F.lit(True).alias("target")), allowMissingColumns=True)
    else:
        places = places.withColumn("target", F.lit(False))
    cell = places.groupBy(*CELL).agg(*[F.max(c).alias(c) for c in ("before", "after", "target")]).where("before is not null or after is not null")
    b, a = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    cell = cell.where((F.trim(b) != "") | (F.trim(a) != "")).join(shapes(before, after), "tab_id")
    shared = (F.col("row_id") < F.col("shared_rows")) & (F.col("col_id") < F.col("shared_cols"))
    kind = F.when(shared, change(b, a)).when(F.col("before").isNotNull(), "only_before").otherwise("only_after")
    return cell.select(*CELL, b.alias("before"), a.alias("after"), kind.alias("kind"), F.col("target").alias("is_target"))


def tally(compared: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, n_<kind> of each kind, and the same of targets): n counts the compared places, not those of one version."""
    count = lambda test: F.count(F.when(test, 1))
    sums = []
    for name, of in (("", F.lit(True)), ("target_", F.col("is_target"))):
        sums += [count(of & F.col("kind").isin("same", "case", "real")).alias(f"{name}n"), *[count(of & (F.col("kind") == k)).alias(f"{name}n_{k}") for k in KINDS]]
    return compared.groupBy(*keys).agg(*sums)


def changes(compared: DataFrame) -> DataFrame:
    """The compared places that are not the same, with the number of letters that differ but for case."""
    return compared.where("kind in ('case', 'real')").withColumn("distance", F.levenshtein(F.lower("before"), F.lower("after")))
