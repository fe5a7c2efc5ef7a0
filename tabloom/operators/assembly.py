"""Tables, candidates and gold put together: placeholders, subsets, checks of sets, and texts for models.

Null keys match nothing; empty tables give empty ones, and checks of them pass. Ties go to the lesser key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.text import guard_correction

TASKS = ("cea", "cta", "cpa")
CELL = ["tab_id", "row_id", "col_id"]


def tasks(names: str) -> list[str]:
    """The tasks of a comma-separated list, in the order of TASKS; others are an error."""
    asked = {n.strip().lower() for n in names.split(",") if n.strip()}
    if asked - set(TASKS):
        raise ValueError(f"no such task: {', '.join(sorted(asked - set(TASKS)))}")
    return [t for t in TASKS if t in asked]


def without_metadata(cells: DataFrame, prefix: str = "Metadata:") -> DataFrame:
    return cells.where(~F.coalesce(F.col("header").startswith(prefix), F.lit(False)))


def column_kinds(cells: DataFrame) -> DataFrame:
    """(tab_id, col_id, missing, literal): the share of values that are missing, and whether all that are there are numbers."""
    value = F.col("value")
    text = value.isNotNull() & value.try_cast("double").isNull()
    return cells.groupBy("tab_id", "col_id").agg(F.avg(value.isNull().cast("int")).alias("missing"), (~F.bool_or(text)).alias("literal"))


def text_cells(cells: DataFrame) -> DataFrame:
    """Cells of columns that aren't literal."""
    return cells.join(column_kinds(cells).where("not literal").select("tab_id", "col_id"), ["tab_id", "col_id"], "left_semi")


def with_placeholders(cells: DataFrame, candidates: DataFrame, blank: bool = False) -> DataFrame:
    """candidates, and a row without id for each cell (tab_id, row_id, col_id, mention) that has none; for blank cells only if asked.

    A placeholder's label and qid are empty and its quality is 0, so that shares of types count its cell; other columns are null.
    """
    empty = F.trim(F.coalesce("mention", F.lit(""))) == ""
    rows = cells.join(candidates.select(*CELL).distinct(), CELL, "left_anti").where(F.lit(blank) | ~empty)
    kinds, text = dict(candidates.dtypes), F.when(empty, "").otherwise(F.col("mention"))
    given = {"mention": text, "label": F.lit(""), "qid": F.lit(""), "quality": F.lit(0), **{c: F.col(c) for c in CELL}}
    return candidates.unionByName(rows.select(*[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in candidates.columns]))


def counted_cells(cells: DataFrame, blank: bool = False) -> DataFrame:
    """with_placeholders() for cells (mention, of) with their candidates in an array: it is empty, not null, where the cell counts without any; other cells without are left out."""
    empty = F.trim(F.coalesce("mention", F.lit(""))) == ""
    of = F.coalesce("of", F.array().cast(cells.schema["of"].dataType))
    return cells.withColumn("of", of).where((F.size("of") > 0) | F.lit(blank) | ~empty)


def of_quality(candidates: DataFrame, qualities: list[int] | None) -> DataFrame:
    return candidates if qualities is None else candidates.where(F.col("quality").isin(qualities))


def first_values(candidates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each key and column the first value that isn't null, by quality and order; they may come from different rows."""
    return candidates.groupBy(*keys).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct("quality", "ord"))).alias(c) for c in columns])


def first_values_of_cell(of: Column, column: str) -> Column:
    """The same of a cell's candidates in an array."""
    there = F.filter(of, lambda c: c[column].isNotNull())
    return F.array_min(F.transform(there, lambda c: F.struct(c["quality"], c["ord"], c[column].alias("value"))))["value"]


def compare_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys of both, with side: both, left or right."""
    sides = left.select(*keys, F.lit(1).alias("side")).union(right.select(*keys, F.lit(2)))
    found = F.bit_or("side")
    return sides.groupBy(*keys).agg(F.when(found == 3, "both").when(found == 1, "left").otherwise("right").alias("side"))


def require_disjoint(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """An error that names a key of both."""
    both = compare_keys(left, right, keys).where("side = 'both'").first()
    if both is not None:
        raise ValueError(f"in both: {[both[k] for k in keys]}")


def column_accuracy(hits: DataFrame, scores: DataFrame, gold: DataFrame) -> DataFrame:
    """(tab_id, col_id, n, accuracy, score) of gold's columns with cells: the share of right cells beside the type's score, 0 where no type was given."""
    keys = ["tab_id", "col_id"]
    cells = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("int")).alias("accuracy"))
    return gold.select(*keys).join(cells, keys).join(scores, keys, "left").select(*keys, "n", "accuracy", F.coalesce("score", F.lit(0.0)).alias("score"))


def with_header(cells: DataFrame) -> DataFrame:
    """Cells as they lie in the file: the header is row 0."""
    head = cells.groupBy("tab_id", "col_id").agg(F.min("header").alias("value")).select("tab_id", F.lit(0).cast("long").alias("row_id"), "col_id", "value")
    return cells.select("tab_id", (F.col("row_id") + 1).cast("long").alias("row_id"), "col_id", "value").unionByName(head)


def mentions(gold: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gold with the value of its cell in raw, where there is one that isn't blank; and the tables of gold that raw lacks."""
    found = gold.join(raw, CELL).withColumn("value", F.trim("value")).where("value <> ''")
    return found, gold.select("tab_id").distinct().join(raw.select("tab_id").distinct(), "tab_id", "left_anti")


def mean_candidates(lists: Column, separator: str = ";") -> Column:
    """The mean length of lists in a text; an empty text is one."""
    return F.avg(F.size(F.split(lists, separator, -1)))


def first_is_right(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """Whether the candidate that was found first is the gold of each cell (tab_id, row_id, gold)."""
    first = candidates.where("ord = 1").select("tab_id", "row_id", F.col("qid").alias("first"))
    return cells.join(first, ["tab_id", "row_id"], "left").withColumn("hit", F.coalesce(F.col("first") == F.col("gold"), F.lit(False)))


def examples_of_each(rows: DataFrame, kind: str, order: str, most: int) -> DataFrame:
    """The first rows of each kind."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(kind).orderBy(order))).where(F.col("k") <= most)


def candidate_line(aliases: Column | None = None, types: Column | None = None, of: Column | None = None) -> Column:
    """qid, label and description, columns or fields of the struct `of`, in a line; also 5 aliases and 4 different labels of types, where given."""

    def part(name: str, items: Column | None, most: int) -> Column:
        if items is None:
            return F.lit("")
        some = F.slice(F.filter(items, lambda x: x.isNotNull() & (x != "")), 1, most)
        return F.when(F.size(some) > 0, F.concat(F.lit(f" [{name}: "), F.array_join(some, ", "), F.lit("]"))).otherwise("")

    get = lambda c: F.col(c) if of is None else of[c]
    line = F.concat(get("qid"), F.lit(": "), get("label"), F.lit(" ("), F.coalesce(get("description"), F.lit("")), F.lit(")"))
    return F.concat(line, part("also known as", aliases, 5), part("type", None if types is None else F.array_distinct(types), 4))


def alias_target(label: Column, aliases: Column, most: int = 5) -> Column:
    """The label and the first aliases that differ from it and each other in more than case."""
    names = F.filter(F.transform(F.concat(F.array(label), F.coalesce(aliases, F.array().cast("array<string>"))), lambda a: F.trim(a)), lambda a: a.isNotNull() & (a != ""))
    lower = F.transform(names, F.lower)
    new = F.filter(names, lambda a, k: F.array_position(lower, F.lower(a)) == k + 1)
    return F.array_join(F.slice(new, 1, most + 1), "; ")


def few_shot(text: Column) -> Column:
    """Pairs of `a -> b; c -> d`; parts without an arrow are left out, null if none is left."""
    parts = F.filter(F.split(text, ";", -1), lambda p: p.contains("->"))
    pairs = F.transform(parts, lambda p: F.transform(F.split(p, "->", 2), lambda x: F.trim(x)))
    return F.when(F.size(pairs) > 0, pairs)


def claim_value(json: Column) -> Column:
    """The kind (entity, quantity, time, string, coord) and value of a claim's JSON; null for other kinds and for quantities that are no numbers."""
    get = lambda path: F.get_json_object(json, f"$.{path}")
    kind, number = get("type"), get("value.amount").try_cast("double")

    def tagged(name: str, **fields: Column) -> Column:
        kinds = {"text": "string", "number": "double", "lat": "double", "lon": "double"}
        return F.struct(F.lit(name).alias("kind"), *[fields.get(f, F.lit(None)).cast(t).alias(f) for f, t in kinds.items()])

    return (
        F.when(kind == "wikibase-entityid", tagged("entity", text=get("value.id")))
        .when((kind == "quantity") & number.isNotNull(), tagged("quantity", number=number))
        .when(kind == "time", tagged("time", text=get("value.time")))
        .when(kind == "string", tagged("string", text=get("value")))
        .when(kind == "monolingualtext", tagged("string", text=get("value.text")))
        .when(kind == "globecoordinate", tagged("coord", lat=get("value.latitude").try_cast("double"), lon=get("value.longitude").try_cast("double")))
    )


def corrected(rows: DataFrame, column: str, answers: DataFrame) -> DataFrame:
    """rows with the answer (value, answer) to each of their values, each different value asked once; the value stays where there is none, or one that guard_correction() turns down."""
    guarded = guard_correction(F.col("value"), F.col("answer"))
    asked = rows.select(F.col(column).alias("value")).distinct().join(answers, "value").where("answer is not null").select(F.col("value").alias("__value"), guarded.alias("__answer"))
    return rows.join(asked, F.col(column) == F.col("__value"), "left").withColumn(column, F.coalesce("__answer", column)).drop("__value", "__answer")


def picked_property(tied: DataFrame, answers: DataFrame) -> DataFrame:
    """Of the tied properties (tab_id, sub_col, obj_col, pid) of a pair of columns the one that the answer (text) names, as a whole id; else the least."""
    keys = ["tab_id", "sub_col", "obj_col"]
    named = F.coalesce(F.array_contains(F.regexp_extract_all(F.upper("text"), F.lit(r"\bP[0-9]+\b"), F.lit(0)), F.col("pid")), F.lit(False))
    return tied.join(answers, keys, "left").groupBy(*keys).agg(F.coalesce(F.min(F.when(named, F.col("pid"))), F.min("pid")).alias("pid"))


def described(types: DataFrame, entities: DataFrame) -> DataFrame:
    """types (type, …) with label and description of their entity; the type itself and an empty text where it is unknown."""
    known = entities.select(F.col("qid").alias("type"), F.col("label").alias("l"), F.col("description").alias("d"))
    return types.join(known, "type", "left").withColumn("label", F.coalesce("l", "type")).withColumn("description", F.coalesce("d", F.lit(""))).drop("l", "d")


def enriched(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """candidates with description, aliases, p31, p279 and sitelink of their entity (qid), each once; empty where it is unknown or has none."""
    kinds = {"description": "string", "aliases": "array<string>", "p31": "array<string>", "p279": "array<string>", "sitelink": "string"}
    none = lambda kind: F.lit("") if kind == "string" else F.array().cast(kind)
    known = entities.select(F.col("qid").alias("__qid"), *[F.col(c).alias(f"__{c}") for c in kinds]).dropDuplicates(["__qid"])
    rows = candidates.drop(*kinds).join(known, F.col("qid") == F.col("__qid"), "left")
    return rows.withColumns({c: F.coalesce(f"__{c}", none(kind)) for c, kind in kinds.items()}).drop("__qid", *[f"__{c}" for c in kinds])


def union_of(frames: list[DataFrame]) -> DataFrame:
    """The candidates of the parts of a run, by name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
