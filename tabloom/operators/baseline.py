"""The direct baseline: a model is asked for ids with nothing but the table, without candidates.

cells: tab_id, row_id, col_id, header, value, rows from 0; a cell that isn't there is blank. Values are shown up to SHOWN
characters. A table without cells, and a target outside its table, is not asked about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import entity_id, property_id
from tabloom.operators import lookup
from tabloom.operators.prompts import answered, filled

SHOWN, MOST_ROWS, MOST_VALUES, MOST_PAIRS = 80, 20, 30, 15
CELL, COLUMN, PAIR = ["tab_id", "row_id", "col_id"], ["tab_id", "col_id"], ["tab_id", "sub_col", "obj_col"]
KEYS = {"cea": CELL, "cta": COLUMN, "cpa": PAIR}
CEA = "A table, the cell in question between >> and <<:\n${table}\n\nThe cell is in row ${row}, column ${col} (${header}) and reads: ${mention}\nGive the QID of the entity it names, and nothing else."
CTA = "A column named ${header} has these values: ${values}\nGive the QID of the class of all of them, and nothing else."
CPA = "Pairs of values from the columns ${sub_header} and ${obj_header}:\n${pairs}\nGive the PID of the property that leads from the first to the second, and nothing else."


def shown(value: Column) -> Column:
    return F.left(F.coalesce(value, F.lit("")), F.lit(SHOWN))


def headers(cells: DataFrame) -> DataFrame:
    """(tab_id, n_rows, headers): the headers by column, as many as the table is wide."""
    sums = cells.groupBy(*COLUMN).agg(F.max("row_id").alias("last"), F.min("header").alias("header"))
    of = F.sort_array(F.collect_list(F.struct("col_id", "header")))
    wide = sums.groupBy("tab_id").agg(F.max("last").alias("last"), of.alias("of"))  # a row for each column
    at = F.sequence(F.lit(0), F.element_at("of", -1)["col_id"])
    name = lambda k: F.coalesce(F.get(F.filter("of", lambda h: h["col_id"] == k), F.lit(0))["header"], F.lit(""))
    return wide.select("tab_id", (F.col("last") + 1).alias("n_rows"), F.transform(at, name).alias("headers"))


def lines(cells: DataFrame) -> DataFrame:
    """(tab_id, row_id, cells): the values of each row that are there, with their columns."""
    of = F.sort_array(F.collect_list(F.struct("col_id", shown(F.col("value")).alias("value"))))
    return cells.groupBy("tab_id", "row_id").agg(of.alias("cells"))


def table_blocks(cells: DataFrame, targets: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """targets (tab_id, row_id, col_id) with table, header and mention: up to `most` rows, from half of them before the target on, or all rows.

    A target's rows are named first and their cells joined to them, so no table is held by one task.
    """
    heads = headers(cells)
    rows = targets.select(*CELL).distinct().join(heads, "tab_id").where((F.col("row_id") >= 0) & (F.col("row_id") < F.col("n_rows")) & (F.col("col_id") >= 0) & (F.col("col_id") < F.size("headers")))
    first = F.when(F.col("n_rows") <= most, F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("row_id") - most // 2))
    last = F.least(F.col("n_rows"), first + most) - 1
    rows = rows.withColumn("near", F.explode(F.sequence(first, last)))
    of = lines(cells).select("tab_id", F.col("row_id").alias("near"), "cells")
    rows = rows.join(of, ["tab_id", "near"], "left")
    value = lambda k: F.coalesce(F.get(F.filter("cells", lambda c: c["col_id"] == k), F.lit(0))["value"], F.lit(""))
    mine = F.col("near") == F.col("row_id")
    marked = lambda k: F.when(mine & (k == F.col("col_id")), F.concat(F.lit(">>"), value(k), F.lit("<<"))).otherwise(value(k))
    columns = F.sequence(F.lit(0), F.size("headers") - 1)
    line = F.array_join(F.transform(columns, marked), " | ")
    rows = rows.select(*CELL, "headers", "near", line.alias("line"), F.when(mine, value(F.col("col_id"))).alias("mention"))
    rows = rows.groupBy(*CELL, "headers").agg(F.transform(F.sort_array(F.collect_list(F.struct("near", "line"))), lambda r: r["line"]).alias("of"), F.max("mention").alias("mention"))
    numbers = F.array_join(F.transform(F.sequence(F.lit(0), F.size("headers") - 1), lambda k: k.cast("string")), " | ")
    table = F.concat(F.lit("columns: "), numbers, F.lit("\n"), F.array_join("headers", " | "), F.lit("\n"), F.array_join("of", "\n"))
    return rows.select(*CELL, table.alias("table"), F.get("headers", F.col("col_id")).alias("header"), "mention")


def cea_prompts(cells: DataFrame, targets: DataFrame, most: int = MOST_ROWS, template: str = CEA) -> DataFrame:
    """(tab_id, row_id, col_id, text)."""
    rows = table_blocks(cells, targets, most)
    return rows.select(*CELL, filled(template, table=F.col("table"), row=F.col("row_id"), col=F.col("col_id"), header=F.col("header"), mention=F.col("mention")).alias("text"))


def _header(cells: DataFrame, name: str, column: str) -> DataFrame:
    return cells.groupBy(*COLUMN).agg(F.min("header").alias(name)).withColumnRenamed("col_id", column)


def cta_prompts(cells: DataFrame, targets: DataFrame, most: int = MOST_VALUES, template: str = CTA) -> DataFrame:
    """(tab_id, col_id, text) with the first different values of the column, by row."""
    some = lookup.first_values(cells.join(targets.select(*COLUMN).distinct(), COLUMN, "left_semi"), COLUMN, "value", "row_id", most)
    values = some.groupBy(*COLUMN).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda v: v["value"]), " | ").alias("values"))
    rows = targets.select(*COLUMN).distinct().join(_header(cells, "header", "col_id"), COLUMN).join(values, COLUMN, "left")
    return rows.select(*COLUMN, filled(template, header=F.col("header"), values=F.col("values")).alias("text"))


def cpa_prompts(cells: DataFrame, targets: DataFrame, most: int = MOST_PAIRS, template: str = CPA) -> DataFrame:
    """(tab_id, sub_col, obj_col, text) with the first rows that have both values."""
    targets = targets.select(*PAIR).distinct()
    side = lambda c, v: cells.select("tab_id", "row_id", F.col("col_id").alias(c), shown(F.col("value")).alias(v))
    both = targets.join(side("sub_col", "subject"), ["tab_id", "sub_col"]).join(side("obj_col", "object"), ["tab_id", "row_id", "obj_col"])
    some = lookup.first_pairs(both, PAIR, "subject", "object", "row_id", most)
    pair = F.concat("subject", F.lit(" -> "), "object")
    pairs = some.groupBy(*PAIR).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", pair.alias("pair")))), lambda p: p["pair"]), "\n").alias("pairs"))
    rows = targets.join(_header(cells, "sub_header", "sub_col"), ["tab_id", "sub_col"]).join(_header(cells, "obj_header", "obj_col"), ["tab_id", "obj_col"]).join(pairs, PAIR, "left")
    return rows.select(*PAIR, filled(template, sub_header=F.col("sub_header"), obj_header=F.col("obj_header"), pairs=F.col("pairs")).alias("text"))


def annotations(items: DataFrame, responses: DataFrame, task: str) -> DataFrame:
    """(keys of the task, id): the first id that the answer to an item's prompt names; items without one are left out."""
    named = property_id(F.col("response")) if task == "cpa" else entity_id(F.col("response"))
    return answered(items, responses).select(*KEYS[task], named.alias("id")).where("id <> ''")
