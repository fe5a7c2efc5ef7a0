"""Queries of versions of tables, of folders that are worked through step by step, and of files that can't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import assembly as asm
from tabloom.operators import versions
from tabloom.plans.q_prompt import BRANDS, brand_cells
from tabloom.plans.standin import read
from tabloom.sources import folders, tables

CATALOG: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(f):
        CATALOG[f.__name__] = (f, sql)
        return f

    return add


#: The brands' tables with headers, and a later version: brands ending in 7 are gone, rows from 60 on are cut off tables ending in 2, the last column of those ending in 5, and one is added to those ending in 3.
_VERSIONS = f"""WITH {BRANDS},
body AS (SELECT tab_id, row_id + 1 AS row_id, 0 AS col_id, c0 AS value FROM row UNION ALL SELECT tab_id, row_id + 1, 1, c1 FROM row UNION ALL SELECT tab_id, row_id + 1, 2, c2 FROM row),
old AS (SELECT * FROM body UNION ALL SELECT tab_id, 0, c, ['name', 'type', 'size'][c + 1] FROM (SELECT DISTINCT tab_id FROM row), (SELECT unnest([0, 1, 2]) AS c)),
new AS (SELECT tab_id, row_id, col_id, CASE WHEN row_id % 4 = 1 THEN upper(value) WHEN row_id % 5 = 2 THEN replace(value, 'e', '') WHEN row_id % 7 = 3 THEN value || '  ' ELSE value END AS value FROM old
  WHERE tab_id NOT LIKE '%7' AND NOT (tab_id LIKE '%2' AND row_id >= 60) AND NOT (tab_id LIKE '%5' AND col_id = 2)
  UNION ALL SELECT tab_id, row_id, 3, 'extra ' || row_id FROM old WHERE tab_id LIKE '%3' AND col_id = 0),
ext AS (SELECT tab_id, max(CASE v WHEN 0 THEN r END) AS br, max(CASE v WHEN 0 THEN c END) AS bc, max(CASE v WHEN 1 THEN r END) AS ar, max(CASE v WHEN 1 THEN c END) AS ac FROM (
  SELECT tab_id, 0 AS v, max(row_id) AS r, max(col_id) AS c FROM old GROUP BY 1 UNION ALL SELECT tab_id, 1, max(row_id), max(col_id) FROM new GROUP BY 1) GROUP BY 1),
cmp AS (SELECT tab_id, row_id, col_id, coalesce(o.value, '') AS before, coalesce(n.value, '') AS after, o.tab_id IS NOT NULL AS has_old, row_id % 3 = 1 AND col_id = 0 AS is_target
  FROM old o FULL JOIN new n USING (tab_id, row_id, col_id) WHERE trim(coalesce(o.value, '')) <> '' OR trim(coalesce(n.value, '')) <> ''),
kinds AS (SELECT tab_id, row_id, col_id, before, after, is_target, CASE WHEN row_id <= least(br, ar) AND col_id <= least(bc, ac) AND br IS NOT NULL AND ar IS NOT NULL
    THEN CASE WHEN before = after THEN 'same' WHEN lower(trim(regexp_replace(before, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(after, '\\s+', ' ', 'g'))) THEN 'case' ELSE 'real' END
    WHEN has_old THEN 'only_before' ELSE 'only_after' END AS kind FROM cmp JOIN ext USING (tab_id))"""


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    old = asm.with_header(brand_cells(spark, sf_dir))
    row, tab, value = F.col("row_id"), F.col("tab_id"), F.col("value")
    changed = F.when(row % 4 == 1, F.upper(value)).when(row % 5 == 2, F.replace(value, F.lit("e"), F.lit(""))).when(row % 7 == 3, F.concat(value, F.lit("  "))).otherwise(value)
    new = old.where(~tab.endswith("7") & ~(tab.endswith("2") & (row >= 60)) & ~(tab.endswith("5") & (F.col("col_id") == 2))).withColumn("value", changed)
    extra = old.where(tab.endswith("3") & (F.col("col_id") == 0)).withColumns({"col_id": F.lit(3), "value": F.concat(F.lit("extra "), row)})
    return old, new.unionByName(extra), old.where((row % 3 == 1) & (F.col("col_id") == 0))


_TALLY = ", ".join(f"count(CASE WHEN {of} AND kind IN ('same', 'case', 'real') THEN 1 END) AS {name}n, " + ", ".join(f"count(CASE WHEN {of} AND kind = '{k}' THEN 1 END) AS {name}n_{k}" for k in versions.KINDS) for name, of in (("", "true"), ("target_", "is_target")))


@query(f"{_VERSIONS} SELECT tab_id, {_TALLY} FROM kinds GROUP BY 1")
def version_tally(spark, sf_dir) -> DataFrame:
    return versions.tally(versions.compare(*_versions(spark, sf_dir)), "tab_id")


@query(f"{_VERSIONS} SELECT tab_id, CASE WHEN ar IS NULL THEN 'before' WHEN br IS NULL THEN 'after' ELSE 'both' END AS side, CASE WHEN ar IS NULL OR br IS NULL THEN 0 ELSE least(br, ar) + 1 END AS shared_rows, br + 1 AS before_rows, coalesce(ar + 1, 0) AS after_rows FROM ext")
def version_shapes(spark, sf_dir) -> DataFrame:
    old, new, _ = _versions(spark, sf_dir)
    return versions.shapes(old, new).select("tab_id", "side", "shared_rows", "before_rows", "after_rows")


@query(f"{_VERSIONS} SELECT tab_id, row_id, col_id, before, after, kind, CAST(levenshtein(lower(before), lower(after)) AS INTEGER) AS distance FROM kinds WHERE is_target AND kind IN ('case', 'real')")
def version_changes(spark, sf_dir) -> DataFrame:
    rows = versions.changes(versions.compare(*_versions(spark, sf_dir))).where("is_target")
    return rows.select("tab_id", "row_id", "col_id", "before", "after", "kind", "distance")


#: Orders as CSV files with a line for each item; of ten, one has a bad byte, one an open quote, and one no text.
_FILES = """WITH f AS (SELECT l_orderkey AS tab_id, count(*) AS n FROM lineitem GROUP BY 1)"""


@query(f"{_FILES} SELECT CAST(tab_id AS VARCHAR) AS tab_id, CASE WHEN tab_id % 10 IN (4, 6, 9) THEN 0 ELSE 3 * n END AS n_cells, CASE tab_id % 10 WHEN 4 THEN 'bad encoding' WHEN 6 THEN 'unbalanced quotes' WHEN 9 THEN 'empty file' END AS error FROM f")
def csv_quarantine(spark, sf_dir) -> DataFrame:
    line = F.concat_ws(",", "l_linenumber", "l_partkey", F.concat(F.lit('"'), F.col("l_returnflag"), F.lit(', ""x"""')))
    text = F.concat(F.lit("line,part,flag\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"))
    orders = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(text.alias("text"))  # few lines an order
    kind, content = F.col("l_orderkey") % 10, F.encode("text", "UTF-8")
    content = F.when(kind == 4, F.concat(content, F.unhex(F.lit("FF")))).when(kind == 6, F.concat(content, F.encode(F.lit('\n1,"2'), "UTF-8"))).when(kind == 9, F.encode(F.lit(" \n"), "UTF-8")).otherwise(content)
    rows = tables.parsed(orders.select(F.concat(F.lit("in/"), "l_orderkey", F.lit(".csv")).alias("path"), content.alias("content")))
    sums = rows.groupBy("tab_id", "error").agg(F.count("value").alias("n_cells"))  # by hash; the largest text alone would sort all cells
    return sums.groupBy("tab_id").agg(F.sum("n_cells").alias("n_cells"), F.max("error").alias("error"))


@query(
    "WITH made AS (SELECT l_orderkey AS id, min(CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_linenumber END) AS length, min(l_shipdate) AS made FROM lineitem WHERE l_orderkey % 4 > 0 GROUP BY 1) "
    "SELECT state, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, CASE WHEN length IS NULL THEN 'new' WHEN length = 0 THEN 'broken' WHEN made < o_orderdate THEN 'stale' ELSE 'done' END AS state FROM orders LEFT JOIN made ON id = o_orderkey) GROUP BY 1"
)
def folder_states(spark, sf_dir) -> DataFrame:
    inputs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tab_id"), F.col("o_orderdate").alias("modified"))
    made = read(spark, sf_dir, "lineitem").where("l_orderkey % 4 > 0")
    outputs = made.select(F.col("l_orderkey").alias("tab_id"), F.when(F.col("l_linestatus") == "O", 0).otherwise(F.col("l_linenumber")).alias("length"), F.col("l_shipdate").alias("modified"))
    return folders.states(inputs, outputs).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.min("tab_id").alias("first"))
