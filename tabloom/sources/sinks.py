"""What is written: candidates, training examples, subsets of tables, token counts, cost logs, knowledge bases; and the finding of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.sources.files import exists, merged, write_each, write_file

RESULTS = ("cea.csv", "cta.csv", "cpa.csv")


#: The columns of a file of candidates, as named in the file and by us.
CANDIDATES = {"data": "mention", "candidates": "label", "QID": "qid", "row": "row_id", "columns": "col_id", "quality": "quality", "description": "description", "aliases": "aliases", "P31": "p31", "P279": "p279", "sitelink": "sitelink"}
#: The keys of a submission, by which its file is sorted.
SUBMISSIONS = {"cea": ["tab_id", "row_id", "col_id"], "cta": ["tab_id", "col_id"], "cpa": ["tab_id", "sub_col", "obj_col"]}


def csv_field(value: Column) -> Column:
    """As a field of a CSV file, in quotes where it has to be; a null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *[csv_field(v) for v in values])


def write_candidates(rows: DataFrame, path: str) -> int:
    """A file <table>_candidates.csv for each table, in the order of cells and candidates; lists are joined by |, columns that rows lack are empty. Tells how many."""
    kinds = dict(rows.dtypes)
    value = lambda c: F.lit("") if c not in kinds else F.array_join(c, "|") if kinds[c].startswith("array") else F.col(c)
    order = ["row_id", "col_id", *(["ord"] if "ord" in kinds else [])]
    lines = rows.select("tab_id", *order, csv_line(*map(value, CANDIDATES.values())).alias("line"))
    return write_each(lines, path, "tab_id", order, "_candidates.csv", ",".join(CANDIDATES))


def write_submission(rows: DataFrame, path: str, task: str, value: str = "qid", nil: bool = True) -> None:
    """<task>.csv in the folder, one file without header, sorted by its keys; without rows of NIL unless asked for."""
    keys = SUBMISSIONS[task]
    of = rows if nil else rows.where(F.col(value) != "NIL")
    write_file(of.select(*keys, csv_line(*[F.col(c) for c in (*keys, value)]).alias("line")), f"{path}/{task}.csv", keys)


def write_training(examples: DataFrame, path: str) -> None:
    """JSON lines in a folder for each value of `split`."""
    examples.write.mode("overwrite").partitionBy("split").json(path)


def copy_tables(cells: DataFrame, ids: DataFrame, path: str) -> int:
    """The tables in ids (tab_id) as CSV files with their headers; tells how many. A table without rows isn't written."""
    some = cells.join(ids.select("tab_id").distinct(), "tab_id", "left_semi")
    every = some.select("tab_id", (F.col("row_id") + 1).alias("row_id"), "col_id", "value").unionByName(some.groupBy("tab_id", "col_id").agg(F.min("header").alias("value")).withColumn("row_id", F.lit(0)))
    fields = F.transform(F.sort_array(F.collect_list(F.struct("col_id", csv_field(F.col("value")).alias("value")))), lambda c: c["value"])
    return write_each(every.groupBy("tab_id", "row_id").agg(F.array_join(fields, ",").alias("line")), path, "tab_id", ["row_id"], ".csv")


def copy_rows(spark: SparkSession, source: str, target: str, ids: DataFrame) -> None:
    """A headerless CSV file with those rows alone whose first field is in ids (tab_id), in their order."""
    rows = spark.read.text(source, wholetext=False).withColumn("place", F.monotonically_increasing_id())
    first = F.regexp_replace(F.regexp_extract("value", r'^("(?:[^"]|"")*"|[^,]*)', 1), r'^"|"$', "")
    kept = rows.withColumn("tab_id", first).join(ids.select("tab_id").distinct(), "tab_id", "left_semi")
    write_file(kept.select("place", F.col("value").alias("line")), target, ["place"])


def write_tokens(counts: DataFrame, path: str, kind: str) -> None:
    if kind not in ("csv", "json"):
        raise ValueError(f"csv or json, not {kind}")
    counts.write.mode("overwrite").format(kind).option("header", True).save(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log, a folder of CSV files, of which the first by name is the header alone."""
    head = f"{path}/0-header.csv"
    if not exists(rows.sparkSession, head):
        merged(rows.sparkSession, [], head, ",".join(rows.columns))
    rows.write.mode("append").option("header", False).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log as texts."""
    names = spark.read.text(f"{path}/0-header.csv").first()["value"].split(",")
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("pathGlobFilter", "part-*").csv(path)


def write_entities(entities: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").parquet(path)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def prepared(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of prepared tables the cells without the last column, and (tab_id, row_id, value) of that column."""
    last = cells.groupBy("tab_id").agg(F.max("col_id").alias("last"))
    both = cells.join(last, "tab_id")
    return both.where("col_id < last").drop("last"), both.where("col_id = last").select("tab_id", "row_id", "value")


def find_runs(spark: SparkSession, path: str, files: tuple[str, ...] = RESULTS) -> dict[str, str]:
    """Name and path of each folder at any depth that holds all the files; the name is its path from the start."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, str] = {}
    root, todo = fs.getFileStatus(hadoop).getPath().toString(), [hadoop]
    while todo:
        here, names = todo.pop(), set()
        for status in fs.listStatus(here):
            if status.isDirectory() and status.getPath().getName() not in files:
                todo.append(status.getPath())
            else:
                names.add(status.getPath().getName())
        if set(files) <= names:
            full = fs.getFileStatus(here).getPath().toString()
            found[full[len(root) :].strip("/") or "."] = full
    return found
