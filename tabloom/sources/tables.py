"""Readers and writers of tables, targets, gold, candidates, hierarchies and triples."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions.text import missing_to_null, split_list, uri, uri_tail

CELLS = "tab_id string, row_id int, col_id int, header string, value string"
PREFIXES = {"cea": "http://www.wikidata.org/entity/", "cta": "http://www.wikidata.org/entity/", "cpa": "http://www.wikidata.org/prop/direct/"}
TARGETS = {"cea": "tab_id string, row_id int, col_id int", "cta": "tab_id string, col_id int", "cpa": "tab_id string, sub_col int, obj_col int"}
GOLD = {"cea": "tab_id string, row_id string, col_id string, entity string", "cta": "tab_id string, col_id string, type string", "cpa": "tab_id string, sub_col string, obj_col string, property string"}


#: Cells, and bytes of files, that are given out together.
BATCH_CELLS, BATCH_BYTES = 20_000, 4 << 20
_PARSED = pa.schema([("tab_id", pa.string()), ("row_id", pa.int32()), ("col_id", pa.int32()), ("header", pa.string()), ("value", pa.string()), ("error", pa.string())])


def _rows(content: bytes) -> tuple[list[str], list[list[str]]]:
    """The header and the rows of a file; a ValueError or csv.Error says why there are none."""
    text = content.decode("utf-8-sig")
    if not text.strip():
        raise ValueError("empty file")
    try:
        header, *rows = csv.reader(io.StringIO(text, newline=""), strict=True)
    except csv.Error as error:
        if "end of data" in str(error):
            raise ValueError("unbalanced quotes") from error
        header, *rows = csv.reader(io.StringIO(text, newline=""))  # text after a closing quote is taken as it is
    return header, rows


def _add(out: list[list], path: str, content: bytes) -> None:
    """Adds a file's cells to the columns, or one row that says why there are none."""
    name = path.rsplit("/", 1)[-1].removesuffix(".csv")
    try:
        header, rows = _rows(content)
    except (ValueError, csv.Error) as error:
        kind = "bad encoding" if isinstance(error, UnicodeDecodeError) else str(error)
        for column, v in zip(out, (name, None, None, None, None, kind), strict=True):
            column.append(v)
        return
    tab, row_id, col_id, headers, values, errors = out
    for r, row in enumerate(filter(None, rows)):
        n = len(row)
        tab += [name] * n
        row_id += [r] * n
        col_id += range(n)
        headers += header[:n]
        headers += [None] * (n - len(header))
        values += row
        errors += [None] * n


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(1 << 30)
    out: list[list] = [[] for _ in _PARSED]
    size = 0

    def whole() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PARSED, strict=True)], schema=_PARSED)
        for column in out:
            column.clear()
        return made

    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            content = content.as_py() or b""
            _add(out, path.as_py(), content)
            size += len(content)
            if len(out[0]) >= BATCH_CELLS or size >= BATCH_BYTES:
                yield whole()
                size = 0
    yield whole()


def parsed(files: DataFrame) -> DataFrame:
    """(tab_id, row_id, col_id, header, value, error) of CSV files (path, content). Files have widths of their own, so each is parsed alone; what is given out are batches of many files' cells.

    A file that can't be read (bad encoding, unbalanced quotes, no text) gives one row with an error and no cells, and the
    others are read on. A header alone is a table without rows; blank lines are no rows.
    """
    return files.select("path", "content").mapInArrow(_parsed, f"{CELLS}, error string")


def split_errors(rows: DataFrame, default_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """Of parsed(): the cells, and (tab_id, error) of the files that couldn't be read. Write parsed() first to read the files once."""
    cells = rows.where("error is null").drop("error")
    cells = cells.withColumn("value", missing_to_null(F.col("value"))) if default_missing else cells
    return cells, rows.where("error is not null").select("tab_id", "error")


def read_tables(spark: SparkSession, path: str, default_missing: bool = True) -> DataFrame:
    """The cells of all CSV files of a folder that can be read; the file's name is the table's."""
    return split_errors(parsed(spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)), default_missing)[0]


def read_headerless(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file without header; an absent one is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path)


def read_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_headerless, of strings, where nothing counts as missing."""
    rows = read_headerless(spark, path, schema)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns])


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Files <table>_candidates.csv as sinks.write_candidates writes them; ord is a candidate's place in its cell. No quality counts as 99."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_candidates.csv").load(path)
    cells = split_errors(parsed(files), default_missing=False)[0]
    of = F.map_from_arrays(F.collect_list("header"), F.collect_list("value"))
    rows = cells.groupBy("tab_id", F.col("row_id").alias("line")).agg(of.alias("of"))
    text = lambda c: F.coalesce(F.try_element_at("of", F.lit(c)), F.lit(""))
    tab = F.regexp_replace("tab_id", r"_candidates$", "").alias("tab_id")
    lists = [split_list(text(c)).alias(c.lower()) for c in ("aliases", "P31", "P279")]
    out = rows.select(tab, text("row").cast("int").alias("row_id"), text("columns").cast("int").alias("col_id"), "line", text("data").alias("mention"), text("candidates").alias("label"), text("QID").alias("qid"), F.coalesce(text("quality").try_cast("int"), F.lit(99)).alias("quality"), text("description").alias("description"), *lists, text("sitelink").alias("sitelink"))
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("tab_id", "row_id", "col_id").orderBy("line"))).drop("line")


def metadata_header(cta: Column, cpa: Column) -> Column:
    """The name of the last column of a prepared table: target columns, and pairs of them."""
    return F.concat(F.lit("Metadata:CTA:"), F.to_json(cta), F.lit(",CPA:"), F.to_json(cpa))


def parse_metadata(header: Column) -> list[Column]:
    """Target columns and pairs of the header; an error if it isn't one."""
    pattern = r"Metadata:CTA:(\[.*?\]),CPA:(\[.*\])$"
    good = F.when(header.rlike(pattern), header).otherwise(F.raise_error(F.concat(F.lit("no metadata: "), header)).cast("string"))
    return [F.from_json(F.regexp_extract(good, pattern, 1), "array<int>").alias("cta"), F.from_json(F.regexp_extract(good, pattern, 2), "array<array<int>>").alias("cpa")]


def parse_targets(value: Column) -> Column:
    """A row's target columns; null if the literal is malformed."""
    return F.from_json(value, "array<int>")


def attach_targets(cells: DataFrame, cea: DataFrame, row_offset: int = 1) -> DataFrame:
    """(tab_id, row_id, targets): the row's target columns in order; targets in the header row are left out."""
    targets = cea.withColumn("row_id", F.col("row_id") - row_offset).where("row_id >= 0").groupBy("tab_id", "row_id").agg(F.sort_array(F.collect_list("col_id")).alias("targets"))
    return cells.select("tab_id", "row_id").distinct().join(targets, ["tab_id", "row_id"], "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<int>")))


def submission(rows: DataFrame, task: str, value: str = "qid", row_offset: int = 1, nil: str = "NIL") -> DataFrame:
    """What is written for a task: rows shifted to count the header, ids as URIs, empty ids left out."""
    out = rows.where(F.coalesce(F.col(value), F.lit("")) != "").withColumn(value, F.when(F.col(value) == nil, F.col(value)).otherwise(uri(F.col(value), PREFIXES[task])))
    return out.withColumn("row_id", F.col("row_id") + row_offset) if "row_id" in rows.columns else out


def gold_cells(rows: DataFrame, row_offset: int = 1, nil: str | None = None) -> DataFrame:
    """(tab_id, row_id, col_id, qid) of a gold file (GOLD["cea"], texts): rows count without the header, ids are the ends of the first of several URIs.

    Without an id that starts with Q a row is left out, or given with nil where that is asked for; so is a row of the header, and one whose numbers are none.
    """
    last = uri_tail(F.get(F.split(F.trim("entity"), r"\s+"), F.lit(0)))
    good = last.rlike(r"^Q\d+$")
    qid = F.when(good, last) if nil is None else F.when(good, last).otherwise(nil)
    row = F.col("row_id").try_cast("int") - row_offset
    out = rows.select("tab_id", row.alias("row_id"), F.col("col_id").try_cast("int").alias("col_id"), qid.alias("qid"))
    return out.where("row_id >= 0 and col_id is not null and qid is not null")


def read_hierarchy(spark: SparkSession, ancestors: str, descendants: str) -> DataFrame:
    """(type, other, direction, depth) of two JSON files {type: {other: depth}}."""
    out = []
    for path, direction in ((ancestors, "ancestor"), (descendants, "descendant")):
        of, name = hierarchy(F.col("value"), direction)
        out.append(spark.read.text(path, wholetext=True).select(of, name).select("type", F.explode("others").alias("other", "depth"), "direction"))
    return out[0].union(out[1]).select("type", "other", "direction", "depth")


def hierarchy(json: Column, direction: str) -> list[Column]:
    """For select(): (type, other, depth) from {type: {other: depth}}; explode twice."""
    return [F.explode(F.from_json(json, "map<string,map<string,int>>")).alias("type", "others"), F.lit(direction).alias("direction")]


def filter_triples(lines: DataFrame, predicates: list[str], english: tuple[str, ...] = (), distinct: bool = False) -> DataFrame:
    """Lines that hold a predicate, and for those in `english` also @en: once for each predicate, or once at all."""
    tests = [F.when(F.col("value").contains(p) & (F.col("value").contains("@en") if p in english else F.lit(True)), F.lit(p)) for p in predicates]
    found = lines.withColumn("predicate", F.array_compact(F.array(*tests)))
    return found.where("size(predicate) > 0") if distinct else found.withColumn("predicate", F.explode("predicate"))
