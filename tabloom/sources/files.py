"""Single files in any file system that Spark reaches, written whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    fs, there = _at(spark, path)
    return fs.exists(there)


def statuses(spark: SparkSession, path: str) -> list[tuple[str, str, int, int]]:
    """(name, path, bytes, milliseconds of its last change) of each file in a folder, without hidden ones; none if there is no folder."""
    fs, there = _at(spark, path)
    if not fs.exists(there):
        return []
    found = [(s.getPath(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(there) if s.isFile()]
    return sorted((p.getName(), p.toString(), n, at) for p, n, at in found if not p.getName().startswith(("_", ".")))


def names(spark: SparkSession, path: str) -> list[str]:
    """The files and folders in a folder, by name, without hidden ones."""
    fs, there = _at(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(there)]
    return sorted(n for n in found if not n.startswith(("_", ".")))


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file over another one; folders that the new name needs are made."""
    fs, new = _at(spark, target)
    fs.mkdirs(new.getParent())
    jvm, old = spark._jvm, _at(spark, source)[1]
    option = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(old), fs.makeQualified(new), options)


def merged(spark: SparkSession, parts: list[str], target: str, head: str = "") -> None:
    """One file of a first line and the bytes of the parts, which are streamed through the driver a buffer at a time."""
    fs, new = _at(spark, target)
    out = fs.create(new, True)
    try:
        if head:
            out.write(bytearray((head + "\n").encode()))
        for part in parts:
            inp = fs.open(_at(spark, part)[1])
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(inp, out, 65536, False)
            finally:
                inp.close()
    finally:
        out.close()


def within(spark: SparkSession, folder: str, work: Callable[[str], None]) -> None:
    """Runs work on a new hidden folder in `folder`, which is deleted in any case."""
    fs, there = _at(spark, f"{folder}/_writing-{uuid.uuid4().hex}")
    try:
        work(there.toString())
    finally:
        fs.delete(there, True)


def write_file(lines: DataFrame, path: str, order: list[str], head: str = "") -> None:
    """The column `line`, in order, as one file of that name.

    Tasks write sorted parts, which are put together in a hidden file and renamed: a job that fails leaves the old file as it was.
    """
    spark, folder = lines.sparkSession, path.rpartition("/")[0] or "."

    def work(at: str) -> None:
        lines.orderBy(*order).select("line").write.text(f"{at}/parts")
        merged(spark, [f"{at}/parts/{n}" for n in names(spark, f"{at}/parts")], f"{at}/whole", head)
        move(spark, f"{at}/whole", path)

    within(spark, folder, work)


def write_each(lines: DataFrame, folder: str, key: str, order: list[str], suffix: str, head: str = "") -> int:
    """The column `line` as one file for each key, named by it; tells how many. A task writes a file; each is renamed when all are written."""
    spark, count = lines.sparkSession, 0
    unescaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName

    def work(at: str) -> None:
        nonlocal count
        rows = lines.where(lines[key].isNotNull()).repartition(key).sortWithinPartitions(key, *order)
        rows.select(key, "line").write.partitionBy(key).text(f"{at}/parts")
        for name in names(spark, f"{at}/parts"):
            parts = [f"{at}/parts/{name}/{n}" for n in names(spark, f"{at}/parts/{name}")]
            if head or len(parts) > 1:
                merged(spark, parts, f"{at}/whole", head)
                parts = [f"{at}/whole"]
            move(spark, parts[0], f"{folder}/{unescaped(name.partition('=')[2])}{suffix}")
            count += 1

    within(spark, folder, work)
    return count
