"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import contamination, packing, quality, sanitise, simhash
from tabloom.llm.common import scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that are frequent on their host.

    Null, empty and short texts go; repeated rows stay each; a null source is a host of its own.
    """
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are alike in 0.8 or more of their five-word shingles.

    Null and empty texts are one group. The least doc_id stays, rows without one only where no other row of the group has one.
    """
    return simhash.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that stand in benchmark windows, nor documents that mostly are such words.

    Null and empty texts stay as they are; repeated rows are treated alike.
    """
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms generalised.

    Null and empty texts stay as they are; repeated rows are treated alike.
    """
    return sanitise.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, a row for each, with their ids. A null or empty text has the end id alone; repeated rows are packed each."""
    return packing.pack(docs, scratch(spark, "packed"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Fingerprints, groups and token ids are beyond SQL; the tests hold single stages against brute force, and the whole only by how many documents it keeps and by its ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again. Empty tables pass through; other columns stay up to the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
