"""A stream of raw cells, cleaned as they come; the batch functions are used as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.text import clean


def clean_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of cells that arrive in a folder, with column cleaned."""
    return spark.readStream.schema(schema).parquet(path).withColumn("cleaned", clean(F.col("value")))
