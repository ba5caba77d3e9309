"""URLs that come in from outside, as a stream or a table: (url, priority, job_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "url string, priority int, job_type string"
# Range and default of priorities.
LEAST, MOST, DEFAULT = 1, 10, 5


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the JSON lines in a folder."""
    return spark.readStream.schema(SCHEMA).json(folder)


def accepted(entries: DataFrame) -> DataFrame:
    """Entries with a URL and a priority in range, 5 where none is given; the others are refused."""
    out = entries.withColumn("priority", F.coalesce("priority", F.lit(DEFAULT)))
    return out.where((F.coalesce("url", F.lit("")) != "") & F.col("priority").between(LEAST, MOST))


def refused(entries: DataFrame) -> DataFrame:
    """Entries without a URL or with a priority out of range."""
    return entries.where((F.coalesce("url", F.lit("")) == "") | ~F.coalesce(F.col("priority").between(LEAST, MOST), F.lit(True)))
