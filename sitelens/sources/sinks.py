"""Where results go: the stored tables with their rules, the log of runs, results by route, reports as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The stored tables, their columns with rules, and the states and sources of a run.
TABLES = {
    "target_cache": "id STRING, url STRING NOT NULL, domain STRING, scraped_data STRING, created_at TIMESTAMP DEFAULT current_timestamp(), "
    "expires_at TIMESTAMP DEFAULT current_timestamp() + INTERVAL 24 HOURS",
    "competitor_cache": "id STRING, domain STRING NOT NULL, url STRING, scraped_data STRING, api_data STRING, created_at TIMESTAMP DEFAULT current_timestamp(), "
    "expires_at TIMESTAMP DEFAULT current_timestamp() + INTERVAL 24 HOURS",
    "reports": "id STRING, target_url STRING NOT NULL, target_domain STRING, report_data STRING, pdf_url STRING, competitor_count INT, "
    "created_at TIMESTAMP DEFAULT current_timestamp()",
    "run_log": "id STRING, target_url STRING, status STRING DEFAULT 'running', triggered_by STRING, started_at TIMESTAMP DEFAULT current_timestamp(), "
    "completed_at TIMESTAMP, error_message STRING, report_id STRING",
}
RUN_STATES, RUN_SOURCES = ["running", "completed", "failed"], ["webhook", "schedule", "dashboard"]
RUN = "id string, target_url string, status string, triggered_by string, started_at timestamp, completed_at timestamp, error_message string, report_id string"
RUN_NAMES = [part.split()[0] for part in RUN.split(", ")]


def create_tables(spark: SparkSession, database: str) -> None:
    """The stored tables, dropped and made anew, and the views of caches that haven't run out."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"CREATE TABLE {database}.{name} ({columns}) USING parquet")
    for name in ("target_cache", "competitor_cache"):
        spark.sql(f"CREATE OR REPLACE VIEW {database}.active_{name} AS SELECT * FROM {database}.{name} WHERE expires_at > current_timestamp()")


def is_valid_run() -> Column:
    """What the log's rules ask of a row: a known state, and a known source or none."""
    return F.coalesce(F.col("status").isin(*RUN_STATES), F.lit(False)) & F.coalesce(F.col("triggered_by").isin(*RUN_SOURCES), F.lit(True))


def started(requests: DataFrame, now: Column) -> DataFrame:
    """Log rows of runs that start now, from (target_url, triggered_by, request): null sources are the dashboard's, rows without a URL go.

    The id follows from the request, the URL and the time, so that a row made twice is the same run.
    """
    rows = requests.where(F.coalesce("target_url", F.lit("")) != "")
    none = F.lit(None)
    return rows.select(
        F.sha2(F.concat_ws(" ", F.col("request").cast("string"), F.col("target_url"), now.cast("string")), 256).alias("id"), "target_url", F.lit("running").alias("status"),
        F.coalesce(F.nullif("triggered_by", F.lit("")), F.lit("dashboard")).alias("triggered_by"), now.cast("timestamp").alias("started_at"),
        none.cast("timestamp").alias("completed_at"), none.cast("string").alias("error_message"), none.cast("string").alias("report_id"),
    )


def ended(log: DataFrame, outcome: DataFrame, now: Column) -> DataFrame:
    """The log after the outcome (id, status, error_message, report_id) of some runs, one row each; runs that aren't in the log are left out."""
    new = outcome.select("id", *[F.col(c).alias(f"new_{c}") for c in ("status", "error_message", "report_id")]).withColumn("hit", F.lit(True))
    out = log.join(new, "id", "left")
    on = F.coalesce("hit", F.lit(False))
    changed = {c: F.when(on, F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("status", "error_message", "report_id")}
    return out.withColumns(changed | {"completed_at": F.when(on, now.cast("timestamp")).otherwise(F.col("completed_at"))}).select(RUN_NAMES)


def write_routed(results: DataFrame, path: str) -> None:
    """Results as JSON, a folder a route; those without a route go nowhere."""
    results.where(F.col("route").isNotNull()).write.partitionBy("route").mode("append").json(path)


def report_name(prefix: str) -> Column:
    """The file name of a report: prefix, domain and time."""
    return F.concat_ws("_", F.lit(prefix), F.replace("domain", F.lit("."), F.lit("_")), F.date_format("created_at", "yyyyMMdd_HHmmss"))


def write_reports(reports: DataFrame, path: str, prefix: str = "report") -> None:
    """Reports (domain, created_at and others) as JSON, a folder each."""
    reports.withColumn("name", report_name(prefix)).write.partitionBy("name").mode("append").json(path)


def write_dead_letters(letters: DataFrame, path: str) -> None:
    letters.write.mode("append").parquet(path)
