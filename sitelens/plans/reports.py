"""The report and run tables' queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered, running_max

_RIVALS = "array<struct<domain:string,url:string,avg_price:double,performance_score:string,product_count:bigint,tech_stack:array<string>>>"
#: The data of a report, as it is stored in JSON.
REPORT = f"target_site struct<avg_price:double,product_count:bigint,performance_score:string>, competitors {_RIVALS}, ai_summary string, market_gaps array<string>"
# Fixed value: what stands for a summary that isn't there yet.
NO_SUMMARY = "Generating strategic summary..."


def recent_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def find_reports(runs: DataFrame, fragment: str | None = None) -> DataFrame:
    return runs if not fragment else runs.where(F.col("domain").ilike(f"%{fragment}%"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of every domain, by a partial aggregation rather than a window."""
    last = F.max(F.struct("started_at", "run_id", "status", "score")).alias("last")
    return runs.groupBy("domain").agg(last).select("domain", "last.*")


def active_cache(runs: DataFrame, now: str, hours: int = 24) -> DataFrame:
    return runs.where(F.col("started_at") + F.expr(f"INTERVAL {hours} HOURS") > F.lit(now).cast("timestamp"))


def price_comparison(parts: DataFrame, target: str) -> DataFrame:
    """Average price of every brand against the target's."""
    brands = parts.groupBy("p_brand").agg(F.avg("p_retailprice").alias("avg_price"), F.count("*").alias("n_products"))
    goal = brands.where(F.col("p_brand") == target).select(F.col("avg_price").alias("target_price"))
    out = brands.join(F.broadcast(goal))  # one row: the target's
    cheaper = F.when(F.col("avg_price") < F.col("target_price"), "Cheaper").otherwise("More Expensive")
    return out.where(F.col("p_brand") != target).withColumn("badge", cheaper)


def daily_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.to_date("started_at").alias("day"), "status").agg(F.count("*").alias("n"))


def queue_order(entries: DataFrame, threshold: int = 3) -> DataFrame:
    """Positions in each domain's queue: urgent entries go to the front, last in first out; the rest to the end."""
    urgent = F.col("priority") <= threshold
    rows = numbered(entries, "domain", F.when(urgent, 0).otherwise(1), F.when(urgent, -F.col("seq")).otherwise(F.col("seq")))
    return rows.withColumn("position", (F.col("k") + 1).cast("int")).drop("k", "at", "part")


def polite_starts(entries: DataFrame, delay: float = 2.0) -> DataFrame:
    """start = the first time at or after arrival that is at least delay after the domain's previous start."""
    rows = numbered(entries, "domain", F.col("arrival"), F.col("seq"))
    out = running_max(rows, "domain", F.col("arrival") - delay * F.col("k"))
    return out.withColumn("start", F.col("most") + delay * F.col("k")).drop("most", "k", "at", "part")


def retries(failures: DataFrame, base: float = 30.0, factor: float = 2.0, most: float = 300.0, limit: int = 3) -> DataFrame:
    """The delay before the next try of entries with ``attempts`` failures, or a dead letter."""
    dead = F.col("attempts") > limit
    delay = F.least(F.lit(most), base * F.pow(F.lit(factor), F.col("attempts") - 1))
    return failures.withColumn("dead", dead).withColumn("delay", F.when(~dead, delay))


def report_by_id(reports: DataFrame, report_id: str) -> DataFrame:
    return reports.where(F.col("id") == report_id)


def listed_reports(reports: DataFrame, fragment: str | None = None) -> DataFrame:
    """The list of reports, newest first, of domains with this part in any case."""
    found = reports if not fragment else reports.where(F.col("target_domain").ilike(f"%{fragment}%"))
    return found.select("id", "target_url", "target_domain", "competitor_count", "pdf_url", "created_at").orderBy(F.desc("created_at"))


def report_cards(reports: DataFrame) -> DataFrame:
    """id and what a report page shows: the cards, the first six price bars, the rivals with three technologies each, the summary's lines."""
    r = reports.withColumn("r", F.from_json("report_data", REPORT))
    target = F.col("r.target_site")
    rivals = F.coalesce(F.col("r.competitors"), F.array().cast(_RIVALS))
    bar = lambda name, price, own: F.struct(name.alias("name"), F.coalesce(price, F.lit(0.0)).alias("price"), F.lit(own).alias("is_target"))
    known = lambda score: F.when(~F.coalesce(score, F.lit("0")).isin("0", "0.0", ""), score).otherwise("N/A")

    def rival(c: Column) -> Column:
        return F.struct(
            c["domain"].alias("domain"), known(c["performance_score"]).alias("performance_score"), F.coalesce(c["product_count"], F.lit(0)).alias("product_count"),
            F.when(c["avg_price"] < target["avg_price"], "Cheaper").otherwise("More Expensive").alias("badge"),
            F.slice(F.coalesce(c["tech_stack"], F.array().cast("array<string>")), 1, 3).alias("technologies"),
        )

    return r.select(
        "id",
        F.coalesce(target["product_count"], F.lit(0)).alias("product_count"),
        known(target["performance_score"]).alias("performance_score"),
        "competitor_count",
        F.format_string("%.2f", F.coalesce(target["avg_price"], F.lit(0.0))).alias("avg_price"),
        F.slice(F.concat(F.array(bar(F.lit("Target"), target["avg_price"], True)), F.transform(rivals, lambda c: bar(c["domain"], c["avg_price"], False))), 1, 6).alias("bars"),
        F.transform(rivals, rival).alias("rivals"),
        F.split(F.coalesce("r.ai_summary", F.lit(NO_SUMMARY)), "\n").alias("summary"),
    )
