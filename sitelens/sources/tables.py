"""The stored tables that queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dom import parse_dom


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with the parsed document: page_id, url, html, nodes, visible, doctype."""
    return table(spark, sf_dir, "pages").withColumn("dom", parse_dom(F.col("html"))).select("page_id", "url", "html", "dom.*")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers of sites (url, status, headers, body), made from customers: a robots file each, and a policy for every other one."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), (F.col("c_custkey") % 4).alias("m"))
    origin = F.concat(F.lit("https://shop"), F.col("k"), F.lit(".example.com"))
    robots = F.concat(
        F.lit("# rules\nUser-agent: *\nDisallow: /cart/"), F.col("k"), F.when(F.col("m") == 0, "\nDisallow: /\n").otherwise("\nDisallow:\n"),
        F.lit("User-Agent: Googlebot\nDisallow: /private\n"), F.when(F.col("m") > 1, F.concat(F.lit("Sitemap: "), origin, F.lit("/map.xml\n"))).otherwise(""),
    )
    policy = F.concat(F.lit("Contact: a@b.example # us\nUser-agent: GPTBot\nDisallow: /a/"), F.col("k"), F.lit("\nTraining: deny\nUser-agent: CCBot\nAllow: /\n"))
    headers = F.create_map(F.lit("server"), F.when(F.col("m") == 1, "cloudflare").otherwise("nginx"), F.lit("ETag"), F.when(F.col("m") == 2, "x").otherwise(""), F.lit("Content-Encoding"), F.lit("GZIP"))
    row = lambda path, status, body: F.struct(F.concat(origin, F.lit(path)).alias("url"), status.alias("status"), headers.alias("headers"), body.alias("body"))
    rows = F.array(
        row("/robots.txt", F.when(F.col("m") == 3, 404).otherwise(200), robots),
        row("/map.xml", F.lit(200), F.lit("<urlset></urlset>")),
        row("/ai.txt", F.when(F.col("m") % 2 == 0, 200).otherwise(404), policy),
    )
    return c.select(F.explode(rows).alias("r")).select("r.*")


def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemaps (url, body) made from pages: an index, and under it files of the pages with the same last digit."""
    p = table(spark, sf_dir, "pages").select("page_id", F.replace("url", F.lit("&"), F.lit("&amp;")).alias("loc"), (F.col("page_id") % 10).alias("k"))
    entry = F.concat(F.lit("<url><loc> "), F.col("loc"), F.lit(" </loc><lastmod>2024-01-0"), F.col("k") % 9 + 1, F.lit("</lastmod><priority>0."), F.col("k"), F.lit("</priority></url>"))
    name = F.concat(F.lit("https://maps.example.com/"), F.when(F.col("k") == 1, "product-sitemap").when(F.col("k") == 2, "category-sitemap").otherwise("urls"), F.col("k"), F.lit(".xml"))
    body = F.concat(F.lit("<?xml version='1.0'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda x: x["e"]), "\n"), F.lit("</urlset>"))
    files = p.groupBy("k", name.alias("url")).agg(body.alias("body"))
    index = files.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform(F.sort_array(F.collect_list("url")), lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("body"))
    return files.select("url", "body").unionByName(index.select(F.lit("https://maps.example.com/index.xml").alias("url"), "body"))


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frontier entries in all states."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    state = n % 4
    return e.select(
        n.cast("string").alias("url_id"), F.concat(F.lit("http://site"), F.col("user_id"), F.lit(".example.com/"), n).alias("url"),
        F.concat(F.lit("site"), F.col("user_id"), F.lit(".example.com")).alias("domain"), (n % 10).cast("int").alias("priority"), F.lit("").alias("job_type"),
        (n % 5).cast("int").alias("retries"), F.element_at(F.array(*map(F.lit, ["queued", "inflight", "retry_scheduled", "completed"])), (state + 1).cast("int")).alias("status"),
        F.when(n % 10 <= 3, "left").otherwise("right").alias("queue_side"), n.cast("double").alias("pushed"),
        F.when(state == 1, n.cast("double")).alias("started_at"), F.when(state == 1, n.cast("double")).alias("lease_deadline"),
        F.when(state == 2, n.cast("double")).alias("next_retry_at"), F.lit(None).cast("string").alias("last_error"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events read as a log of runs: run_id, domain, status, started_at, score."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("site"), F.col("user_id"), F.lit(".example.com")).alias("domain"),
        F.col("event_type").alias("status"),
        F.col("ts").cast("timestamp").alias("started_at"),
        F.col("value").alias("score"),
    )


def market_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports (id, target_domain, report_data, competitor_count), one for each brand of parts against all others; brands are few."""
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("domain")).agg(F.round(F.avg("p_retailprice"), 2).alias("avg_price"), F.count("*").alias("product_count"))
    every = brands.agg(F.sort_array(F.collect_list(F.struct("domain", "avg_price", "product_count"))).alias("every"))  # a row a brand
    rivals = F.filter("every", lambda x: x["domain"] != F.col("domain"))
    data = F.to_json(F.struct(F.struct("avg_price", "product_count").alias("target_site"), rivals.alias("competitors"), F.lit("first line\nsecond line").alias("ai_summary")))
    return brands.join(F.broadcast(every)).select(F.col("domain").alias("id"), F.col("domain").alias("target_domain"), data.alias("report_data"), F.size(rivals).alias("competitor_count"))
