"""What is done with a page by its kind, and search intent by text and address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls

# Job and route of every kind of page, and parts of addresses that show an intent, by strength.
JOBS = {
    "product_list_paginated": "extract_product_list", "product_list": "extract_product_list", "product_detail": "extract_product_detail",
    "content_list": "extract_page_content",
}
ROUTES = {
    "crawl": "crawl_result_url", "extract_product_list": "product_list_scrape_result_url", "extract_product_detail": "product_scrape_result_url",
    "extract_page_content": "content_scrape_result_url",
}
URL_INTENTS = {
    "transactional": {
        4: ["/pricing", "/plans", "/buy", "/order", "/checkout", "/cart", "/purchase"],
        2: ["/trial", "/demo", "/signup", "/register", "/subscribe"],
        1: ["/contact", "/quote", "/estimate"],
    },
    "commercial": {
        4: ["/compare", "/vs", "/versus", "/reviews", "/alternatives"],
        2: ["/features", "/benefits", "/pricing-comparison"],
        1: ["/products", "/services", "/solutions"],
    },
    "informational": {
        4: ["/blog", "/guide", "/tutorial", "/how-to", "/learn"],
        2: ["/help", "/support", "/faq", "/documentation"],
        1: ["/news", "/articles", "/resources"],
    },
    "navigational": {
        4: ["/login", "/signin", "/dashboard", "/account", "/profile"],
        2: ["/about", "/contact", "/home", "/index"],
        1: ["/sitemap", "/directory"],
    },
}
TIES = ["transactional", "commercial", "navigational", "informational"]


def routed(classified: DataFrame) -> DataFrame:
    """page_id, page_type (paged lists told apart), job_type and the setting that names where its result goes."""
    kind = F.when((F.col("page_type") == "product_list") & F.col("has_pagination"), "product_list_paginated").otherwise(F.col("page_type"))
    job = F.create_map(*[F.lit(x) for pair in JOBS.items() for x in pair])
    route = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    out = classified.select("page_id", kind.alias("page_type")).withColumn("job_type", F.try_element_at(job, "page_type"))
    return out.withColumn("route", F.try_element_at(route, "job_type"))


def url_intent(url: Column, intent: str) -> Column:
    at = F.lower(F.concat_ws(" ", urls.path(url), F.nullif(urls.query(url), F.lit(""))))
    out = F.lit(0)
    for weight, parts in URL_INTENTS[intent].items():
        for p in parts:
            out = out + F.when(F.contains(at, F.lit(p)), weight).otherwise(0)
    return out


def url_signals(url: Column) -> Column:
    """The parts of an address that show an intent, in order."""
    at = F.lower(F.concat_ws(" ", urls.path(url), F.nullif(urls.query(url), F.lit(""))))
    parts = [p for by in URL_INTENTS.values() for ps in by.values() for p in ps]
    return F.array_compact(F.array(*[F.when(F.contains(at, F.lit(p)), F.lit(p)) for p in parts]))


def intents(pages: DataFrame, text_col: str = "visible", url_col: str = "url") -> DataFrame:
    """page_id, the four scores by text and address, the primary intent, the confidence and the address's signals."""
    empty = F.trim(F.coalesce(F.col(text_col), F.lit(""))) == ""
    scores = {k: F.when(empty, 0).otherwise(F.col("said")[k] + url_intent(F.col(url_col), k)) for k in text.INTENTS}
    out = pages.withColumn("said", text.intent_scores(F.col(text_col))).select("page_id", *[c.cast("bigint").alias(k) for k, c in scores.items()], F.when(empty, F.array().cast("array<string>")).otherwise(url_signals(F.col(url_col))).alias("url_signals"))
    ranked = F.sort_array(F.array(*text.INTENTS), asc=False)
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    primary = F.lit("informational")
    for k in reversed(TIES):
        primary = F.when((F.col(k) == best) & (best > 0), k).otherwise(primary)
    confidence = F.when(best <= 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), best / 10.0) * (1 - second / best * 0.3), 2))
    return out.withColumn("primary_intent", primary).withColumn("confidence", confidence)
