"""Page, report and scheduling queries: against DuckDB where they have SQL, and on small pages by hand."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sitelens.functions import dom, text, urls
from sitelens.operators import checks
from sitelens.plans import queries as plans
from sitelens.plans import reports
from sitelens.streaming import frontier

SQL = plans.oracle_sql()


def plain(rows):
    return sorted(repr(tuple(round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = plans.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall()
    assert plain(df.select(*names).collect()) == plain(want)


HTML = """<!DOCTYPE html><html lang="EN"><head><title>Best shoes - Shop</title><meta charset="utf-8"><meta name="Robots" content="noindex">
<link rel="canonical" href="/x"><style>p{}</style></head><body><nav><a href="/home">Home</a></nav><h1>One</h1><h3 style="a">Three</h3>
<p>Read more &amp; <b>buy now</b><p>nested<table><tr><td><table></table></td></tr></table>
<a href="https://other.example.org/a" rel="nofollow">Click here</a><a href="#x">skip</a><a href="sub/page">Page</a></body></html>"""


def test_one_page(spark):
    df = spark.createDataFrame([(1, "http://a.example.com/d/e.html", HTML), (2, "http://b.example.com/", None)], "page_id int, url string, html string")
    pages = df.withColumn("dom", dom.parse_dom(F.col("html"))).select("page_id", "url", "html", "dom.*").where("nodes IS NOT NULL")
    t = checks.check(pages, "title", "title_status", "title_power_words", of=(checks.title,)).first()
    assert t[1:] == ("Best shoes - Shop", "too_short", True)
    h = checks.check(pages, "n_h1", "n_h2", "n_h3", "hierarchy_ok", of=(checks.headings,)).first()
    assert h[1:] == (1, 0, 1, False)
    found = {r.url: (r.internal, r.anchor, r.rel) for r in pages.select(F.explode(checks.page_links()).alias("x")).select("x.*").collect()}
    assert found == {
        "http://a.example.com/home": (True, "Home", ""), "https://other.example.org/a": (False, "Click here", "nofollow"),
        "http://a.example.com/d/sub/page": (True, "Page", ""),
    }
    k = checks.check(pages, "https", "html_lang", "charset", "has_doctype", "has_meta_robots", "has_canonical", of=(checks.technical,)).first()
    assert k[1:] == (False, "en", "utf-8", True, True, True)
    assert checks.check(pages, "has_cta", of=(checks.content,)).first().has_cta
    assert 0 <= checks.scores(pages).first().overall <= 100


def test_urls(spark):
    given = {
        "HTTP://User@Ex.com:80?b=2&a=1#f": ("http://ex.com/?a=1&b=2", "other"),
        "https://ex.com/shop/shoes": ("https://ex.com/shop/shoes", "category"),
        "https://ex.com/shop/a/b/red-shoe": ("https://ex.com/shop/a/b/red-shoe", "product"),
        "https://ex.com:8443/blog/x": ("https://ex.com:8443/blog/x", "blog"),
        "no url": (None, "other"),
    }
    df = spark.createDataFrame([(u,) for u in given], "url string")
    got = df.select("url", urls.normalized(F.col("url")).alias("n"), urls.url_class(F.col("url")).alias("c")).collect()
    assert {r.url: (r.n, r.c) for r in got} == given


def test_words(spark):
    df = spark.createDataFrame([("running tables made the cities",)], "t string")
    r = df.select(
        text.ngrams(text.plain_tokens(F.col("t")), 3).alias("g"), text.syllables(F.lit("tables")).alias("s"), text.stem(F.lit("running")).alias("m")
    ).first()
    assert r.g == ["running tables made", "tables made cities"] and r.s == 2 and r.m == "runn"


def test_retries(spark):
    df = spark.createDataFrame([(1,), (3,), (4,)], "attempts int")
    assert [(r.dead, r.delay) for r in reports.retries(df).orderBy("attempts").collect()] == [(False, 30.0), (False, 120.0), (True, None)]


def test_frontier_stream(spark, tmp_path):
    rows = [("http://a.com/1", 0), ("http://a.com/1#x", 1), ("http://a.com/2", 1), ("http://b.com/", 1)]
    spark.createDataFrame(rows, "url string, at int").select("url", F.timestamp_seconds("at").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = frontier.first_seen(spark.readStream.schema("url string, ts timestamp").parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("seen").count() == 3


def test_polite_stream(spark, tmp_path):
    spark.createDataFrame([("a", "1", 0.0), ("a", "2", 0.5), ("b", "3", 9.0)], "domain string, url_id string, arrival double").write.parquet(f"{tmp_path}/in")
    stream = frontier.polite(spark.readStream.schema("domain string, url_id string, arrival double").parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("polite").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {r.url_id: r.start for r in spark.table("polite").collect()} == {"1": 0.0, "2": 2.0, "3": 9.0}
