"""Product blocks, paging controls, page contents, report cards, run log and ordered numbers on hand-made rows."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sitelens.functions import contents, text
from sitelens.functions.dom import parse_dom
from sitelens.operators import blocks, pages
from sitelens.plans import frontier, ordered, reports
from sitelens.sources import sinks
from sitelens.streaming import ingest

SHOP = (
    '<body><nav class="pagination"><a href="?page=2">2</a></nav><ul class="products">'
    + "".join(
        f'<li class="product-item post-{k} first"><a href="/product/thing-{k}"><img src="{k}.png"></a><h2>Thing {"xABCD"[k]}</h2>'
        f'<span>{k}9,00 DT</span><button class="btn-cart">Ajouter</button></li>'
        for k in range(1, 5)
    )
    + '<li class="banner">none</li></ul><div class="x"><p>a</p><p>b</p></div></body>'
)


def parsed(spark, *rows):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id int, url string, html string")
    return df.withColumn("dom", parse_dom(F.col("html"))).select("page_id", "url", "html", "dom.*")


def test_product_list(spark):
    rows = [(0, "http://s.com/l/", SHOP), (1, "http://s.com/", "<p>alone</p>"), (2, "http://s.com/", ""), (3, None, None)]
    got = {r.page_id: r for r in blocks.product_lists(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    best = got[0]
    assert (best.is_product_list, best.selector, best.n_blocks) == (True, "ul.products > li.product-item", 4)
    # image, link, product address, price and cart of seven points, all alike and all with a product, four of twenty blocks
    assert best.confidence == pytest.approx(5.5 / 7 * 0.5 + 0.2 + 0.2 + 0.1 * 4 / 20, abs=1e-4)
    assert [tuple(p) for p in best.products] == [(f"http://s.com/product/thing-{k}", f"Thing {'xABCD'[k]}", f"{k}9,00 DT") for k in range(1, 5)]
    assert not any(got[k].is_product_list or got[k].products for k in (1, 2, 3))


def test_block_keys_and_spread():
    assert blocks.key_of({"tag": "li", "attrs": {"class": "b post-12 a col-md-3 type-product odd"}}) == "li::a b"
    assert blocks.spread([3.0]) == 0 and blocks.spread([0.0, 0.0]) == 0 and blocks.spread([2.0, 2.0]) == 0
    assert blocks.spread([1.0, 3.0]) == pytest.approx(2**0.5 / 3)


def test_paging(spark):
    got = blocks.paging(
        parsed(
            spark, ("http://a.com/l", SHOP), ("http://a.com/?p=3", "<p>x</p>"), ("http://a.com/", '<button class="btn-load">x</button>'),
            ("http://a.com/", '<a class="b" href="/">Afficher plus</a>'), ("http://a.com/", '<li class="next"><a href="/2">&gt;</a></li>'), ("http://a.com/", ""),
        )
    )
    want = [("url", "page", 'li[class*="product"]'), ("url", "p", "div"), ("load_more", None, "div"), ("load_more", None, "div"), ("next_button", None, "div"), ("infinite_scroll", None, "div")]
    assert [(r.control, r.param, r.selector) for r in got.orderBy("page_id").collect()] == want


def test_contents():
    html = (
        '<html lang="fr"><head><title>T</title><meta name="twitter:title" content=" A  title "></head><body><nav><p>menu</p></nav><header>top</header>'
        '<div class="content">short</div><article><header><h1>Head</h1></header><h3>Sub</h3><p>One <b> bold </b>and <em>it</em> <a href="/x">link</a><br>next</p>'
        "<ul><li>a<ul><li>b</li></ul></li><li>c_d</li></ul><ol><li>x</li><li>y</li></ol><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table>"
        '<pre>a  b\n c</pre><div class="newsletter">no</div><aside>no</aside></article></body></html>'
    )
    got = contents.contents(html)
    assert (got["title"], got["language"]) == ("A title", "fr")
    assert got["text"] == (
        "Head\n====\n\n### Sub\n\nOne **bold** and *it* [link](/x)  \nnext\n\n* a\n  + b\n* c\\_d\n\n1. x\n2. y\n\n"
        "| k | v |\n| --- | --- |\n| 1 | 2 |\n\n```\na  b\n c\n```"
    )
    assert contents.contents("<h1>H</h1><title>T</title>")["title"] == "H" and contents.contents("") == {"title": None, "text": "", "language": None}
    assert contents.contents(None) is None
    assert contents.contents("<p>" * 5000 + "deep")["text"].endswith("deep")


def test_keywords(spark):
    df = spark.createDataFrame([("Walking dogs walked; a dog walks the Dog", ), ("",), (None,)], "t string")
    got = [r.k for r in df.select(text.keyword_usage(F.col("t"), ["walk", "dog w"]).alias("k")).collect()]
    assert [tuple(x) for x in got[0]] == [("walk", 3, 37.5, ["walked", "walking", "walks"]), ("dog w", 1, 12.5, ["dogs"])]
    assert [(x.n, x.percent, x.variants) for x in got[1] + got[2]] == [(0, 0.0, [])] * 4


def test_intents_in_one_pass_count_like_single_patterns(spark):
    rows = ["Buy now, get started: log in or sign up to compare the best price", "how-to guide; contact support, main page and home", "", None, "pricing pricing buyers"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    low = F.lower(F.coalesce("t", F.lit("")))
    plain = lambda k: sum((F.regexp_count(low, F.lit(rf"\b({p})\b")) * w for w, ps in text.INTENTS[k].items() for p in ps), F.lit(0))
    for r in df.select(text.intent_scores(F.col("t")).alias("s"), *[plain(k).alias(k) for k in text.INTENTS]).collect():
        assert r.s.asDict() == {k: r[k] for k in text.INTENTS}


def test_top_terms_ties_and_empty_rows(spark):
    df = spark.createDataFrame([(1, "beta alfa beta gamma alfa zeta"), (1, "zeta"), (2, ""), (3, None)], "doc_id int, text string")
    got = [tuple(r) for r in pages.top_terms(df, k=2).collect()]
    assert sorted(got) == [(1, "alfa", 2, 2), (1, "beta", 2, 1), (1, "zeta", 1, 1)]


def test_numbers_in_a_group_that_fills_several_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = F.col("id")
        entries = spark.range(4000).select(
            F.when(n % 3 > 0, "hot").when(n % 30 == 0, F.lit(None)).otherwise(F.concat(F.lit("d"), n % 7)).alias("domain"),
            (n * 7919 % 1000).cast("double").alias("arrival"), n.alias("seq"), (n % 10).alias("priority"),
        )
        rows = ordered.numbered(entries, "domain", F.col("arrival"), F.col("seq"))
        assert rows.where("domain = 'hot'").select("part").distinct().count() > 1
        w = Window.partitionBy("domain").orderBy("arrival", "seq")
        same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
        assert same(rows.select("seq", "k"), entries.select("seq", (F.row_number().over(w) - 1).cast("bigint").alias("k")))
        plain = entries.withColumn("k", F.row_number().over(w) - 1)
        most = F.max(F.col("arrival") - 2 * F.col("k")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        assert same(reports.polite_starts(entries).select("seq", "start"), plain.select("seq", (most + 2 * F.col("k")).alias("start")))
        assert reports.queue_order(entries.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_report_cards(spark):
    rival = lambda d, p, **more: {"domain": d, "avg_price": p, **more}
    data = {
        "target_site": {"avg_price": 10.5, "product_count": 7, "performance_score": 92},
        "competitors": [rival("a", 9, tech_stack=["x", "y", "z", "w"]), rival("b", 12.0, performance_score=0), rival("c", None), *[rival(f"r{k}", 1.0) for k in range(5)]],
        "ai_summary": "one\n\ntwo",
    }
    rows = [("1", json.dumps(data), 8), ("2", None, None), ("3", "no json", 0)]
    got = {r.id: r for r in reports.report_cards(spark.createDataFrame(rows, "id string, report_data string, competitor_count int")).collect()}
    r = got["1"]
    assert (r.product_count, r.performance_score, r.competitor_count, r.avg_price, r.summary) == (7, "92", 8, "10.50", ["one", "", "two"])
    assert [(b.name, b.price) for b in r.bars] == [("Target", 10.5), ("a", 9.0), ("b", 12.0), ("c", 0.0), ("r0", 1.0), ("r1", 1.0)]
    assert [(x.badge, x.performance_score, x.technologies) for x in r.rivals[:3]] == [("Cheaper", "N/A", ["x", "y", "z"]), ("More Expensive", "N/A", []), ("More Expensive", "N/A", [])]
    assert all((got[k].product_count, got[k].avg_price, len(got[k].bars), got[k].summary) == (0, "0.00", 1, [reports.NO_SUMMARY]) for k in "23")


def test_run_log(spark, tmp_path):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    asked = spark.createDataFrame([("http://a.com", None, 1), ("http://b.com", "schedule", 2), ("", None, 3), (None, None, 4)], "target_url string, triggered_by string, request int")
    log = sinks.started(asked, now)
    rows = sorted(log.collect(), key=lambda r: r.target_url)
    assert [(r.target_url, r.status, r.triggered_by) for r in rows] == [("http://a.com", "running", "dashboard"), ("http://b.com", "running", "schedule")]
    assert rows == sorted(sinks.started(asked, now).collect(), key=lambda r: r.target_url)
    outcome = spark.createDataFrame([(rows[0].id, "failed", "no answer", None), ("unknown", "failed", "", None)], "id string, status string, error_message string, report_id string")
    after = {r.id: r for r in sinks.ended(log, outcome, now).collect()}
    assert len(after) == 2 and (after[rows[0].id].status, after[rows[0].id].error_message) == ("failed", "no answer") and after[rows[1].id].completed_at is None
    odd = spark.createDataFrame([("running", None), ("lost", None), (None, "schedule"), ("failed", "else")], "status string, triggered_by string")
    assert [r.v for r in odd.select(sinks.is_valid_run().alias("v")).collect()] == [True, False, False, False]
    results = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "v string, route string")
    sinks.write_routed(results, f"{tmp_path}/routed")
    assert sorted(map(tuple, spark.read.json(f"{tmp_path}/routed").select("v", "route").collect())) == [("a", "x"), ("b", "y")]
    done = spark.createDataFrame([("a.b.com", 1)], "domain string, score int").withColumn("created_at", now)
    sinks.write_reports(done, f"{tmp_path}/reports", "seo")
    assert [p.name for p in (tmp_path / "reports").glob("name=*")] == ["name=seo_a_b_com_20240101_000000"]


def test_tables_with_defaults(spark, tmp_path):
    name = f"stored_{tmp_path.name.replace('-', '_')}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    sinks.create_tables(spark, name)
    spark.sql(f"INSERT INTO {name}.target_cache (id, url, expires_at) VALUES ('1', 'u', DEFAULT), ('2', 'u', TIMESTAMP '2000-01-01')")
    spark.sql(f"INSERT INTO {name}.run_log (id) VALUES ('r')")
    assert [r.id for r in spark.table(f"{name}.active_target_cache").collect()] == ["1"]
    assert spark.table(f"{name}.run_log").first().status == "running"
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_ingest(spark, tmp_path):
    rows = [("http://a.com", None, "x"), ("http://b.com", 10, None), ("http://c.com", 11, None), ("http://d.com", 0, None), ("", 5, None), (None, 5, None)]
    df = spark.createDataFrame(rows, ingest.SCHEMA)
    assert [(r.url, r.priority) for r in ingest.accepted(df).collect()] == [("http://a.com", 5), ("http://b.com", 10)]
    assert ingest.refused(df).count() == 4
    df.write.json(f"{tmp_path}/in")
    query = ingest.accepted(ingest.landed(spark, f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_status_of(spark):
    entries = spark.createDataFrame([("a", "queued")], "url_id string, status string")
    assert frontier.status_of(entries, "a").first().status == "queued" and frontier.status_of(entries, "b").count() == 0


def test_keyword_words_as_by_all_words(spark):
    """The share and the words of one stem as they come from an array of all words; found by patterns in the text."""
    rows = [
        ("Walking walks walked, walkedly walkly walk 𝒳walks walks𝒳 naïve_walks walks_ WALKS9 walking-stick",), ("",), (None,), ("the walkings and é walk é",),
        ("using used uses use us used9 ing edly",), ("x" * 5000 + " walks",),
    ]
    df = spark.createDataFrame(rows, "t string")
    keywords = ["walk", "walking stick", "using", "us", "edly", "c++ x"]
    longer, every = F.array_distinct(text.plain_tokens(F.col("t"), 4)), F.size(text.plain_tokens(F.col("t"), 1, stopwords=True))
    of = lambda k: F.filter(longer, lambda w: (text.stem(w) == text.stem(F.lit(k.split()[0]))) & (w != k))
    kin = [F.slice(F.array_sort(of(k)), 1, 8) for k in keywords]
    share = [F.round(text.times_in(F.col("t"), k) / F.greatest(every, F.lit(1)) * 100, 2) for k in keywords]
    used = text.keyword_usage(F.col("t"), keywords)
    for r in df.select(used.alias("k"), F.array(*kin).alias("kin"), F.array(*share).alias("share")).collect():
        assert [x.variants for x in r.k] == r.kin and [x.percent for x in r.k] == r.share
    plan = df.select(used)._jdf.queryExecution().executedPlan().toString()
    assert "array_distinct(filter(" not in plan  # no array of all words
