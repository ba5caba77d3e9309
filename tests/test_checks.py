"""Every check on one hand-made page, and files of a site."""

import pytest
from pyspark.sql import functions as F

from sitelens.functions import dom, text, urls
from sitelens.operators import checks, classify, jobs, products, site
from sitelens.plans import frontier

PAGE = """<!DOCTYPE html><html lang="FR" amp><head><title> Best shoes | Shoes Shop </title>
<meta name="Description" content="Buy now"><meta http-equiv="Content-Type" content="text/html; charset=latin1">
<meta property="og:title" content="T"><meta property="og:type" content="product"><meta name="twitter:card" content="c">
<meta name="viewport" content="w"><meta name="ROBOTS" content="NOINDEX, follow"><meta property="article:published_time" content="2024-01-02">
<link rel="canonical" href="../c?x=1"><link rel="apple-touch-icon" href="/i.png"><link rel="shortcut icon" href="f.ico">
<link rel="alternate" hreflang="en" href="/en"><link rel="stylesheet" href="http://cdn.example.net/a.css"><link rel="next" href="?page=2">
<style>@media print{p{margin:0}}</style><script src="/a.js"></script>
<script type="application/ld+json">{"@graph": [{"@type": ["Product", "Thing"], "name": "Red  shoe", "image": ["/r.jpg"], "brand": {"@type": "Brand", "name": "B"},
 "sku": 7, "offers": [{"price": 12.5, "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}]}]}</script>
<script type="application/ld+json">{broken</script></head>
<body style="width: 900px"><nav class="breadcrumb"><a href="/a">Home</a><a href="#x">x</a></nav>
<h1>Shoes</h1><h3>Related items</h3><p>The shoes were mended by hand. Lorem ipsum.</p>
<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">Red</span><div itemprop="offers" itemscope itemtype="Offer"><meta itemprop="price" content="3"></div></div>
<img src="img_001.jpg" alt=""><picture><source type="image/webp" srcset="x"><img src="/photos/red-shoe.jpg" alt="red shoes"></picture>
<img src="data:xx"><img src="/b/long-name.avif" alt="a" style="max-width: 10px">
<a href="./b/../d.html" rel="nofollow noopener">more</a><a href="https://other.example/x" target="_blank">Other</a><a href="//www.facebook.com/sharer?u=1">share</a>
<a href="/product/red-shoe">Red shoe</a><a href="mailto:a@b.example">mail</a><a class="btn-cart" href="/cart">Ajouter au panier</a>
<form><input name="q"><select></select></form><table><tr><td><table></table></td></tr></table><iframe></iframe><center>x</center><b>b</b><strong>s</strong>
<ul><li>1</li></ul><ol></ol><object classid="clsid:D27CDB6E-AE6D-11cf-96B8-444553540000"></object>contact me@shop.example or x@y.png</body></html>"""
URL = "https://shop.example:8443/fr/page.html?b=2"


@pytest.fixture(scope="module")
def page(spark):
    df = spark.createDataFrame([(1, URL, PAGE), (2, "https://shop.example/", None)], "page_id int, url string, html string")
    return df.withColumn("dom", dom.parse_dom(F.col("html"))).select("page_id", "url", "html", "dom.*")


def of(page, *names, groups, keyword=None):
    return checks.check(page.where("page_id = 1"), *names, of=groups, keyword=keyword).first()


def test_head(page):
    r = of(page, "title", "title_status", "title_duplicate_words", "title_has_brand", "title_power_words", "title_keyword_near_start", groups=(checks.title,), keyword="Shoes")
    assert r[1:] == ("Best shoes | Shoes Shop", "good", 1, True, True, True)
    r = of(page, "description", "description_status", "description_has_cta", groups=(checks.description,))
    assert r[1:] == ("Buy now", "too_short", True)
    r = of(page, "has_open_graph", "open_graph", "twitter_cards", "has_share_buttons", "has_breadcrumbs", groups=(checks.social,))
    assert r[1:] == (True, {"og:title": "T", "og:type": "product"}, {"twitter:card": "c"}, True, True)


def test_body(page):
    r = of(page, "n_h1", "n_h2", "n_h3", "hierarchy_ok", "h1_has_keyword", groups=(checks.headings,), keyword="shoes")
    assert r[1:] == (1, 0, 1, False, True)
    r = of(page, "n_images", "images_without_alt", "n_images_not_responsive", "n_image_names_undescriptive", "n_images_with_keyword", groups=(checks.images,), keyword="shoes")
    assert r[1:] == (4, ["img_001.jpg"], 2, 1, 1)
    r = of(page, "all_links", "n_internal_nofollow", "n_unsafe_blank", "n_generic", groups=(checks.with_links,))
    base = "https://shop.example:8443"
    assert r.all_links == [f"{base}/a", f"{base}/fr/d.html", f"{base}/product/red-shoe", f"{base}/cart", "https://other.example/x", "https://www.facebook.com/sharer?u=1"]
    assert r[2:] == (1, 1, 1)
    r = of(page, "n_iframes", "apple_touch_icon", "n_scripts", "n_stylesheets", "n_strong", "deprecated_tags", "has_flash", "nested_tables", "n_forms", "n_form_fields", groups=(checks.markup,))
    assert r[1:] == (1, f"{base}/i.png", 1, 1, 2, {"center": 1}, True, True, 1, 2)
    r = of(page, "published", "modified", "lorem_ipsum", "n_bullet_lists", "n_numbered_lists", groups=(checks.dates, checks.content))
    assert r[1:] == ("2024-01-02", None, True, 1, 1)


def test_technical(page):
    r = of(
        page, "charset", "canonical", "noindex", "nofollow", "is_amp", "mobile_responsive", "has_media_queries", "has_mixed_content", "emails", "uses_webp", "uses_avif", "favicon",
        groups=(checks.technical,),
    )
    base = "https://shop.example:8443"
    assert r[1:] == ("latin1", f"{base}/c?x=1", True, False, True, False, True, True, ["a@b.example", "me@shop.example"], True, True, f"{base}/f.ico")
    r = of(page, "hreflangs", "mixed_content", "script_urls", groups=(checks.assets,))
    assert [tuple(x) for x in r.hreflangs] == [("en", f"{base}/en")] and [tuple(x) for x in r.mixed_content] == [("link", "http://cdn.example.net/a.css")] and r.script_urls == [f"{base}/a.js"]
    r = of(page, "has_json_ld", "json_ld_types", "microdata_types", "microdata", "has_schema", groups=(checks.structured,))
    assert r[1:4] == (True, ["Product", "Thing", "Brand"], ["https://schema.org/Product"]) and r.has_schema
    assert [tuple(x) for x in r.microdata[0].properties] == [("name", "Red"), ("offers", "Offer")]


def test_kinds_products_and_scores(page):
    r = classify.classify(page).where("page_id = 1").first()
    assert r.schema_product and r.n_add_to_cart == 1 and r.n_product_links == 1 and r.has_search and r.has_related and r.pagination == ["rel_next"]
    assert r.detail_score == 0.65 and r.page_type == "product_detail"  # schema, cart, few product links; no price in the text
    r = products.detail(page).where("page_id = 1").first()
    assert r[1:] == ("Red shoe", None, "B", "7", "12.5", "EUR", "InStock", ["https://shop.example:8443/r.jpg"])
    assert products.listed(page).where("page_id = 1").first().links == ["https://shop.example:8443/product/red-shoe"]
    got = {x.page_id: x for x in checks.scores(page).collect()}
    earned = 15 + 8 * 1.2 * 0.3 + 12 * 0.6 + 7 * 0.75 + 0.8 * 3 + 5 * 0.7 + 15 + 2.1 * 2 + 5 + 1.5 - 0.05 * 2 + 0 + 0 + 5 + 3.2 * (1 - 0.5 / 4)
    full = 15 + 9.6 + 12 + 7 + 4 + 8 + 3.5 + 15 + 2.1 + 2.1 + 5 + 1.5 + 4 + 5 + 5 + 3.2
    assert abs(got[1].on_page - round(100 * earned / full, 1)) <= 0.11


def test_urls(spark):
    rows = [("http://a.com/p?a=%zz&b=~*",), ("http://a.com/p?b=%zz",), ("https://x.tn/shop/",), ("https://x.tn/Cat%C3%A9gorie/2",), ("https://x.tn/a?page=3",)]
    got = spark.createDataFrame(rows, "u string").select(urls.normalized(F.col("u")), urls.url_class(F.col("u")), urls.next_page(F.col("u"))).collect()
    assert got[0][0] == "http://a.com/p?a=%25zz&b=~%2A" and got[1][0] == "http://a.com/p?b=%25zz"
    assert got[2][1] == "category" and got[3][1] == "category"
    assert got[4][2] == "https://x.tn/a?page=4" and got[2][2] == "https://x.tn/shop/?page=2"
    base = "https://x.tn/a/b.html?q=1"
    for href, want in (("c", "/a/c"), ("../c/./d/", "/c/d/"), ("?z=1", "/a/b.html?z=1"), ("/r/../s", "/s"), ("..", "/"), (".", "/a/")):
        assert spark.range(1).select(urls.resolve(F.lit(base), F.lit(href))).first()[0] == f"https://x.tn{want}"


def test_site_files(spark):
    robots = "# c\nUser-agent: Googlebot\nDisallow: /\n\nuser-agent: *\nDisallow: /a\nDisallow:\nSitemap: https://x.tn/s.xml\n"
    xml = "<sitemapindex><sitemap><loc>https://x.tn/product-sitemap.xml</loc></sitemap><sitemap><loc>https://x.tn/s.xml</loc></sitemap></sitemapindex>"
    leaf = "<urlset xmlns='x'><url><loc> https://x.tn/p?a=1&amp;b=2 </loc><priority>0.5</priority></url><url><lastmod>x</lastmod></url><url><loc><![CDATA[https://x.tn/q]]></loc></url></urlset>"
    responses = spark.createDataFrame([("https://x.tn/robots.txt", 200, {"CF-Ray": "1"}, robots), ("https://x.tn/s.xml", 301, {}, xml)], "url string, status int, headers map<string,string>, body string")
    r = site.robots(responses).first()
    assert (r.robots_status, r.sitemaps, r.disallowed, r.closed_to_all, r.closed_to_google) == ("found", ["https://x.tn/s.xml"], ["/a"], False, True)
    assert site.site_checks(responses).first().sitemap_url == "https://x.tn/s.xml"
    assert site.response_checks(responses).first().networks == ["Cloudflare"]
    files = spark.createDataFrame([("https://x.tn/s.xml", xml), ("https://x.tn/product-sitemap.xml", leaf)], "url string, body string")
    starts = spark.createDataFrame([("x", "https://x.tn/s.xml", 0)], "site string, url string, position bigint")
    got = site.classified(site.traverse(files, starts)).collect()
    assert sorted((g.loc, g.priority, g.category) for g in got) == [("https://x.tn/p?a=1&b=2", 0.5, "product"), ("https://x.tn/q", None, "product")]


def test_frontier_steps(spark):
    empty = spark.createDataFrame([], frontier.ENTRY)
    batch = spark.createDataFrame([(0, "http://a.com/1", 5), (1, "http://a.com/2", 1), (2, "http://A.com:80/1", 5), (3, "nonsense", 5), (4, "http://b.com/", 9)], "ordinal int, url string, priority int")
    entries = frontier.add(empty, batch, 100.0).cache()
    assert tuple(frontier.counts(empty, entries, batch).first()) == (5, 3, 2)
    assert frontier.add(entries, batch, 200.0).count() == 3
    none = spark.createDataFrame([], "domain string, ready_at double")
    leased, times = frontier.lease(entries, none, 100.0)
    assert sorted(r.url for r in leased.where("status = 'inflight'").collect()) == ["http://a.com/2", "http://b.com/"]
    again, _ = frontier.lease(leased, times, 101.0)
    assert again.where("status = 'inflight'").count() == 2
    done = frontier.complete(leased, leased.where("domain = 'b.com'"))
    late, summary = frontier.recover(done, 1000.0)
    assert tuple(summary.first()) == (1, 0)
    assert late.where("status = 'retry_scheduled'").first().next_retry_at == 1030.0
    assert frontier.promote(late, 1030.0).where("status = 'queued'").count() == 2
    assert frontier.waits(late, times, 1000.0).first().sleep == 0.05


def test_intents_and_jobs(spark):
    df = spark.createDataFrame([(1, "buy this guide", "https://x.tn/pricing?x=/blog")], "page_id int, visible string, url string")
    r = jobs.intents(df).first()
    assert (r.transactional, r.informational, r.primary_intent, r.confidence, r.url_signals) == (7, 7, "transactional", 0.49, ["/pricing", "/blog"])
    kinds = spark.createDataFrame([(1, "product_list", True), (2, "unknown", False)], "page_id int, page_type string, has_pagination boolean")
    assert [tuple(r) for r in jobs.routed(kinds).collect()] == [(1, "product_list_paginated", "extract_product_list", "product_list_scrape_result_url"), (2, "unknown", None, None)]


def test_minification(spark):
    r = spark.range(1).select(text.minification(F.lit("a" * 600)), text.minification(F.lit("a b\nc d\n")), text.minification(F.lit(""))).first()
    assert [x.is_minified for x in r] == [True, False, False]
