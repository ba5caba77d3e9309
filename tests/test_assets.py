"""Stored assets and probes, speed reports, spelling and whole page reports on hand-made rows."""

import json

from pyspark.sql import functions as F

from sitelens.functions.dom import parse_dom
from sitelens.operators import assets, checks

HTML = (
    '<html><head><script src="/a.js"></script><script>var a=1;</script><style>p { margin: 0 }</style><script type="x"> </script></head><body><p>Some words here</p>'
    '<img src="/x.png"><img src="data:a"><picture><source srcset="/y.webp 1x, /z.webp 2x, /x.png"></picture><a href="/one">one</a><a href="/two">two</a></body></html>'
)
ASSETS = [
    ("http://a.com/a.js", 200, {"cache-control": "max-age=1", "Content-Length": "3"}, "javascript", "x" * 600),
    ("http://a.com/b.js", 200, {"ETag": "1", "Content-Length": "99999999"}, "javascript", "big"),
    ("http://a.com/c.js", None, None, "javascript", None),
    ("http://a.com/x.png", 200, {"Expires": "0"}, "image", None),
]


def pages(spark):
    rows = [(1, "http://a.com/p", HTML, ASSETS), (2, "http://a.com/q", None, None), (3, "http://b.com/", "", [])]
    df = spark.createDataFrame(rows, f"page_id int, url string, html string, assets {assets.ASSETS}")
    return df.withColumn("dom", parse_dom(F.col("html"))).select("page_id", "url", "html", "assets", "dom.*")


def test_caching_and_minification(spark):
    cols = {f"c_{k}": assets.caching(k) for k in ("image", "javascript", "css")} | {f"m_{k}": assets.minification(k) for k in ("javascript", "css")}
    got = {r.page_id: r for r in pages(spark).select("page_id", assets.image_urls().alias("images"), *[c.alias(n) for n, c in cols.items()]).collect()}
    r = got[1]
    assert [tuple(d)[1:] for d in r.c_javascript.details] == [("ok", 200, True, False, False), ("ok", 200, False, False, True), ("error_fetching", None, False, False, False)]
    assert (r.c_image.status, r.c_image.n_checked, r.c_css.status) == ("completed", 1, "no_css_found")
    # the first script and the page's own one; the second one is too large, the third one has no answer
    assert tuple(r.m_javascript) == ("completed_with_errors", 2, 1, 1) and tuple(r.m_css) == ("completed", 1, 0, 0)
    assert r.images == ["http://a.com/x.png", "http://a.com/y.webp", "http://a.com/z.webp"]
    assert got[3].m_css.status == "no_css_found_or_analyzed" and got[3].images == []


def test_broken_targets_and_responses(spark):
    probes = spark.createDataFrame([("http://a.com/one", "404"), ("http://a.com/two", "200"), ("http://a.com/x.png", "timeout"), ("http://c.com/", "500"), ("http://a.com/two", None)], "url string, status string")
    got = {r.page_id: r for r in assets.broken(pages(spark), probes).collect()}
    assert [tuple(x) for x in got[1].broken_links] == [("http://a.com/one", "404")] and [tuple(x) for x in got[1].broken_images] == [("http://a.com/x.png", "timeout")]
    assert got[2].broken_links == [] and got[3].broken_images == []
    answers = spark.createDataFrame(
        [("http://a.com/p", 200, {"ETag": "x"}, HTML), ("http://a.com/robots.txt", 200, {}, "User-agent: *\nDisallow: /x"), ("http://a.com/sitemap.xml", 200, {}, "<urlset/>")],
        "url string, status int, headers map<string,string>, body string",
    )
    out = assets.with_responses(pages(spark), answers, probes)
    r = {x.page_id: x.response for x in out.collect()}
    assert (r[1].status, r[1].robots_found, r[1].sitemap_found, r[1].broken_links) == (200, True, True, 1)
    assert (r[3].status, r[3].robots_found, r[3].sitemap_found, r[3].broken_links) == (None, False, False, 0)
    with_, without = ({x.page_id: x.technical for x in checks.scores(p).collect()} for p in (out, pages(spark)))
    assert with_[1] > without[1] and with_[3] == without[3]


def test_speed(spark):
    data = {
        "lighthouseResult": {
            "categories": {"performance": {"score": 0.915}, "best-practices": {"score": 1}, "seo": {"score": None}},
            "audits": {"first-contentful-paint": {"displayValue": "1.2 s", "numericValue": 1200}, "speed-index": {"numericValue": 7}},
        },
        "loadingExperience": {"overall_category": "FAST", "metrics": {"a": 1}},
    }
    df = spark.createDataFrame([(json.dumps(data),), ("no json",), (None,)], "t string")
    good, bad, none = [r.s for r in df.select(assets.speed(F.col("t")).alias("s")).collect()]
    assert (good.psi_status, good.performance_score, good.best_practices_score, good.seo_score, good.first_contentful_paint, good.speed_index) == ("ok", 92, 100, None, "1.2 s", "7")
    assert (good.field_category, good.origin_field_category, good.field_metrics) == ("FAST", None, '{"a":1}')
    assert bad.psi_status == none.psi_status == "error" and bad.performance_score is None


def test_words(spark):
    df = spark.createDataFrame([(1, "Appel apple APPEL zz pear bananna"), (1, "apple"), (2, ""), (3, None)], "doc_id int, text string")
    known = spark.createDataFrame([("Apple",), ("pear",), ("pear",)], "word string")
    got = sorted((r.doc_id, r.n_misspelled, tuple(r["sample"])) for r in assets.misspelled(df, known).collect())
    assert got == [(1, 0, ()), (1, 2, ("appel", "bananna")), (2, 0, ()), (3, 0, ())]
    terms = [r.t for r in df.select(assets.related_terms(F.col("text"), ["Pear"], 2).alias("t")).collect()]
    assert terms == [["appel", "apple"], ["apple"], [], []]


def test_report(spark):
    got = {r.page_id: r for r in assets.report(pages(spark), F.lit("2024-01-02 03:04:05").cast("timestamp")).collect()}
    r = got[1]
    assert (r.analysis_timestamp, r.target_url, r.domain, r.errors) == ("2024-01-02T03:04:05", "http://a.com/p", "a.com", [])
    assert (r.seo_attributes.on_page.n_links, r.seo_attributes.technical.https, r.seo_attributes.content.n_paragraphs) == (2, False, 1)
    plain = {x.page_id: x for x in checks.scores(pages(spark)).collect()}
    assert all(tuple(got[k].scoring) == tuple(plain[k])[1:] for k in got)
    assert got[2].seo_attributes.on_page is None and got[2].errors == ["on_page", "technical", "content"]
