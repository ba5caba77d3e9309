"""Checks of a site's files and headers, over stored responses: robots, sitemaps, policies for crawlers, and the like.

A response is a row (url, status, headers map, body).  Files are parsed line by line with array functions, and sitemaps by
matching their elements; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls

# Crawlers that a policy should name, what a directive is called, and traces of content networks.
CRAWLERS = [
    "GPTBot", "ChatGPT-User", "Google-Extended", "CCBot", "ClaudeBot", "anthropic-ai", "PerplexityBot", "Applebot-Extended", "FacebookBot", "Bytespider",
]
TRAINING = ["training", "allow-training", "data-usage", "data_use", "data-collection"]
POLICY_FILES = ["/llms.txt", "/ai.txt", "/.well-known/ai.txt"]
LISTED_FOLDERS = ["/css/", "/js/", "/images/", "/uploads/"]
CATEGORIES = ["product", "category", "other", "blog", "news", "about", "contact", "event", "promo", "auth", "support", "rules"]


def _lines(body: Column) -> Column:
    return F.transform(F.split(F.coalesce(body, F.lit("")), r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def _after(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, r"^[^:]*:\s*(.*)$", 1))


def looks_like_robots(body: Column) -> Column:
    return F.lower(F.coalesce(body, F.lit(""))).rlike("user-agent|sitemap")


def sitemap_directives(body: Column) -> Column:
    """The URLs after Sitemap:, in order."""
    found = F.filter(_lines(body), lambda x: F.lower(x).startswith("sitemap:"))
    return F.filter(F.transform(found, _after), lambda u: u != "")


def rules(body: Column) -> Column:
    """The file's Disallow lines with the crawler named last before each, * at first."""
    lines = F.filter(_lines(body), lambda x: (x != "") & ~x.startswith("#"))

    def step(state: Column, line: Column) -> Column:
        low = F.lower(line)
        agent = F.when(low.startswith("user-agent:"), F.lower(_after(line))).otherwise(state["agent"])
        rule = F.struct(state["agent"].alias("agent"), _after(line).alias("path"))
        return F.struct(agent.alias("agent"), F.when(low.startswith("disallow:"), F.concat(state["rules"], F.array(rule))).otherwise(state["rules"]).alias("rules"))

    none = F.array().cast("array<struct<agent:string,path:string>>")
    return F.aggregate(lines, F.struct(F.lit("*").alias("agent"), none.alias("rules")), step, lambda s: s["rules"])


def disallowed(body: Column, agent: str = "*") -> Column:
    """The non-empty Disallow paths of the blocks that name this crawler exactly, or *."""
    lines = F.filter(_lines(body), lambda x: (x != "") & ~x.startswith("#"))

    def step(state: Column, line: Column) -> Column:
        low = F.lower(line)
        named = low.startswith("user-agent:")
        inside = F.when(named, _after(line).isin(agent, "*")).otherwise(state["inside"])
        takes = ~named & state["inside"] & low.startswith("disallow:") & (_after(line) != "")
        return F.struct(inside.alias("inside"), F.when(takes, F.concat(state["paths"], F.array(_after(line)))).otherwise(state["paths"]).alias("paths"))

    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("paths"))
    return F.aggregate(lines, start, step, lambda s: s["paths"])


def robots(responses: DataFrame) -> DataFrame:
    """Of every stored robots.txt: origin, status, sitemaps, rules, disallowed paths, and whether all is closed to all or to Google's crawler."""
    at = responses.where(urls.path(F.col("url")) == "/robots.txt")
    found = (F.col("status") == 200) & looks_like_robots(F.col("body"))
    body = F.when(found, F.col("body"))
    out = at.select(
        origin_of(F.col("url")).alias("origin"),
        F.when(found, "found").when(F.col("status").isNull(), "error_accessing").otherwise("not_found").alias("robots_status"),
        sitemap_directives(body).alias("sitemaps"),
        rules(body).alias("rules"),
        disallowed(body).alias("disallowed"),
    )
    closed = lambda test: F.exists("rules", lambda r: (r["path"] == "/") & test(r["agent"]))
    return out.withColumn("closed_to_all", closed(lambda a: a == "*")).withColumn("closed_to_google", closed(lambda a: F.contains(a, F.lit("googlebot"))))


def origin_of(url: Column) -> Column:
    return F.concat(urls.scheme(url), F.lit("://"), F.lower(urls.netloc(url)))


def _element(xml: Column, name: str) -> Column:
    inner = F.trim(F.regexp_extract(xml, rf"(?is)<(?:[\w-]+:)?{name}\b[^>]*>(.*?)</(?:[\w-]+:)?{name}\s*>", 1))
    plain = F.trim(F.regexp_replace(inner, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"))
    for escape, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(escape), F.lit(char))
    return F.nullif(plain, F.lit(""))


def _elements(xml: Column, name: str) -> Column:
    return F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(rf"(?is)<(?:[\w-]+:)?{name}(?:\s[^>]*)?>(.*?)</(?:[\w-]+:)?{name}\s*>"), F.lit(1))


def sitemap_entries(xml: Column) -> Column:
    """The url elements of a sitemap that have a loc: loc, lastmod, changefreq, priority."""
    made = F.transform(
        _elements(xml, "url"),
        lambda x: F.struct(
            _element(x, "loc").alias("loc"), _element(x, "lastmod").alias("lastmod"), _element(x, "changefreq").alias("changefreq"),
            _element(x, "priority").try_cast("double").alias("priority"),
        ),
    )
    return F.filter(made, lambda e: e["loc"].isNotNull())


def sitemap_children(xml: Column) -> Column:
    """The sitemaps that a sitemap index names."""
    return F.filter(F.transform(_elements(xml, "sitemap"), lambda x: _element(x, "loc")), lambda u: u.isNotNull())


def traverse(files: DataFrame, starts: DataFrame, max_sitemaps: int = 50) -> DataFrame:
    """source_sitemap, position and the entries of all sitemaps reached from starts (site, url), breadth first.

    files is (url, body).  Each round follows one level of index files for all sites together; a site stops at max_sitemaps files, the limit
    that keeps a crawl from running away.  The rounds are as many as the levels, and a file that was seen is not read again.
    """
    files = files.groupBy("url").agg(F.min("body").alias("body")).select("url", sitemap_entries(F.col("body")).alias("entries"), sitemap_children(F.col("body")).alias("children"))
    seen = starts.groupBy("site", "url").agg(F.min("position").alias("position")).withColumn("level", F.lit(0))
    wave, level = seen, 0
    while level < max_sitemaps:
        level += 1
        below = wave.join(files, "url").select("site", F.posexplode("children").alias("k", "child"), "position")
        below = below.groupBy("site", F.col("child").alias("url")).agg(F.min(F.struct("position", "k")).alias("at"))
        wave = below.join(seen.select("site", "url"), ["site", "url"], "left_anti").select(
            "site", "url", (F.col("at.position") * 100000 + F.col("at.k") + 1).cast("bigint").alias("position"), F.lit(level).alias("level")
        )
        if wave.isEmpty():
            break
        seen = seen.unionByName(wave)
    rank = F.row_number().over(_by_site())
    kept = seen.withColumn("rank", rank).where(F.col("rank") <= max_sitemaps)
    return kept.join(files, "url").select("site", F.col("url").alias("source_sitemap"), "rank", F.posexplode("entries").alias("position", "entry")).select(
        "site", "source_sitemap", "rank", "position", "entry.*"
    )


def _by_site():
    from pyspark.sql import Window

    return Window.partitionBy("site").orderBy("level", "position", "url")


def classified(entries: DataFrame) -> DataFrame:
    """Entries (loc, source_sitemap) with their category: the sitemap's name decides where it can, else the URL."""
    return entries.withColumn("category", F.coalesce(urls.sitemap_class(F.col("source_sitemap")), urls.url_class(F.col("loc"))))


def by_category(entries: DataFrame) -> DataFrame:
    """site, category, how many URLs it has and which, in order; every category of a site that has any entry."""
    return entries.groupBy("site", "category").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("loc")).alias("urls"))


def policy(body: Column) -> Column:
    """A crawler policy's groups (agent, allows, disallows, crawl_delay, training) and the directives before any of them."""
    lines = F.filter(F.transform(_lines(body), lambda x: F.trim(F.substring_index(x, "#", 1))), lambda x: F.contains(x, F.lit(":")))
    group = "struct<agent:string,allows:array<string>,disallows:array<string>,crawl_delay:string,training:string>"

    def step(state: Column, line: Column) -> Column:
        key, value = F.lower(F.trim(F.substring_index(line, ":", 1))), _after(line)
        none = F.array().cast("array<string>")
        fresh = F.struct(value.alias("agent"), none.alias("allows"), none.alias("disallows"), F.lit(None).cast("string").alias("crawl_delay"), F.lit(None).cast("string").alias("training"))
        g = F.element_at(state["groups"], -1)
        changed = F.struct(
            g["agent"].alias("agent"),
            F.when(key == "allow", F.concat(g["allows"], F.array(value))).otherwise(g["allows"]).alias("allows"),
            F.when(key == "disallow", F.concat(g["disallows"], F.array(value))).otherwise(g["disallows"]).alias("disallows"),
            F.when(key.isin("crawl-delay", "crawl_delay"), value).otherwise(g["crawl_delay"]).alias("crawl_delay"),
            F.when(key.isin(*TRAINING), value).otherwise(g["training"]).alias("training"),
        )
        some = F.size(state["groups"]) > 0
        before = F.slice(state["groups"], 1, F.greatest(F.size(state["groups"]) - 1, F.lit(0)))
        groups = F.when(key == "user-agent", F.concat(state["groups"], F.array(fresh))).when(some, F.concat(before, F.array(changed))).otherwise(state["groups"])
        free = F.when((key != "user-agent") & ~some, F.concat(state["free"], F.array(F.struct(key.alias("key"), value.alias("value"))))).otherwise(state["free"])
        return F.struct(groups.alias("groups"), free.alias("free"))

    start = F.struct(F.array().cast(f"array<{group}>").alias("groups"), F.array().cast("array<struct<key:string,value:string>>").alias("free"))
    return F.aggregate(lines, start, step)


def policies(responses: DataFrame) -> DataFrame:
    """Of every origin, the first policy file there is: its url, groups, free directives, crawlers it doesn't name, and what to add."""
    order = F.array_position(F.array(*map(F.lit, POLICY_FILES)), urls.path(F.col("url")))
    usable = responses.where((F.col("status") == 200) & (F.col("body") != "") & (order > 0))
    first = usable.groupBy(origin_of(F.col("url")).alias("origin")).agg(F.min_by(F.struct("url", "body"), order).alias("r"))
    out = first.select("origin", "r.url", F.substring("r.body", 1, 1000).alias("preview"), policy(F.col("r.body")).alias("p")).select("origin", "url", "preview", "p.groups", "p.free")
    agents = F.transform("groups", lambda g: g["agent"])
    missing = F.filter(F.array(*map(F.lit, CRAWLERS)), lambda c: ~F.array_contains(F.col("agents"), c) & ~F.array_contains(F.col("agents"), F.lower(c)))
    keys = F.transform("free", lambda d: d["key"])
    advice = F.array_compact(
        F.array(
            F.when(F.size("groups") == 0, "name a crawler"),
            F.when(F.size("missing") > 0, "name the other crawlers"),
            F.when(~F.exists("groups", lambda g: F.coalesce(g["training"], F.lit("")) != ""), "state training use"),
            F.when(~F.array_contains(keys, "sitemap"), "add a sitemap"),
            F.when(~F.arrays_overlap(keys, F.array(*map(F.lit, ["contact", "owner", "email"]))), "add a contact"),
            F.when(~F.exists(keys, lambda k: k.rlike("policy|license")), "link a policy"),
        )
    )
    return out.withColumn("agents", agents).withColumn("missing", missing).withColumn("advice", advice)


def header(headers: Column, name: str) -> Column:
    """A header by name, whatever its case."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name.lower())), F.lit(0))


def networks(headers: Column) -> Column:
    """The content networks that the headers show."""
    server = F.lower(F.coalesce(header(headers, "Server"), F.lit("")))
    names = F.map_keys(headers)
    has = lambda name, word: F.contains(F.coalesce(header(headers, name), F.lit("")), F.lit(word))
    tests = {
        "Cloudflare": F.exists(names, lambda k: F.lower(k) == "cf-ray") | F.contains(server, F.lit("cloudflare")),
        "Akamai": F.exists(names, lambda k: F.lower(k).startswith("x-akamai")) | F.contains(server, F.lit("akamaighost")),
        "CloudFront": has("Via", "cloudfront") | has("X-Amz-Cf-Id", "cloudfront") | F.contains(server, F.lit("cloudfront")),
        "Fastly": has("X-Served-By", "fastly") | F.contains(server, F.lit("fastly")),
        "Google": F.contains(server, F.lit("gws")) | F.contains(server, F.lit("google")),
    }
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))


def response_checks(responses: DataFrame) -> DataFrame:
    """Of every response: compression, signature, security and cache headers, networks."""
    h = F.col("headers")
    cached = {k: header(h, k) for k in ("Cache-Control", "Expires", "Pragma", "ETag", "Last-Modified")}
    return responses.select(
        "url", "status", F.lower(header(h, "Content-Encoding")).alias("encoding"), header(h, "X-Robots-Tag").alias("x_robots_tag"),
        header(h, "Strict-Transport-Security").alias("hsts"), header(h, "Server").alias("server"), networks(h).alias("networks"),
        F.struct(*[v.alias(k) for k, v in cached.items()]).alias("cache"),
        (F.coalesce(cached["Cache-Control"], cached["Expires"], cached["ETag"], F.lit("")) != "").alias("is_cached"),
        urls.resource_type(F.col("url"), header(h, "Content-Type")).alias("resource_type"),
    )


def site_checks(responses: DataFrame) -> DataFrame:
    """Of every origin: sitemap found, own page for missing ones, listed folders, ads.txt."""
    path, ok = urls.path(F.col("url")), F.col("status") == 200
    title = F.lower(F.regexp_extract(F.coalesce("body", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))
    listed = ok & path.isin(*LISTED_FOLDERS) & F.contains(title, F.lit("index of /"))
    declared = robots(responses).select("origin", F.explode("sitemaps").alias("url"))
    names = responses.select(origin_of(F.col("url")).alias("origin"), "url", "status")
    usual = names.where(urls.path(F.col("url")).isin("/sitemap.xml", "/sitemap_index.xml")).join(declared.select("origin").distinct(), "origin", "left_anti")
    looked = names.join(declared.select("origin", "url").distinct(), ["origin", "url"], "left_semi").unionByName(usual.select("origin", "url", "status"))
    found = looked.where(F.col("status").isin(200, 301, 302)).groupBy("origin").agg(F.min("url").alias("sitemap_url"))
    own = responses.groupBy(origin_of(F.col("url")).alias("origin")).agg(
        F.bool_or(F.contains(path, F.lit("/non_existent_page_")) & (F.col("status") == 404) & (F.octet_length("body") > 1024)).alias("custom_404"),
        F.sort_array(F.collect_set(F.when(listed, path))).alias("listed_folders"),
        F.max(F.when(ok & (path == "/ads.txt"), F.substring("body", 1, 1000))).alias("ads_txt"),
    )
    return own.join(found, "origin", "left").withColumn("has_sitemap", F.col("sitemap_url").isNotNull())


def mail_records(records: DataFrame) -> DataFrame:
    """Of every domain (domain, txt): the sender policies among its text records."""
    spf = F.when(F.lower("txt").startswith("v=spf1"), F.col("txt"))
    return records.groupBy("domain").agg(F.sort_array(F.collect_list(spf)).alias("spf")).withColumn("has_spf", F.size("spf") > 0)
