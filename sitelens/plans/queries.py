"""The registered page, report and scheduling queries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.contents import text_contents
from ..operators import assets, blocks, checks, classify, jobs, pages as op, products, site
from ..sources.tables import frontier as frontier_table, market_reports, parsed_pages, responses, run_log, sitemap_files, table
from . import frontier, reports

Query = Callable[[SparkSession, str], DataFrame]
NOW = "2024-01-20 00:00:00"


def _url_parts(s: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(s, d, "pages").select(
        "page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"),
        F.size(urls.segments(u)).alias("depth"), urls.is_seo_friendly(u).alias("seo_friendly"),
    )


def _url_identity(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", urls.normalized(F.col("url")).alias("normalized"), urls.url_id(F.col("url")).alias("url_id"))


def _frontier(s: SparkSession, d: str) -> DataFrame:
    """events as frontier entries: domain, seq, priority 0 to 9, arrival in seconds."""
    return table(s, d, "events").select(
        F.concat(F.lit("site"), F.col("user_id")).alias("domain"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 10).alias("priority"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("micros"),
    ).select("domain", "seq", "priority", F.floor(F.col("micros") / 1e6).cast("double").alias("arrival"))


def _prices(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(
        "doc_id", text.price_matches(F.col("text")).cast("bigint").alias("n_prices"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(text.EMAIL)).cast("bigint").alias("n_emails"),
    )


def _attempts(s: SparkSession, d: str) -> DataFrame:
    runs = run_log(s, d).where("status = 'error'").groupBy("domain").agg(F.count("*").alias("attempts"))
    return reports.retries(runs)


def _sitemap(s: SparkSession, d: str) -> DataFrame:
    starts = s.createDataFrame([("maps", "https://maps.example.com/index.xml", 0)], "site string, url string, position bigint")
    return site.traverse(sitemap_files(s, d), starts)


def _leased(s: SparkSession, d: str) -> DataFrame:
    domains = s.createDataFrame([("site1.example.com", 5000.0), ("site2.example.com", 10.0)], "domain string, ready_at double")
    entries, _ = frontier.lease(frontier_table(s, d), domains, 1000.0)
    return entries.where("started_at = 1000.0 AND status = 'inflight' AND lease_deadline = 1300.0").select("domain", "url_id")


def _keywords(s: SparkSession, d: str) -> DataFrame:
    used = text.keyword_usage(F.col("text"), ["data", "the report"])
    out = table(s, d, "documents").select("doc_id", F.explode(used).alias("k"))
    return out.select("doc_id", "k.keyword", "k.n", "k.percent", F.array_join("k.variants", ",").alias("variants"))


def _cards(s: SparkSession, d: str) -> DataFrame:
    r = reports.report_cards(market_reports(s, d))
    return r.select("id", "product_count", "performance_score", "competitor_count", "avg_price", F.size("bars").alias("n_bars"), F.col("bars")[1]["name"].alias("second_bar"), F.size(F.filter("rivals", lambda x: x["badge"] == "Cheaper")).alias("n_cheaper"), F.size("summary").alias("n_lines"))


def queries() -> dict[str, Query]:
    page = parsed_pages
    return {
        "url_parts": _url_parts,
        "url_identity": _url_identity,
        "url_class": lambda s, d: table(s, d, "pages").select("page_id", urls.url_class(F.col("url")).alias("url_class"), urls.is_product_url(F.col("url")).alias("product_url")),
        "title_check": lambda s, d: checks.check(page(s, d), "title", "n_titles", "title_length", "title_status", "title_pixels", "title_fits", "title_duplicate_words", "title_has_brand", "title_power_words", of=(checks.title,)),
        "description_check": lambda s, d: checks.check(page(s, d), "description", "description_length", "description_status", "description_has_cta", of=(checks.description,)),
        "tag_counts": lambda s, d: op.tag_counts(page(s, d)),
        "headings": lambda s, d: checks.check(page(s, d), "h1", *[f"n_h{k}" for k in range(1, 7)], "hierarchy_ok", of=(checks.headings,)).withColumn("h1", F.array_join("h1", "|")),
        "image_stats": lambda s, d: checks.check(page(s, d), "n_images", "n_images_without_alt", "n_images_not_responsive", "n_image_names_undescriptive", of=(checks.images,)),
        "link_stats": lambda s, d: checks.check(page(s, d), "n_links", "enough_links", "n_internal", "n_external", "n_internal_nofollow", "n_unsafe_blank", "n_generic", "generic_ratio", "anchor_length", of=(checks.with_links,)),
        "social_tags": lambda s, d: checks.check(page(s, d), "has_open_graph", "has_twitter_cards", "has_share_buttons", "has_breadcrumbs", of=(checks.social,)),
        "markup_checks": lambda s, d: checks.check(page(s, d), "n_iframes", "n_scripts", "n_stylesheets", "n_strong", "n_inline_css", "has_flash", "nested_tables", "has_frames", "n_forms", "n_form_fields", of=(checks.markup,)),
        "content_stats": lambda s, d: checks.check(page(s, d), "n_words", "long_enough", "n_paragraphs", "lorem_ipsum", "has_cta", of=(checks.content,)),
        "content_structure": lambda s, d: checks.check(page(s, d), "n_paragraphs", "paragraph_words", "n_bullet_lists", "n_numbered_lists", "passive_ratio", "text_ratio", "flesch", "published", "modified", of=(checks.content, checks.dates)),
        "page_duplicates": lambda s, d: op.duplicate_content(page(s, d).select(F.col("page_id").alias("doc_id"), F.col("visible").alias("text"))),
        "technical_checks": lambda s, d: checks.check(page(s, d), "https", "html_lang", "charset", "has_charset", "has_doctype", "dom_size", "html_chars", "has_viewport", "has_canonical", "has_meta_robots", "mobile_responsive", "has_media_queries", "has_mixed_content", "is_amp", "has_analytics", "uses_webp", "has_meta_refresh", of=(checks.technical,)),
        "structured_data": lambda s, d: checks.check(page(s, d), "has_json_ld", "has_microdata", "has_schema", of=(checks.structured,)),
        "minification": lambda s, d: checks.check(page(s, d), "inline_scripts", "inline_styles", of=(checks.assets,)).select("page_id", F.col("inline_scripts")[0]["char_count"].alias("script_chars"), F.col("inline_scripts")[0]["is_minified"].alias("script_minified"), F.col("inline_styles")[0]["char_count"].alias("style_chars")),
        "page_scores": lambda s, d: checks.scores(page(s, d)),
        "page_types": lambda s, d: classify.classify(page(s, d)).select("page_id", "n_product_links", "n_nav_links", "n_articles", "is_homepage", "url_category", "has_search", "has_pagination", "page_type"),
        "page_jobs": lambda s, d: jobs.routed(classify.classify(page(s, d))),
        "page_intents": lambda s, d: jobs.intents(page(s, d)),
        "product_detail": lambda s, d: products.detail(page(s, d)).select("page_id", "title", "price", "sku"),
        "product_links": lambda s, d: products.listed(page(s, d)).select("page_id", F.size("links").alias("n_links")),
        "home_links": lambda s, d: products.discovered(page(s, d)),
        "robots_rules": lambda s, d: site.robots(responses(s, d)).select("origin", "robots_status", F.array_join("sitemaps", ",").alias("sitemaps"), F.array_join("disallowed", ",").alias("disallowed"), "closed_to_all", "closed_to_google"),
        "crawler_policies": lambda s, d: site.policies(responses(s, d)).select("origin", "url", F.array_join("agents", ",").alias("agents"), F.size("missing").alias("n_missing"), F.col("groups")[0]["training"].alias("training")),
        "response_checks": lambda s, d: site.response_checks(responses(s, d)).select("url", "status", "encoding", "server", F.array_join("networks", ",").alias("networks"), "is_cached"),
        "site_checks": lambda s, d: site.site_checks(responses(s, d)).select("origin", "has_sitemap", "sitemap_url", "custom_404"),
        "sitemap_entries": lambda s, d: _sitemap(s, d).select("source_sitemap", "loc", "lastmod", "priority", "position"),
        "sitemap_categories": lambda s, d: site.by_category(site.classified(_sitemap(s, d))).select("category", "n"),
        "frontier_lease": lambda s, d: _leased(s, d),
        "frontier_fail": lambda s, d: frontier.fail(frontier_table(s, d), frontier_table(s, d).where("priority = 5").select("url_id", F.lit("x").alias("error")), 1000.0).select("url_id", "status", "retries", "next_retry_at", "last_error"),
        "frontier_recover": lambda s, d: frontier.recover(frontier_table(s, d), 500.0)[1],
        "frontier_promote": lambda s, d: frontier.statuses(frontier.promote(frontier_table(s, d), 300.0)),
        "url_slugs": lambda s, d: table(s, d, "pages").select("page_id", urls.slug_quality(F.col("url")).alias("q")).select("page_id", "q.*"),
        "page_contents": lambda s, d: table(s, d, "pages").select("page_id", text_contents(F.col("html")).alias("c")).select("page_id", "c.title", "c.language"),
        "product_blocks": lambda s, d: blocks.product_lists(table(s, d, "pages")).select("page_id", "is_product_list", "confidence", "selector", "n_blocks", F.size("products").alias("n_products")),
        "page_paging": lambda s, d: blocks.paging(page(s, d)),
        "keyword_usage": _keywords,
        "related_terms": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(assets.related_terms(F.col("text"), ["data"]), ",").alias("terms")),
        "spelling": lambda s, d: assets.misspelled(table(s, d, "documents"), table(s, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))).select("doc_id", "n_misspelled", F.array_join("sample", ",").alias("sample")),
        "report_cards": _cards,
        "top_trigrams": lambda s, d: op.top_terms(table(s, d, "documents"), 3),
        "top_words": lambda s, d: op.top_terms(table(s, d, "documents")),
        "top_bigrams": lambda s, d: op.top_terms(table(s, d, "documents"), 2),
        "readability": lambda s, d: op.readability(table(s, d, "documents")),
        "intent_scores": lambda s, d: op.intents(table(s, d, "documents")),
        "price_and_email": _prices,
        "duplicate_content": lambda s, d: op.duplicate_content(table(s, d, "documents")),
        "runs_top50": lambda s, d: reports.recent_runs(run_log(s, d)).select("run_id", "domain", "status"),
        "reports_by_domain": lambda s, d: reports.find_reports(run_log(s, d), "SITE1").select("run_id", "domain"),
        "latest_run": lambda s, d: reports.latest_runs(run_log(s, d)).select("domain", "run_id", "status", "score"),
        "active_cache": lambda s, d: reports.active_cache(run_log(s, d), NOW).select("run_id", "domain"),
        "daily_status": lambda s, d: reports.daily_status(run_log(s, d)).withColumn("day", F.col("day").cast("string")),
        "price_comparison": lambda s, d: reports.price_comparison(table(s, d, "part"), "Brand#11").select("p_brand", "n_products", "badge"),
        "queue_order": lambda s, d: reports.queue_order(_frontier(s, d)).select("domain", "seq", "position"),
        "polite_starts": lambda s, d: reports.polite_starts(_frontier(s, d)).select("domain", "seq", "start"),
        "retry_backoff": _attempts,
    }


_RE = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?'"
_FR = "(SELECT 'site' || user_id AS domain, event_id AS seq, event_id % 10 AS priority, CAST(floor(epoch_us(ts) / 1e6) AS DOUBLE) AS arrival FROM events)"
_RUNS = "(SELECT event_id AS run_id, 'site' || user_id || '.example.com' AS domain, event_type AS status, ts AS started_at, value AS score FROM events)"
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS = rf"""list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'),
  lambda w: regexp_full_match(w, '[a-z0-9]+') AND length(w) >= LEAST AND w NOT IN ({_STOP}))"""
# Widths of characters, stated for the SQL on their own.
_PIXELS = """list_sum(list_transform(string_split(title, ''), lambda c: CASE WHEN c = ' ' THEN 3 WHEN c IN ('i', 'l') THEN 4 WHEN c = 'j' THEN 5
  WHEN c IN ('t', 'f', 'r', 'I') THEN 6 WHEN c IN ('J', '1', 's', 'z', 'a', 'c', 'e') THEN 7 WHEN c IN ('o', 'u', 'k', 'v', 'x', 'y') THEN 8
  WHEN c IN ('A', 'E', 'S', 'T', 'L', 'Z') THEN 9 WHEN c IN ('B', 'C', 'D', 'G', 'H', 'K', 'N', 'O', 'P', 'Q', 'R', 'U', 'V', 'X', 'Y') THEN 10
  WHEN c IN ('M', 'W') THEN 12 ELSE 9 END))"""
_MAP = "'https://maps.example.com/' || CASE page_id % 10 WHEN 1 THEN 'product-sitemap' WHEN 2 THEN 'category-sitemap' ELSE 'urls' END || (page_id % 10) || '.xml'"
_BODY = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style|nav|footer|title)\b.*?</(script|style|nav|footer|title)>', ' ', 'g'),
  '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g')"""


def _case(value: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, '{urls.any_of(p)}') THEN '{k}'" for k, p in urls.CLASSES.items()) + " ELSE 'other' END"


def _top(n: int) -> str:
    grams = "t" if n == 1 else f"list_transform(range(1, len(t) - {n - 2}), lambda i: {' || chr(32) || '.join(f't[i + {k}]' for k in range(n))})"
    return f"""SELECT doc_id, term, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM (
      SELECT doc_id, g[i] AS term, count(*) AS n, min(i) AS pos FROM (
        SELECT doc_id, g, unnest(range(1, len(g) + 1)) AS i FROM (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {_TOKENS.replace('LEAST', '4' if n == 1 else '3')} AS t FROM documents)))
      GROUP BY ALL)) WHERE rank <= 10"""


def _intent(name: str) -> str:
    parts = [rf"len(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[À-ÿ]', 'q', 'g'), '\b({p})\b')) * {w}" for w, ps in text.INTENTS[name].items() for p in ps]
    return f"{' + '.join(parts)} AS {name}"


def oracle_sql() -> dict[str, str]:
    part = lambda k: f"regexp_extract(url, {_RE}, {k})"
    host = rf"regexp_replace(regexp_replace(lower({part(2)}), '^.*@', ''), ':\d*$', '')"
    segs = f"list_filter(string_split({part(3)}, '/'), lambda x: x <> '')"
    normal = rf"""lower({part(1)}) || '://' || {host} || CASE WHEN {part(3)} = '' THEN '/' ELSE {part(3)} END ||
      CASE WHEN {part(4)} = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split({part(4)}, '&')), '&') END"""
    tags = r"unnest(list_transform(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|[^>]*</script>', '', 'g'), '<([a-z][a-z0-9]*)', 1), lambda x: x))"
    syllable = r"""CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(
      CASE WHEN lower(w) LIKE '%e' AND lower(w) NOT LIKE '%le' THEN lower(w)[:-2] ELSE lower(w) END, '[aeiouy]+'))) END"""
    prices = " + ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}'))" for p in text.PRICES)
    ranked = "greatest(transactional, commercial, informational, navigational)"
    primary = f"CASE WHEN {ranked} = 0 THEN 'informational' " + " ".join(f"WHEN {k} = {ranked} THEN '{k}'" for k in text.INTENTS) + " END"
    return {
        "url_parts": f"""SELECT page_id, lower({part(1)}) AS scheme, {host} AS host, {part(3)} AS path, {part(4)} AS query,
          CAST(len({segs}) AS INT) AS depth, length(url) <= 100 AND len({segs}) <= 4 AS seo_friendly FROM pages""",
        "url_identity": f"SELECT page_id, normalized, sha1(normalized) AS url_id FROM (SELECT page_id, {normal} AS normalized FROM pages)",
        "url_class": f"""SELECT page_id, CASE WHEN {_case("lower(strip_accents(url_decode(replace(url, '+', '%2B'))))")} <> 'other' OR regexp_matches(lower(url), '/author|/page/[0-9]+')
            THEN {_case("lower(strip_accents(url_decode(replace(url, '+', '%2B'))))")}
            WHEN shop = 0 THEN 'other' WHEN len(segs) - shop <= 2 THEN 'category'
            WHEN regexp_full_match(segs[-1], '[a-z0-9][a-z0-9-]+') AND NOT regexp_full_match(segs[-1], '[0-9]+') THEN 'product' ELSE 'other' END AS url_class,
          regexp_matches(lower(p), '{urls.any_of(urls.PRODUCT_URL)}') AND NOT regexp_matches(lower(p), '{urls.any_of(urls.NOT_PRODUCT_URL)}') AS product_url
          FROM (SELECT *, coalesce(list_min(list_filter(range(1, len(segs) + 1), lambda i: segs[i] IN ('shop', 'boutique', 'cat', 'produits'))), 0) AS shop FROM (
            SELECT *, {part(3)} || CASE WHEN {part(4)} <> '' THEN '?' || {part(4)} ELSE '' END AS p, list_transform({segs}, lambda x: lower(x)) AS segs FROM pages))""",
        "tag_counts": f"SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, {tags} AS tag FROM pages) GROUP BY ALL",
        "link_stats": r"""SELECT page_id, CAST(len(a) AS INT) AS n_links, len(a) >= 5 AS enough_links, CAST(len(a) AS INT) AS n_internal, CAST(0 AS INT) AS n_external,
          CAST(0 AS INT) AS n_internal_nofollow, CAST(0 AS INT) AS n_unsafe_blank,
          CAST(len(g) AS INT) AS n_generic, CASE WHEN len(t) > 0 THEN round(len(g) / len(t), 3) ELSE 0 END AS generic_ratio,
          CASE WHEN len(t) > 0 THEN round(list_sum(list_transform(t, lambda x: length(x))) / len(t), 2) ELSE 0 END AS anchor_length
          FROM (SELECT *, list_filter(a, lambda x: x <> '') AS t, list_filter(a, lambda x: lower(x) IN ('click here', 'read more', 'learn more', 'more', 'here',
            'this link', 'link', 'see more', 'details', 'view more', 'check this', 'visit')) AS g
            FROM (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1), lambda x: trim(replace(x, '&amp;', '&'))) AS a FROM pages))""",
        "title_check": rf"""SELECT page_id, title, CAST(1 AS INT) AS n_titles, CAST(length(title) AS INT) AS title_length,
          CASE WHEN title = '' THEN 'missing' WHEN length(title) < 20 THEN 'too_short' WHEN length(title) > 70 THEN 'too_long' ELSE 'good' END AS title_status,
          CAST({_PIXELS} AS INT) AS title_pixels, title <> '' AND {_PIXELS} <= 600 AS title_fits,
          CAST(len(list_filter(list_distinct(w), lambda x: length(x) > 2 AND len(list_filter(w, lambda y: y = x)) > 1)) AS INT) AS title_duplicate_words,
          contains(title, '|') OR contains(title, ' - ') AS title_has_brand,
          regexp_matches(lower(title), 'ultimate|proven|best|top|essential|secret|exclusive|easy|quick|simple|step-by-step|definitive|complete|powerful|effective|free|instant|guaranteed|new|now|today') AS title_power_words
          FROM (SELECT *, regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+') AS w
            FROM (SELECT page_id, trim(replace(regexp_extract(html, '<title>([^<]*)', 1), '&amp;', '&')) AS title FROM pages))""",
        "description_check": """SELECT page_id, '' AS description, CAST(0 AS INT) AS description_length, 'missing' AS description_status, false AS description_has_cta
          FROM pages WHERE NOT regexp_matches(lower(html), '<meta[^>]*name="?description')""",
        "headings": """SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1), lambda x: trim(replace(x, '&amp;', '&'))), '|') AS h1,
          """
        + ", ".join(f"CAST(len(regexp_extract_all(html, '<h{k}[ >]')) AS INT) AS n_h{k}" for k in range(1, 7))
        + """, true AS hierarchy_ok FROM pages""",
        "image_stats": """SELECT page_id, CAST(len(regexp_extract_all(html, '<img')) AS INT) AS n_images, CAST(len(regexp_extract_all(html, '<img')) AS INT) AS n_images_without_alt,
          CAST(len(regexp_extract_all(html, '<img')) AS INT) AS n_images_not_responsive, CAST(len(regexp_extract_all(html, '<img')) AS INT) AS n_image_names_undescriptive FROM pages""",
        "social_tags": """SELECT page_id, contains(html, 'property="og:') AS has_open_graph, contains(html, 'name="twitter:') AS has_twitter_cards,
          regexp_matches(html, 'class="[^"]*share') AS has_share_buttons, regexp_matches(html, 'class="[^"]*breadcrumb') AS has_breadcrumbs FROM pages""",
        "markup_checks": """SELECT page_id, """
        + ", ".join(
            f"CAST(len(regexp_extract_all(html, '{p}')) AS INT) AS {n}"
            for n, p in {"n_iframes": "<iframe", "n_scripts": "<script[^>]*src=", "n_stylesheets": "<link[^>]*stylesheet", "n_strong": "<(?:b|strong)>", "n_inline_css": "<[a-z]+ [^>]*style=", "n_forms": "<form"}.items()
        )
        + """, contains(html, 'shockwave') AS has_flash, contains(html, '<table') AS nested_tables, contains(html, '<frame') AS has_frames,
          CAST(0 AS BIGINT) AS n_form_fields FROM pages""",
        "technical_checks": """SELECT page_id, starts_with(url, 'https:') AS https, lower(regexp_extract(html, '<html lang="([^"]*)"', 1)) AS html_lang,
          regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset, contains(html, '<meta charset=') AS has_charset, starts_with(lower(html), '<!doctype') AS has_doctype,
          CAST(len(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|[^>]*</script>', '', 'g'), '<[a-z][a-z0-9]*')) AS INT) AS dom_size, CAST(length(html) AS INT) AS html_chars,
          contains(html, 'name="viewport"') AS has_viewport, contains(html, 'rel="canonical"') AS has_canonical, contains(html, 'name="robots"') AS has_meta_robots,
          contains(html, 'name="viewport"') AS mobile_responsive, contains(html, '@media') AS has_media_queries, contains(html, 'src="http://') AS has_mixed_content,
          contains(html, 'amphtml') AS is_amp, contains(html, 'gtag') AS has_analytics, contains(html, '.webp') AS uses_webp, contains(html, 'http-equiv="refresh"') AS has_meta_refresh FROM pages""",
        "structured_data": """SELECT page_id, contains(html, 'ld+json') AS has_json_ld, contains(html, 'itemscope') AS has_microdata, contains(lower(html), 'schema.org') AS has_schema FROM pages""",
        "minification": r"""SELECT page_id, CAST(length(s) AS INT) AS script_chars, length(s) > 500 AS script_minified, CAST(length(c) AS INT) AS style_chars
          FROM (SELECT page_id, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS s, regexp_extract(html, '(?s)<style>(.*?)</style>', 1) AS c FROM pages)""",
        "product_links": """SELECT page_id, CAST(len(list_distinct(list_filter(regexp_extract_all(html, '<a href="(/[^"]*)"', 1),
          lambda x: regexp_matches(lower(x), '/products?/|/produits?/|/shop/[^/]+|/items?/|/p/[^/]+|/catalogue/')))) AS INT) AS n_links FROM pages""",
        "home_links": rf"""SELECT DISTINCT page_id, link, {_case('lower(strip_accents(link))')} AS category
          FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS link FROM pages)""",
        "robots_rules": """SELECT 'https://shop' || c_custkey || '.example.com' AS origin, CASE WHEN c_custkey % 4 = 3 THEN 'not_found' ELSE 'found' END AS robots_status,
          CASE WHEN c_custkey % 4 = 2 THEN 'https://shop' || c_custkey || '.example.com/map.xml' ELSE '' END AS sitemaps,
          CASE c_custkey % 4 WHEN 3 THEN '' WHEN 0 THEN '/cart/' || c_custkey || ',/' ELSE '/cart/' || c_custkey END AS disallowed,
          c_custkey % 4 = 0 AS closed_to_all, false AS closed_to_google FROM customer""",
        "crawler_policies": """SELECT 'https://shop' || c_custkey || '.example.com' AS origin, 'https://shop' || c_custkey || '.example.com/ai.txt' AS url, 'GPTBot,CCBot' AS agents,
          CAST(8 AS INT) AS n_missing, 'deny' AS training FROM customer WHERE c_custkey % 2 = 0""",
        "response_checks": """SELECT 'https://shop' || c_custkey || '.example.com' || p AS url, CAST(CASE WHEN p = '/robots.txt' AND c_custkey % 4 = 3 OR p = '/ai.txt' AND c_custkey % 2 = 1 THEN 404 ELSE 200 END AS INT) AS status,
          'gzip' AS encoding, CASE WHEN c_custkey % 4 = 1 THEN 'cloudflare' ELSE 'nginx' END AS server, CASE WHEN c_custkey % 4 = 1 THEN 'Cloudflare' ELSE '' END AS networks,
          c_custkey % 4 = 2 AS is_cached FROM customer, (SELECT unnest(['/robots.txt', '/map.xml', '/ai.txt']) AS p)""",
        "site_checks": """SELECT 'https://shop' || c_custkey || '.example.com' AS origin, c_custkey % 4 = 2 AS has_sitemap,
          CASE WHEN c_custkey % 4 = 2 THEN 'https://shop' || c_custkey || '.example.com/map.xml' END AS sitemap_url, false AS custom_404 FROM customer""",
        "sitemap_entries": f"""SELECT {_MAP} AS source_sitemap, url AS loc, '2024-01-0' || (page_id % 10 % 9 + 1) AS lastmod, CAST('0.' || (page_id % 10) AS DOUBLE) AS priority,
          CAST(row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) - 1 AS INT) AS position FROM pages""",
        "sitemap_categories": f"""SELECT category, count(*) AS n FROM (SELECT CASE page_id % 10 WHEN 1 THEN 'product' WHEN 2 THEN 'category' ELSE {_case('lower(strip_accents(url))')} END AS category FROM pages)
          GROUP BY category""",
        "frontier_lease": """SELECT domain, url_id FROM (SELECT 'site' || user_id || '.example.com' AS domain, CAST(event_id AS VARCHAR) AS url_id, row_number() OVER (PARTITION BY user_id
            ORDER BY event_id % 10 > 3, CASE WHEN event_id % 10 <= 3 THEN -event_id ELSE event_id END) AS r FROM events WHERE event_id % 4 = 0)
          WHERE r = 1 AND domain <> 'site1.example.com'""",
        "frontier_fail": """SELECT CAST(event_id AS VARCHAR) AS url_id, CASE WHEN NOT hit THEN status WHEN tries > 3 THEN 'failed' ELSE 'retry_scheduled' END AS status,
          CAST(CASE WHEN hit THEN tries ELSE tries - 1 END AS INT) AS retries,
          CASE WHEN hit AND tries <= 3 THEN 1000 + least(300, 30 * pow(2, tries - 1)) WHEN NOT hit AND event_id % 4 = 2 THEN CAST(event_id AS DOUBLE) END AS next_retry_at,
          CASE WHEN hit THEN 'x' END AS last_error
          FROM (SELECT event_id, event_id % 5 + 1 AS tries, event_id % 4 = 1 AND event_id % 10 = 5 AS hit, ['queued', 'inflight', 'retry_scheduled', 'completed'][event_id % 4 + 1] AS status FROM events)""",
        "frontier_recover": """SELECT CAST(count_if(event_id % 5 < 3) AS BIGINT) AS requeued, CAST(count_if(event_id % 5 >= 3) AS BIGINT) AS failed
          FROM (SELECT event_id FROM events WHERE event_id % 4 = 1 AND event_id <= 500 ORDER BY event_id, CAST(event_id AS VARCHAR) LIMIT 100)""",
        "frontier_promote": """SELECT 'site' || user_id || '.example.com' AS domain, CASE WHEN event_id % 4 = 2 AND event_id IN (SELECT event_id FROM events WHERE event_id % 4 = 2 AND event_id <= 300
            ORDER BY event_id LIMIT 100) THEN 'queued' ELSE ['queued', 'inflight', 'retry_scheduled', 'completed'][event_id % 4 + 1] END AS status, count(*) AS n FROM events GROUP BY ALL""",
        "url_slugs": rf"""SELECT page_id, slug, contains(slug, '-') AS has_hyphens, regexp_matches(slug, '[^a-zA-Z0-9-]') AS special_chars, false AS has_keyword,
          CAST(len(list_filter(regexp_extract_all(lower(slug), '[a-z0-9]+'), lambda w: w IN ({_STOP}))) AS INT) AS n_stopwords,
          trim(regexp_replace(lower(slug), '[^a-z0-9]+', '-', 'g'), '-') AS normalized FROM (SELECT page_id, coalesce({segs}[-1], '') AS slug FROM pages)""",
        "page_contents": """SELECT page_id, CASE WHEN h1 <> '' THEN h1 ELSE t END AS title, lang AS language FROM (SELECT page_id, trim(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')) AS h1,
          trim(replace(regexp_extract(html, '<title>([^<]*)', 1), '&amp;', '&')) AS t, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages)""",
        "keyword_usage": rf"""SELECT doc_id, keyword, CAST(n AS INT) AS n, round(n / greatest(w, 1) * 100, 2) AS percent, array_to_string(list_sort(list_distinct(list_filter(t, lambda x:
            regexp_replace(x, CASE WHEN x LIKE '%ing' AND length(x) > 5 THEN 'ing$' WHEN x LIKE '%edly' AND length(x) > 6 THEN 'edly$' WHEN x LIKE '%ed' AND length(x) > 4 THEN 'ed$'
              WHEN x LIKE '%ly' AND length(x) > 4 THEN 'ly$' WHEN x LIKE '%s' AND length(x) > 3 THEN 's$' ELSE '$' END, '') = split_part(keyword, ' ', 1) AND x <> keyword)))[1:8], ',') AS variants
          FROM (SELECT doc_id, keyword, (length(low) - length(replace(low, keyword, ''))) // length(keyword) AS n, t, len(list_filter(regexp_extract_all(low, '[\p{{L}}\p{{N}}_]+'),
            lambda x: regexp_full_match(x, '[a-z0-9]+'))) AS w FROM (SELECT doc_id, unnest(['data', 'the report']) AS keyword, lower(coalesce(text, '')) AS low, {_TOKENS.replace('LEAST', '4')} AS t FROM documents))""",
        "related_terms": f"""SELECT doc_id, coalesce(array_to_string(terms, ','), '') AS terms FROM documents LEFT JOIN (
          SELECT doc_id, list(term ORDER BY rank) AS terms FROM ({_top(1).replace("rank <= 10", "rank <= 20").replace("AS t FROM documents", "AS t0 FROM documents").replace("SELECT doc_id, t AS g", "SELECT doc_id, list_filter(t0, lambda w: w <> 'data') AS g")})
          GROUP BY doc_id) USING (doc_id)""",
        "spelling": r"""WITH known AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
          words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[ß-ÿ]', '1', 'g'), '\b[a-z]{3,}\b')) AS word FROM documents)
          SELECT doc_id, coalesce(n, 0) AS n_misspelled, coalesce(array_to_string(w[1:20], ','), '') AS sample FROM documents LEFT JOIN (
            SELECT doc_id, count(*) AS n, list(word ORDER BY word) AS w FROM words WHERE word NOT IN (SELECT word FROM known) GROUP BY doc_id) USING (doc_id)""",
        "report_cards": """WITH b AS (SELECT p_brand AS brand, round(avg(p_retailprice), 2) AS price, count(*) AS n FROM part GROUP BY 1)
          SELECT brand AS id, n AS product_count, 'N/A' AS performance_score, CAST((SELECT count(*) - 1 FROM b) AS INT) AS competitor_count, printf('%.2f', price) AS avg_price,
            CAST(least(6, (SELECT count(*) FROM b)) AS INT) AS n_bars, (SELECT min(x.brand) FROM b AS x WHERE x.brand <> b.brand) AS second_bar,
            CAST((SELECT count(*) FROM b AS x WHERE x.brand <> b.brand AND x.price < b.price) AS INT) AS n_cheaper, CAST(2 AS INT) AS n_lines FROM b""",
        "top_trigrams": _top(3),
        "top_words": _top(1),
        "top_bigrams": _top(2),
        "readability": rf"""SELECT doc_id, n_words, n_sentences, n_syllables, CASE WHEN n_words >= 100 AND n_sentences >= 3
            THEN 206.835::DOUBLE - 1.015::DOUBLE * n_words / n_sentences - 84.6::DOUBLE * n_syllables / n_words END AS flesch FROM (
          SELECT doc_id, len(ws) AS n_words, len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda x: regexp_matches(x, '[A-Za-z]'))) AS n_sentences,
            CAST(coalesce(list_sum(list_transform(ws, lambda w: {syllable})), 0) AS BIGINT) AS n_syllables
          FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS ws FROM documents))""",
        "intent_scores": f"SELECT *, {primary} AS primary_intent FROM (SELECT doc_id, {', '.join(map(_intent, text.INTENTS))} FROM documents)",
        "price_and_email": f"SELECT doc_id, {prices} AS n_prices, len(regexp_extract_all(coalesce(text, ''), '{text.EMAIL}')) AS n_emails FROM documents",
        "duplicate_content": """SELECT md5(substr(text, 1, 1500)) AS content_hash, count(*) AS n_docs, min(doc_id) AS first_doc
          FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
        "runs_top50": f"SELECT run_id, domain, status FROM {_RUNS} ORDER BY started_at DESC, run_id DESC LIMIT 50",
        "reports_by_domain": f"SELECT run_id, domain FROM {_RUNS} WHERE domain ILIKE '%SITE1%'",
        "latest_run": f"""SELECT domain, run_id, status, score FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY started_at DESC, run_id DESC) AS r
          FROM {_RUNS}) WHERE r = 1""",
        "active_cache": f"SELECT run_id, domain FROM {_RUNS} WHERE started_at + INTERVAL 24 HOURS > TIMESTAMP '{NOW}'",
        "daily_status": f"SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, status, count(*) AS n FROM {_RUNS} GROUP BY ALL",
        "price_comparison": """WITH b AS (SELECT p_brand, avg(p_retailprice) AS a, count(*) AS n_products FROM part GROUP BY 1)
          SELECT b.p_brand, b.n_products, CASE WHEN b.a < t.a THEN 'Cheaper' ELSE 'More Expensive' END AS badge
          FROM b, b AS t WHERE t.p_brand = 'Brand#11' AND b.p_brand <> 'Brand#11'""",
        "queue_order": f"""SELECT domain, seq, CAST(row_number() OVER (PARTITION BY domain ORDER BY priority > 3,
          CASE WHEN priority <= 3 THEN -seq ELSE seq END) AS INT) AS position FROM {_FR}""",
        "polite_starts": f"""SELECT domain, seq, 2.0::DOUBLE * k + max(arrival - 2.0::DOUBLE * k) OVER (PARTITION BY domain ORDER BY k) AS start
          FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY arrival, seq) - 1 AS k FROM {_FR})""",
        "retry_backoff": f"""SELECT domain, attempts, attempts > 3 AS dead,
          CASE WHEN attempts <= 3 THEN least(300.0::DOUBLE, 30.0::DOUBLE * pow(2, attempts - 1)) END AS delay
          FROM (SELECT domain, count(*) AS attempts FROM {_RUNS} WHERE status = 'error' GROUP BY 1)""",
        "content_stats": rf"""SELECT page_id, CAST(len(regexp_extract_all({_BODY}, '[\p{{L}}\p{{N}}_]+')) + len(regexp_extract_all(regexp_replace(
          regexp_extract(html, '<title>([^<]*)', 1), '&[a-z]+;', ' ', 'g'), '[\p{{L}}\p{{N}}_]+')) AS INT) AS n_words, n_words >= 300 AS long_enough,
          CAST(len(regexp_extract_all(html, '<p>')) AS INT) AS n_paragraphs, contains(lower({_BODY}), 'lorem ipsum') AS lorem_ipsum,
          regexp_matches(lower({_BODY}),
            'learn more|read more|buy now|shop now|get started|try now|sign up|contact us|book now|download|discover|find out|see how|start now|join now|request a quote|subscribe') AS has_cta FROM pages""",
    }
