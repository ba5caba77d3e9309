"""All checks of a page as columns of its parsed row, so that one pass over a page makes them all, without a join.

Each group is a dict of name -> column over the columns of parsed_pages().  What a stored page can't tell (headers,
probes, files of the site) comes from a ``response`` struct column where the table has one, and is null otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom, text, urls
from .pages import CTA_PHRASES, POWER_WORDS, pixels

# Limits, generic link texts, elements out of use, widths and formats.
TITLE_CHARS, TITLE_PIXELS = (20, 70), 600
DESCRIPTION_CHARS, DESCRIPTION_PIXELS = (70, 160), 680
MIN_WORDS, MIN_LINKS = 300, 5
GENERIC_ANCHORS = ["click here", "read more", "learn more", "more", "here", "this link", "link", "see more", "details", "view more", "check this", "visit"]
DEPRECATED = [
    "applet", "acronym", "bgsound", "dir", "frame", "frameset", "noframes", "isindex", "listing", "xmp", "nextid", "plaintext", "rb", "rtc",
    "strike", "basefont", "big", "blink", "center", "font", "marquee", "multicol", "nobr", "spacer", "tt",
]
SHARE_LINKS = ["facebook.com/sharer", "twitter.com/intent", "linkedin.com/share", "wa.me/", "api.whatsapp.com", "t.me/share"]
FIXED_WIDTH_TAGS, WIDEST = ["body", "div", "main", "article", "section", "table"], 380
MIXED = {"img": "src", "script": "src", "link": "href", "iframe": "src", "video": "src", "audio": "src", "source": "src"}
ANALYTICS = {
    "ga_object": r"window\.ga\s*=\s*window\.ga\s*\|\|\s*function\(\)",
    "ga_function": r"ga\s*\(\s*['\"]create['\"]\s*,",
    "gtag_config": r"gtag\s*\(\s*['\"]config['\"]\s*,\s*['\"](G|UA|AW)-",
    "gtag_js": r"https://www.googletagmanager.com/gtag/js\?id=(G|UA|AW)-",
}
FLASH = ("application/x-shockwave-flash", "clsid:d27cdb6e-ae6d-11cf-96b8-444553540000")


def _nodes() -> Column:
    return F.col("nodes")


def _attr(n: Column, name: str) -> Column:
    return n["attrs"][name]


def _has(n: Column, name: str) -> Column:
    return F.map_contains_key(n["attrs"], name)


def _first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def _no(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def _any(value: Column, phrases: list[str]) -> Column:
    return F.lower(F.coalesce(value, F.lit(""))).rlike("|".join(phrases))


def _contains(value: Column, keyword: str | None) -> Column:
    return _no(F.contains(F.lower(value), F.lit(keyword.lower()))) if keyword else F.lit(False)


def _status(n: Column, least: int, most: int) -> Column:
    return F.when(n == 0, "missing").when(n < least, "too_short").when(n > most, "too_long").otherwise("good")


def title(keyword: str | None = None) -> dict[str, Column]:
    value = F.trim(F.coalesce(dom.first_text(_nodes(), "title"), F.lit("")))
    words = F.array_sort(F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    again = F.filter(F.array_distinct(words), lambda w: (F.length(w) > 2) & (F.size(F.filter(words, lambda x: x == w)) > 1))
    n = F.length(value)
    return {
        "title": value,
        "n_titles": dom.count_of(_nodes(), "title"),
        "title_length": n,
        "title_status": _status(n, *TITLE_CHARS),
        "title_pixels": pixels(value),
        "title_fits": (n > 0) & (pixels(value) <= TITLE_PIXELS),
        "title_duplicate_words": F.size(again),
        "title_has_brand": F.contains(value, F.lit("|")) | F.contains(value, F.lit(" - ")),
        "title_power_words": _any(value, POWER_WORDS),
        "title_has_keyword": _contains(value, keyword),
        "title_keyword_near_start": F.instr(F.lower(value), keyword.lower()).between(1, 21) if keyword else F.lit(False),
    }


def description(keyword: str | None = None) -> dict[str, Column]:
    found = F.filter(dom.by_tag(_nodes(), "meta"), lambda n: F.lower(_attr(n, "name")) == "description")
    value = F.trim(F.coalesce(_attr(_first(found), "content"), F.lit("")))
    n = F.length(value)
    return {
        "description": value,
        "n_descriptions": F.size(found),
        "description_length": n,
        "description_status": _status(n, *DESCRIPTION_CHARS),
        "description_pixels": pixels(value),
        "description_fits": (n > 0) & (pixels(value) <= DESCRIPTION_PIXELS),
        "description_has_cta": _any(value, CTA_PHRASES),
        "description_has_keyword": _contains(value, keyword),
    }


def headings(keyword: str | None = None) -> dict[str, Column]:
    counts = {f"n_h{k}": dom.count_of(_nodes(), f"h{k}") for k in range(1, 7)}
    used = F.filter(F.array(*[F.when(counts[f"n_h{k}"] > 0, k) for k in range(1, 7)]), lambda x: x.isNotNull())
    steps = F.zip_with(used, F.slice(used, 2, 6), lambda a, b: b - a)
    below = F.filter(_nodes(), lambda n: n["tag"].isin("h2", "h3", "h4", "h5", "h6") & _contains(n["text"], keyword))
    texts = {f"h{k}": F.transform(dom.by_tag(_nodes(), f"h{k}"), lambda n: n["text"]) for k in range(1, 7)}
    return {
        **counts,
        **texts,
        "hierarchy_ok": ~_no(F.exists(steps, lambda s: s > 1)),
        "h1_has_keyword": F.exists(dom.by_tag(_nodes(), "h1"), lambda n: _contains(n["text"], keyword)),
        "n_subheadings_with_keyword": F.size(below),
    }


def _inline(src: Column) -> Column:
    return src.startswith("data:") | src.startswith("blob:")


def images(keyword: str | None = None) -> dict[str, Column]:
    every = dom.by_tag(_nodes(), "img")
    src = lambda n: F.coalesce(_attr(n, "src"), F.lit("N/A"))
    no_alt = F.filter(every, lambda n: (F.trim(F.coalesce(_attr(n, "alt"), F.lit(""))) == "") & ~_inline(src(n)))
    style = lambda n: F.lower(F.coalesce(_attr(n, "style"), F.lit("")))
    fixed = F.filter(every, lambda n: ~_has(n, "srcset") & (dom.within(n, "picture") == 0) & ~style(n).rlike("max-width|width: 100%|height: auto"))

    def undescriptive(n: Column) -> Column:
        at = F.trim(F.coalesce(_attr(n, "src"), F.lit("")))
        name = F.lower(F.regexp_replace(F.substring_index(F.substring_index(at, "/", -1), "?", 1), r"\.[a-zA-Z0-9]+$", ""))
        return (at != "") & ~_inline(at) & (name.rlike(r"^(img|image|photo|pic|dsc)[-_]?\d{2,}$") | (F.length(name) <= 3))

    return {
        "n_images": F.size(every),
        "images_without_alt": F.transform(no_alt, src),
        "n_images_without_alt": F.size(no_alt),
        "n_images_not_responsive": F.size(fixed),
        "n_images_with_keyword": F.size(F.filter(every, lambda n: _contains(_attr(n, "alt"), keyword))),
        "n_image_names_undescriptive": F.size(F.filter(every, undescriptive)),
        "images_to_probe": F.transform(F.filter(F.slice(every, 1, 10), lambda n: (src(n) != "N/A") & (src(n) != "") & ~_inline(src(n))), lambda n: urls.resolve(F.col("url"), src(n))),
    }


def page_links() -> Column:
    """The page's links as structs: url, anchor, rel, target, internal; internal ones are on the page's host and port."""
    usable = F.filter(dom.by_tag(_nodes(), "a"), lambda n: _no((_attr(n, "href") != "") & ~_attr(n, "href").rlike("^(#|mailto:|tel:|javascript:)")))

    def one(n: Column) -> Column:
        at = urls.resolve(F.col("url"), _attr(n, "href"))
        return F.struct(
            at.alias("url"), F.coalesce(n["text"], F.lit("")).alias("anchor"), F.coalesce(_attr(n, "rel"), F.lit("")).alias("rel"),
            F.coalesce(_attr(n, "target"), F.lit("")).alias("target"), (urls.netloc(at) == urls.netloc(F.col("url"))).alias("internal"),
        )

    return F.transform(usable, one)


def links(every: Column) -> dict[str, Column]:
    """Checks over what page_links() gives, which the caller puts into a column once."""
    inside = F.filter(every, lambda x: x["internal"])
    outside = F.filter(every, lambda x: ~x["internal"])
    named = F.filter(every, lambda x: x["anchor"] != "")
    generic = F.size(F.filter(named, lambda x: F.lower(F.trim(x["anchor"])).isin(*GENERIC_ANCHORS)))
    n = F.size(named)
    return {
        "n_links": F.size(every),
        "enough_links": F.size(every) >= MIN_LINKS,
        "n_internal": F.size(inside),
        "n_external": F.size(outside),
        "all_links": F.concat(F.transform(inside, lambda x: x["url"]), F.transform(outside, lambda x: x["url"])),
        "n_internal_nofollow": F.size(F.filter(inside, lambda x: dom.has_token(x["rel"], "nofollow"))),
        "n_unsafe_blank": F.size(F.filter(outside, lambda x: (x["target"] == "_blank") & ~dom.has_token(x["rel"], "noopener") & ~dom.has_token(x["rel"], "noreferrer"))),
        "anchor_length": F.when(n > 0, F.round(dom.sum_of(F.transform(named, lambda x: F.length(x["anchor"]).cast("bigint"))) / n, 2)).otherwise(0.0),
        "n_generic": generic,
        "generic_ratio": F.when(n > 0, F.round(generic / n, 3)).otherwise(0.0),
        "descriptive_ratio": F.when(n > 0, F.round(1 - generic / n, 3)).otherwise(0.0),
    }


def _meta_map(key: str, prefix: str) -> Column:
    """The contents of meta elements by name, the last of a name."""
    found = F.filter(dom.by_tag(_nodes(), "meta"), lambda n: _no(F.lower(_attr(n, key)).startswith(prefix) & (_attr(n, "content") != "")))
    last = F.filter(found, lambda n, i: ~F.exists(F.slice(found, i + 2, F.size(found) + 1), lambda m: _attr(m, key) == _attr(n, key)))
    return F.map_from_entries(F.transform(last, lambda n: F.struct(_attr(n, key), _attr(n, "content"))))


def social() -> dict[str, Column]:
    og, cards = _meta_map("property", "og:"), _meta_map("name", "twitter:")
    hrefs = F.transform(dom.by_tag(_nodes(), "a"), lambda n: _attr(n, "href"))
    return {
        "open_graph": og,
        "has_open_graph": F.size(og) > 0,
        "twitter_cards": cards,
        "has_twitter_cards": F.size(cards) > 0,
        "has_share_buttons": F.exists(hrefs, lambda h: _no(h.rlike("|".join(x.replace(".", r"\.") for x in SHARE_LINKS))))
        | F.exists(_nodes(), lambda n: _no(F.contains(F.lower(_attr(n, "class")), F.lit("share")))),
        "has_breadcrumbs": F.exists(_nodes(), lambda n: _no(_attr(n, "itemtype").rlike("(?i)schema.org/BreadcrumbList")) | _no(_attr(n, "class").rlike("(?i)breadcrumb"))),
    }


def markup() -> dict[str, Column]:
    nodes = _nodes()
    icon = _first(F.filter(dom.by_tag(nodes, "link"), lambda n: _no(_attr(n, "rel").rlike("(?i)apple-touch-icon"))))
    old = F.filter(F.transform(F.array(*map(F.lit, DEPRECATED)), lambda t: F.struct(t.alias("tag"), F.size(F.filter(nodes, lambda n: n["tag"] == t)).alias("n"))), lambda x: x["n"] > 0)
    flash = lambda n: _no(n["tag"].isin("object", "embed") & F.contains(F.lower(_attr(n, "type")), F.lit(FLASH[0]))) | _no((n["tag"] == "object") & F.contains(F.lower(_attr(n, "classid")), F.lit(FLASH[1])))
    return {
        "n_iframes": dom.count_of(nodes, "iframe"),
        "apple_touch_icon": F.when(_attr(icon, "href") != "", urls.resolve(F.col("url"), _attr(icon, "href"))),
        "n_scripts": F.size(F.filter(dom.by_tag(nodes, "script"), lambda n: _has(n, "src"))),
        "n_stylesheets": F.size(F.filter(dom.by_tag(nodes, "link"), lambda n: dom.has_token(_attr(n, "rel"), "stylesheet") & _has(n, "href"))),
        "n_strong": dom.count_of(nodes, "strong", "b"),
        "n_inline_css": F.size(F.filter(nodes, lambda n: _has(n, "style"))),
        "deprecated_tags": F.map_from_entries(old),
        "has_flash": F.exists(nodes, flash),
        "nested_tables": F.exists(nodes, lambda n: (n["tag"] == "table") & F.array_contains(n["anc"], "table")),
        "has_frames": F.exists(nodes, lambda n: n["tag"].isin("frameset", "frame")),
        "n_forms": dom.count_of(nodes, "form"),
        "n_form_fields": dom.sum_of(F.transform(dom.by_tag(nodes, "input", "select", "textarea"), lambda n: dom.within(n, "form").cast("bigint"))),
    }


def dates() -> dict[str, Column]:
    """The first published and modified dates that meta and time elements give, in the order of the kinds."""
    nodes = _nodes()

    def said(tag: str, test, key: str) -> Column:
        value = lambda n: F.coalesce(F.nullif(_attr(n, key), F.lit("")), F.nullif(n["text"], F.lit("")))
        found = F.filter(dom.by_tag(nodes, tag), lambda n: _no(test(n)))
        return _first(F.filter(F.transform(found, value), lambda v: v.isNotNull()))

    def first(*tests) -> Column:
        return F.coalesce(*[said(*t) for t in tests])

    return {
        "published": first(
            ("meta", lambda n: _attr(n, "property") == "article:published_time", "content"),
            ("time", lambda n: _attr(n, "itemprop").rlike("(?i)datePublished|dateCreated"), "datetime"),
        ),
        "modified": first(
            ("meta", lambda n: _attr(n, "property") == "article:modified_time", "content"),
            ("time", lambda n: _attr(n, "itemprop").rlike("(?i)dateModified"), "datetime"),
        ),
    }


def content() -> dict[str, Column]:
    visible = F.coalesce(F.col("visible"), F.lit(""))
    n = F.regexp_count(visible, F.lit(r"[\p{L}\p{N}_]+"))
    paragraphs = dom.by_tag(_nodes(), "p")
    words = F.transform(paragraphs, lambda p: F.size(F.filter(F.split(p["text"], r"\s+"), lambda x: x != "")).cast("bigint"))
    reading, ratio = text.flesch(visible), text.text_html_ratio(visible, F.col("html"))
    return {
        "n_words": n,
        "long_enough": n >= MIN_WORDS,
        "n_paragraphs": F.size(paragraphs),
        "paragraph_words": F.when(F.size(paragraphs) > 0, F.round(dom.sum_of(words) / F.size(paragraphs), 2)).otherwise(0.0),
        "n_bullet_lists": dom.count_of(_nodes(), "ul"),
        "n_numbered_lists": dom.count_of(_nodes(), "ol"),
        "passive_ratio": text.passive_ratio(visible),
        "has_cta": _any(visible, CTA_PHRASES),
        "lorem_ipsum": F.contains(F.lower(visible), F.lit("lorem ipsum")),
        "flesch": reading,
        "text_ratio": ratio,
        "has_common_words": F.exists(text.plain_tokens(visible, 4), lambda w: w.isNotNull()),
        "sample": F.substring(visible, 1, 1500),
    }


def placement(keywords: list[str]) -> dict[str, Column]:
    """Where the target keywords stand in the visible text; the first one is the primary one."""
    visible, first = F.lower(F.coalesce(F.col("visible"), F.lit(""))), dom.first_text(_nodes(), "p")
    low = [k.lower() for k in keywords]
    found = F.array_compact(F.array(*[F.when(F.contains(visible, F.lit(k)), F.lit(k)) for k in low[1:]])) if low[1:] else F.array().cast("array<string>")
    return {
        "n_keyword": (F.length(visible) - F.length(F.replace(visible, F.lit(low[0]), F.lit("")))) / len(low[0]) if low else F.lit(0.0),
        "keyword_in_first_paragraph": _contains(first, low[0] if low else None),
        "secondary_found": found,
        "first_paragraph": F.substring(first, 1, 240),
    }


def _origin() -> Column:
    return F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.netloc(F.col("url")))


def technical() -> dict[str, Column]:
    nodes, html = _nodes(), F.col("html")
    root = _attr(_first(dom.by_tag(nodes, "html")), "lang")
    metas, link = dom.by_tag(nodes, "meta"), dom.by_tag(nodes, "link")
    declared = _attr(_first(F.filter(metas, lambda n: _has(n, "charset"))), "charset")
    typed = _attr(_first(F.filter(metas, lambda n: _no(_attr(n, "http-equiv").rlike("(?i)content-type")))), "content")
    charset = F.coalesce(declared, F.when(F.contains(F.lower(typed), F.lit("charset=")), F.trim(F.substring_index(typed, "charset=", -1))))
    canonical = _attr(_first(F.filter(link, lambda n: dom.has_token(_attr(n, "rel"), "canonical") & _has(n, "href"))), "href")
    amp = _attr(_first(F.filter(link, lambda n: dom.has_token(_attr(n, "rel"), "amphtml") & _has(n, "href"))), "href")
    robots = _first(F.filter(metas, lambda n: _no(_attr(n, "name").rlike("(?i)robots"))))
    robots_text = F.when(robots.isNotNull(), F.lower(F.coalesce(_attr(robots, "content"), F.lit(""))))
    viewport = _first(F.filter(metas, lambda n: _attr(n, "name") == "viewport"))
    refresh = _first(F.filter(metas, lambda n: _no(_attr(n, "http-equiv").rlike("(?i)refresh"))))
    wide = F.filter(dom.by_tag(nodes, *FIXED_WIDTH_TAGS), lambda n: _no(F.regexp_extract(_attr(n, "style"), r"width\s*:\s*(\d{3,})px", 1).try_cast("bigint") > WIDEST))
    plain = F.filter(nodes, _is_mixed)
    https = urls.scheme(F.col("url")) == "https"
    source = dom.by_tag(nodes, "source")
    uses = lambda kind: F.exists(source, lambda n: (dom.within(n, "picture") > 0) & _no(_attr(n, "type") == f"image/{kind}")) | F.exists(dom.by_tag(nodes, "img"), lambda n: _no(F.contains(F.lower(_attr(n, "src")), F.lit(f".{kind}"))))
    linked = F.filter(link, lambda n: _no(_attr(n, "href") != ""))
    icons = [F.filter(linked, lambda n: dom.has_token(_attr(n, "rel"), "icon")), F.filter(linked, lambda n: _no(F.contains(_attr(n, "rel"), F.lit("icon")))), F.filter(linked, lambda n: _attr(n, "href") == "/favicon.ico")]
    icon = F.coalesce(*[_attr(_first(x), "href") for x in icons])
    mail = text.emails(html)
    styles = F.filter(nodes, lambda n: n["tag"] == "style")
    return {
        "https": https,
        "html_lang": F.lower(root),
        "charset": charset,
        "has_charset": charset.isNotNull(),
        "has_doctype": F.col("doctype").isNotNull(),
        "dom_size": F.size(nodes),
        "html_chars": F.length(html),
        "has_viewport": viewport.isNotNull(),
        "viewport": _attr(viewport, "content"),
        "is_amp": amp.isNotNull() | F.exists(dom.by_tag(nodes, "html"), lambda n: _has(n, "amp") | _has(n, "⚡")),
        "canonical": F.when(canonical.isNotNull(), urls.resolve(F.col("url"), canonical)),
        "has_canonical": canonical.isNotNull(),
        "meta_robots": robots_text,
        "has_meta_robots": robots.isNotNull(),
        "noindex": _no(F.contains(robots_text, F.lit("noindex"))),
        "nofollow": _no(F.contains(robots_text, F.lit("nofollow"))),
        "meta_refresh": _attr(refresh, "content"),
        "has_meta_refresh": refresh.isNotNull(),
        "n_fixed_widths": F.size(wide),
        "mobile_responsive": viewport.isNotNull() & (F.size(wide) == 0),
        "has_media_queries": F.exists(styles, lambda n: _no(F.contains(n["text"], F.lit("@media")))),
        "has_mixed_content": https & (F.size(plain) > 0),
        "emails": mail,
        "has_emails": F.size(mail) > 0,
        "uses_webp": uses("webp"),
        "uses_avif": uses("avif"),
        "favicon": F.when(icon.isNotNull(), urls.resolve(_origin(), icon)),
        **{k: html.rlike(p) for k, p in ANALYTICS.items()},
        "has_analytics": html.rlike("|".join(f"(?:{p})" for p in ANALYTICS.values())),
    }


def assets() -> dict[str, Column]:
    """What a page refers to, by absolute URL, and how tight its own scripts and styles are."""
    nodes = _nodes()
    link = dom.by_tag(nodes, "link")
    styles = F.filter(nodes, lambda n: n["tag"] == "style")
    https = urls.scheme(F.col("url")) == "https"
    amp = _attr(_first(F.filter(link, lambda n: dom.has_token(_attr(n, "rel"), "amphtml") & _has(n, "href"))), "href")
    langs = F.filter(link, lambda n: dom.has_token(_attr(n, "rel"), "alternate") & _has(n, "hreflang") & _has(n, "href"))
    plain = F.filter(nodes, _is_mixed)
    return {
        "hreflangs": F.transform(langs, lambda n: F.struct(_attr(n, "hreflang").alias("lang"), urls.resolve(_origin(), _attr(n, "href")).alias("url"))),
        "amp_url": F.when(amp.isNotNull(), urls.resolve(_origin(), amp)),
        "mixed_content": F.when(https, F.transform(plain, lambda n: F.struct(n["tag"].alias("tag"), F.coalesce(*[F.when(n["tag"] == t, _attr(n, a)) for t, a in MIXED.items()]).alias("url")))).otherwise(F.array().cast("array<struct<tag:string,url:string>>")),
        "image_urls": F.filter(F.transform(dom.by_tag(nodes, "img"), lambda n: urls.absolute(F.col("url"), _attr(n, "src"))), lambda u: u.isNotNull()),
        "script_urls": F.filter(F.transform(dom.by_tag(nodes, "script"), lambda n: urls.absolute(F.col("url"), _attr(n, "src"))), lambda u: u.isNotNull()),
        "style_urls": F.transform(F.filter(link, lambda n: dom.has_token(_attr(n, "rel"), "stylesheet") & _no(_attr(n, "href") != "")), lambda n: urls.absolute(F.col("url"), _attr(n, "href"))),
        "inline_scripts": F.transform(F.slice(F.filter(nodes, lambda n: (n["tag"] == "script") & ~_has(n, "src") & (F.trim(n["text"]) != "")), 1, 3), lambda n: text.minification(F.trim(n["text"]))),
        "inline_styles": F.transform(F.slice(F.filter(styles, lambda n: F.trim(n["text"]) != ""), 1, 3), lambda n: text.minification(F.trim(n["text"]))),
    }


def _is_mixed(n: Column) -> Column:
    return F.coalesce(*[F.when(n["tag"] == t, _no(F.lower(_attr(n, a)).startswith("http://"))) for t, a in MIXED.items()], F.lit(False))


def structured() -> dict[str, Column]:
    """JSON-LD blocks that parse, all their @type values, and the types of outermost microdata items with properties of their own."""
    nodes = _nodes()
    blocks = F.transform(F.filter(nodes, lambda n: _no((n["tag"] == "script") & (_attr(n, "type") == "application/ld+json"))), lambda n: n["text"])
    valid = F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())
    quoted = r'(?<!\\)"@type"\s*:\s*(\[[^\]]*\]|"(?:[^"\\]|\\.)*")'
    types = F.flatten(F.transform(valid, lambda b: F.flatten(F.transform(F.regexp_extract_all(b, F.lit(quoted), F.lit(1)), lambda v: F.regexp_extract_all(v, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))))))
    items = F.filter(nodes, lambda n: _has(n, "itemscope") & n["scope"].isNull() & F.exists(nodes, lambda p: _has(p, "itemprop") & _no(p["scope"] == n["i"])))
    kinds = F.transform(items, lambda n: F.coalesce(_attr(n, "itemtype"), F.lit("UnknownType")))
    schema = F.exists(nodes, lambda n: _no(F.contains(F.lower(_attr(n, "itemtype")), F.lit("schema.org"))))
    return {
        "json_ld": valid,
        "json_ld_types": F.array_distinct(types),
        "has_json_ld": F.size(valid) > 0,
        "microdata_types": kinds,
        "microdata": F.transform(items, lambda n: F.struct(F.coalesce(_attr(n, "itemtype"), F.lit("UnknownType")).alias("type"), _properties(nodes, n["i"]).alias("properties"))),
        "has_microdata": F.size(items) > 0,
        "has_schema": schema | (F.size(valid) > 0),
    }


def _properties(nodes: Column, item: Column) -> Column:
    """name and value of an item's own properties, in order."""
    own = F.filter(nodes, lambda p: _has(p, "itemprop") & _no(p["scope"] == item))

    def value(p: Column) -> Column:
        said = F.nullif(p["text"], F.lit(""))
        return (
            F.when(_has(p, "itemscope"), F.coalesce(_attr(p, "itemtype"), F.lit("UnknownNestedType")))
            .when(p["tag"] == "meta", _attr(p, "content"))
            .when(p["tag"].isin("a", "link"), _attr(p, "href"))
            .when(p["tag"].isin("img", "audio", "video", "embed", "iframe", "source", "track"), _attr(p, "src"))
            .when(p["tag"] == "time", F.coalesce(F.nullif(_attr(p, "datetime"), F.lit("")), said))
            .when(p["tag"] == "data", F.coalesce(F.nullif(_attr(p, "value"), F.lit("")), said))
            .when(p["tag"] == "object", _attr(p, "data"))
            .otherwise(p["text"])
        )

    return F.filter(F.transform(own, lambda p: F.struct(_attr(p, "itemprop").alias("name"), value(p).alias("value"))), lambda x: x["value"].isNotNull())


def address(keyword: str | None = None) -> dict[str, Column]:
    u = F.col("url")
    return {"seo_friendly": urls.is_seo_friendly(u), "url_issues": urls.url_issues(u), "slug": urls.slug_quality(u, keyword)}


def with_links() -> dict[str, Column]:
    return links(F.col("links"))


#: All groups of checks; those in the first tuple take a keyword.
BY_KEYWORD, PLAIN = (title, description, headings, images, address), (with_links, social, markup, dates, content, technical, assets, structured)


def check(pages: DataFrame, *names: str, of: tuple = BY_KEYWORD + PLAIN, keyword: str | None = None) -> DataFrame:
    """page_id and the checks of these names, in one select; ``of``: the groups that have them, as building all takes the driver seconds."""
    every: dict[str, Column] = {}
    for group in of:
        every |= group(keyword) if group in BY_KEYWORD else group()
    if with_links in of:
        pages = pages.withColumn("links", page_links())
    return pages.select("page_id", *[every[n].alias(n) for n in names])


# Points and weight of every check, by category, and the weight of each category.
WEIGHTS = {
    "on_page": {
        "title": (10, 1.5), "description": (8, 1.2), "headings": (10, 1.2), "alt_texts": (7, 1.0), "responsive_images": (5, 0.8), "length": (8, 1.0),
        "links": (5, 0.7), "broken_links": (10, 1.5), "open_graph": (3, 0.7), "twitter_cards": (3, 0.7), "url": (5, 1.0), "inline_css": (3, 0.5),
        "deprecated": (5, 0.8), "flash": (5, 1.0), "frames": (5, 1.0), "unsafe_links": (4, 0.8),
    },
    "technical": {
        "https": (10, 1.5), "robots_txt": (5, 1.0), "sitemap": (5, 1.0), "canonical": (7, 1.2), "mobile": (10, 1.5), "structured_data": (8, 1.0),
        "meta_robots": (5, 1.0), "http_version": (3, 0.7), "hsts": (4, 0.8), "mixed_content": (8, 1.2), "redirects": (5, 0.8), "custom_404": (3, 0.5),
        "html_size": (5, 0.8), "dom_size": (5, 0.8), "compression": (4, 1.0), "page_cache": (5, 0.7), "favicon": (2, 0.5), "charset": (2, 0.8),
        "doctype": (2, 1.0),
    },
    "content": {"readability": (10, 1.0), "keyword_usage": (10, 1.2), "common_keywords": (5, 0.8), "text_ratio": (5, 0.7), "spelling": (5, 0.8)},
}
CATEGORIES = {"on_page": 0.40, "technical": 0.35, "content": 0.25}
RESPONSE = "struct<status:int,headers:map<string,string>,http_version:string,redirects:int,robots_found:boolean,sitemap_found:boolean,custom_404:boolean,broken_links:int>"


def earned(response: Column) -> dict[str, dict[str, Column]]:
    """The share of its points that each check earns, 0 to 1."""
    yes = lambda c: F.when(_no(c), 1.0).otherwise(0.0)
    no = lambda c: F.when(_no(c), 0.0).otherwise(1.0)
    header = lambda name: _first(F.map_values(F.map_filter(F.coalesce(response["headers"], F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k) == name)))
    c = F.col
    sized = lambda n: F.when(n == "good", 1.0).when(n == "missing", 0.0).otherwise(0.3)
    penalty = lambda n, most: 1 - F.least(F.lit(float(most)), n) / float(most)
    flesch = c("flesch")["score"]
    return {
        "on_page": {
            "title": sized(c("title_status")),
            "description": sized(c("description_status")),
            "headings": F.when(c("n_h1") == 1, 0.6).when(c("n_h1") > 1, 0.3).otherwise(0.0) + F.when(c("n_h2") > 0, 0.4).otherwise(0.0),
            "alt_texts": F.when(c("n_images") > 0, (c("n_images") - c("n_images_without_alt")) / F.greatest(c("n_images"), F.lit(1))).otherwise(0.5),
            "responsive_images": penalty(c("n_images_not_responsive"), 5),
            "length": yes(c("long_enough")),
            "links": yes(c("enough_links")),
            "broken_links": penalty(F.coalesce(response["broken_links"], F.lit(0)), 10),
            "open_graph": yes(c("has_open_graph")),
            "twitter_cards": yes(c("has_twitter_cards")),
            "url": yes(c("seo_friendly")),
            "inline_css": penalty(c("n_inline_css") * 0.1, 3),
            "deprecated": no(F.size("deprecated_tags") > 0),
            "flash": no(c("has_flash")),
            "frames": no(c("has_frames")),
            "unsafe_links": penalty(c("n_unsafe_blank") * 0.5, 4),
        },
        "technical": {
            "https": yes(c("https")),
            "robots_txt": yes(response["robots_found"]),
            "sitemap": yes(response["sitemap_found"]),
            "canonical": yes(c("has_canonical")),
            "mobile": yes(c("mobile_responsive")),
            "structured_data": yes(c("has_schema") | c("has_json_ld") | c("has_microdata")),
            "meta_robots": yes(c("has_meta_robots")),
            "http_version": yes(response["http_version"].isin("HTTP/2.0", "HTTP/3")),
            "hsts": yes(F.coalesce(header("strict-transport-security"), F.lit("")) != ""),
            "mixed_content": no(c("has_mixed_content")),
            "redirects": no(response["redirects"] > 0),
            "custom_404": yes(response["custom_404"]),
            "html_size": F.when(c("html_chars") > 500 * 1024, 0.0).when(c("html_chars") > 200 * 1024, 0.5).otherwise(1.0),
            "dom_size": F.when(c("dom_size") > 1500, 0.0).when(c("dom_size") > 800, 0.5).otherwise(1.0),
            "compression": yes(F.lower(header("content-encoding")).rlike("gzip|br")),
            "page_cache": yes(F.coalesce(header("cache-control"), header("expires"), header("etag"), F.lit("")) != ""),
            "favicon": yes(c("favicon").isNotNull()),
            "charset": yes(c("has_charset")),
            "doctype": yes(c("has_doctype")),
        },
        "content": {
            "readability": F.element_at(F.transform(F.array(flesch), lambda f: F.when(f >= 60, 1.0).when(f >= 30, 0.5).when(f.isNotNull(), 0.1).otherwise(0.0)), 1),  # the score is made once
            "keyword_usage": F.lit(1.0),  # no keywords are set
            "common_keywords": yes(c("has_common_words")),
            "text_ratio": F.when(c("text_ratio")["status"] == "low_ratio", 0.2).otherwise(1.0),
            "spelling": F.lit(1.0),  # no dictionary is at hand, so nothing is taken off
        },
    }


def scores(pages: DataFrame, weights: dict = WEIGHTS, categories: dict = CATEGORIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """on_page, technical, content and overall percentages, to one place; a page without visible words has no content score.

    ``keep``: other columns of pages that go along.
    """
    if "response" not in pages.columns:
        pages = pages.withColumn("response", F.lit(None).cast(RESPONSE))
    every = title() | description() | headings() | images() | with_links() | address() | social() | markup() | content() | technical() | structured()
    response = F.col("response")
    shares = earned(response)
    wanted = ["flesch", "text_ratio", "deprecated_tags"] + [
        "title_status", "description_status", "n_h1", "n_h2", "n_images", "n_images_without_alt", "n_images_not_responsive", "long_enough", "enough_links",
        "has_open_graph", "has_twitter_cards", "seo_friendly", "n_inline_css", "has_flash", "has_frames", "n_unsafe_blank", "https", "has_canonical",
        "mobile_responsive", "has_schema", "has_json_ld", "has_microdata", "has_meta_robots", "has_mixed_content", "html_chars", "dom_size", "favicon",
        "has_charset", "has_doctype", "has_common_words", "n_words",
    ]
    made = pages.withColumn("links", page_links()).select("page_id", "response", *keep, *[every[n].alias(n) for n in wanted])

    def percent(category: str) -> Column:
        total = F.lit(0.0)
        for name, (points, weight) in weights[category].items():
            total = total + F.lit(points * weight) * shares[category][name]
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * total / float(sum(p * w for p, w in weights[category].values())))), 1)

    out = made.select("page_id", *keep, percent("on_page").alias("on_page"), percent("technical").alias("technical"), F.when(F.col("n_words") > 0, percent("content")).otherwise(0.0).alias("content"))
    total = F.lit(0.0)
    for name, share in categories.items():
        total = total + F.col(name) * share
    return out.withColumn("overall", F.round(total / float(sum(categories.values())), 1))
