"""URL functions, column in and column out."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOPWORDS

# The patterns of each class of URL, tried in this order.
ANTI = [r"/author", r"/page/\d+"]
CATEGORY = [
    r"/(nos\-)?categor", r"/collection[s]?/", r"/catalog\/?", r"/products", r"/produits", r"/c/", r"/cat/",
    r"\/\d{1,3}-[0-9a-zA-Z+\-?]+\/?$", r"/accueil", r"[nos\-]?marque[s]?",
]
PRODUCT = [
    r"/product[s]?/[0-9\w-]+/?", r"/produit[s]?/[0-9\w-]+/?", r"/item[s]?/[0-9\w-]+/?", r"/p/[0-9\w-]+/?",
    r"[a-zA-Z][a-zA-Z0-9-]+-\d+\.html$", r"[?&](?:id|pid|product_id|item_id)=\d+", r"/product/[0-9\w-]+/?$",
]
CLASSES = {
    "other": ANTI,
    "category": CATEGORY,
    "product": PRODUCT,
    "blog": [r"/blog[s]?", r"/article[s]?", r"/post[s]?", r"/tag[s]?"],
    "news": [r"/news", r"/actualit"],
    "about": [r"/about[\w-]*", r"/a[-_/]?propos[\w-]*", r"/qui[-_/]?sommes(?:[-_/]?nous)?"],
    "contact": [r"/contact[\w-]*"],
    "event": [r"/event[s]?[\w-]*", r"/evenement[s]?[\w-]*"],
    "promo": [r"/promo(?:tion)?s?", r"/offre[s]?", r"/pack[s]?"],
    "auth": [r"/login", r"/logout", r"password", r"register|registration", r"account", r"checkout", r"cart", r"wishlist"],
    "support": [r"ticket[s]?"],
    "rules": [r"conditions", r"mentions", r"politique", r"confidentialite"],
}
# First path segments of shops, names of sitemap files, and forms of product URLs.
SHOP_ROOTS = ["shop", "boutique", "cat", "produits"]
SITEMAP_NAMES = {
    "other": [
        r"post[-_]sitemap", r"page[-_]sitemap", r"cms[_-]block[-_]sitemap", r"portfolio[-_]sitemap", r"product[_-]tag[-_]sitemap",
        r"basel[_-]sidebar[-_]sitemap", r"author[-_]sitemap",
    ],
    "product": [r"product[-_]sitemap", r"produit[-_]sitemap", r"sitemap[-_]product"],
    "category": [
        r"category[-_]sitemap", r"categorie[-_]sitemap", r"product[_-]cat[-_]sitemap", r"project[_-]cat[-_]sitemap", r"sitemap[-_]categor",
    ],
}
PRODUCT_URL = [
    r"/product[s]?/", r"/produit[s]?/", r"/shop/[^/]+", r"/item[s]?/", r"/p/[^/]+", r"/catalogue/",
    r"[a-zA-Z][a-zA-Z0-9-]+-\d+\.html$", r"[?&](?:id|pid|product_id|item_id)=\d+", r"/product/[\w-]+/?$",
]
NOT_PRODUCT_URL = [
    r"/\d{4}/\d{2}/", r"/\d{4}/[a-z]", r"/blog/", r"/news/", r"/actualit", r"/article[s]?/", r"/post[s]?/", r"/tag[s]?/", r"/categor",
    r"/author/", r"/page/\d+", r"/\w+(compte|connexion)\w+",
]


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """The lower-cased host, without userinfo and port."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), r"^.*@", ""), r":\d*$", "")


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def _decoded(value: Column) -> Column:
    """Percent escapes and plus signs decoded; a percent sign that begins no escape stands for itself."""
    return F.url_decode(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(value: Column) -> Column:
    """Encoded as a form value: letters, digits and _.-~ stand as they are, a blank is a plus sign."""
    return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def unquoted(value: Column) -> Column:
    """Percent escapes decoded, plus signs kept."""
    return _decoded(F.replace(value, F.lit("+"), F.lit("%2B")))


def _accents() -> tuple[str, str]:
    """The letters that are an ASCII letter and marks, and those ASCII letters."""
    found = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for c in range(0xA0, 0x2000)]
    found = [(c, a) for c, a in found if len(a) == 1]
    return "".join(c for c, _ in found), "".join(a for _, a in found)


def matchable(url: Column) -> Column:
    """The form that classes are matched by: unquoted, without accents and other non-ASCII characters, in lower case."""
    return F.lower(F.regexp_replace(F.translate(unquoted(url), *_accents()), r"[^\x00-\x7F]", ""))


def _without_dots(at: Column) -> Column:
    """A path without its . and .. segments."""
    parts = F.split(at, "/")
    start = F.array().cast("array<string>")
    drop = lambda out: F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        start,
        lambda out, p: F.when(p == ".", out).when(p == "..", F.when(F.size(out) > 1, drop(out)).otherwise(start)).otherwise(F.concat(out, F.array(p))),
    )
    last = F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, last).otherwise(""))


def resolve(base: Column, href: Column) -> Column:
    """An absolute URL from a link on the page at base."""
    h = F.trim(href)
    origin = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    ref = F.regexp_extract(h, "^[^?#]*", 0)
    tail = F.substring(h, F.length(ref) + 1, F.length(h))
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    return (
        F.when(h == "", base)
        .when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h))
        .when(h.startswith("?"), F.concat(origin, path(base), h))
        .otherwise(F.concat(origin, _without_dots(F.when(ref.startswith("/"), ref).otherwise(F.concat(folder, ref))), tail))
    )


def absolute(base: Column, href: Column) -> Column:
    """The resolved link without its fragment; null for an empty one, a bare fragment and a script."""
    h = F.trim(href)
    return F.when((h != "") & (h != "#") & ~h.startswith("javascript:"), F.regexp_replace(resolve(base, h), "#.*$", ""))


def netloc(url: Column) -> Column:
    """Host and port as they stand in the URL."""
    return part(url, 2)


def is_excluded(href: Column, fragments: list[str], exact: list[str]) -> Column:
    low = F.lower(F.coalesce(href, F.lit("")))
    out = (low == "") | low.isin(*exact) if exact else low == ""
    for f in fragments:
        out = out | F.contains(low, F.lit(f))
    return out


def is_homepage(url: Column) -> Column:
    return path(url).isin("", "/") | F.lower(path(url)).rlike(r"/index\.html?$")


def is_bare_origin(url: Column) -> Column:
    return path(url).isin("", "/") & (query(url) == "")


def with_scheme(url: Column) -> Column:
    """https where none is written."""
    return F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def slug_quality(url: Column, keyword: str | None = None) -> Column:
    """slug, has_hyphens, special_chars, has_keyword, n_stopwords and normalized, as a struct."""
    slug = F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.filter(F.split(unquoted(path(url)), "/"), lambda x: x != "")), -1), F.lit(""))
    found = F.regexp_extract_all(F.lower(slug), F.lit("[a-z0-9]+"), F.lit(0))
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(slug)), "[^a-z0-9-]+", "-"), "-{2,}", "-")
    return F.struct(
        slug.alias("slug"),
        F.contains(slug, F.lit("-")).alias("has_hyphens"),
        slug.rlike("[^a-zA-Z0-9-]").alias("special_chars"),
        (F.contains(F.lower(slug), F.lit(keyword.lower())) if keyword else F.lit(False)).alias("has_keyword"),
        F.size(F.filter(found, lambda w: w.isin(*STOPWORDS))).alias("n_stopwords"),
        F.regexp_replace(clean, "^-+|-+$", "").alias("normalized"),
    )


def url_issues(url: Column, max_length: int = 100, max_depth: int = 4) -> Column:
    """What is wrong with a URL, as a list of words."""
    at = unquoted(path(url))
    return F.array_compact(
        F.array(
            F.when(F.length(url) > max_length, "too_long"),
            F.when(F.size(F.filter(F.split(at, "/"), lambda x: x != "")) > max_depth, "too_deep"),
            F.when(at.rlike(r"\p{Lu}"), "uppercase"),
            F.when(F.lower(at).rlike(r"\.(php|asp|aspx|jsp|html|htm)$"), "file_extension"),
        )
    )


def next_page(url: Column) -> Column:
    """The URL of the page after: a page number in the query or the path plus one, or page=2 in the query."""
    in_query, in_path = r"(?is)^(.*?[?&](?:page|p|pagenumber)=)(\d+)(.*)$", r"(?is)^(.*?/page/)(\d+)(.*)$"

    def plus(pattern: str) -> Column:
        n = (F.regexp_extract(url, pattern, 2).try_cast("bigint") + 1).cast("string")
        return F.concat(F.regexp_extract(url, pattern, 1), n, F.regexp_extract(url, pattern, 3))

    first = F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("page=2"))
    return F.when(url.rlike(in_query), plus(in_query)).when(url.rlike(in_path), plus(in_path)).otherwise(first)


def normalized(url: Column) -> Column:
    """The form that duplicates are found by; null without a scheme and a host."""
    url = F.trim(url)
    s, port = scheme(url), F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    shown = (port != "") & ~((s == "http") & (port == "80")) & ~((s == "https") & (port == "443"))
    at = F.concat(host(url), F.when(shown, F.concat(F.lit(":"), port)).otherwise(""))
    pairs = F.transform(
        F.filter(F.split(query(url), "&"), lambda p: p != ""),
        lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_extract(p, r"=(.*)$", 1)).alias("v")),
    )
    joined = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    tail = F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")
    whole = F.concat(s, F.lit("://"), at, F.when(path(url) == "", "/").otherwise(path(url)), tail)
    return F.when((s != "") & (host(url) != ""), whole)


def url_id(url: Column) -> Column:
    return F.sha1(normalized(url).cast("binary"))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def by_depth(url: Column) -> Column:
    """Below a shop's root: up to two segments are a category, three or more that end in a slug a product."""
    parts = segments(url)
    roots = F.filter(F.transform(parts, lambda x, i: F.when(x.isin(*SHOP_ROOTS), i)), lambda i: i.isNotNull())
    below = F.size(parts) - F.get(roots, F.lit(0)) - 1
    last = F.element_at(parts, -1)
    slug = last.rlike(r"^[a-z0-9][a-z0-9-]{1,}$") & ~last.rlike(r"^[0-9]+$")
    return F.when(F.size(roots) == 0, F.lit(None)).when(below <= 2, "category").when((below >= 3) & slug, "product")


def url_class(url: Column) -> Column:
    low = matchable(url)
    out = None
    for name, patterns in CLASSES.items():
        test = low.rlike(any_of(patterns))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(F.coalesce(by_depth(low), F.lit("other")))


def sitemap_class(url: Column) -> Column:
    name = F.lower(F.substring_index(path(url), "/", -1))
    out = None
    for kind, patterns in SITEMAP_NAMES.items():
        test = name.rlike(any_of(patterns))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def is_product_url(url: Column) -> Column:
    at = F.concat(path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))
    return F.lower(at).rlike(any_of(PRODUCT_URL)) & ~F.lower(at).rlike(any_of(NOT_PRODUCT_URL))


def is_seo_friendly(url: Column, max_length: int = 100, max_depth: int = 4) -> Column:
    return (F.length(url) <= max_length) & (F.size(segments(url)) <= max_depth)


def resource_type(url: Column, content_type: Column) -> Column:
    p, c = F.lower(path(url)), F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(p.rlike(r"\.m?js$"), "script").when(p.rlike(r"\.css$"), "stylesheet").when(p.rlike(r"\.(png|jpe?g|gif|svg|webp)$"), "image")
        .when(p.rlike(r"\.(woff2?|ttf|otf|eot)$"), "font").when(F.contains(c, F.lit("javascript")), "script").when(F.contains(c, F.lit("css")), "stylesheet")
        .when(F.contains(c, F.lit("image")), "image").when(F.contains(c, F.lit("font")), "font").otherwise("other")
    )
