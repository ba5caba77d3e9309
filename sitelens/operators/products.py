"""Product pages: their fields, from JSON-LD, else from meta elements, microdata and the page itself; and lists of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom, text, urls
from .checks import _attr, _first, _has, _no


def _meta(*keys: str) -> Column:
    """The content of the first key that a meta element has as its property or name."""
    metas = dom.by_tag(F.col("nodes"), "meta")

    def said(key: str, attr: str) -> Column:
        return F.trim(_attr(_first(F.filter(metas, lambda n: _no((_attr(n, attr) == key) & (_attr(n, "content") != "")))), "content"))

    return F.coalesce(*[said(k, a) for k in keys for a in ("property", "name")])


def _prop(name: str, *attrs: str) -> Column:
    """What the first element with this itemprop says: one of its attributes, else its text."""
    n = _first(F.filter(F.col("nodes"), lambda n: _no(_attr(n, "itemprop") == name)))
    return text.collapsed(F.coalesce(*[F.nullif(_attr(n, a), F.lit("")) for a in attrs], F.nullif(n["text"], F.lit(""))))


def detail(pages: DataFrame) -> DataFrame:
    """page_id, title, description, brand, sku, price, currency, availability, images; null where the page says nothing."""
    p, nodes = F.col("product"), F.col("nodes")
    data = lambda key: _attr(_first(F.filter(nodes, lambda n: _has(n, key))), key)
    images = F.when(F.size(F.coalesce(p["images"], F.array().cast("array<string>"))) > 0, p["images"])
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    image = _attr(_first(F.filter(nodes, lambda n: _no(_attr(n, "itemprop") == "image"))), "src")
    images = F.coalesce(images, one(_meta("og:image", "twitter:image")), one(image), F.array().cast("array<string>"))
    return pages.select(
        "page_id",
        F.coalesce(p["name"], _meta("og:title", "twitter:title", "title"), F.nullif(text.collapsed(dom.first_text(nodes, "h1")), F.lit("")), F.nullif(text.collapsed(dom.first_text(nodes, "title")), F.lit(""))).alias("title"),
        F.coalesce(p["description"], _meta("og:description", "description"), _prop("description")).alias("description"),
        F.coalesce(p["brand"], _prop("brand", "content"), data("data-brand")).alias("brand"),
        F.coalesce(p["sku"], _prop("sku", "content"), data("data-sku")).alias("sku"),
        F.coalesce(p["price"], _meta("product:price:amount", "og:price:amount", "product:price"), _prop("price", "content"), text.first_price(F.coalesce("full", F.lit("")))).alias("price"),
        F.coalesce(p["currency"], _meta("product:price:currency", "og:price:currency"), _prop("priceCurrency", "content")).alias("currency"),
        F.substring_index(p["availability"], "/", -1).alias("availability"),
        F.transform(images, lambda i: F.coalesce(urls.absolute(F.col("url"), i), i)).alias("images"),
    )


def listed(pages: DataFrame) -> DataFrame:
    """page_id and the links to products: those of a JSON-LD list of items, else links on the page that look like one, each once."""
    nodes, u = F.col("nodes"), F.col("url")
    found = F.transform(dom.by_tag(nodes, "a"), lambda n: urls.absolute(u, _attr(n, "href")))
    looks = F.array_distinct(F.filter(found, lambda x: _no(urls.is_product_url(x))))
    given = F.coalesce(F.col("product")["listed"], F.array().cast("array<string>"))
    return pages.select("page_id", F.when(F.size(given) > 0, F.transform(given, lambda x: F.coalesce(urls.absolute(u, x), x))).otherwise(looks).alias("links"))


def discovered(pages: DataFrame) -> DataFrame:
    """page_id, url and category of every link on the page's own host, each once: what a home page leads to."""
    nodes, u = F.col("nodes"), F.col("url")
    found = F.array_distinct(F.filter(F.transform(dom.by_tag(nodes, "a"), lambda n: urls.absolute(u, _attr(n, "href"))), lambda x: _no(urls.netloc(x) == urls.netloc(u)) & ~urls.is_bare_origin(x)))
    return pages.select("page_id", F.explode(found).alias("link")).select("page_id", "link", urls.url_class(F.col("link")).alias("category"))
