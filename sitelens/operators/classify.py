"""What kind of page it is, from its signals, and how it is paged; one pass over the parsed row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom, text, urls
from .checks import _attr, _has, _no, structured

# Words and names that signals are told by.
CART_WORDS = ["add to cart", "add to bag", "ajouter au panier", "ajouter", "buy now", "acheter"]
CART_CLASSES = ["add-to-cart", "addtocart", "add_to_cart", "btn-cart", "cart-button", "buy-btn"]
BLOG_HINTS = ["blog", "news", "article", "post", "wiki", "press", "stories"]
POST_CLASSES = ["post", "entry", "article", "blog"]
SEARCH_NAMES = ["q", "s", "search", "query"]
SHOP_PATHS = ["/category/", "/categories/", "/shop/", "/c/", "/catalogue"]
RELATED = [
    "related", "similar", "you may also like", "products you may like", "produits similaires", "produits associes", "produits liés", "cross-sell",
    "upsell", "accessoires",
]
DATE = r"\b(20\d{2}|19\d{2})[-/]\d{1,2}[-/]\d{1,2}\b"
FILTER_TEXT = r"(?i)\b(tri|sort|filtres?|trier\s*par|prix\s*croissant|prix\s*décroissant)\b"
LOAD_MORE = r"(?i)(load more|show more|afficher plus|voir plus)"
PAGE_PARAM, PAGE_PATH = r"(?i)[?&](page|p|pagenumber)=\d+", r"(?i)/page/\d+"
PAGER_CLASSES = ["pagination", "page-numbers", "pager"]


def _one_of(value: Column, words: list[str]) -> Column:
    return _no(F.lower(value).rlike("|".join(w.replace(".", r"\.") for w in words)))


def signals() -> dict[str, Column]:
    nodes, u = F.col("nodes"), F.col("url")
    text_of = lambda n: F.coalesce(n["text"], F.lit(""))
    og_type = F.exists(dom.by_tag(nodes, "meta"), lambda n: _no((_attr(n, "property") == "og:type") & F.contains(F.lower(_attr(n, "content")), F.lit("product"))))
    schema = F.exists(nodes, lambda n: _no(F.contains(_attr(n, "itemtype"), F.lit("schema.org/Product"))))
    typed = F.exists(structured()["json_ld_types"], lambda t: F.contains(F.lower(t), F.lit("product")))
    carts = F.filter(dom.by_tag(nodes, "button", "a", "input"), lambda n: _one_of(text_of(n), CART_WORDS) | _one_of(_attr(n, "class"), CART_CLASSES))
    anchors = F.filter(dom.by_tag(nodes, "a"), lambda n: _has(n, "href"))
    goods = F.filter(anchors, lambda n: _no(urls.is_product_url(urls.absolute(u, _attr(n, "href")))))
    n_articles = dom.count_of(nodes, "article")
    posts = F.size(F.filter(nodes, lambda n: _one_of(_attr(n, "class"), POST_CLASSES)))
    dated = F.filter(dom.by_tag(nodes, "meta"), lambda n: _no(_attr(n, "property").rlike("(?i)article:") & (_attr(n, "content") != "")))
    path = urls.path(u)
    search = F.exists(dom.by_tag(nodes, "input"), lambda n: _no(_attr(n, "type") == "search") | _no(F.lower(_attr(n, "name")).isin(*SEARCH_NAMES)) | _no(F.contains(F.lower(_attr(n, "placeholder")), F.lit("search"))))
    sorting = F.exists(
        nodes,
        lambda n: ((n["tag"] == "form") & (_no(_attr(n, "id") == "productsSortForm") | dom.has_token(_attr(n, "class"), "productsSortForm") | dom.has_token(_attr(n, "class"), "wd-product-filters") | dom.has_token(_attr(n, "class"), "nbrItemPage")))
        | ((n["tag"] == "select") & _no(_attr(n, "id").isin("selectProductSort", "nb_item")))
        | ((n["tag"] == "li") & _no(_attr(n, "id").isin("grid", "list")) & F.array_contains(n["anc"], "ul")),
    )
    related = F.exists(nodes, lambda n: (n["tag"].isin("h1", "h2", "h3", "h4", "h5") & _one_of(n["text"], RELATED)) | _one_of(F.concat_ws(" ", _attr(n, "id"), _attr(n, "class")), RELATED))
    product = urls.is_product_url(u)
    return {
        "schema_product": schema | typed | og_type,
        "n_add_to_cart": F.size(carts),
        "n_prices": text.price_matches(F.col("full")),
        "url_product": product,
        "url_detail": product | path.rlike(r"(?i)-\d+\.html?$"),
        "url_category": ~path.isin("", "/") & (((F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) <= 2) & path.endswith("/")) | F.lower(path).rlike("|".join(SHOP_PATHS))),
        "n_product_links": F.size(goods),
        "n_articles": F.when(n_articles >= 3, n_articles).otherwise(n_articles + posts),
        "n_dates": dom.count_of(nodes, "time") + F.size(dated) + F.regexp_count(F.coalesce("full", F.lit("")), F.lit(DATE)),
        "blog_url": F.lower(path).rlike("|".join(BLOG_HINTS)),
        "n_nav_links": dom.sum_of(F.transform(anchors, lambda n: dom.within(n, "nav", "header").cast("bigint"))),
        "has_search": search,
        "has_filters": sorting | _no(F.col("full").rlike(FILTER_TEXT)),
        "has_related": related,
        "is_homepage": urls.is_homepage(u),
    }


def pagination() -> Column:
    """The hints that a page has others after it."""
    nodes = F.col("nodes")
    anchors = F.filter(dom.by_tag(nodes, "a"), lambda n: _has(n, "href"))
    holders = F.transform(F.filter(nodes, lambda n: F.lit(False) | F.exists(F.array(*map(F.lit, PAGER_CLASSES)), lambda c: dom.has_token(_attr(n, "class"), c))), lambda n: n["i"])
    inside = F.exists(anchors, lambda a: F.exists(holders, lambda h: _under(nodes, a, h)))
    href = lambda n: F.trim(_attr(n, "href"))
    return F.array_compact(
        F.array(
            F.when(inside, "pagination_links"),
            F.when(F.exists(dom.by_tag(nodes, "a", "link"), lambda n: _no(_attr(n, "rel") == "next")), "rel_next"),
            F.when(F.exists(nodes, lambda n: _one_of(_attr(n, "aria-label"), ["next", "suivant"])), "aria_next"),
            F.when(F.exists(anchors, lambda n: _no(href(n).rlike(PAGE_PARAM))), "page_param"),
            F.when(F.exists(anchors, lambda n: _no(href(n).rlike(PAGE_PATH))), "page_path"),
            F.when(F.exists(dom.by_tag(nodes, "button", "a"), lambda n: _no(n["text"].rlike(LOAD_MORE))), "load_more_text"),
        )
    )


def _under(nodes: Column, n: Column, holder: Column) -> Column:
    """Whether a node comes after the holder, deeper than it, with no node as high as the holder in between."""
    top = F.get(nodes, holder)["depth"]
    return (n["i"] > holder) & (n["depth"] > top) & ~F.exists(F.slice(nodes, holder + 2, F.greatest(n["i"] - holder - 1, F.lit(0))), lambda x: x["depth"] <= top)


def classify(pages: DataFrame) -> DataFrame:
    """page_id, signals, pagination hints, the scores of the kinds and page_type."""
    made = pages.select("page_id", "url", *[c.alias(n) for n, c in signals().items()], pagination().alias("pagination"))
    c = F.col
    part = lambda test, points: F.when(test, points).otherwise(0.0)
    detail = part(c("schema_product"), 0.5) + part(c("n_add_to_cart") > 0, 0.1) + part(c("n_prices") > 0, 0.05) + part(c("url_detail") | c("url_product"), 0.4) + part(c("n_product_links") <= 3, 0.05)
    listing = part(c("n_articles") >= 3, 0.4) + part(c("n_dates") >= 3, 0.2) + part(c("blog_url"), 0.2) + part(c("n_product_links") <= 2, 0.1)
    home = part(c("is_homepage"), 0.6) + part(c("n_nav_links") >= 8, 0.2) + part(c("has_search"), 0.1)
    least = lambda x: F.round(F.least(F.lit(1.0), x), 4)
    out = made.withColumns({"detail_score": least(detail), "list_score": least(listing), "home_score": least(home)})
    kind = (
        F.when(c("is_homepage") & ~c("url_category"), "general")
        .when(c("has_filters"), "product_list")
        .when((c("detail_score") >= 0.7) & (c("has_related") | c("url_detail")), "product_detail")
        .when((c("detail_score") >= 0.6) & (c("detail_score") >= c("list_score")), "product_detail")
        .when(c("list_score") >= 0.6, "content_list")
        .when(c("home_score") >= 0.6, "general")
        .otherwise("unknown")
    )
    return out.withColumn("page_type", kind).withColumn("has_pagination", F.size("pagination") > 0)
