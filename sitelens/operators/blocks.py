"""Repeated blocks of a page that look like products, and the block's own fields; and how a page leads to its next one.

Blocks are siblings of the same name and lasting classes.  A block's points come from what is below it, so the page is
walked once, with running counts: what lies below a node is a stretch of the nodes, and of the texts, after it.
"""

from __future__ import annotations

import re
import statistics
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom, passes, text, urls
from .checks import _attr, _no
from .classify import _under

# Words, points, weights, and classes that differ from block to block.
CART_WORDS = ["add to cart", "add to bag", "ajouter au panier", "ajouter", "buy now", "acheter"]
CART_CLASSES = ["add-to-cart", "addtocart", "add_to_cart", "btn-cart", "cart-button", "buy-btn"]
NOT_A_LINK = ["add-to-cart", "wishlist", "compare", "quickview", "quick-view", "quick_view", "login", "register"]
NO_LINKS = ["#", "javascript:void(0)"]
POINTS = {"image": 1.0, "anchor": 1.0, "product_url": 1.0, "price": 1.5, "cart": 1.0, "schema": 1.5}
WEIGHTS = {"score": 0.5, "consistency": 0.2, "url_share": 0.2, "count": 0.1}
FULL_COUNT, LEAST_CONFIDENCE, TITLE_CHARS = 20, 0.2, 200
PASSING_CLASSES = [
    r"post-\d+", r"\d+", r"type-[\w-]+", r"status-[\w-]+", "instock|outofstock", "first|last", "odd|even", ".*item-of-.*", ".*-line",
    r"col-(xs|sm|md|lg|xl)-\d+", "row|clearfix", "product_cat.*", "product-type.*", "shimmer", "shipping-taxable", "sale", "wd-quantity-overlap", "wd-with-labels",
]
LOAD_TEXTS = ["load", "charger", "plus", "more", "afficher plus", "show more"]
PAGE_PARAMS = ["page", "p"]
#: So many blocks make a list; one alone is no repetition.
MIN_BLOCKS = 2

SCHEMA = (
    "struct<is_product_list:boolean,confidence:double,selector:string,n_blocks:int,avg_score:double,consistency:double,url_share:double,"
    "products:array<struct<url:string,title:string,price:string>>>"
)
_PASSING = re.compile("|".join(f"(?:{p})" for p in PASSING_CLASSES), re.I)
_PRICES = [re.compile(p, re.I) for p in text.PRICES]
_PRODUCT = re.compile(urls.any_of(urls.PRODUCT_URL), re.I)
_CART, _CART_CLASS = (re.compile("|".join(map(re.escape, words)), re.I) for words in (CART_WORDS, CART_CLASSES))


class _Tree(dom._Page):
    """A page whose nodes know where what is below them ends, in nodes and in texts."""

    def __init__(self, html: str):
        super().__init__()
        self.pieces: list[str] = []
        self.below: dict[int, tuple[int, int, int]] = {}
        self.began: dict[int, int] = {}
        self.feed(html)
        self.close()
        self._close(0)

    def handle_starttag(self, tag, attrs):
        at = len(self.nodes)
        super().handle_starttag(tag, attrs)
        self.began[at] = len(self.pieces)
        self.below[at] = (at + 1, len(self.pieces), len(self.pieces))

    def _close(self, k):
        for at in self.open[k:]:
            self.below[at] = (len(self.nodes), self.began[at], len(self.pieces))
        super()._close(k)

    def handle_data(self, data):
        super().handle_data(data)
        if data.strip() and not {self.nodes[k]["tag"] for k in self.open} & dom.NO_TEXT:
            self.pieces.append(data.strip())

    def words(self, at: int, glue: str = " ") -> str:
        _, first, end = self.below[at]
        return glue.join(self.pieces[first:end])


def _classes(node: dict) -> list[str]:
    return node["attrs"].get("class", "").split()


def key_of(node: dict) -> str:
    """Name and lasting classes, in order: what blocks of a list have in common."""
    return f"{node['tag']}::{' '.join(sorted(c for c in _classes(node) if not _PASSING.fullmatch(c)))}"


def _named(tag: str, classes: list[str]) -> str:
    return ".".join([tag, *sorted(classes)])


def _is_product_link(node: dict) -> bool:
    href = node["attrs"].get("href", "").lower()
    return bool(href) and href not in NO_LINKS and not any(x in href for x in NOT_A_LINK) and _PRODUCT.search(href) is not None


def _is_cart(tree: _Tree, at: int) -> bool:
    has = tree.nodes[at]["attrs"]
    said = [tree.words(at, ""), *(has.get(k, "") for k in ("data-action", "aria-label", "title", "value"))]
    return any(_CART.search(x) for x in said) or _CART_CLASS.search(" ".join(_classes(tree.nodes[at]))) is not None


def _signals(tree: _Tree) -> dict[str, list[int]]:
    """Per signal, how many of the nodes before each place have it."""

    def count(test) -> list[int]:
        return list(accumulate((test(i, n) for i, n in enumerate(tree.nodes)), initial=0))

    kind = lambda n: n["attrs"].get("itemtype", "")
    return {
        "image": count(lambda i, n: n["tag"] == "img"),
        "anchor": count(lambda i, n: n["tag"] == "a" and "href" in n["attrs"]),
        "product_url": count(lambda i, n: n["tag"] == "a" and _is_product_link(n)),
        "cart": count(lambda i, n: n["tag"] in ("button", "a", "input") and _is_cart(tree, i)),
        "schema": count(lambda i, n: "schema.org/product" in kind(n).lower() or ("itemscope" in n["attrs"] and "product" in kind(n).lower())),
    }


def spread(values: list[float]) -> float:
    """The standard deviation over the largest value, 1 at most; 0 for a single value or zeros."""
    return min(statistics.stdev(values) / max(values), 1.0) if len(values) > 1 and max(values) else 0.0


def price_of(words: str) -> str | None:
    return next((m.group(0).strip() for p in _PRICES if (m := p.search(words))), None)


def _title(tree: _Tree, at: int) -> str | None:
    """The first heading's words, else those of something with a class like title or name, else the first link's."""
    below = range(at + 1, tree.below[at][0])
    tests = [lambda n, h=h: n["tag"] == h for h in ("h1", "h2", "h3", "h4")]
    tests += [lambda n, c=c: any(c in x.lower() for x in _classes(n)) for c in ("title", "name")]
    for test in [*tests, lambda n: n["tag"] == "a"]:
        first = next((i for i in below if test(tree.nodes[i])), None)
        if first is not None and (words := tree.words(first, "")):
            return words[:TITLE_CHARS]
    return None


def product_list(html: str | None) -> dict | None:
    """The best group of blocks on a page, with its products; None where no two siblings are alike."""
    if html is None:
        return None
    tree = _Tree(html)
    groups: dict[tuple, list[int]] = {}
    for n in tree.nodes:
        groups.setdefault((n["parent"], key_of(n)), []).append(n["i"])
    before = _signals(tree)
    has = lambda name, at: before[name][tree.below[at][0]] > before[name][at + 1]
    best = None
    for (parent, key), blocks in groups.items():
        if len(blocks) < MIN_BLOCKS:
            continue
        scores = [sum(POINTS[name] for name in before if has(name, b)) + (POINTS["price"] if price_of(tree.words(b)) else 0.0) for b in blocks]
        avg, share = sum(scores) / len(blocks), sum(has("product_url", b) for b in blocks) / len(blocks)
        even = 1 - spread(scores)
        total = (
            avg / sum(POINTS.values()) * WEIGHTS["score"] + even * WEIGHTS["consistency"] + share * WEIGHTS["url_share"]
            + min(len(blocks) / FULL_COUNT, 1.0) * WEIGHTS["count"]
        )
        if avg > 0 and (best is None or total > best[0]):
            best = (total, parent, key, blocks, avg, even, share)
    if best is None:
        return None
    total, parent, key, blocks, avg, even, share = best
    above = tree.nodes[parent] if parent is not None else {"tag": "div", "attrs": {}}
    tag, classes = key.split("::")
    products = []
    for b in blocks:
        link = next((tree.nodes[i]["attrs"]["href"] for i in range(b + 1, tree.below[b][0]) if tree.nodes[i]["tag"] == "a" and _is_product_link(tree.nodes[i])), None)
        if link:
            products.append({"url": link, "title": _title(tree, b), "price": price_of(tree.words(b))})
    return {
        "is_product_list": total >= LEAST_CONFIDENCE and bool(products), "confidence": max(0.0, min(total, 1.0)),
        "selector": f"{_named(above['tag'], _classes(above))} > {_named(tag, classes.split())}", "n_blocks": len(blocks),
        "avg_score": avg, "consistency": even, "url_share": share, "products": products,
    }


def product_lists(pages: DataFrame) -> DataFrame:
    """page_id and the best group of blocks of every page; nulls where there is none; links are resolved."""
    found = passes.column(F.col("html"), product_list, SCHEMA)
    out = pages.select("page_id", "url", found.alias("b"))
    to = lambda p: F.struct(F.coalesce(urls.absolute(F.col("url"), p["url"]), p["url"]).alias("url"), p["title"].alias("title"), p["price"].alias("price"))
    return out.select(
        "page_id", F.coalesce("b.is_product_list", F.lit(False)).alias("is_product_list"), F.round("b.confidence", 4).alias("confidence"), "b.selector", "b.n_blocks",
        F.transform(F.coalesce("b.products", F.array().cast("array<struct<url:string,title:string,price:string>>")), to).alias("products"),
    )


def _class_has(n: Column, part: str) -> Column:
    return _no(F.contains(_attr(n, "class"), F.lit(part)))


def _with_class(name: str):
    return lambda n: dom.has_token(_attr(n, "class"), name)


def _with_param(name: str):
    return lambda n: _has_param(_attr(n, "href"), name)


def repeated_selector() -> Column:
    """The selector of a list of forms that most elements meet, more than two; else div."""
    nodes = F.col("nodes")
    tests = {
        'div[class*="product"]': lambda n: (n["tag"] == "div") & _class_has(n, "product"),
        'li[class*="product"]': lambda n: (n["tag"] == "li") & _class_has(n, "product"),
    } | {f".{c}": _with_class(c) for c in ("product-item", "grid-item", "product-card", "item")}  # fixed values
    each = F.array(*[F.struct(F.size(F.filter(nodes, test)).alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("selector")) for k, (s, test) in enumerate(tests.items())])
    best = F.array_max(each)
    return F.when(best["n"] > 2, best["selector"]).otherwise("div")


def _has_param(url: Column, name: str) -> Column:
    return _no(url.rlike(rf"[?&]{name}=[^&#]"))


def next_control() -> Column:
    """How the page leads on, as a struct (type, pattern): a button that loads more, a number in the address, a button for the next page, or scrolling.

    A stored page shows no layout, so every element counts as visible.
    """
    nodes, u = F.col("nodes"), F.col("url")
    tag = lambda n, *names: n["tag"].isin(*names)
    load = lambda n: (tag(n, "button") & (_class_has(n, "load") | _class_has(n, "more") | _no(F.contains(_attr(n, "id"), F.lit("load"))))) | (tag(n, "a") & _class_has(n, "load-more"))
    said = lambda n: tag(n, "button", "a") & (F.trim(F.coalesce(_attr(n, "class"), F.lit(""))) != "") & _no(F.lower(n["text"]).rlike("|".join(LOAD_TEXTS)))
    pagers = F.transform(
        F.filter(nodes, lambda n: (tag(n, "nav", "ul") & dom.has_token(_attr(n, "class"), "pagination")) | F.exists(F.array(*map(F.lit, ["page-numbers", "pagination-container", "pages-items"])), lambda c: dom.has_token(_attr(n, "class"), c))),
        lambda n: n["i"],
    )  # fixed values
    links = F.filter(nodes, lambda n: tag(n, "a") & F.exists(pagers, lambda p: _under(nodes, n, p)))
    after = lambda n: (tag(n, "a") & (_no(_attr(n, "rel") == "next") | _class_has(n, "next"))) | _no(_attr(n, "aria-label").rlike("ext|uivant"))
    in_next = F.transform(F.filter(nodes, lambda n: tag(n, "li") & _class_has(n, "next")), lambda n: n["i"])
    found = lambda kind, param=None: F.struct(F.lit(kind).alias("type"), F.lit(param).cast("string").alias("pattern"))
    kind = F.when(F.exists(nodes, load) | F.exists(nodes, said), found("load_more"))
    for p in PAGE_PARAMS:
        kind = kind.when(_has_param(u, p), found("url", p))
    for p in PAGE_PARAMS:
        kind = kind.when(F.exists(links, _with_param(p)), found("url", p))
    kind = kind.when(F.exists(nodes, after) | F.exists(nodes, lambda n: tag(n, "a") & F.exists(in_next, lambda p: _under(nodes, n, p))), found("next_button"))
    return kind.otherwise(found("infinite_scroll"))


def paging(pages: DataFrame) -> DataFrame:
    """page_id, the kind of control that leads on and its parameter, and the selector of what repeats."""
    out = pages.select("page_id", next_control().alias("c"), repeated_selector().alias("selector"))
    return out.select("page_id", F.col("c.type").alias("control"), F.col("c.pattern").alias("param"), "selector")
