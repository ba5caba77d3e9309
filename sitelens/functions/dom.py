"""A page as a column of its nodes: parsed once, then every check is a Spark expression over the array.

Void elements close at once, an end tag closes back to its nearest open match or is ignored, and no end tags are
implied.  Names are lower-cased and entities decoded.  Text in script, style and template is not page text; that of
script and style elements is kept with them as it stands.  ``scope`` is the nearest element around with itemscope.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jsonld, passes

# Element names of the HTML standard and those whose text is not visible.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NO_TEXT = {"script", "style", "template"}
HIDDEN = {"script", "style", "nav", "footer", "aside", "header", "noscript", "template"}
#: Elements whose own subtree text is kept beside them.
WITH_TEXT = {"title", "h1", "h2", "h3", "h4", "h5", "h6", "a", "p", "li", "button", "label", "time", "option"}

SCHEMA = (
    "struct<nodes:array<struct<i:int,parent:int,depth:int,tag:string,attrs:map<string,string>,text:string,anc:array<string>,scope:int>>,"
    f"visible:string,full:string,doctype:string,product:{jsonld.SCHEMA}>"
)


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.texts: dict[int, list[str]] = {}
        self.visible: list[str] = []
        self.full: list[str] = []
        self.raw: dict[int, list[str]] = {}
        self.scopes: list[int] = []
        self.doctype = None

    def handle_decl(self, decl):
        if decl.lower().startswith("doctype"):
            self.doctype = decl[7:].strip() or None

    def handle_starttag(self, tag, attrs):
        at = len(self.nodes)
        self.nodes.append(
            {
                "i": at,
                "parent": self.open[-1] if self.open else None,
                "depth": len(self.open),
                "tag": tag,
                "attrs": {k: v or "" for k, v in attrs},
                "text": None,
                "anc": [self.nodes[k]["tag"] for k in self.open],
                "scope": self.scopes[-1] if self.scopes else None,
            }
        )
        has = self.nodes[at]["attrs"]
        if tag in WITH_TEXT or "itemprop" in has:
            self.texts[at] = []
        if tag in ("script", "style"):
            self.raw[at] = []
        if tag not in VOID:
            self.open.append(at)
            if "itemscope" in has:
                self.scopes.append(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                self._close(k)
                return

    def _close(self, k):
        del self.open[k:]
        while self.scopes and self.scopes[-1] not in self.open:
            self.scopes.pop()

    def handle_data(self, data):
        if self.open and self.open[-1] in self.raw:
            self.raw[self.open[-1]].append(data)
        part = data.strip()
        if not part:
            return
        tags = {self.nodes[k]["tag"] for k in self.open}
        if not tags & NO_TEXT:
            self.full.append(part)
            for k in self.open:
                if k in self.texts:
                    self.texts[k].append(part)
        if not tags & HIDDEN:
            self.visible.append(part)


def parse(html: str | None) -> dict | None:
    if html is None:
        return None
    page = _Page()
    page.feed(html)
    page.close()
    for k, parts in page.texts.items():
        page.nodes[k]["text"] = " ".join(parts)
    for k, parts in page.raw.items():
        page.nodes[k]["text"] = "".join(parts)
    blocks = [n["text"] for n in page.nodes if n["tag"] == "script" and n["attrs"].get("type") == "application/ld+json"]
    return {
        "nodes": page.nodes, "visible": " ".join(page.visible), "full": " ".join(page.full), "doctype": page.doctype,
        "product": jsonld.product(blocks) if blocks else None,
    }


def _around(page: dict) -> int:
    """The names that nodes hold of the nodes around them, of which deep pages have many."""
    return sum(n["depth"] for n in page["nodes"])


def parse_dom(html: Column) -> Column:
    return passes.column(html, parse, SCHEMA, _around)


def by_tag(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def count_of(nodes: Column, *tags: str) -> Column:
    return F.size(by_tag(nodes, *tags))


def first_text(nodes: Column, tag: str) -> Column:
    return F.get(by_tag(nodes, tag), F.lit(0))["text"]


def meta(nodes: Column, name: str, key: str = "name") -> Column:
    """The content of the first meta element of that name, whatever its case."""
    found = F.filter(by_tag(nodes, "meta"), lambda n: F.lower(n["attrs"][key]) == name)
    return F.get(found, F.lit(0))["attrs"]["content"]


def has_token(value: Column, token: str) -> Column:
    """Whether a list of words in an attribute, such as rel or class, has this one."""
    return F.array_contains(F.split(F.coalesce(value, F.lit("")), r"\s+"), token)


def within(n: Column, *tags: str) -> Column:
    """How many elements of these names are around a node."""
    return F.size(F.filter(n["anc"], lambda a: a.isin(*tags)))


def sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, b: a + b)
