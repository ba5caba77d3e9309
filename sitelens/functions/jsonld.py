"""Product data in JSON-LD blocks, for the parse pass: plain Python, as the nodes may be nested to any depth."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

FIELDS = ["name", "description", "brand", "sku", "price", "currency", "availability", "url"]
SCHEMA = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ",images:array<string>,listed:array<string>>"


def nodes(value: Any) -> Iterator[dict]:
    """All objects in a value, outer ones first, with a stack rather than recursion."""
    waiting = [value]
    while waiting:
        item = waiting.pop()
        if isinstance(item, dict):
            yield item
            waiting += reversed(list(item.values()))
        elif isinstance(item, list):
            waiting += reversed(item)


def _types(node: dict) -> list[str]:
    kind = node.get("@type")
    return [str(k) for k in kind] if isinstance(kind, list) else [kind] if isinstance(kind, str) else []


def clean(value: Any, most: int = 2000) -> str | None:
    out = " ".join(str(value).split())[:most] if value not in (None, "", {}, []) else None
    return out or None


def _offer(offers: Any) -> dict[str, str | None]:
    first = offers[0] if isinstance(offers, list) and offers else offers
    if not isinstance(first, dict):
        return {}
    detail = first.get("priceSpecification")
    detail = detail if isinstance(detail, dict) else {}
    return {
        "price": clean(first.get("price") or detail.get("price")),
        "currency": clean(first.get("priceCurrency") or detail.get("priceCurrency")),
        "availability": clean(first.get("availability")),
        "url": clean(first.get("url")),
    }


def product(blocks: list[str]) -> dict | None:
    """The first node whose type names a product, and the links of lists of items; None where there is neither."""
    found, listed = None, []
    for block in blocks:
        try:
            data = json.loads(block)
        except (ValueError, RecursionError):
            continue
        for node in nodes(data):
            kinds = _types(node)
            if found is None and any("product" in k.lower() for k in kinds):
                found = node
            if "ItemList" in kinds and isinstance(node.get("itemListElement"), list):
                for e in node["itemListElement"]:
                    inner = e.get("item") if isinstance(e, dict) else None
                    link = isinstance(e, dict) and (e.get("url") or (inner.get("url") if isinstance(inner, dict) else inner))
                    listed += [str(link)] if link else []
    if found is None and not listed:
        return None
    found = found or {}
    brand, image = found.get("brand"), found.get("image")
    image = image.get("url") if isinstance(image, dict) else image
    return {
        "name": clean(found.get("name")), "description": clean(found.get("description")),
        "brand": clean(brand.get("name") if isinstance(brand, dict) else brand), "sku": clean(found.get("sku") or found.get("mpn")),
        **dict.fromkeys(["price", "currency", "availability", "url"]), **_offer(found.get("offers")),
        "images": [str(x) for x in (image if isinstance(image, list) else [image]) if x], "listed": listed,
    }
