"""A page's readable text as Markdown: its title, its language, and the longest of its content containers without what surrounds it."""

from __future__ import annotations

import re

from pyspark.sql import Column

from . import dom, passes

SCHEMA = "struct<title:string,text:string,language:string>"
# What is no content, by name, class token, and parts of a div's class.
DROP_TAGS = {"script", "noscript", "aside", "form", "style", "footer", "nav"}
DROP_CLASSES = {"newsletter", "copyright"}
DROP_DIVS = ["header", "footer", "nav", "pied", "chat", "whatsapp", "back"]
TITLES = ["og:title", "twitter:title", "title"]


class _Stream(dom._Page):
    """A page with what it says in order: ("open", node), ("text", words as they stand), ("close", node)."""

    def __init__(self, html: str):
        super().__init__()
        self.steps: list[tuple[str, object]] = []
        self.feed(html)
        self.close()
        self._close(0)

    def handle_starttag(self, tag, attrs):
        at = len(self.nodes)
        super().handle_starttag(tag, attrs)
        self.steps.append(("open", at))
        if tag in dom.VOID:
            self.steps.append(("close", at))

    def _close(self, k):
        self.steps += [("close", at) for at in reversed(self.open[k:])]
        super()._close(k)

    def handle_data(self, data):
        super().handle_data(data)
        self.steps.append(("text", data))


def _dropped(node: dict) -> bool:
    classes = node["attrs"].get("class", "")
    tokens = classes.split()
    return (
        node["tag"] in DROP_TAGS
        or (node["tag"] == "header" and "article" not in node["anc"])
        or bool(DROP_CLASSES & set(tokens))
        or (node["tag"] == "div" and ("head" in tokens or any(x in classes for x in DROP_DIVS)))
    )


def _is_container(node: dict) -> bool:
    tag, tokens, name = node["tag"], node["attrs"].get("class", "").split(), node["attrs"].get("id")
    return (
        tag in ("article", "main")
        or (tag in ("section", "div") and name == "content")
        or (tag == "div" and "content" in tokens)
        or (tag == "section" and "article" in tokens)
    )


def _kept(steps: list, nodes: list[dict]) -> list:
    out, hidden = [], None
    for kind, value in steps:
        if hidden is None and kind == "open" and _dropped(nodes[value]):
            hidden = value
        if hidden is None:
            out.append((kind, value))
        elif kind == "close" and value == hidden:
            hidden = None
    return out


def _container(steps: list, nodes: list[dict]) -> list:
    """The steps of the container with the most text, the first of equals; else of the body, else all."""
    size, waiting, best = 0, [], (0, None)
    began: dict[int, tuple[int, int]] = {}
    body = None
    for place, (kind, value) in enumerate(steps):
        if kind == "text":
            size += len(value.strip()) + 1 if value.strip() else 0
        elif kind == "open":
            began[value] = (place, size)
            waiting.append(value)
        else:
            first, before = began[value]
            waiting.pop()
            if _is_container(nodes[value]) and size - before > best[0]:
                best = (size - before, (first, place))
            if nodes[value]["tag"] == "body" and body is None:
                body = (first, place)
    span = best[1] or body
    return steps[span[0] : span[1] + 1] if span else steps


def _inline(words: str) -> str:
    return re.sub(r"([*_])", r"\\\1", re.sub(r"\s+", " ", words))


def _wrapped(words: str, mark: str) -> str:
    """Marks around words, with the blanks outside of them."""
    inner = words.strip()
    lead, tail = words[: len(words) - len(words.lstrip())], words[len(words.rstrip()) :]
    return f"{lead[:1]}{mark}{inner}{mark}{tail[:1]}" if inner else words[:1]


def _element(node: dict, inside: str, depth: int) -> str:
    """An element as Markdown around what is inside of it; depth: the lists around it."""
    tag, has = node["tag"], node["attrs"]
    words = inside.strip()
    if re.fullmatch("h[1-6]", tag):
        line = " ".join(words.split())
        if not line:
            return ""
        return f"\n\n{line}\n{('=' if tag == 'h1' else '-') * len(line)}\n\n" if tag in ("h1", "h2") else f"\n\n{'#' * int(tag[1])} {line}\n\n"
    if tag in ("b", "strong"):
        return _wrapped(inside, "**")
    if tag in ("i", "em"):
        return _wrapped(inside, "*")
    if tag in ("code", "kbd", "samp"):
        return f"`{words}`" if words else ""
    if tag == "a":
        href = has.get("href")
        if not href or not words:
            return inside
        return f"<{href}>" if words.replace("\\", "") == href and "title" not in has else f"[{words}]({href}" + (f' "{has["title"]}")' if has.get("title") else ")")
    if tag == "img":
        return f"![{has.get('alt', '')}]({has.get('src', '')})"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "pre":
        return f"\n\n```\n{inside.strip(chr(10))}\n```\n\n" if words else ""
    if tag == "blockquote":
        return "\n\n" + "\n".join(f"> {line}".rstrip() for line in words.split("\n")) + "\n\n" if words else ""
    if tag in ("ul", "ol"):
        return ("\n" + inside.strip("\n") + "\n") if depth else ("\n\n" + inside.strip("\n") + "\n\n")
    if tag in ("td", "th"):
        return " " + " ".join(words.split()) + " |"
    if tag == "tr":
        return f"|{inside.strip(chr(10))}\n" if words else ""
    if tag in ("table", "p", "div", "section", "article", "main", "header", "figure", "address", "dl", "dt", "dd"):
        return f"\n\n{words}\n\n" if words else ""
    return inside


def _add(out: list[str], words: str) -> None:
    """Put words after others, with one blank between them at most."""
    if out and out[-1].endswith(" ") and words.startswith(" "):
        words = words.lstrip(" ")
    if words:
        out.append(words)


def markdown(steps: list, nodes: list[dict]) -> str:
    """The steps of a part of a page as Markdown, walked with a stack."""
    parts: list[list[str]] = [[]]
    lists: list[list] = []
    rows = 0
    raw = 0
    for kind, value in steps:
        if kind == "text":
            if raw:
                parts[-1].append(value)
            else:
                _add(parts[-1], _inline(value))
            continue
        node = nodes[value]
        if kind == "open":
            parts.append([])
            raw += node["tag"] == "pre"
            if node["tag"] in ("ul", "ol"):
                lists.append([node["tag"], int(node["attrs"].get("start", "1")) if node["attrs"].get("start", "1").isdigit() else 1])
            elif node["tag"] == "table":
                rows = 0
            continue
        inside = "".join(parts.pop())
        raw -= node["tag"] == "pre"
        if node["tag"] in ("ul", "ol"):
            lists.pop()
        if node["tag"] == "li":
            mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else f"{'*+-'[(len(lists) - 1) % 3 if lists else 0]} "
            if lists:
                lists[-1][1] += 1
            body = re.sub(r"\n{2,}", "\n", inside.strip()).replace("\n", "\n" + " " * len(mark))
            done = f"\n{mark}{body}"
        else:
            done = _element(node, inside, len(lists))
            if node["tag"] == "tr" and done:
                rows += 1
                if rows == 1:
                    done += "|" + " --- |" * inside.count("|") + "\n"
        _add(parts[-1], done)
    text = "".join("".join(p) for p in parts)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n(?!\n)", lambda m: m.group(0) if m.group(0) == "  \n" else "\n", text)).strip()


def contents(html: str | None) -> dict | None:
    if html is None:
        return None
    page = _Stream(html)
    metas = [n["attrs"] for n in page.nodes if n["tag"] == "meta"]
    said = [m["content"] for key in TITLES for attr in ("property", "name") for m in metas if m.get(attr) == key and m.get("content")]
    steps = _kept(page.steps, page.nodes)
    left = {value for kind, value in steps if kind == "open"}
    for tag in ("h1", "title"):
        said += [" ".join(page.texts.get(n["i"], [])) for n in page.nodes if n["tag"] == tag and n["i"] in left][:1]
    lang = next((n["attrs"].get("lang") for n in page.nodes if n["tag"] == "html"), None)
    clean = lambda x: " ".join((x or "").split()) or None
    title = next((t for t in map(clean, said) if t), None)
    return {"title": title, "text": markdown(_container(steps, page.nodes), page.nodes), "language": clean(lang)}


def text_contents(html: Column) -> Column:
    """title, text and language of a page, as a struct; nulls for null."""
    return passes.column(html, contents, SCHEMA)
