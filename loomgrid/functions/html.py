"""HTML to text and links by a standard parser, in Arrow batches: nesting is beyond expressions."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DROPPED = set("aside footer header iframe nav noscript script style".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
MOST = 8000


class Tree(HTMLParser):
    """Texts with the regions that are open around them."""

    def __init__(self) -> None:
        HTMLParser.__init__(self, convert_charrefs=True)
        self.open, self.parts, self.seen = [], {k: [] for k in ("main", "article", "content", "body", "all")}, set()
        self.links, self.link = [], None

    def region(self, tag: str, attributes: dict) -> str:
        if tag in DROPPED:
            return "dropped"
        if tag in ("main", "article", "body"):
            return tag
        name = (attributes.get("class") or "").lower()
        return "content" if tag == "div" and any(x in name for x in ("content", "main", "body")) else ""

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        if tag not in VOID:
            self.open.append((tag, r := self.region(tag, attributes)))
            if not any(x == "dropped" for _, x in self.open[:-1]):
                self.seen.add(r)
        if tag == "a":
            self.link = [attributes.get("href") or "", attributes.get("class") or "", ""]

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        if tag == "a" and self.link:
            self.links.append(self.link)
            self.link = None

    def handle_data(self, data):
        if self.link:
            self.link[2] += data
        regions = {r for _, r in self.open}
        if "dropped" in regions or not data.strip():
            return
        for k in ("main", "article", "content", "body"):
            if k in regions:
                self.parts[k].append(data)
        self.parts["all"].append(data)


def parsed(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree


def text_of(html: str | None, most: int = MOST) -> str | None:
    """Lines of the first region there is: main, article, a content block, body, or the whole."""
    if html is None:
        return None
    tree = parsed(html)
    for k in ("main", "article", "content", "body", "all"):
        if k == "all" or k in tree.seen:
            lines = [x.strip() for d in tree.parts[k] for x in d.splitlines()]
            text = "\n".join(x for x in lines if x)
            return text if len(text) <= most else text[:most] + " [truncated]"
    return ""


def main_text(html: Column) -> Column:
    @F.arrow_udf("string")
    def f(pages: pa.Array) -> pa.Array:
        return pa.array([text_of(x) for x in pages.to_pylist()], pa.string())

    return f(html)


def links(html: Column) -> Column:
    """Every link in order: href, class, text."""

    @F.arrow_udf("array<struct<href:string,class:string,text:string>>")
    def f(pages: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("href", pa.string()), ("class", pa.string()), ("text", pa.string())]))
        return pa.array([None if x is None else [{"href": a, "class": b, "text": " ".join(c.split())} for a, b, c in parsed(x).links] for x in pages.to_pylist()], kind)

    return f(html)
