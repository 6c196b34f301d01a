"""Parsing HTML into typed spans, one row per element, in Arrow batches on the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HIDDEN = {"script", "style"}
_FURNITURE = {"script", "style", "nav", "footer", "header", "aside"}


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def strings(self, skip: set[str] = _HIDDEN) -> Iterator[str]:
        todo = [iter(self.children)]
        while todo:
            for c in todo[-1]:
                if isinstance(c, str):
                    yield c
                elif c.tag not in skip:
                    todo.append(iter(c.children))
                    break
            else:
                todo.pop()

    def text(self) -> str:
        return "".join(s.strip() for s in self.strings())

    def find(self, tag: str) -> list[_Node]:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if n.tag == tag and n is not self:
                out.append(n)
            todo.extend(c for c in reversed(n.children) if isinstance(c, _Node))
        return out


class _Tree(HTMLParser):
    """An element ends with its own end tag or that of an element around it; unknown end tags are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag):
        for n in range(len(self.open) - 1, 0, -1):
            if self.open[n].tag == tag:
                del self.open[n:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> _Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def page_metadata(root: _Node) -> dict[str, str]:
    """Description, keywords and author (the first of each), og_* and twitter_* (the last of each)."""
    out: dict[str, str] = {}
    for m in root.find("meta"):
        name, prop, value = m.attrs.get("name", ""), m.attrs.get("property", ""), m.attrs.get("content", "")
        if value:
            if name in ("description", "keywords", "author"):
                out.setdefault(name, value)
            for key in (name, prop):
                for prefix in ("og:", "twitter:"):
                    if key.startswith(prefix):
                        out[key.replace(":", "_", 1)] = value
    return out


def page_rows(html: str, links: bool = True) -> list[tuple]:
    """(type, level, href, text) of the title, the headings by level, the paragraphs, the links, and the metadata."""
    root = tree(html)
    rows = [("title", None, None, "".join(t.strings()).strip()) for t in root.find("title")[:1]]
    for level in range(1, 7):
        rows += [("heading", level, None, h.text()) for h in root.find(f"h{level}")]
    rows += [("paragraph", None, None, re.sub(r"\s+", " ", "".join(p.strings())).strip()) for p in root.find("p")]
    if links:
        rows += [("link", None, a.attrs["href"], a.text()) for a in root.find("a") if a.attrs.get("href")]
    if meta := page_metadata(root):
        rows.append(("metadata", None, None, "\n".join(f"{k}: {v}" for k, v in meta.items())))
    return [r for r in rows if r[3]]


def plain_text(html: str, keep_links: bool = False) -> str:
    """The text of a page without scripts, styles, navigation, headers, footers and asides, cleaned."""
    root = tree(html)
    if keep_links:
        for a in root.find("a"):
            if a.attrs.get("href") and len(a.children) == 1 and isinstance(a.children[0], str):
                a.children = [f"{a.children[0].strip()} ({a.attrs['href']})"]
    text = "\n".join(s for s in (x.strip() for x in root.strings(_FURNITURE)) if s)
    text = re.sub(r"\n\s*\n\s*\n+", "\n\n", re.sub(r" +", " ", text))
    return "\n".join(line.strip() for line in text.split("\n")).strip()


def parse_html(df: DataFrame, id_col: str, html_col: str, links: bool = True) -> DataFrame:
    """``id, ordinal, type, level, href, text, span_start, span_end`` of each non-empty element.

    Spans count code points of the texts joined by one sign. Null and empty pages have no rows; malformed ones are read
    as far as they go. Pages are parsed where they are read; no shuffle.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter("html <> ''")
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "ordinal", "type", "level", "href", "text", "span_start", "span_end"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for at, html in enumerate(batch.column("html").to_pylist()):
                offset = 0
                for n, (typ, level, href, text) in enumerate(page_rows(html, links)):
                    for column, x in zip(out, (at, n, typ, level, href, text, offset, offset + len(text))):
                        column.append(x)
                    offset += len(text) + 1
            types = [None, pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            ids = batch.column("id").take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, t) for x, t in zip(out[1:], types[1:])]], names=names)

    return rows.mapInArrow(parse, f"id {kind}, ordinal int, type string, level int, href string, text string, span_start long, span_end long")
