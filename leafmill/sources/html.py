"""Typed blocks from web pages: a true walk of each page's tags, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags that make blocks, that are passed over whole, and that mark italics.
KINDS = {
    "p": "paragraph", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "blockquote": "blockquote", "li": "list-item", "figcaption": "caption", "caption": "caption", "table": "table", "pre": "verse",
}
SKIPPED = {"head", "script", "style", "title", "nav", "svg", "meta", "link"}
ITALIC = {"i", "em", "cite", "var", "dfn"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.open: list[tuple[str, int, list[str]]] = []
        self.loose: list[str] = []
        self.deaf = 0
        self.carried: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.deaf += tag not in _VOID
        elif not self.deaf:
            if tag == "br":
                self._put(" ")
            elif tag in ITALIC:
                self._put("<i>")
            elif tag in KINDS:
                if tag == "p" and self.open and self.open[-1][0] == "p":
                    self._close()
                self._flush()
                if tag == "blockquote" or tag == "pre":
                    self.carried.append(KINDS[tag])
                self.open.append((tag, int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0, []))
            elif tag in ("td", "th", "tr"):
                self._put(" | " if tag != "tr" else "\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.deaf = max(0, self.deaf - 1)
        elif not self.deaf:
            if tag in ITALIC:
                self._put("</i>")
            elif tag in KINDS and any(tag == t for t, _, _ in self.open):
                while self.open and self.open[-1][0] != tag:
                    self._close()
                self._close()

    def handle_data(self, data):
        if not self.deaf:
            self._put(data)

    def _put(self, data: str) -> None:
        (self.open[-1][2] if self.open else self.loose).append(data)

    def _add(self, kind: str, level: int, parts: list[str]) -> None:
        lines = [" ".join(x.split()) for x in "".join(parts).split("\n")] if kind == "table" else [" ".join("".join(parts).split())]
        text = "\n".join(x.strip(" |") for x in lines if x.strip(" |"))
        if text:
            self.blocks.append((kind, level, text))

    def _flush(self) -> None:
        """What stands before a nested block is a block of its own."""
        if self.open:
            tag, level, parts = self.open[-1]
            self._add(self.carried[-1] if tag == "p" and self.carried else KINDS[tag], level, parts)
            parts.clear()
        else:
            self._add("paragraph", 0, self.loose)
            self.loose.clear()

    def _close(self) -> None:
        self._flush()
        tag, _, _ = self.open.pop()
        if tag in ("blockquote", "pre") and self.carried:
            self.carried.pop()

    def done(self) -> list[tuple[str, int, str]]:
        while self.open:
            self._close()
        self._flush()
        return self.blocks


def walk(html: str | None) -> list[tuple[str, int, str]]:
    """kind, level, text of a page's blocks."""
    parser = _Walk()
    parser.feed(html or "")
    parser.close()
    return parser.done()


def blocks(pages: DataFrame) -> DataFrame:
    """page_id, n (from 0), kind, level, text of the blocks of each page (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, n, *b) for i, html in zip(frame["page_id"], frame["html"]) for n, b in enumerate(walk(html))]
            yield pd.DataFrame(rows, columns=["page_id", "n", "kind", "level", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInPandas(run, f"page_id {kind}, n int, kind string, level int, text string")


def text_of(html: Column) -> Column:
    """All text between tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"\s+", " "))
