"""HTML pages as documents: headings and blocks of some length, without page furniture."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements that are left out, and elements that make a block.
_OUT = {"script", "style", "nav", "footer", "aside", "noscript", "form", "svg"}
_HEADINGS = {"h1", "h2", "h3"}
_KEPT = _HEADINGS | {"p", "li", "td", "blockquote"}
_DATES = {"article:published_time", "datepublished", "date", "dc.date", "pubdate"}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.title, self.published = "", None
        self.out, self.tag, self.held = 0, "", []

    def close_block(self) -> None:
        text = " ".join("".join(self.held).split())
        if text and self.tag == "title":
            self.title = text
        elif text and self.tag:
            self.blocks.append((self.tag, text))
        self.tag, self.held = "", []

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "meta" and self.published is None:
            a = {k: v or "" for k, v in attrs}
            if (a.get("property") or a.get("name") or a.get("itemprop", "")).lower() in _DATES:
                self.published = a.get("content", "")[:10] or None
        if tag in _OUT:
            self.close_block()
            self.out += 1
        elif not self.out and (tag in _KEPT or tag == "title"):
            self.close_block()
            self.tag = tag
        elif tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag) -> None:
        if tag in _OUT:
            self.out = max(0, self.out - 1)
        elif tag == self.tag:
            self.close_block()

    def handle_data(self, data) -> None:
        if not self.out and self.tag:
            self.held.append(data)


def parsed(page: str | None, least_block: int = 40, least_text: int = 200) -> tuple[str, str, str | None] | None:
    """(title, text, published) of a page; None if it has too little text."""
    p = _Blocks()
    p.feed(page or "")
    p.close()
    p.close_block()
    text = "\n".join(t for tag, t in p.blocks if tag in _HEADINGS or len(t) >= least_block)
    return (p.title, text, p.published) if len(text) >= least_text else None


def documents(pages: DataFrame, key: str = "page_id", html: str = "html", least_block: int = 40, least_text: int = 200) -> DataFrame:
    """(key, title, text, published) of the pages that have enough text."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *d) for k, h in zip(pdf[key], pdf[html], strict=True) if (d := parsed(h, least_block, least_text))]
            yield pd.DataFrame(rows, columns=[key, "title", "text", "published"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).mapInPandas(parse, f"{key} {kind}, title string, text string, published string")
