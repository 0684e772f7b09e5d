"""Main text of web pages: differencing with the nearest page by URL, between zones that markup names.

A page is cut into blocks of text, its lines, in one parse. Elements that hold no text of the page (nav, footer,
aside, form, script and their like, and classes, ids and roles that are names of such parts) are dropped, and an
explicit article (or main) element is kept whole: lines there that other pages have too are quotations and
copies, and belong to the article. All other lines are decided by the nearest page: pages are paired with
the page of their host whose URL path is nearest, the lines of both are aligned by their longest common
subsequence, and shared lines are deleted.

The nearest path is the one with the longest common prefix, which is next to it in the order of paths. So pages are sorted by
range over (host, path, id), and each is compared with the one before or after it; the border rows of
the ranges are carried over. A host with a third of all pages is many ranges, and the same page is nearest at every size.
Only hashes of lines are sorted and compared; texts stay where they were written, and are joined with the decision
only where a page has lines to decide.

Two pages that have nearly all characters in common (less than `COPY` of them are their own) are copies of one text, not
two texts in one template: then the neighbour on the other side is taken, and if that is none or a copy too, nothing
is deleted. Of a page with an article and no such neighbour, the article alone is kept.

Defined results: a null or empty html gives an empty text; a null url is a host of its own, where pages are
in order of their ids; broken markup (tags left open, quotes not closed, a page cut off) is read as browsers do, as far as it goes;
repeated rows are each reported; an empty table gives an empty result. Other columns of the input are left alone and can have any name.
"""

from __future__ import annotations

import html as entities
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.session import table, written

COPY = 0.05
#: Bits of the table of one alignment; longer pages are halved first.
ALIGN_BITS = 1 << 27
# Elements of HTML by what they mean here.
_RAW = {"script", "style", "template", "noscript", "svg", "math", "iframe", "textarea", "title", "object", "canvas", "audio", "video", "xmp"}
_DROP = {"nav", "footer", "aside", "form", "head", "button", "select", "menu", "dialog", "fieldset", "input", "label", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | _DROP
# A start tag of these ends an open one of the same kind within its container.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Names of parts that are no text of the page. A class or id is one of them as a whole, or with a word for a box before or after it.
_PARTS = r"ads?|adverts?|advertisements?|advertising|adsbygoogle|sponsored|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscribe|subscription|signup|sign-up|login|comments?|commentlist|disqus|disqus_thread|replies|reply|responses|side-?bar|menu|navbar|nav|navigation|breadcrumbs?|footer|masthead|topbar|toolbar|share|sharing|social|related|recommended|recommendations|popup|modal|overlay|widgets?|pagination|pager|skip-?link|legal|copyright|site-?header|page-?header"
_BAD_NAME = re.compile(rf"(?:(?:site|page|main|top|bottom|left|right|global|user|reader)[-_])?(?:{_PARTS})(?:[-_]?\d[\dx]*|[-_](?:ads?|notice|banner|menu|nav|bar|box|list|lists|section|wrap|wrapper|container|area|block|links?|buttons?|form|inner|items?|widget|unit|slot|panel|top|bottom|left|right))?", re.I)
_BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
# Quotes count only around a value, just after "=".
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|$)|<[!?/][^>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*(?:>|$)", re.I) for tag in _RAW}
DROPPED, UNDECIDED, ARTICLE = 0, 1, 2


def _is_bad(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in _DROP or (tag == "header" and not in_article):
        return True
    if not attributes or attributes.isspace() or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and any(_BAD_NAME.fullmatch(x) for x in value.split()):
            return True
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in _BAD_ROLE):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Open:
    """The open elements, with the zone inside each. Elements of a name, and blocks, are found without a search: any page is read in linear time."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.zones: list[int] = []
        self.of: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def zone(self) -> int:
        return self.zones[-1] if self.zones else UNDECIDED

    def push(self, name: str, zone: int) -> None:
        at = len(self.names)
        self.names.append(name)
        self.zones.append(zone)
        self.of.setdefault(name, []).append(at)
        if name in _BLOCKS:
            self.blocks.append(at)

    def close(self, at: int) -> None:
        while len(self.names) > at:
            name = self.names.pop()
            self.zones.pop()
            if name:
                self.of[name].pop()
            if name in _BLOCKS:
                self.blocks.pop()

    def forget(self, at: int) -> None:
        """An inline element closed around blocks stays for its zone, without its name."""
        self.of[self.names[at]].pop()
        self.names[at] = ""


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order, without dropped ones."""
    if not page:
        return []
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack, at = _Open(), 0

    def flush() -> None:
        if held:
            zone = stack.zone()
            text = " ".join(entities.unescape("".join(held)).split()) if zone != DROPPED else ""
            if text:
                out.append((zone, text))
            held.clear()

    while at < len(page):
        m = _TOKEN.search(page, at)
        held.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br":
            held.append(" ")
            continue
        if m[1]:
            if tag in _BLOCKS:
                flush()
            if places := stack.of.get(tag):
                i = places[-1]
                if tag not in _BLOCKS and stack.blocks and stack.blocks[-1] > i:
                    stack.forget(i)
                else:
                    if stack.zone() != (stack.zones[i - 1] if i else UNDECIDED):
                        flush()
                    stack.close(i)
            continue
        if tag in _RAW and not m[3].endswith("/"):
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _BLOCKS:
            flush()
        if stack.blocks and stack.names[stack.blocks[-1]] in _CLOSES.get(tag, ()):
            stack.close(stack.blocks[-1])
        if tag in _VOID or m[3].endswith("/"):
            continue
        inside = zone = stack.zone()
        if zone != DROPPED:
            if _is_bad(tag, m[3], zone == ARTICLE):
                inside = DROPPED
            elif tag in ("article", "main"):
                inside = ARTICLE
        if inside != zone:
            flush()
        stack.push(tag, inside)
    flush()
    return out


def _rows(a: list, b: list) -> Iterator[int]:
    """Bit j of the i-th number is 0 where the length of the common subsequence of a[:i] and b[:j] grows with b[j]."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    yield v
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & full
        yield v


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the common subsequences of a and b[:j] for each j."""
    v = 0
    for v in _rows(a, b):  # noqa: B007
        pass
    grows = 1 - np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(grows)])


def _aligned(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > ALIGN_BITS:  # in halves, so the table stays small
        mid = len(a) // 2
        cut = int((_lengths(a[:mid], b) + _lengths(a[mid:][::-1], b[::-1])[::-1]).argmax())
        return [*_aligned(a[:mid], b[:cut]), *[mid + i for i in _aligned(a[mid:], b[cut:])]]
    rows, out, j = list(_rows(a, b)), [], len(b)
    length = lambda row, j: j - (row & ((1 << j) - 1)).bit_count()
    # Lengths are counted back along a.
    for i in range(len(a) - 1, -1, -1):
        n = length(rows[i + 1], j)
        if n == 0:
            break
        if length(rows[i], j) == n:
            continue
        out.append(i)
        while length(rows[i + 1], j - 1) == n:  # the match is the last place where the length grew
            j -= 1
        j -= 1
    return out[::-1]


def common(a: list, b: list) -> list[int]:
    """Indexes into `a` of a longest common subsequence; equal ends are matched first."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    m = 0
    while m < most - n and a[len(a) - 1 - m] == b[len(b) - 1 - m]:
        m += 1
    return [*range(n), *[n + i for i in _aligned(a[n : len(a) - m], b[n : len(b) - m])], *range(len(a) - m, len(a))]


def decided(zones: list[int], lines: list, sizes: list[int], path: str, near: list[tuple[str, list]]) -> list[bool]:
    """Which lines are kept, of a page at `path` with neighbours (path, lines) of its host: the one before it, then the one after it."""
    total = sum(sizes)
    for _, other in sorted(near, key=lambda x: -len(os.path.commonprefix([path, x[0]]))):
        shared = set(common(lines, other))
        if sum(s for i, s in enumerate(sizes) if i not in shared) >= COPY * total:
            return [z == ARTICLE or i not in shared for i, z in enumerate(zones)]
    return [z == ARTICLE or ARTICLE not in zones for z in zones]


_PARSED = "_row long, page_id {id}, url string, text string, lines array<string>, zones array<int>, hashes array<long>, sizes array<int>"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [blocks(x) for x in pdf.html]
        whole = [all(z == ARTICLE for z, _ in b) for b in found]
        yield pd.DataFrame(
            {
                "_row": pdf["_row"], "page_id": pdf.page_id, "url": pdf.url,
                "text": [" ".join(t for _, t in b) if w else None for b, w in zip(found, whole, strict=True)],
                "lines": [None if w else [t for _, t in b] for b, w in zip(found, whole, strict=True)],
                "zones": [[z for z, _ in b] for b in found],
                "hashes": [[xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for _, t in b] for b in found],
                "sizes": [[len(t) for _, t in b] for b in found],
            }
        )


def _differ(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            near = [(x["path"], list(x["hashes"])) for x in (r.before, r.after) if x is not None and x["host"] == r.host]
            out.append(decided(list(r.zones), list(r.hashes), list(r.sizes), r.path, near))
        yield pd.DataFrame({"_row": pdf["_row"], "keep": out})


def _neighbours(rows: DataFrame) -> DataFrame:
    """Rows of (host, path, page_id, hashes, ...) with the rows before and after each in order of host, path and id, as structs (host, path, hashes)."""
    order = ["host", "path", "page_id", "_row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumns({"part": F.spark_partition_id(), "mid": F.monotonically_increasing_id()}), "ranges")
    own = F.struct("host", "path", "hashes")
    # A range has two border rows, and a row of this table.
    ends = ranged.groupBy("part").agg(F.min_by(own, "mid").alias("first"), F.max_by(own, "mid").alias("last"))
    by_part = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(by_part).alias("left"), F.lead("first").over(by_part).alias("right"))
    inside = Window.partitionBy("part").orderBy("mid")
    placed = ranged.withColumns({"before": F.lag(own).over(inside), "after": F.lead(own).over(inside)})
    placed = placed.join(F.broadcast(ends), "part")
    return placed.withColumns({"before": F.coalesce("before", "left"), "after": F.coalesce("after", "right")}).drop("left", "right", "part", "mid")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for each page."""
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = written(rows.mapInPandas(_parse, _PARSED.format(id=rows.schema["page_id"].dataType.simpleString())), "lines")
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://", ""), r"[?#].*$", "")
    host, path = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/]*", 0)), "^www[.]", ""), F.regexp_extract(bare, r"^[^/]*(.*)$", 1)
    placed = _neighbours(rows.where(F.size("hashes") > 0).select("_row", "page_id", host.alias("host"), path.alias("path"), "zones", "hashes", "sizes"))
    keep = placed.where(F.array_contains("zones", UNDECIDED)).select("_row", "host", "path", "zones", "hashes", "sizes", "before", "after").mapInPandas(_differ, "_row long, keep array<boolean>")
    kept = F.array_join(F.filter("lines", lambda _, i: F.get("keep", i)), " ")
    decided_ = rows.where("text is null").join(keep, "_row").select("page_id", "url", kept.alias("text"))
    return rows.where("text is not null").select("page_id", "url", "text").unionByName(decided_)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
