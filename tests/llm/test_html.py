import html
import random
import re

import pytest

from glimmer.llm import html as H


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<article>a</article>", "a"),
        ("<p>x</p><article><h1>T &amp; t</h1><p>a <b>b</b>c<br>d\n\n e<p>f</article><footer>no", "T & t a bc d e f"),
        ("<article><p><b>one<br><p>two</p><p>three</p></article>", "one two three"),
        ("<article><header><h1>Head</h1></header><p>x</p><aside>no</aside><div class='comments'><p>no</p></div><p>y</p></article>", "Head x y"),
        ("<main><nav><ul><li>m</ul></nav><form>f<input></form><p>x&nbsp;&#233;&lt;p&gt;</p><script>if(a<b)'</p>'</script><p hidden>no</p></main>", "x é<p>"),
        ("<article><p>cut off &am", "cut off &am"), ("<article><p>a<!-- no <p>no</p> -->b</p></article>", "ab"),
        ("<article><div class='ad'>no</div><div class='add-on lead'>yes</div><p id=cookie-notice>no</p>z</article>", "yes z"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one two a b"),
    ],
)
def test_blocks(page, want):
    assert " ".join(t for z, t in H.blocks(page) if z == H.ARTICLE) == want


def test_common_is_longest():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
        got = [a[i] for i in H.common(a, b)]
        rest = iter(b)
        assert len(got) == n[-1][-1] and all(x in rest for x in got)


def test_differencing(spark):
    frame = "<div>Welcome to the site</div><div>{}</div><div>{}</div><div>All rights are ours</div>"
    rows = [(i, f"https://h.org/a/{i}", frame.format(f"text {i}", f"more {i}"), "x") for i in range(6)]
    rows += [(20, "https://h.org/alone", frame.format("single", "page"), "x"), (21, "https://h.org/b/alone", frame.format("other", "words"), "x"), (30, "https://only.org/1", "<p>kept</p>", "x")]
    rows += [(40, "https://c.org/1", "<p>a</p><p>b</p>", "x"), (41, "https://c.org/2", "<p>a</p><p>b</p>", "x"), (50, None, "<p>no url</p>", "x"), (None, None, None, "x"), (60, "u", "<p>" + "w " * 300_000, "x"), (60, "u", "<article>" + "<b>" * 3000 + "deep", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in H.extract(pages).collect()]
    by = dict(got)
    assert len(got) == len(rows) and all(by[i] == f"text {i} more {i}" for i in range(6))
    assert by[20] == "single page" and by[21] == "other words" and by[30] == "kept" and by[40] == by[41] == "a b" and by[50] == "no url" and by[None] == ""
    assert {len(t) for i, t in got if i == 60} == {599_999, 4}
    assert H.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p data-x=it's>kept</p><p title='a > b'>too</p>", "kept too"), ('<p class=x"y>a</p><p>b</p>', "a b"), ("<p>x</p><a href=/y/>link</a>", "x link"),
        ("<p class='related-work'>a</p><p id=share-price>b</p><div class='responses-to-stress'>c</div><div class='related'>no</div><div class='post ad-2'>no</div>", "a b c"),
        ("<p>a <span class=ad>no</span> b</p>", "a b"), ("<p>İstanbul</p><SCRIPT>no</p></Script ><p>b", "İstanbul b"), ("<!--><p>a</p><!-- no --!><p>b</p></3>c", "a b c"), ('<p title="open>a</p><p>b', "a b"),
    ],
)
def test_broken_markup(page, want):
    assert " ".join(t for _, t in H.blocks(page)) == want


def test_linear_in_open_elements():
    import time

    for page in ("<b>" * 20_000 + "x" + "</i>" * 20_000, "<b>" * 10_000 + "<div>" + "<i>" * 10_000 + "x" + "</b>" * 10_000, "<b>" * 20_000 + "<p>x</p>" * 20_000):
        began = time.perf_counter()
        assert H.blocks(page)
        assert time.perf_counter() - began < 2


def test_alignment_in_halves(monkeypatch):
    rng = random.Random(5)
    cases = [([rng.choice("abcdef") for _ in range(rng.randint(0, 40))], [rng.choice("abcdef") for _ in range(rng.randint(0, 40))]) for _ in range(100)]
    whole = [len(H.common(a, b)) for a, b in cases]
    monkeypatch.setattr(H, "ALIGN_BITS", 20)
    assert [len(H.common(a, b)) for a, b in cases] == whole


def brute_text(pages):
    """The definition over all pages of a host at once."""
    found = {i: [(z, t) for z, t in H.blocks(h)] for i, (_, h) in enumerate(pages)}
    place = {}
    for i, (url, _) in enumerate(pages):
        bare = re.sub(r"[?#].*$", "", re.sub(r"^https?://", "", url))
        host, _, path = bare.partition("/")
        place[i] = (host.lower(), "/" + path if "/" in bare else "")
    out = []
    for i in range(len(pages)):
        own = [t for _, t in found[i]]
        hosts = sorted(j for j in found if place[j][0] == place[i][0] and found[j])
        order = sorted(hosts, key=lambda j: (place[j][1].encode(), j))
        near = [] if i not in order else [order[k] for k in (order.index(i) - 1, order.index(i) + 1) if 0 <= k < len(order)]
        lcp = lambda j, i=i: next((k for k, (x, y) in enumerate(zip(place[i][1], place[j][1], strict=False)) if x != y), min(len(place[i][1]), len(place[j][1])))
        article, gone = [z == H.ARTICLE for z, _ in found[i]], None
        for j in sorted(near, key=lambda j: -lcp(j)):
            shared = set(H.common(own, [t for _, t in found[j]]))
            if sum(len(t) for k, t in enumerate(own) if k not in shared) >= 0.05 * sum(map(len, own)):
                gone = shared
                break
        if gone is None:
            gone = set(range(len(own))) if any(article) else set()
        out.append(" ".join(t for k, t in enumerate(own) if article[k] or k not in gone))
    return out


def test_nearest_page_decides(spark):
    """Pages without article markup, in directories of more pages than any block or range, against the definition."""
    rng = random.Random(11)
    menus = {d: "".join(f"<div>{d} entry {k}</div>" for k in range(20)) for d in ("news", "docs", "a/b")}
    pages, last = [], "<p>first sentence</p>"
    for i in range(900):
        d = rng.choice(list(menus))
        body = "".join(f"<p>{rng.choice('abcdefgh')} sentence {rng.randint(0, 10**6)} of page {i}</p>" for _ in range(3))
        last = body = rng.choice([body, body, f"<div>standfirst {i}</div><article>{body}</article>", last])
        pages.append((f"https://{rng.choice(['h.org', 'h.org', 'g.net'])}/{d}/{rng.randint(0, 5000)}{rng.choice(['', '?x=1', '#top'])}", menus[d] + body + "<div>All rights are ours</div>"))
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.page_id: r.text for r in H.extract(frame).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_text(pages)
    assert [got[i] for i in range(len(pages))] == want
    assert sum("entry 3" not in t for t in want) > 0.9 * len(want) and all("sentence" in t for t in want)


def test_query_against_plain_rules(spark):
    """The article of the test pages by a rule for their one template."""
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", p))) for p in re.split(r"</?(?:p|h1)>", body)]
        want[r.page_id] = " ".join(t for t in (" ".join(p.split()) for p in parts) if t)
    got = {r.page_id: (r.text, r.n_chars) for r in H.op6_html(spark, sf).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
