import hashlib
import re

import pytest

from glimmer.llm import decontaminate as D


def toks(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = toks(t)
        for p in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[p : p + 13]), set()).update([str(i)] if i is not None else [])
    out = []
    for d, t in docs:
        w, hit, found = toks(t), set(), set()
        for win, ids in wins.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


LONG = " ".join(f"Wort{i}" for i in range(40))
ITEMS = [(1, LONG), (2, "Short one here."), (2, "Short one here."), (3, None), (4, "..."), (None, "quite nameless"), (10, "zwei"), (5, " ".join(f"wort{i}" for i in range(5, 18)))]
DOCS = [
    (1, "x " * 30 + LONG.upper() + " y" * 30),
    (2, "nothing to see"),
    (3, None),
    (4, ""),
    (5, "the short-one, HERE; and É quite nameless É zwei zwei"),
    (5, "the short-one, HERE; and É quite nameless É zwei zwei"),
    (None, "short one here " + "pad " * 100),
    (7, "w " * 20_000 + "short one here"),
    (8, " ".join(f"wort{i}" for i in range(5, 17))),
    (9, "ZWEİ zweı Zwei"),
    (11, "zwei " * 40 + LONG + " " + LONG),
]


@pytest.mark.parametrize("most", [0, 1000])
def test_against_brute_force(spark, most):
    docs = spark.createDataFrame([(*r, "q", 1) for r in DOCS], "doc_id long, text string, w string, key int")
    bench = spark.createDataFrame([(*r, "z") for r in ITEMS], "item_id long, text string, doc_id string")
    got = D.report(docs, bench, max_broadcast=most)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(DOCS, ITEMS)
    kept = D.clean(docs, bench, max_broadcast=most)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in brute(DOCS, ITEMS) if not r[5])


def test_spans_and_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    by = {r.doc_id: r.text for r in D.clean(docs, bench, remove="spans").collect()}
    assert toks(by[1]) == ["x"] * 30 + ["y"] * 30 and by[2] == "nothing to see" and by[3] is None
    assert toks(by[5]) == ["the", "and", "É", "É"]
    assert not any(r.contaminated for r in D.report(docs, bench.limit(0)).collect())
    assert D.report(docs.limit(0), bench).count() == 0


def test_stays_in_the_jvm(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = D.report(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
