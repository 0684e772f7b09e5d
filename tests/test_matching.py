import random

import pytest

from glimmer.operators import matching
from glimmer.session import new_path
from glimmer.sources import runs


def brute(left, right, least):
    out = set()
    for a, x in left:
        for b, y in right:
            i = len({t for t in x if t is not None} & set(y))
            score = round(i / min(len(set(x)), len(set(y))) if i >= 2 else i / (len(set(x)) + len(set(y)) - i), 6) if i else 0
            if i and score >= least:
                out.add((a, b, score))
    return out


def sets(spark, rows):
    return spark.createDataFrame(rows, "id long, tokens array<string>")


@pytest.mark.parametrize("least", [0.1, 0.34, 0.5, 1.0])
def test_overlap_pairs(spark, least):
    """All pairs at or above the bound, short sets, repeats and one token in all rows included."""
    r = random.Random(3)
    make = lambda k: [(i, ["all"] * r.randint(0, 2) + [f"t{int(r.paretovariate(0.6)) % 60}" for _ in range(r.randint(0, 9))] + [None] * (i % 11 == 0)) for i in range(k)]
    left, right = make(150), make(200)
    got = matching.overlap_pairs(sets(spark, left), sets(spark, right), least).collect()
    assert len(got) == len({(x.a, x.b) for x in got})
    assert {tuple(x) for x in got} == brute(left, right, least) and got


def test_frequent_token_joins_nothing(spark):
    """A token in all rows, and one in a third of them: only pairs with a rarer token in common meet."""
    rows = [(i, ["all", *(["third"] if i % 3 == 0 else []), *(f"w{i // 2}-{k}" for k in range(4))]) for i in range(1200)]
    x, y = matching.rarest_first([sets(spark, rows), sets(spark, rows)])
    met = matching.overlap_candidates(x, y, 0.34).collect()
    assert {tuple(m) for m in met} == {(i, j) for i in range(1200) for j in (i - i % 2, i - i % 2 + 1)}


def test_first_mentions(spark):
    reference = sets(spark, [(1, ["solar", "paint", "cell"]), (2, ["fuel"]), (3, [])])
    titles = spark.createDataFrame([(7, "u7", ["cell", "solar", "roof"]), (4, "u4", ["solar", "cell", "roof"]), (2, "u2", ["solar", "roof", "tile"]), (9, "u9", None), (8, "u8", ["fuel"])], "position long, url string, tokens array<string>")
    got = {tuple(r) for r in matching.first_mentions(reference, titles).collect()}
    assert got == {(1, 2, 4, "u4", 0.666667), (2, 1, 8, "u8", 1.0)}
    assert matching.first_mentions(reference.limit(0), titles).count() == 0


def test_run_folders(spark):
    """A manifest of a fixture, one cut short, one absent; a row cut short, a blank line."""
    rows, manifests = new_path(spark, "r"), new_path(spark, "m")
    lines = [("a", '{"x": 1}'), ("a", '{"x": 2'), ("a", ""), ("b", '{"x": 3}'), ("c", '{"x": 4}'), ("d", '{"x": 5}'), ("e", '{"x": 6}')]
    runs.write_folders(spark.createDataFrame(lines, "run string, value string"), rows)
    runs.write_folders(spark.createDataFrame([("a", '{"mode": "live"}'), ("b", '{"mode": "fixture"}'), ("c", '{"mode": "li'), ("e", '{"mode": "live"}')], "run string, value string"), manifests)
    found = runs.manifests(spark, manifests)
    live = runs.of_live_runs(runs.run_rows(spark, rows, "x long"), found)
    assert live.count() == 2 and runs.run_rows(spark, rows, "x long").count() == 5 and found.count() == 3
    assert sorted(tuple(r) for r in live.select("run_id", "x").collect()) == [("a", 1), ("e", 6)]
    assert [r.run_id for r in runs.catalogue(found, 2).collect()] == ["e", "b"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quotes_of_all_lengths(spark):
    """Quotes of 15 to 300 characters, some above the first plane, of texts that repeat themselves: each pair once, and texts are not moved."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("aé\n😀 ") for _ in range(r.randint(1, 9)))
    line = "".join(word() for _ in range(40))
    texts = ["".join(word() for _ in range(120)) + line * (i % 3) + word() for i in range(25)] + [None, "", "short"]
    quotes = [(i, (t := texts[r.randrange(25)])[(p := r.randrange(len(t))) : p + r.randint(15, 300)] + ("x" if i % 9 == 0 else "")) for i in range(300)] + [(300, None)]
    q, t = spark.createDataFrame(quotes, "quote_id long, quote string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, d) for i, x in quotes for d, y in enumerate(texts) if x and len(x) >= 20 and x in (y or ""))
    found = matching.contained(q, t)
    assert sorted(tuple(x) for x in found.collect()) == want and want
    assert sorted(x.quote_id for x in matching.held(q, t).collect()) == sorted({i for i, _ in want})
    assert "hashpartitioning(doc_id" not in plan(found)
    assert matching.contained(q.limit(0), t).count() == matching.contained(q, t.limit(0)).count() == 0


def test_quotes_are_cut_before_they_move(spark):
    from glimmer.plans import inputs

    shown = plan(inputs.quotes(spark, "/root/testdata/sf0.001"))
    below = shown[shown.index("Join") :] if "Join" in shown else shown
    assert "substr" in below


def test_evidence_pick_counts_unknown_owners(spark):
    """Rows without an owner or card are of one owner and of one card; a card of many batches keeps its counters."""
    from glimmer.operators import select

    rows = [(1, "q", i, None, i) for i in range(5)] + [(None, "q", i, i % 3, i) for i in range(6)] + [(2, f"q{i % 40:02}", i, i % 7, i) for i in range(25_000)]
    got = select.picked(spark.createDataFrame(rows, "card long, query string, rank long, owner long, id long"), 3).collect()
    queries, owners, want = {}, {}, set()
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[4])):
        if queries.get((r[0], r[1]), 0) < 3 and owners.get((r[0], r[3]), 0) < 2:
            queries[r[0], r[1]], owners[r[0], r[3]] = queries.get((r[0], r[1]), 0) + 1, owners.get((r[0], r[3]), 0) + 1
            want.add(r)
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 2 + 3 + 14
    assert "FlatMapGroupsInPandas" not in plan(select.picked(spark.createDataFrame(rows[:1], "card long, query string, rank long, owner long, id long"), 3))


def test_texts_come_in_slices(spark):
    """Whatever Spark's batches hold, few rows at a time; keys may be null."""
    import pandas as pd

    from glimmer.session import in_slices

    sizes = lambda parts: (pd.DataFrame({"k": p["k"], "n": len(p)}) for p in parts)
    rows = spark.range(0, 3000, 1, 1).selectExpr("nullif(id, 7) AS k")
    got = in_slices(rows, sizes, "k bigint, n int").collect()
    assert max(r.n for r in got) == 256 and len(got) == 3000 and [r.k for r in got if r.k is None] == [None]


def test_packets_are_cut_by_a_sketch(spark, monkeypatch):
    """No exact percentile, which would hold every distinct time in one task."""
    from glimmer.plans import scans

    def exact(*_):
        raise AssertionError("all times in one task")

    monkeypatch.setattr(scans.F, "percentile", exact)
    assert scans.st2(spark, "/root/testdata/sf0.001").count() == 5
