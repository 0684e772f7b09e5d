import numpy as np
import pytest

from glimmer.llm import mix as M


def reshared(sizes, most=3):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        t = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = [s for s in free if t[s] > most * sizes[s]]
        if not over:
            return t
        capped.update(over)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    pi, docs, words = np.full(5000, 0.37), rng.integers(1, 3, 5000).astype(float), rng.integers(0, 900, 5000).astype(float)
    out = M.flight(pi, docs, docs * words, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs((out * docs).sum() - (pi * docs).sum()) < 1e-5 and abs((out * docs * words).sum() - (pi * docs * words).sum()) < 1e-2
    landed = M.flight(pi, docs, docs * words, rng, land=True)
    assert set(landed) <= {0.0, 1.0} and abs((landed * docs * words).sum() - (pi * docs * words).sum()) < 5


def test_flight_keeps_the_mean():
    out = np.mean([M.flight(np.array([0.2, 0.5, 0.7, 0.9]), np.ones(4), np.array([1.0, 5, 9, 2]), np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.allclose(out, [0.2, 0.5, 0.7, 0.9], atol=0.03)


ROWS = [(i, "w " * (i % 50), f"s{i % 7 if i % 3 else 0}", "x") for i in range(3000)] + [(5, None, None, None), (5, None, None, None), (None, "a b c", None, "y"), (6, "a b c", None, "y"), (7, "", "empty", "z"), (8, "long " * 20_000, "s3", "z")]


@pytest.mark.parametrize("block", [20_000, 100])
def test_mix(spark, block):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string, size string")
    got = M.decide(docs, block=block).collect()
    assert sum(r.n for r in got) == len(ROWS)
    sizes = {}
    for _, t, s, _ in ROWS:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = reshared(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.copies <= 3 for r in mine)
        assert abs(sum(r.copies * r["size"] * r.n for r in mine) - want[s]) <= (max(r["size"] for r in mine) if s == "s3" else 5 + 0.002 * want[s])  # one text has most of its source
    again = M.decide(docs.repartition(5), block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_caps_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "a", 0), (2, "b " * 500, "b", 0), (3, "c " * 10, "c", 0)], "doc_id long, text string, source string, n int")
    want = reshared({"a": 1, "b": 500, "c": 10})
    assert {r.source: round(r.target, 6) for r in M.decide(docs).collect()} == {s: round(t, 6) for s, t in want.items()}
    assert M.decide(docs.limit(0)).count() == 0
    taken = M.take(spark, docs, "")
    assert taken.columns == [*docs.columns, "copies"] and {r.doc_id for r in taken.collect()} >= {1}


REPEATED = [[(None, "w " * 10, "a", 0)] * 2000, [(4, "w " * 10, "a", 0)] * 2000, [(None, "w " * 10, "a", 0)] * 900 + [(None, "v " * 10, "a", 0)] * 1100]


@pytest.mark.parametrize("same", REPEATED)
@pytest.mark.parametrize("more", [0, 300])
def test_repeated_rows(spark, same, more):
    """One row many times in a source: what is taken is as near the target as without repeats, in the query's rows and in the documents taken."""
    rows = [*same, *[(10 + i, "x " * (i % 90), "a", 0) for i in range(more)], *[(5000 + i, "y " * 5, "b", 0) for i in range(1000)], *[(9000 + i, "z " * 8, "c", 0) for i in range(500)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(7)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = reshared(sizes)
    got = M._repeated(M.decide(docs)).collect()
    assert len(got) == len(rows)
    taken = M.take(spark, docs, "").collect()
    for s in sizes:
        assert abs(sum(r.copies * r["size"] for r in got if r.source == s) - want[s]) <= 10
        assert abs(sum(r.copies * len(r.text.split()) for r in taken if r.source == s) - want[s]) <= 10
    assert sorted((str(r.doc_id), r["size"], r.source, r.copies) for r in got if r.copies) == sorted((str(r.doc_id), len(r.text.split()), r.source, r.copies) for r in taken)


def test_very_many_repeats(spark, monkeypatch):
    monkeypatch.setattr(M, "REPEATS", 7)
    docs = spark.createDataFrame([(None, "a b", "s", 0)] * 50 + [(1, "c", "s", 0)] * 7, "doc_id long, text string, source string, n int")
    assert sorted((str(r.doc_id), r.copies) for r in M._repeated(M.decide(docs)).collect()) == [("1", 1)] * 7 + [("None", 1)] * 50


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = M.op4_mix(spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert abs(by.target.sum() - got["size"].sum()) < 1e-3
    assert (abs(by.taken - by.target) <= 0.002 * by.target + 5).all()
    assert (got.taken <= 3 * got["size"]).all()
