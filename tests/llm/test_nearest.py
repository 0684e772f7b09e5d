import itertools

import numpy as np

from glimmer.llm import nearest as N


def brute(ids, x, every, n):
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            s = N.exact(np.repeat(x[i : i + 1], len(x), 0), x)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:n]
            out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_pairs_are_visited_by_summed_distance():
    rng = np.random.default_rng(2)
    d1, d2, sizes = rng.random(6), rng.random(6), rng.integers(0, 5, (6, 6))
    masks = N.visited(d1, d2, sizes, 25)
    got = {(i, j) for i in range(6) for j in range(6) if int(masks[i]) >> j & 1}
    held, want = 0, set()
    for i, j in sorted(itertools.product(range(6), range(6)), key=lambda c: d1[c[0]] + d2[c[1]]):
        if held >= 25:
            break
        want.add((i, j))
        held += sizes[i, j]
    assert got == want


def test_small_tables_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[20:58] = x[19]  # one large group of equal vectors
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(3, x[3].tolist(), "b"), (None, [1.0] * 8, "c"), (70, None, "c"), (80, [0.0] * 8, "c"), (81, [float("nan")] * 8, "c"), (82, [None] * 8, "c"), (83, [float("inf")] * 8, "c"), (84, [1.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")
    got = by_query(N.nearest(df, 20).collect())
    assert got == brute(np.arange(60), x.astype(np.float64), 20, 20)
    few = by_query(N.nearest(df.where("vec_id < 5"), 2).collect())
    assert few == brute(np.arange(5), x[:5].astype(np.float64), 2, 20)
    assert N.nearest(df.limit(0), 20).count() == 0


def test_blocks_do_not_change_results(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = by_query(N.nearest(df, 9, k=8, least=200).collect())
    monkeypatch.setattr(N, "ENTRY_BLOCK", 50)
    monkeypatch.setattr(N, "QUERY_BLOCK", 30)
    assert by_query(N.nearest(df, 9, k=8, least=200).collect()) == whole


def test_repeated_ids_are_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.5, 0.1]), (1, [0.5, 0.1]), (2, [0.7, 0.0])]
    got = by_query(N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20).collect())
    assert got == {0: [(1, 0.9), (2, 0.7), (1, 0.5)]}


def test_recall_with_unequal_norms(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 16)) * rng.lognormal(0, 0.7, 3000)[:, None] * 1e-3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(np.arange(3000), x, 20, 20)
    got = by_query(N.nearest(df, 20, least=0).collect())
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
    print("recall with unequal norms", hits / 20 / len(want))
    assert hits >= 0.9 * 20 * len(want)


def test_share_follows_the_data():
    """Clusters need a small part of the entries, directions without structure a large one."""
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(100, 32))
    shares = []
    for x in (middle[rng.integers(0, 100, 4000)] + 0.1 * rng.normal(size=(4000, 32)), rng.normal(size=(4000, 32))):
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c1, c2 = N.centroids(x[:, :16]), N.centroids(x[:, 16:])
        d1, d2 = N._distances(x[:, :16], c1), N._distances(x[:, 16:], c2)
        shares.append(N.share_for(x, d1[:100], d2[:100], d1.argmin(1), d2.argmin(1), 20))
    assert shares[0] < 0.1 < 0.25 < shares[1]


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    pdf = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
    want = brute(pdf.vec_id.to_numpy(), x, 20, 20)
    got = by_query(N.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), 20, least=0).collect())
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values()) and hits >= 0.9 * 20 * len(want)


def test_runs_return_what_can_be_nearest(spark, monkeypatch):
    """Many runs of cells: each returns what can be among a query's nearest, not its own best, and the result is that without bounds."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 12))
    x[100:160] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(N, "ENTRY_BLOCK", 64)
    made = spark.sparkContext.accumulator(0)
    plain = N.rerank

    def counted(left, right, n):
        found = plain(left, right, n)
        made.add(len(found))
        return found

    monkeypatch.setattr(N, "rerank", counted)
    got = by_query(N.nearest(df, 20, share=1.0).collect())
    assert got == brute(np.arange(4000), x, 20, 20)
    assert 200 * 20 <= made.value < 200 * 20 * 5
