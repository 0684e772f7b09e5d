import numpy as np
import pytest
import xxhash

from glimmer.llm import simhash as S


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(x, least.get(root(i), x))
    return {x: least[root(i)] for i, x in enumerate(ids)}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "A b c D", "a b c d e f g É é Ü", "x " * 5000, "nbsp stays one word here now"])
def test_fingerprint(text):
    assert S.simhash(text.encode() if text is not None else None) == brute_fingerprint(text)


def test_every_word_has_one_home_and_meets_its_neighbours():
    rng = np.random.default_rng(3)
    p = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    q = p.copy()
    for _ in range(4):
        q ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    homes, reach = {}, {}
    for b, i, a, h in S._copies(p, 2):
        for x, y in zip(i[h], a[h], strict=True):
            assert (b, x) not in homes
            homes[b, x] = y
    for b, i, a, _ in S._copies(q, 2):
        for x, y in zip(i, a, strict=True):
            reach.setdefault((b, x), set()).add(y)
    assert all(any(homes[b, i] in reach[b, i] for b in range(3)) for i in range(300))


@pytest.mark.parametrize("max_group", [20_000, 40])
def test_links_against_brute_force(spark, max_group):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.repeat(base, 8)
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    dense = np.full(200, base[0])  # one large group around one point
    for _ in range(2):
        dense ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    fps = np.unique(np.concatenate([base, near, dense, [np.uint64(0), np.uint64(1)]]))
    points = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = S.connected_components(S.links(points, max_group=max_group)).collect()
    got = {r.node: r.component for r in found}
    ids = fps.view(np.int64).tolist()
    want = brute_components(ids, fps.tolist())
    assert {x: got.get(x, x) for x in ids} == want


def test_rows_and_odd_input(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, None, None), (4, "", "x"), (5, " ".join(f"w{i}" for i in range(30_000)), "z"), (5, " ".join(f"w{i}" for i in range(30_000)), "z"), (None, "a b c d e f g", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(S.components(docs).collect(), key=str)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and by[None].component_id == 1 and by[4].component_id == 3 and by[3].fp == 0 and by[5].component_id == 5
    kept = S.keep_one(spark, docs, "").collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3, 5, 5]
    assert S.components(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    want = brute_components(list(fps), list(fps.values()))
    got = S.op3_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_keep_one_by_row(spark):
    a, b = (" ".join(f"{w}{i * i % 97}" for i in range(60)) for w in ("alpha", "other"))
    rows = [(1, a), (2, a), (2, b), (3, b)]
    got = S.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, a), (2, b)]
