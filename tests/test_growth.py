"""Redirects, the query gate, batches and acceptance against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import gate, growth, redirects, select
from glimmer.streaming import admission


def plain_ends(edges):
    to = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            to[a] = min(b, to.get(a, b))
    out = {}
    for a in to:
        seen, at = [], a
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        out[a] = min(seen[seen.index(at) :]) if at in to else at
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_redirects(spark, seed):
    r = random.Random(seed)
    chain = [(i, i + 1) for i in range(0, 37)]
    loops = [(100, 101), (101, 102), (102, 100), (103, 102), (104, 103), (200, 201), (201, 200), (300, 300), (301, None), (None, 5), (302, 303), (302, 299)]
    many = [(1000 + i, 999) for i in range(50)]
    mixed = [(2000 + i, 2000 + r.randrange(60)) for i in range(50)]
    edges = chain + loops + many + mixed
    got = {x.src: x.final for x in redirects.resolved(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == plain_ends(edges)


def test_redirects_of_chains_alone(spark):
    got = redirects.resolved(spark.createDataFrame([("b", "c"), ("a", "b"), ("x", "c")], "src string, dst string")).collect()
    assert {x.src: x.final for x in got} == {"a": "c", "b": "c", "x": "c"}
    assert redirects.resolved(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_batches_end_without_growth(spark, tmp_path):
    rows = [(0, 1, "Ab "), (0, 2, "ab"), (0, 3, None), (0, 4, " "), (1, 5, "c"), (1, 6, "AB"), (2, 7, "c"), (2, 8, "ab"), (3, 9, "never seen")]
    answers = spark.createDataFrame(rows, "batch int, id long, name string")
    path = f"file://{tmp_path}/h"
    got = sorted((r.name, r.id, r.batch) for r in growth.until_no_growth(answers, path).collect())
    assert got == [("ab", 1, 0), ("c", 5, 1)]
    # What is complete is not worked out again; a batch that was broken off is.
    (tmp_path / "h" / "batch=1" / "_SUCCESS").unlink()
    changed = answers.withColumn("name", F.when(F.col("id") == 1, "zz").otherwise(F.col("name")))
    assert sorted((r.name, r.id) for r in growth.until_no_growth(changed, path).collect()) == [("ab", 1), ("c", 5)]
    assert [(r.name, r.batch) for r in growth.until_no_growth(answers, f"file://{tmp_path}/few", 1).collect()] == [("ab", 0)]
    assert growth.until_no_growth(answers.limit(0), f"file://{tmp_path}/none").count() == 0


def plain_accept(rows):
    heads, pairs = {}, set()
    for key, _, _, evidence, mechanism, date in sorted(rows, key=lambda r: (r[1], r[2])):
        m = mechanism or ""
        h = heads.get(key)
        if h is None:
            heads[key] = [m, date, 1, 1, 0, 0]
        else:
            h[2], h[4] = h[2] + 1, h[4] + 1
            h[5] += evidence is not None and (key, evidence) not in pairs
            if h[0] and len(m) > len(h[0]) and h[0].lower() in m.lower():
                h[0] = m
            h[1] = h[1] or date
        if evidence is not None:
            pairs.add((key, evidence))
    return {k: tuple(v) for k, v in heads.items()}, pairs


SCHEMA = "key string, at long, id long, evidence string, mechanism string, event_date string"


def proposals(n, seed):
    r = random.Random(seed)
    word = "A film of Water"
    text = lambda: r.choice([None, "", "other", word[r.randrange(3) : 3 + r.randrange(13)], word.lower()[: r.randrange(1, 15)]])
    return [(r.choice([None, "hot", "hot", "hot", "b", "c"]), i // 3, i, r.choice([None, "q1", "q2", f"q{i % 40}"]), text(), r.choice([None, None, "2024-01-02", "2023"])) for i in range(n)]


def test_acceptance(spark):
    rows = proposals(300, 4)
    heads, pairs = growth.accept(spark.createDataFrame(rows, SCHEMA).repartition(4))
    want = plain_accept(rows)
    assert {r.key: tuple(r)[1:] for r in heads.collect()} == want[0]
    assert {tuple(r) for r in pairs.collect()} == want[1]


def test_acceptance_across_packets_and_replay(spark, tmp_path):
    rows = proposals(120, 9)
    source, path, state = (f"file://{tmp_path}/{x}" for x in ("source", "state", "checkpoint"))
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], SCHEMA).write.mode("append").parquet(source)
        admission.merge_evidence(spark.readStream.schema(SCHEMA).parquet(source), path, state).awaitTermination()
    want = plain_accept(rows)
    got = lambda: {r.key: tuple(r)[1:] for r in admission.heads_of(spark, path).collect()}
    assert got() == want[0] and {tuple(r) for r in admission.pairs_of(spark, path).collect()} == want[1]
    # The last packet again, as after a driver that was lost before the commit.
    for name in ("2", ".2.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    admission.merge_evidence(spark.readStream.schema(SCHEMA).parquet(source), path, state).awaitTermination()
    assert got() == want[0] and admission.pairs_of(spark, path).count() == len(want[1])


def test_query_gate(spark):
    """Every verdict, and beside it a case that lacks one condition of it."""
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    near = 0.815 * basis[0] + np.sqrt(1 - 0.815**2) * basis[1]
    cases = {
        "one": [(basis[0], 12, "")], "few": [(basis[0], 5, "")], "hosts": [(basis[0], 12, "")], "two": [(basis[0], 8, ""), (basis[1], 4, "")], "near": [(basis[0], 8, ""), (near, 4, "")], "small second": [(basis[0], 10, ""), (basis[1], 3, "")],
        "broad": [(basis[i], 2, "") for i in range(6)], "broad but one": [(basis[0], 6, "")] + [(basis[i], 1, "") for i in range(1, 6)], "shop": [(basis[0], 7, "/download"), (basis[1], 6, "")], "small shop": [(basis[0], 10, ""), (basis[1], 3, "/download")],
    }
    rows = []
    for q, parts in cases.items():
        for vector, n, page in parts:
            for _ in range(n):
                v = vector + 0.02 * rng.normal(size=16) / 4
                k = len(rows)
                rows.append((q, k, f"https://h{k % (3 if q == 'hosts' else 9)}.org/{k}{page}", (v / np.linalg.norm(v)).tolist()))
    found = gate.judged(gate.readings(spark.createDataFrame(rows, "query string, key long, url string, vector array<double>")))
    assert {r.query: r.verdict for r in found.collect()} == {
        "one": "ok", "few": "no_material", "hosts": "no_material", "two": "ambiguous", "near": "ok", "small second": "ok", "broad": "too_broad", "broad but one": "ok", "shop": "wrong_sense", "small shop": "ok",
    }


@pytest.mark.parametrize("budget", [0, 1, 7, 25, 200])
def test_least_used(spark, budget):
    r = random.Random(budget)
    used = {leaf: r.randrange(6) for leaf in "abcdefg"}
    variants = [(leaf, f"{leaf}{i}", r.randrange(1000)) for leaf in "abcdef" for i in range(r.choice([0, 1, 5, 30]))]
    left = {leaf: sorted((k, name) for own, name, k in variants if own == leaf) for leaf in used}
    level, want = dict(used), []
    while len(want) < budget and any(left.values()):
        leaf = min((x for x in left if left[x]), key=lambda x: (level[x], x))
        want.append((leaf, left[leaf].pop(0)[1]))
        level[leaf] += 1
    df = spark.createDataFrame([(*v, used[v[0]]) for v in variants], "leaf string, name string, k long, used long")
    got = select.least_used(df, "leaf", "used", ["k", "name"], budget)
    assert sorted((x.leaf, x.name) for x in got.collect()) == sorted(want)
