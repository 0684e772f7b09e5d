import math
from collections import Counter

import pytest

from glimmer.llm import quality as Q


def codes(text):
    return [int(Q.symbols()[min(ord(c), 1 << 16)]) for c in text]


def windows(text):
    s = [0] * (Q.ORDER - 1) + codes(text)
    return [tuple(s[i : i + Q.ORDER]) for i in range(len(text))]


def brute_model(texts):
    """log p(symbol | those before) by the textbook, over symbols."""
    levels = {Q.ORDER: Counter(g for t in texts for g in windows(t))}
    for k in range(Q.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def off(k, c):
        n = Counter(levels[k].values())
        i = min(c, 3)
        if not n[i] or not n[i + 1]:
            return 0.75
        y = n[1] / max(1, n[1] + 2 * n[2])
        return min(float(i), max(0.0, i - (i + 1) * y * n[i + 1] / n[i]))

    def prob(g):
        k = len(g)
        low = prob(g[1:]) if k > 1 else 1 / Q.K
        inside = {x: c for x, c in levels[k].items() if x[:-1] == g[:-1]}
        if not inside:
            return low
        total = sum(inside.values())
        c = levels[k].get(g, 0)
        return (max(c - off(k, c), 0) if c else 0) / total + sum(off(k, x) for x in inside.values()) / total * low

    return prob


TRAIN = ["the cat sat on the mat. the cat ran.", "The dog sat; the dog ran home, 42 times!", "éa öü and the rest\nof it", "кот сидел на окне, а пёс спал"]


def test_model_against_textbook(spark):
    texts = spark.createDataFrame([(1, t) for t in TRAIN], "model long, text string")
    model = Q.tables(Q.count_grams(texts))
    prob = brute_model(TRAIN)
    probe = ["the cat", "zebra | ###", "THE!!", "dog sat on é", "x", "кот спал", "猫は窓"]
    docs = spark.createDataFrame([(1, t) for t in probe] + [(1, None), (1, ""), (2, "other"), (None, "none")], "model long, text string")
    want = {t: -sum(math.log(prob(w)) for w in windows(t)) for t in probe}
    for hot in (10**6, 20, 0):  # all seen n-grams broadcast, the most frequent, none
        got = {r.text: r for r in Q.scores(docs.withColumn("id", docs.text), model, ["id"], hot).withColumnRenamed("id", "text").collect()}
        for t in probe:
            assert got[t]["_surprise"] == pytest.approx(want[t], rel=1e-5) and got[t]["_n"] == len(t)
        assert all(got[t]["_surprise"] is None for t in (None, "", "other", "none")) and len(got) == len(probe) + 4


def test_probabilities_sum_to_one(spark):
    model = Q.tables(Q.count_grams(spark.createDataFrame([(1, t) for t in TRAIN], "model long, text string")))
    for context in ("the ", "zzzz", "\0\0\0\0"):
        g = 0
        for c in context:
            g = (g << Q.BITS) + (0 if c == "\0" else codes(c)[0])
        rows = spark.range(Q.K).select(Q.F.lit(1).cast("long").alias("model"), (Q.F.lit(g << Q.BITS) + Q.F.col("id")).alias("g"))
        assert sum(math.exp(-r.nlp) for r in Q.looked_up(rows, model).collect()) == pytest.approx(1, abs=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.op1_quality(spark, sf).join(labels, "doc_id").toPandas()
    good, junk = got[got.quality == 1], got[got.quality == 0]
    print("kept of good", good.keep.mean(), "of junk", junk.keep.mean(), "short good", good[good.n_chars < 300].keep.mean())
    assert good.keep.mean() > 0.995 and junk.keep.mean() < 0.15


def test_odd_rows(spark):
    rows = [(i, "the cat sat on the mat. " * (1 + i % 5), "en") for i in range(60)] + [(100, None, "en"), (101, "", None), (None, "the", "en"), (102, "|||### !!!!" * 5000, "en"), (102, "|||### !!!!" * 5000, "en"), (103, "autre", "fr")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, g double")
    labels = spark.createDataFrame([(i, 1, None, "z") for i in range(60)] + [(5, 1, 0, "z"), (None, 1, 0, "z")], "doc_id long, quality int, toxic int, lang string")
    got = Q.judge(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert not by[102]["_keep"] and all(by[i]["_keep"] for i in (100, 101, None, 103)) and by[101].lang is None and all(by[i]["_keep"] for i in range(60))
    assert all(r["_keep"] for r in Q.judge(docs, labels.limit(0)).collect())
    assert Q.judge(docs.limit(0), labels).count() == 0


def test_clashing_names(spark):
    names = ["_mid", "mid", "_lang", "model", "_key1", "e", "q", "_row", "g", "b"]
    docs = spark.createDataFrame([(i, "the cat sat on the mat. " * (1 + i % 3), "en", *["x"] * len(names)) for i in range(30)], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(i, 1, 0, "x") for i in range(30)], "doc_id long, quality int, toxic int, lang string")
    assert Q.judge(docs, labels).count() == 30
    assert len(Q.op1_quality.__doc__) and Q.verdicts(docs, labels).where("_keep").count() == 30


def test_new_text_means_new_counts(spark):
    """What is gathered grows with the corpus."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 0").select(Q.F.lit(1).cast("long").alias("model"), "text", "doc_id")
    half, whole = Q.count_grams(docs.where("doc_id % 2 = 0")).count(), Q.count_grams(docs).count()
    assert whole > 1.15 * half
