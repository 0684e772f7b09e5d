"""Fingerprints against a plain version of closed syncmers, and the order of documents."""

import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from glimmer.llm import syncmers

TOKEN = re.compile("[⺀-\U0010ffff]|[^\x20\x09-\x0d⺀-\U0010ffff]{1,8}")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def of_strings(*words):
    """The engine's hash of strings beside each other: each one's hash is the next one's seed."""
    h = 42
    for w in words:
        h = xxhash.xxh64(w.encode(), seed=h).intdigest()
    return signed(h)


def of_longs(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64((v & ((1 << 64) - 1)).to_bytes(8, "little"), seed=h).intdigest()
    return h


def plain(text):
    """(place, key) of the anchors of a text, each k-mer looked at on its own."""
    t = TOKEN.findall(text or "")
    k, s = syncmers.K, syncmers.S
    short = lambda h: h & 0x7FFFFFFF | 0x80000000
    if len(t) < k:
        return [(0, short(of_strings(text)))] if t else []
    out = []
    for i in range(len(t) - k + 1):
        runs = [of_strings(*t[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(runs) in (runs[0], runs[-1]):
            out.append((i, short(of_longs(runs[0], runs[2], runs[3]))))
    return out


TEXTS = ["", None, " \n\t", "one", "a b c d", "a b c d e", "a a a a a a a a", "the quick brown fox jumps over the lazy dog again and again", "東京タワーは高い", "🙂👍🏽 mixed текст " * 30, "x" * 100, "w1 w2 w3 w4 w5 w6 w7 w8 w9\n" * 400]


def said(found):
    return "".join(f"{k:08x}" for _, k in found)


def share(a, b):
    a, b = {k for _, k in a}, {k for _, k in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    """Of rows (doc_id, text) in order."""
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, u = t or "", u or ""
        cut = len(t) // 3
        e = t[: len(t) - cut] + u[:cut]
        a, b, c = plain(t), plain(e), plain(u)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), said(a), said(b), share(a, b), share(a, c), len(set(a) & set(b))))
    return out


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_place"]


def test_anchors(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, anchors int")
    for r in syncmers.fingerprints(df).collect():
        found = plain(TEXTS[r.doc_id])
        assert [(x >> 32, x & 0xFFFFFFFF) for x in r.anchors] == found and r.fingerprint == said(found) and r.n_chars == len(TEXTS[r.doc_id] or "")


def test_edits_in_order_of_ids(spark, tmp_path):
    rows = [(i * 7 - 30, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, "last of all, by the order of ids")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, no string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = expected(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0))))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in syncmers.op11_syncmers(spark, str(tmp_path)).collect()}
    assert got == {r[0]: r for r in want}
    many = syncmers.edits(spark.read.parquet(f"{tmp_path}/documents.parquet"), range_chars=300)
    assert {r.doc_id: r.edited for r in many.collect()} == {r.doc_id: r.edited for r in syncmers.edits(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    df = syncmers.op11_syncmers(spark, "/root/testdata/sf0.001")
    assert "Python" not in df._jdf.queryExecution().toString()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in df.collect()) == sorted(expected([tuple(r) for r in rows]))


def test_repeated_rows(spark):
    """Copies are each other's next ones, however many; the last one's next is another document."""
    df = spark.createDataFrame([(5, "same words here again")] * 3000 + [(4, "other words there instead")] * 2 + [(5, "same id but another text")], "doc_id long, text string")
    found = syncmers.with_next(df, range_chars=2000).groupBy("doc_id", "text", "next_text").count().collect()
    assert sum(r["count"] for r in found) == 3003 and sum(r.next_text != r.text for r in found) == 3
    assert {r["count"] for r in found if r.text == r.next_text} == {2999, 1} and all(r["count"] == 1 for r in found if r.text != r.next_text)


def test_one_document_and_none(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    r = syncmers.edits(df).first()
    assert r.edited == "a b c d e f a b c" and r.next_anchors == r.anchors
    assert syncmers.edits(df.limit(0)).count() == 0
