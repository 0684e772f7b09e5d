import re

import pytest
from pyspark.sql import functions as F

from glimmer.llm import secrets as S


@pytest.fixture(scope="module")
def forest(spark):
    return S.train(S.labelled_findings(spark))


def test_held_out_accuracy(spark):
    rows = S.labelled_findings(spark, 150).withColumn("held", F.pmod(F.xxhash64("value", "before"), F.lit(4)) == 0).cache()
    forest = S.train(rows.where("not held").drop("held"))
    got = S.classified(rows.where("held").select("label", "value", "before", "after", "path"), forest).toPandas()
    right = (got.probability >= 0.5) == (got.label == 1)
    assert len(got) > 500 and right.mean() > 0.98


def test_templates_left_out(spark):
    """Findings of templates that the forest has seen nothing of: every fifth template is held out in turn."""
    rows = S.labelled_findings(spark, 60).cache()
    right = {0: [], 1: []}
    for fold in range(5):
        forest = S.train(rows.where(F.col("template") % 5 != fold))
        got = S.classified(rows.where(F.col("template") % 5 == fold), forest).select("label", "probability").toPandas()
        for label in right:
            right[label] += [(p >= 0.5) == (label == 1) for p in got.probability[got.label == label]]
    share = {label: sum(x) / len(x) for label, x in right.items()}
    print("right of templates left out", share)
    assert share[1] > 0.7 and share[0] > 0.7


ROWS = [
    (1, 'Text token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" und mehr.', "src1"),
    (2, "The number 9807915762804490 is no secret, nor 97.51.17.173 or a@mail6.example.com", "src2"),
    (3, None, "src2"),
    (4, "", None),
    (5, 'password = "Tr0ub4dor&3x!" and commit 04dbebab91ab85687d33eeaaf9ac699e1188f962', None),
    (5, 'password = "Tr0ub4dor&3x!" and commit 04dbebab91ab85687d33eeaaf9ac699e1188f962', None),
    (None, 'token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', "x"),
    (7, "word " * 40_000 + 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"' + " 2669109448945250" * 3000, "x"),
    (8, "a" * 300_000 + "1" + "-" * 100_000, "x"),
]


def test_rows(spark, forest):
    docs = spark.createDataFrame([(*r, "z", 2) for r in ROWS], "doc_id long, text string, source string, value string, n_chars int")
    got = S.scan(docs, forest).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.is_secret for r in by[1]] == [True] and not any(r.is_secret for r in by[2]) and 3 not in by and 4 not in by
    assert sorted(r.is_secret for r in by[5]) == [False, False, True, True] and by[None][0].is_secret
    assert sum(r.is_secret for r in by[7]) == 1 and len(by[7]) == 3001
    masked = S.redact(docs, forest)
    assert masked.columns == docs.columns and masked.count() == len(ROWS)
    text = {r.doc_id: r.text for r in masked.collect()}
    want = {r[0]: r[1] for r in ROWS}
    assert text[1] == 'Text token = "[SECRET]" und mehr.' and text[2] == want[2] and text[3] is None and text[4] == "" and text[8] == want[8]
    assert text[5] == 'password = "[SECRET]" and commit 04dbebab91ab85687d33eeaaf9ac699e1188f962'
    assert text[7] == want[7].replace("2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", "[SECRET]")
    assert S.scan(docs.limit(0), forest).count() == 0 and S.redact(docs.limit(0), forest).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    runs = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}")
    want = sorted((r.doc_id, len(m)) for r in docs for m in runs.findall(r.text or ""))
    frame = S.op10_secrets(spark, sf)
    got = frame.collect()
    assert sorted((r.doc_id, r.n_chars) for r in got) == want
    planted = {r.doc_id for r in docs if re.search(r'(?i)token = "[0-9a-f]{40}"', r.text or "")}
    assert {r.doc_id for r in got if r.is_secret} == planted
    plan = frame._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_given_values(spark, forest):
    secret = [
        ('DB_PASSWORD="', "S3cr3t!pa", '"'), ('my_token = "', "correcthorsebattery", '"'), ("PASSWORD=", "hunter2secret", "\nPORT=5432"), ("db:\n  password: ", "Wq7!kz@92x", "\n  host: localhost"),
        ("postgres://app:", "Wq7!kz92x", "@db.internal:5432/main"), ("API_KEY=", "k3Jd8sLq0Pz2Xv7Bn5Mt!x", ""), ("token_value => '", "zK4#tttqwe", "'"),
    ]
    clean = ["token = get_value(request)", "password=${DB_PASSWORD}", "see http://example.com:8080/a@b and the secret: something else", "12:30@home"]
    rows = [(i, f"{a}{v}{b}", "x") for i, (a, v, b) in enumerate(secret)] + [(100 + i, t, "x") for i, t in enumerate(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in S.redact(docs, forest).collect()}
    assert got == {i: f"{a}[SECRET]{b}" for i, (a, _, b) in enumerate(secret)} | {100 + i: t for i, t in enumerate(clean)}
