import re

import corpus_pipeline
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if name.startswith("simhash"):
            fps = [brute_fingerprint(r.text) for r in before.values()]
            found = brute_components(list(before), fps)
            assert set(after) == {d for d in before if found[d] == d}
        elif name.startswith("secret"):
            secret = lambda t: re.sub(r'(?i)(?<=token = ")[0-9a-f]{40}', "[SECRET]", t)
            assert {d: r.text for d, r in after.items()} == {d: secret(r.text) for d, r in before.items()}
        else:
            assert set(after) < set(before) and len(after) > 0.6 * len(before) and all(after[d] == before[d] for d in after)
        docs = spark.createDataFrame(list(after.values()), docs.schema)


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "copies"} <= set(out.columns) and out.count() > 50


def test_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x " * 50_000, None, None, 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for d in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, "/root/testdata/sf0.001")
            d.collect()
