from glimmer.llm import licenses as L


def test_rows(spark):
    mit = next(t for i, t in L.KNOWN if t.startswith("MIT License"))
    spoiled = mit.upper().replace("LICENSE", "LICENCE").replace(", ", "\n ; ").replace("MIT LICENCE ", "MIT Licence\n\nCopyright (c) 2020 Jane Doe <j@x.org>\n\n")
    rows = [
        (1, mit), (2, spoiled), (2, spoiled), (3, None), (4, ""), (5, "Some words\nreleased UNDER the mit licence!\nReleased under the MIT License."), (6, mit + " but not quite"), (None, "Licensed under CC BY-NC 4.0."),
        (7, "Copyright 2020 A\n...\n"), (8, "wort " * 40_000 + "\n** Licensed under the Apache License, Version 2.0 **"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    got = sorted(((r.doc_id or 0, r.license_id, r.unit, r.n_units) for r in L.scan(docs).collect()))
    assert got == [(0, "CC-BY-NC-4.0", "text", 1), (1, "MIT", "text", 1), (2, "MIT", "text", 1), (2, "MIT", "text", 1), (5, "MIT", "line", 2), (8, "Apache-2.0", "line", 1)]
    assert L.scan(docs.limit(0)).count() == 0


def test_both_canonical_forms_agree(spark):
    import hashlib

    want = {(i, hashlib.sha256(L.canonical_text(t).encode()).hexdigest()) for i, t in L.KNOWN}
    assert {tuple(r) for r in L.known_digests(spark).collect()} == want


def test_marks_pass_over_no_known_text(spark):
    import re

    for _, text in L.KNOWN:
        for form in (text, text.upper(), text.replace("icense", "icence")):
            assert re.search(L.MARKS, form)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(L.KNOWN)], "doc_id long, text string")
    assert {r.doc_id for r in L.scan(docs).collect()} == set(range(len(L.KNOWN)))
    own = spark.createDataFrame([("own", __import__("hashlib").sha256(b"do as you like").hexdigest())], "license_id string, digest string")
    assert [r.license_id for r in L.scan(spark.createDataFrame([(1, "Do as you like!", 2)], "doc_id long, text string, u int"), own, marks="").collect()] == ["own"]
