"""The alignment against a plain version: the file's own engine, cuts by sets, links by all pairs."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from glimmer.llm import align

TEXTS = [
    None, "", "a", " ", "  two  blanks ", "The quick brown fox.\nJumps over\tit", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve café — 東京タワー 🙂👍🏽 данные",
    "▁ a real mark of a blank", "a ▁", "x" * 300, "no break space \u0085 \x1c sign", "The quick brown fox.\nJumps over\tit", "ab\x00cd", "tail \n", "\n\n lead", "don't we'll I'VE 1234567 $%^ ...---",
    "Αβγ 你好 こんにちは สวัสดี שלום مرحبا ﷺ 𐍈", "word " * 4000,
]


def plain(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(f"{align.FOLDER}/{align.A_FILE}")
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=f"{align.FOLDER}/{align.B_FILE}")
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in itself} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(itself))}
    out, df = [], Counter()
    for t in texts:
        if not t:
            out.append(None)
            continue
        a, b = ta.encode(" " + t, add_special_tokens=False).ids, tb.encode(t)
        ba = [bytes(letters[c] for c in ta.id_to_token(i)) for i in a]
        bb = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(ba) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            out.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        cuts = sorted(set(ea) & set(eb))
        said, links, i, j = [], [], 0, 0
        for c in cuts:
            i2, j2 = ea.index(c, i) + 1, eb.index(c, j) + 1
            said.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            for x in range(i, i2):
                for y in range(j, j2):
                    if max(ea[x] - len(ba[x]), eb[y] - len(bb[y])) < min(ea[x], eb[y]):
                        links.append((a[x], b[y]))
            i, j = i2, j2
        df.update(set(links))
        out.append((a, b, len(cuts), links, hashlib.sha256(";".join(said).encode()).hexdigest()))
    most = {}
    for (a, _), n in df.items():
        most[a] = max(most.get(a, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if x is None else (len(x[0]), len(x[1]), x[2], len(x[3]), sum(df[p] == most[p[0]] for p in x[3]), sum(df[p] for p in x[3]), x[4])
        for x in out
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("shard", [align.SHARD, 40])
def test_odd_texts(spark, shard, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 900)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, row string").coalesce(2)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align(docs, shard=shard).collect()}
    assert got == dict(enumerate(plain(TEXTS)))


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = align.op12_align(spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes) | {c: "bigint" for c in ["doc_id", *COLUMNS[:-1]]} == dict(found.dtypes)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in found.collect()}
    assert got == dict(zip((r.doc_id for r in rows), plain([r.text for r in rows]), strict=True))


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text")], "doc_id long, text string")
    got = align.align(docs).collect()
    assert len(got) == 3 and len({(r.n_a, r.count_sum, r.groups_sha256) for r in got}) == 1 and got[0].count_sum == 3 * got[0].n_links
    assert align.align(docs.limit(0)).count() == 0


def test_groups_by_halving():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 400):
        for density in (0.05, 0.3, 0.9):
            whole = np.arange(1, n + 1)
            keep = lambda: np.unique(np.append(whole[rng.random(n) < density], n))  # noqa: E731, B023
            a, b = keep(), keep()
            last_a, last_b = align.groups(a, b, np.array([len(a) - 1]))
            assert a[last_a].tolist() == np.intersect1d(a, b).tolist() == b[last_b].tolist()
