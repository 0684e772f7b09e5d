import hashlib

import pytest
import zstandard

from glimmer.llm import warc as W

LONG = "<p>" + "gleich é " * 40 + "</p>"
ROWS = [(3, "http://a/3", LONG), (1, None, LONG), (2, "http://a/2\r\nX: y", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "y" * 100), (7, "u", "y" * 100), (None, "u", LONG), (8, "u", "z" * 3_000_000), (9, "u", "a\r\n\r\nb" * 50)]


def want(rows):
    out, firsts = [], {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            firsts[b] = min(firsts.get(b, 1e9), 1e9 if i is None else i)
    seen = set()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and (i != firsts[b] or (i, b) in seen)
        seen.add((i, b))
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", firsts[b] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, frame int")
    W.write(pages, f"file://{tmp_path}/w")
    got = W.read(spark, f"file://{tmp_path}/w").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(ROWS)
    payloads = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    assert set(payloads.values()) == {(h or "").encode() for _, _, h in ROWS}
    assert {r.url for r in got if r.page_id == 2} == {"http://a/2%0D%0AX: y"} and {r.url for r in got if r.page_id == 1} == {None}
    W.write(pages.limit(0), f"file://{tmp_path}/e")
    assert W.read(spark, f"file://{tmp_path}/e").count() == 0


def test_archive_is_plain_zstandard_and_faults_are_found():
    first = [W.record(i, "u", b"payload %d" % i * 30, False, None) for i in range(50)]
    parts = list(W.archive(iter(first), first))
    data = W._LINE_END.encode().join(parts)
    rows = list(W.records(data))
    assert [r["page_id"] for r in rows] == list(range(50)) and int.from_bytes(parts[0][:4], "little") == 0x184D2A5D
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(parts[0][8:]))
    assert [d.decompress(p) for p in parts[1:]] == first
    for bad in (data[:-3], data[: len(parts[0]) - 5], b"\1" + data, data + parts[0]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(W.records(bad))
    for a, b in ((b"WARC/1.1", b"WARC/9.1"), (b"Content-Length: ", b"Content-Length: 1"), (b"payload 3", b"payload 4"), (b"WARC-Type: response", b"WARC-Type: revisit"), (b"WARC-Date", b"WARC-Dat")):
        with pytest.raises(ValueError):
            W.parse(first[3].replace(a, b, 1))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in W.op7_warc(spark, sf).collect()), key=str) == want(rows)


def test_payloads_are_shuffled_once(spark):
    """Each row to write once, in as many tasks as there are archives, whatever the session's number of partitions."""
    pages = spark.createDataFrame([(i, "u", LONG * 400 + "x" * (i // 2 % 50)) for i in range(1000)], "page_id long, url string, html string")
    dealt = W.plan(pages)
    assert dealt.where("_page").count() == 1000
    assert 1 < dealt.rdd.getNumPartitions() == -(-sum(len((LONG * 400 + "x" * (i // 2 % 50)).encode()) for i in range(1000)) // W.ARCHIVE_BYTES)
    assert "Join" not in dealt._jdf.queryExecution().executedPlan().toString().split("Union")[0]
