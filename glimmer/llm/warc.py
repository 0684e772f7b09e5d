"""WARC archives in Zstandard: writing one frame per record, and a reader for them.

An archive begins with a skippable frame (0x184D2A5D) that holds the dictionary its
records are compressed with; each record is one frame of its own. Archives are
written by Spark's own text writer, so they go to any file system it knows and through its commit
protocol: a frame is a line, and the line end is an empty skippable frame, which decoders
pass over. The reader takes whole files, loads the dictionary, walks from frame to
frame by the block headers, and checks every header, length and digest.

The number of archives follows from the bytes to write, so an archive is of bounded size. Pages are dealt
out by id and digest: pages with equal payloads are spread like any others. Which page of
equal payloads is stored is an aggregation per digest over ids alone.

Defined results: a null html is an empty payload; a null page_id comes after all others
and is read back as null; of repeated rows (equal id and payload) the first is as its id is and the
rest revisit it if they have `least` bytes; a null url is left out; line breaks in a url are escaped;
an empty table gives an empty result. Other columns of the input are left alone and can have any name.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.session import new_path, table, written

LEAST = 100
ARCHIVE_BYTES = 32 << 20
#: Bytes that a batch of frames or payloads has about at most.
BATCH_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
# Fixed values of the formats.
_FRAME, _SKIPPABLE, _DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
_LINE_END = struct.pack("<II", _SKIPPABLE, 0).decode("ascii")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DICT_BYTES, _SAMPLES = 32_768, 400


def _uri(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC record: the page's response, or its revisit, whose block has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8") + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the first sample's start where there is too little to train on."""
    try:
        return zstandard.train_dictionary(_DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return samples[0][:_DICT_BYTES] or b"\0" * 8


def archive(records: Iterator[bytes], first: list[bytes]) -> Iterator[bytes]:
    """The frames of an archive: the dictionary's, and one for each record."""
    data = dictionary(first)
    yield struct.pack("<II", _DICTIONARY, len(data)) + data
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=True, write_content_size=True)
    for r in records:
        yield packer.compress(r)


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(magic, frame or skipped content) one after the other."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"the archive ends within a frame at {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == _SKIPPABLE:
            end = at + 8 + size
            if end > len(data):
                raise ValueError(f"the archive ends within a skippable frame at {at}")
            yield magic, data[at + 8 : end]
        elif magic == _FRAME:
            end, last = at + zstandard.frame_header_size(data[at : at + 18]), False
            while not last:
                if end + 3 > len(data):
                    raise ValueError(f"the archive ends within a block at {end}")
                b = int.from_bytes(data[end : end + 3], "little")
                last, kind = bool(b & 1), b >> 1 & 3
                end += 3 + (1 if kind == 1 else b >> 3)
            end += 4 if data[at + 4] & 4 else 0
            if end > len(data):
                raise ValueError(f"the archive ends within a frame at {at}")
            yield magic, data[at:end]
        else:
            raise ValueError(f"no frame at {at}")
        at = end


def _page(uri: str) -> int | None:
    if not (uri.startswith("<urn:page:") and uri.endswith(">")):
        raise ValueError(f"not the name of a page: {uri}")
    return int(uri[10:-1]) if uri[10:-1] else None


def parse(data: bytes) -> dict:
    """The record as a row; ValueError if a header, a length or the digest is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not gap or version != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) for line in lines)
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "Content-Length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, {len(rest) - 4} bytes follow")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit") or (kind == "revisit") != ("WARC-Refers-To" in fields):
        raise ValueError(f"WARC-Type {kind} does not go with the headers")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    sizes = [line.split(b": ")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length: ")]
    if not gap or len(sizes) != 1:
        raise ValueError("no HTTP header with a Content-Length")
    size, digest = int(sizes[0]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload has another length or digest than its headers say")
    if kind == "revisit" and payload:
        raise ValueError("a revisit with a payload")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _page(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def records(data: bytes) -> Iterator[dict]:
    """The records of an archive's bytes."""
    reader = None
    for i, (magic, content) in enumerate(frames(data)):
        if magic == _DICTIONARY:
            if i:
                raise ValueError("the dictionary is not in the leading frame")
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        elif magic == _FRAME:
            reader = reader or zstandard.ZstdDecompressor()
            size = zstandard.frame_content_size(content)
            text = reader.decompress(content) if size >= 0 else reader.decompressobj().decompress(content)
            if size >= 0 and len(text) != size:
                raise ValueError("a frame holds another length than its header says")
            yield parse(text)


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages with _key and _payload, and before those of a key one row without a page (_page false) with `first`, the page id and known flag of
    the response, where payloads are equal. Both are dealt out for writing at once: joined before, payloads would be shuffled twice."""
    payload = F.coalesce(F.encode(F.col("html"), "utf-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("_payload")).withColumn("_digest", F.sha2("_payload", 256))
    rows = rows.withColumn("_key", F.concat_ws(":", F.col("page_id").cast("string"), F.col("_digest")))
    slim = rows.select("page_id", "_key", "_digest", F.octet_length("_payload").alias("n"))
    total = slim.agg(F.sum("n")).first()[0] or 0
    archives = max(1, -(-total // ARCHIVE_BYTES))
    firsts = slim.where(F.col("n") >= least).groupBy("_digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("_digest", "first")
    firsts = written(firsts, "firsts")  # a plain table, so that a digest of very many pages is split in the join
    later = slim.where(F.col("n") >= least).join(firsts, "_digest").groupBy("_key").agg(F.first("first").alias("first"))
    page = rows.select("page_id", "url", "_payload", "_key", F.lit(None).cast(later.schema["first"].dataType).alias("first"), F.lit(True).alias("_page"))
    # A page id that is not null, so that pandas keeps those of pages as integers.
    mark = later.select(F.lit(0).cast(rows.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(b"").alias("_payload"), "_key", "first", F.lit(False).alias("_page"))
    return page.unionByName(mark).repartition(archives, "_key").sortWithinPartitions("_key", "_page")


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write the archives of all pages under `path`."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made() -> Iterator[bytes]:
            before, marked, at = None, None, None
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    if not r.page:
                        marked, at = r.first, r.page_key
                        continue
                    page_id = None if pd.isna(r.page_id) else int(r.page_id)
                    first = marked if r.page_key == at else None
                    revisit = first is not None and ((None if first["none"] else int(first["page_id"])) != page_id or r.page_key == before)
                    before = r.page_key
                    yield record(page_id, r.url, r.payload, revisit, None if not revisit or first["none"] else int(first["page_id"]))

        todo = made()
        first = [r for _, r in zip(range(_SAMPLES), todo, strict=False)]
        if not first:
            return

        def every() -> Iterator[bytes]:
            yield from first
            yield from todo

        held, size = [], 0
        for frame in archive(every(), first):
            held.append(frame)
            size += len(frame)
            if len(held) >= 500 or size >= BATCH_BYTES:
                yield pd.DataFrame({"frame": held})
                held, size = [], 0
        yield pd.DataFrame({"frame": held})

    dealt = plan(pages, least).select("page_id", "url", F.col("_payload").alias("payload"), "first", F.col("_key").alias("page_key"), F.col("_page").alias("page"))
    dealt.mapInPandas(pack, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", _LINE_END).text(path)


SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under `path`."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                held, size = [], 0
                try:
                    for r in records(content):
                        held.append(r)
                        size += len(r["payload"] or b"")
                        if len(held) >= 1000 or size >= BATCH_BYTES:
                            yield _frame(held)
                            held, size = [], 0
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e
                if held:
                    yield _frame(held)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, SCHEMA)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([r[c] for r in rows], dtype="Int64")
    return out


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as archives, and what reading them back says of each page."""
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
