"""Document fingerprints: closed syncmers of tokens.

A token is a run of up to eight code points that are not white space, an ideograph (from U+2E80 on) always one of its own. A k-mer (K tokens in
a row) is an anchor if the least hash of its inner runs of S tokens is that of its first or of its last run. Whether it is one depends on
the k-mer alone, so an edit changes the anchors that it touches and no other, and whatever two texts share they share with its anchors.

An anchor is a long: its place (tokens before it) in the upper half, a hash of the k-mer in the lower one. The fingerprint is the
anchors' hashes in the order of their places, eight hex digits each. Likeness is the share of distinct hashes that two fingerprints have
in common; `same_place` counts anchors that two texts have at equal places. All of it is built-in functions.

Defined results: a null text is an empty one; a text without tokens has no anchors and the fingerprint ''; one of fewer than K tokens has one anchor,
its whole; two texts without anchors have likeness 1, one of them 0. Documents are in the order of doc_id descending, nulls last, then of a hash of
their text; rows of equal doc_id and text are in any order, as their results cannot differ but for the last one's next document. The next
document of the last is the first, so of a single one itself. Other columns are left alone and can have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.session import table, written

#: Tokens of a k-mer and of its inner runs: 2 of K - S + 1 = STEP * STEP k-mers are anchors.
K, S, STEP = 5, 2, 2
TOKEN = r"[\x{2E80}-\x{10FFFF}]|[^\x20\x09-\x0D\x{2E80}-\x{10FFFF}]{1,8}"
#: Code points of a range of documents, and the most ranges: their bounds are the only thing that goes through the driver.
RANGE_CHARS, MAX_RANGES = 1_000_000, 16_384
_LOW = (1 << 32) - 1


def _key(of: Column) -> Column:
    """31 bits of a hash under a one, so that its hex form has eight digits."""
    return of.bitwiseAND(F.lit(_LOW >> 1)).bitwiseOR(F.lit(1 << 31))


def _let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _long(c) -> Column:
    return c.cast("long")


def _found(h: Column) -> Column:
    """The anchors by the hashes `h` of the inner runs. The least of the n runs of a k-mer comes from the least of STEP neighbours each."""
    n = K - S + 1

    def least(of: Column, apart: int) -> Column:
        return F.transform(of, lambda x, i: F.least(x, *(F.get(of, i + at * apart) for at in range(1, STEP))))

    def anchor(i: Column) -> Column:
        key = F.xxhash64(*(F.get(h, i + at) for at in sorted({*range(0, K - S, S), K - S})))
        return F.shiftleft(_long(i), 32).bitwiseOR(_key(key))

    def at_edge(x: Column, i: Column) -> Column:
        return F.when(((x == F.get(h, i)) | (x == F.get(h, i + (n - 1)))) & (i <= F.size(h) - n), anchor(i))

    return _let(least(h, 1), lambda few: _let(least(few, STEP), lambda m: F.array_compact(F.transform(m, at_edge))))


def anchors(text: Column) -> Column:
    """The anchors of a whole text, by place."""
    none = F.array().cast("array<bigint>")

    def of(tokens: Column) -> Column:
        run = lambda x, i: F.xxhash64(x, *(F.get(tokens, i + at) for at in range(1, S)))
        runs = F.slice(F.transform(tokens, run), 1, F.size(tokens) - (S - 1))
        whole = F.array(_key(F.xxhash64(text)))
        return F.when(F.size(tokens) >= K, _let(runs, _found)).when(F.size(tokens) > 0, whole).otherwise(none)

    return F.coalesce(_let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), of), none)


def keys(found: Column) -> Column:
    return F.transform(found, lambda x: x.bitwiseAND(F.lit(_LOW)))


def fingerprint(found: Column) -> Column:
    return F.lower(F.array_join(F.transform(found, lambda x: F.hex(x.bitwiseAND(F.lit(_LOW)))), ""))


def _share(x: Column, y: Column) -> Column:
    every = F.size(F.array_union(x, y))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / every)


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct hashes of all distinct ones, wherever they stand."""
    return _share(keys(a), keys(b))


def _range_of(key: Column, bounds: list) -> Column:
    """The last range whose bound is not above the key: bisection in a constant array."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    at = lambda i: F.get(F.array(*bounds), i)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda found, step: F.when((found + step < len(bounds)) & (at(found + step) <= key), found + step).otherwise(found))


def with_next(docs: DataFrame, range_chars: int = RANGE_CHARS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """(doc_id, text, anchors, next_text, next_anchors) of every row, the next document by doc_id descending. Texts are shuffled once, by ranges of the
    order; the last document of each range stands in the following one too. Copies of equal doc_id and text are each other's
    next ones: where they are more than a range, they are counted instead of moved."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    counted = written(docs.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n"), F.sum(_long(F.length("text"))).alias("chars")), "keys")
    n, chars = counted.agg(F.sum("n"), F.sum("chars")).first()
    m = max(1, min(max_ranges, (chars or 0) // range_chars))
    most = max(1024, (n or 0) // m)
    key = F.struct("doc_id", "h")
    part = counted.select(key.alias("k")).repartitionByRange(m, "k").groupBy(F.spark_partition_id()).agg(F.min("k").alias("low"), F.max("k").alias("high"))
    spans = part.orderBy("low").collect()
    kind = counted.schema["doc_id"].dataType
    literal = lambda k: F.struct(F.lit(k.doc_id).cast(kind).alias("doc_id"), F.lit(k.h).alias("h"))
    bounds = [literal(r.low) for r in spans] or [F.lit(None).cast(counted.select(key.alias("k")).schema["k"].dataType)]
    highs = [literal(r.high) for r in spans] or bounds

    # At most max_ranges keys have more than `most` rows.
    many = F.broadcast(counted.where(F.col("n") > most).select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"), "n"))
    same = docs["doc_id"].eqNullSafe(F.col("_doc")) & (docs["h"] == F.col("_h"))
    copies = docs.join(many, same).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.first("n").alias("n"))
    single = docs.join(many, same, "left_anti").unionByName(copies.drop("n"))

    no = _range_of(key, bounds)
    last = F.get(F.array(*highs), F.col("no")).eqNullSafe(key)
    dealt = single.withColumn("no", no).withColumn("places", F.when(last, F.array(F.struct(F.col("no").alias("no"), F.lit(1).alias("own")), F.struct(((F.col("no") + 1) % len(bounds)).alias("no"), F.lit(0).alias("own")))).otherwise(F.array(F.struct(F.col("no").alias("no"), F.lit(1).alias("own")))))
    dealt = dealt.select("doc_id", "h", "text", F.explode("places").alias("p")).select("doc_id", "h", "text", "p.no", "p.own").repartition("no")
    dealt = dealt.select("*", anchors(F.col("text")).alias("anchors"))
    # The next one in descending order is the one before in ascending order.
    upto = Window.partitionBy("no").orderBy("own", "doc_id", "h")
    rows = dealt.select("*", F.lag("text").over(upto).alias("next_text"), F.lag("anchors").over(upto).alias("next_anchors")).where("own = 1")
    rows = rows.select("doc_id", "text", "anchors", "next_text", "next_anchors")
    again = copies.select("doc_id", "text", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).select("doc_id", "text", anchors(F.col("text")).alias("anchors"))
    return rows.unionByName(again.select("*", F.col("text").alias("next_text"), F.col("anchors").alias("next_anchors")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, anchors, fingerprint) of every row, without a shuffle."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", _long(F.length("text")).alias("n_chars"), anchors(F.col("text")).alias("anchors"))
    return rows.select("*", fingerprint(F.col("anchors")).alias("fingerprint"))


def edits(docs: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, n_chars, edited, anchors, edited_anchors, next_anchors): each document beside itself with its last third replaced from the next."""
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = with_next(docs, **limits).select("doc_id", _long(n).alias("n_chars"), edited.alias("edited"), "anchors", "next_anchors")
    return rows.select("*", anchors(F.col("edited")).alias("edited_anchors"))


def op11_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    a, e = F.col("anchors"), F.col("edited_anchors")
    rows = edits(table(spark, sf_dir, "documents")).withColumns({"ka": keys(a), "ke": keys(e), "kb": keys(F.col("next_anchors"))})
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(a).alias("fingerprint"), fingerprint(e).alias("edited_fingerprint"),
        _share(F.col("ka"), F.col("ke")).alias("near_edited"), _share(F.col("ka"), F.col("kb")).alias("near_next"), _long(F.size(F.array_intersect(a, e))).alias("same_place"),
    )
