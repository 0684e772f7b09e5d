"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Main path in DataFrame functions only. Every word of a text is hashed once, each window
of `n` word hashes is hashed to one key, and the keys are looked up in a broadcast hash
set of the benchmark's windows. Only keys and positions are exploded, so a long text is not
copied for each of its windows. Candidates are written, and each document's are
verified word by word as one array, where its text is. The set is broadcast behind a count of
the benchmark's windows; beyond `max_broadcast` windows the same join shuffles keys and positions.

Words: A-Z are lower-cased, all ASCII but letters and digits separates. An item with
fewer words than `n` is one window of its length; an item with none has none.

Defined results: a null text has no words and is clean; an item without id marks
words but is not listed; repeated items count once, repeated documents are each reported; ties do
not arise. An empty benchmark leaves all clean, an empty table gives an empty result.
Other columns of the input are left alone and can have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.session import table, written

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: About 200 MB as a hash table; a benchmark of 13-word windows has one a word.
MAX_BROADCAST = 1_000_000
#: Documents with hits, as keys, that are broadcast at most.
MAX_BROADCAST_DOCS = 500_000
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text whose capitals are still there.
_RAW_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; lower() does just that in texts of ASCII alone."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.array_remove(F.split(_ascii_lower(F.coalesce(text, F.lit(""))), _GAPS), "")


def windows(bench: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct windows of the benchmark: their words, length and items."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    return (
        items.select("item", F.explode(F.transform(at, lambda i: F.slice("w", i + 1, F.lit(n)))).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("len", F.size("window"))
    )


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def scanned(docs: DataFrame, known: DataFrame, lengths: list[int], keys: list[str], text: Column, broadcast: bool) -> DataFrame:
    """(keys, n, i, len, key, found, mark), written: one `mark` row of each document with its number of words n, and
    `found` rows of windows at word i whose key the benchmark has. The words stay behind."""
    longest = max(lengths, default=1)
    hashed = docs.select(*keys, _hashes(words(text)).alias("h"))
    # Each word's hash next to those of the words after it: the arrays are shifted whole and a window is hashed in generated code.
    # With posexplode_outer() no filter on the array's size is inferred, which would be pushed below the words and make them anew for each window.
    shifted = F.arrays_zip(*[F.slice("h", j + 1, F.lit(1 << 30)).alias(f"w{j}") for j in range(longest)])
    every = hashed.select(*keys, F.size("h").alias("n"), F.posexplode_outer(shifted).alias("i", "z"))

    def window(n: int) -> Column:
        return F.struct(F.lit(n).alias("len"), F.when(F.col(f"z.w{n - 1}").isNotNull(), F.xxhash64(*[F.col(f"z.w{j}") for j in range(n)])).alias("key"))

    every = every.select(*keys, "n", "i", F.explode(F.array(*[window(n) for n in lengths or [1]])).alias("x")).select(*keys, "n", "i", "x.len", "x.key")
    mark = (F.coalesce(F.col("i"), F.lit(0)) == 0) & (F.col("len") == (lengths or [1])[0])
    own = known.select("key").distinct().withColumn("found", F.lit(True))
    if broadcast:
        found = every.join(F.broadcast(own), "key", "left").withColumn("mark", mark).where(F.col("mark") | F.col("found"))
    else:
        found = every.where(mark).withColumns({"found": F.lit(False), "mark": F.lit(True)}).unionByName(every.join(own, "key").withColumn("mark", F.lit(False)))
    return written(found.select(*keys, "n", "i", "len", "key", F.coalesce("found", F.lit(False)).alias("found"), "mark"), "windows")


def hits(docs: DataFrame, bench: DataFrame, keys: list[str], text: Column, n: int = WINDOW, max_broadcast: int = MAX_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(keys, n_words) of each document, and (keys, spans array<struct<pos, len>>, items array<string>) of those with hits;
    `keys` tell documents apart, and rows with equal keys have equal texts."""
    known = written(windows(bench, n), "known")
    sizes = {r["len"]: r["k"] for r in known.groupBy("len").agg(F.count(F.lit(1)).alias("k")).collect()}  # n rows at most
    small = sum(sizes.values()) <= max_broadcast
    # Nulls leave a hash as it is, so a short window's key is that of its words.
    known = known.select(F.xxhash64(*[F.when(F.col("len") > j, F.xxhash64(F.get("window", F.lit(j)))) for j in range(n)]).alias("key"), "window", "items")
    rows = scanned(docs, known, sorted(sizes), keys, text, small)
    # Word by word, where the text is: a document's candidates go to it as one array, so no text is copied for each.
    found = rows.where("found").select(*keys, F.col("i").alias("pos"), "len", "key").distinct().join(F.broadcast(known) if small else known, "key")
    found = found.groupBy(*keys).agg(F.collect_list(F.struct("pos", "len", "window", "items")).alias("_at"))
    found = written(found, "candidates")
    some = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = [docs[k].eqNullSafe(some[f"_k{i}"]) for i, k in enumerate(keys)]
    own = docs.join(F.broadcast(some) if found.count() <= MAX_BROADCAST_DOCS else some, same, "left_semi").select(*keys, words(text).alias("_w")).dropDuplicates(keys)
    found = found.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    met = own.join(found, [own[k].eqNullSafe(found[f"_k{i}"]) for i, k in enumerate(keys)])
    right = F.filter("_at", lambda x: F.slice("_w", x["pos"] + 1, x["len"]) == x["window"])
    met = met.select(*keys, right.alias("_at")).where(F.size("_at") > 0)
    spans = F.transform("_at", lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len")))
    met = met.select(*keys, spans.alias("spans"), F.array_distinct(F.flatten(F.transform("_at", lambda x: x["items"]))).alias("items"))
    return rows.where("mark").select(*keys, F.col("n").cast("long").alias("n_words")), written(met, "hits")


def _n_hit(spans: Column) -> Column:
    """Number of words inside any of the spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["pos"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["pos"])).cast("long")).alias("n"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with what tells their texts apart: rows that are alike in id and text are hit alike."""
    return docs.withColumns({"_id": F.col(id_col).cast("string"), "_tag": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _tagged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "doc_id", "_text")


def _with_hits(docs: DataFrame, found: DataFrame, how: str = "left", most: int = MAX_BROADCAST_DOCS) -> DataFrame:
    """`docs` joined with the few documents of `found`, which are broadcast behind a count of them."""
    found = found.withColumnsRenamed({"_id": "_hit_id", "_tag": "_hit_tag", "spans": "_spans", "items": "_items"})
    found = F.broadcast(found) if found.count() <= most else found
    return docs.join(found, docs["_id"].eqNullSafe(found["_hit_id"]) & (docs["_tag"] == found["_hit_tag"]), how)


def _contaminated(n_hit: Column, n_words: Column, share: int) -> Column:
    return (n_hit > 0) & (share * n_hit >= n_words)


def report(docs: DataFrame, bench: DataFrame, n: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """A row for each document: words, words hit, items and the verdict."""
    rows, found = hits(_slim(docs, id_col, text_col), bench, ["doc_id", "_id", "_tag"], F.col("_text"), n, max_broadcast)
    n_hit = F.coalesce(_n_hit(F.col("_spans")), F.lit(0).cast("long"))
    items = F.coalesce(F.array_sort("_items"), F.array().cast("array<string>"))
    # Rows are numbers here, but the spans of a hit have no bound in sum: these are joined, not broadcast.
    return (
        _with_hits(rows, found.drop("doc_id"), most=-1)
        .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
        .withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words"), share))
    )


def clean(docs: DataFrame, bench: DataFrame, remove: str = "documents", n: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """`docs` without contaminated documents, or (remove="spans") with the words hit taken out of all texts."""
    rows, found = hits(_slim(docs, id_col, text_col), bench, ["_id", "_tag"], F.col("_text"), n, max_broadcast)
    tagged = _tagged(docs, id_col, text_col)
    if remove == "documents":
        judged = _with_hits(rows.distinct(), found, "inner", -1).select("_id", "_tag", "n_words", _n_hit(F.col("_spans")).alias("n_hit"))
        bad = written(judged.where(_contaminated(F.col("n_hit"), F.col("n_words"), share)).select("_id", "_tag"), "contaminated")
        return _with_hits(tagged, bad, "left_anti").select(docs.columns)
    joined = _with_hits(tagged, found, most=-1)
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(rf"({_WORD}(?:{_RAW_GAPS})?)"), 1)
    kept = F.filter(pieces, lambda _, i: ~F.exists("_spans", lambda s: (i >= s["pos"]) & (i < s["pos"] + s["len"])))
    text = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(F.array_join(kept, ""))
    return joined.withColumn(text_col, text).select(docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows of the benchmark, and the verdict."""
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the contamination rule leaves."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, list_slice(w, p + 1, p + least(13, len(w))) AS win, least(13, len(w)) AS n FROM bp),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, lens WHERE len(w) >= n),
dw AS (SELECT doc_id, p, n, list_slice(w, p + 1, p + n) AS win FROM dp),
h AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
