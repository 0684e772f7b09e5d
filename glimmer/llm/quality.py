"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The n-grams are of `ORDER` characters: 12 bits each, so the letters of most alphabets are symbols of their own (capitals of
A-Z are one symbol, digits one, code points from 2048 on share 2048), and the counts grow with the corpus. Trusted texts are counted in full:
each task counts its texts, the counts are added up in shards of (model, n-gram), and joins of
n-gram counts with the counts of their contexts and with the next lower order give
the probabilities. A language has one model.

A document's perplexity is the join of its n-grams with the shards. What is frequent is held back from it: the `HOT` most frequent
n-grams at most, behind a count of them, are broadcast with their probabilities and summed where the text is, so no text is
shuffled. All other n-grams of a document, rare or never seen, are counted per document, and each is looked up
once for all documents: in the shards of its order, or else by the weight of its context and
the next lower order. This is the same way at every size.

The threshold of a language is made of quantiles of trusted documents that the model has
not seen (one in `FOLDS`, by a hash): of the excess, the mean surprise less the language's
median times the root of the length, so short texts are not judged by the noise they
have. A document goes if its excess is above the quantile HIGH, or below the median by more than REACH times the lower quartile's
distance from it: such text repeats itself, while documents that the model was trained on are only a little below. The fence is LEAST away
from the median at least, for languages of few trusted documents.

Labels are joined by document id. They grow with the documents, so both are shuffled; before that a filter of fixed size (a bit
for each hash of an id, BLOOM_BITS in all) keeps most texts without a trusted label out of it.

Defined results: null and empty texts have no perplexity and are kept, as are
documents of a language without trusted text (null is a language of its own); without labels
all are kept; rows with equal ids are scored each; an empty table gives an
empty result. Other columns of the input are left alone and can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.session import table, written

ORDER = 5
BITS = 12
K = 1 << BITS
FOLDS = 5
#: The quantile of held-out trusted documents that the fence stands at above; below, REACH times the distance of the quantile LOW from the median; LEAST at least.
LOW, REACH, HIGH, LEAST = 0.25, 15.0, 0.997, 7.5
#: N-grams that are broadcast at most, 12 bytes each, and slots of their table in a task.
HOT = 1 << 20
_SLOTS = 21
BLOOM_BITS = 1 << 24
MAX_BROADCAST = 10_000
MAX_BROADCAST_DOCS = 500_000
#: Characters and rows that a task turns into n-grams at once.
_PIECE = 200_000
_ROWS = 500


@cache
def symbols() -> np.ndarray:
    """Symbol of each code point below 2 ** 16; the last entry stands for all above. 0 is the edge of a text."""
    c = np.arange((1 << 16) + 1)
    out = np.where(c < K // 2, c, K // 2 + c % (K // 2))
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    out[0] = ord(" ")
    return out.astype(np.int64)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts one after the other, one for each character, and the lengths."""
    edge = "\0" * (ORDER - 1)
    code = np.frombuffer((edge + edge.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    s = symbols()[np.minimum(code, 1 << 16)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + ORDER - 1) - lengths
    of_text = np.ones(len(s), bool)
    of_text[: ORDER - 1] = False
    s[: ORDER - 1] = 0
    for i in range(ORDER - 1):
        of_text[starts[1:] - 1 - i] = False
        s[starts[1:] - 1 - i] = 0
    g = s[: len(s) - ORDER + 1].copy()
    for i in range(1, ORDER):
        g <<= BITS
        g += s[i : len(s) - ORDER + 1 + i]
    return g[of_text[ORDER - 1 :]], lengths


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `_PIECE` characters together, one text at least."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > _PIECE:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def _suffix(g: Column, k: int) -> Column:
    return g.bitwiseAND(F.lit((1 << BITS * k) - 1))


def _context(g: Column) -> Column:
    return F.shiftright(g, BITS)


def count_grams(texts: DataFrame) -> DataFrame:
    """(model, g, c) over the columns model (a long) and text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A batch gives its distinct n-grams; Spark adds them up before and after the shuffle.
        for pdf in batches:
            for m, index in pdf.text.groupby(pdf.model).indices.items():
                own = [pdf.text.iat[i] for i in index]
                for a, b in _pieces(own):
                    g, k = np.unique(_grams(own[a:b])[0], return_counts=True)
                    yield pd.DataFrame({"model": m, "g": g, "c": k})

    return texts.select("model", "text").mapInPandas(count, "model long, g long, c long").groupBy("model", "g").agg(F.sum("c").alias("c"))


#: By order from 1: (model, g, c, nlp) of seen n-grams, and (model, ctx, weight) of contexts, weight being -log of what lower orders have there.
Tables = list[tuple[DataFrame, DataFrame]]


def tables(counts: DataFrame) -> Tables:
    by_order = {ORDER: written(counts, "counts")}
    for k in range(ORDER - 1, 0, -1):
        by_order[k] = written(by_order[k + 1].groupBy("model", _suffix(F.col("g"), k).alias("g")).agg(F.count(F.lit(1)).alias("c")), f"continued{k}")
    out: Tables = []
    for k in range(1, ORDER + 1):
        c = by_order[k]
        n = [F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]
        y = n[0] / F.greatest(n[0] + 2 * n[1], F.lit(1))
        off = [F.least(F.lit(float(i + 1)), F.greatest(F.lit(0.0), F.when((n[i] > 0) & (n[i + 1] > 0), i + 1 - (i + 2) * y * n[i + 1] / F.greatest(n[i], F.lit(1))).otherwise(0.75))) for i in range(3)]
        # A row for each model.
        discounts = c.groupBy("model").agg(*[o.alias(f"d{i + 1}") for i, o in enumerate(off)])
        rows = c.join(discounts, "model").withColumn("ctx", _context(F.col("g")))
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        contexts = rows.groupBy("model", "ctx").agg(F.sum("c").alias("t"), (F.sum(discount) / F.sum("c")).alias("gamma"))
        rows = rows.join(contexts, ["model", "ctx"]).withColumn("low", _suffix(F.col("g"), k - 1))
        low = F.lit(1.0 / K)
        if out:
            rows = rows.join(out[-1][0].select("model", F.col("g").alias("low"), F.col("nlp").alias("nlp_low")), ["model", "low"])
            low = F.exp(-F.col("nlp_low"))
        p = F.greatest(F.col("c") - discount, F.lit(0.0)) / F.col("t") + F.col("gamma") * low
        seen = written(rows.select("model", "g", "c", (-F.log(p)).alias("nlp")), f"order{k}")
        out.append((seen, written(contexts.select("model", "ctx", (-F.log("gamma")).alias("weight")), f"contexts{k}")))
    return out


def looked_up(grams: DataFrame, model: Tables, k: int = ORDER) -> DataFrame:
    """(model, g, nlp) for distinct n-grams (model, g) of order k: joins with the shards of order k, and for what is not
    there with those of its context and, by way of its distinct suffixes, of the lower orders."""
    seen, contexts = model[k - 1]
    rows = written(grams.select("model", "g").join(seen.select("model", "g", "nlp"), ["model", "g"], "left"), f"known{k}")
    open_ = rows.where("nlp is null").select("model", "g", _context(F.col("g")).alias("ctx"), _suffix(F.col("g"), k - 1).alias("low")).join(contexts, ["model", "ctx"], "left")
    weight = F.coalesce("weight", F.lit(0.0))
    if k == 1:
        open_ = open_.withColumn("low_nlp", F.lit(float(np.log(K))))
    else:
        lower = looked_up(open_.select("model", F.col("low").alias("g")).distinct(), model, k - 1)
        open_ = open_.join(lower.select("model", F.col("g").alias("low"), F.col("nlp").alias("low_nlp")), ["model", "low"])
    return rows.where("nlp is not null").unionByName(open_.select("model", "g", (weight + F.col("low_nlp")).alias("nlp")))


def _slot(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _hot(seen: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a table of the most frequent n-grams, `hot` at most: all above a count that few enough have.

    The key is the n-gram's bits turned by the model's hash. Each has one slot; of two in one the more frequent is kept, the other is looked up like the rest.
    """
    level = F.floor(F.log2("c") * 8).cast("int")
    sizes = seen.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect()  # 8 rows a power of two
    least, held = None, 0
    for r in sizes:
        held += r["n"]
        if held > hot:
            break
        least = r["level"]
    keys, values = np.full(1 << _SLOTS, -1, np.int64), np.zeros(1 << _SLOTS, np.float32)
    if least is not None:
        rows = seen.where(level >= least).select(F.col("g").bitwiseXOR(F.col("model")).alias("key"), F.least("c", F.lit((1 << 31) - 1)).cast("int").alias("c"), F.col("nlp").cast("float").alias("nlp")).toArrow()
        key, order = rows["key"].to_numpy(), np.argsort(rows["c"].to_numpy(), kind="stable")
        at = _slot(key)
        keys[at[order]], values[at[order]] = key[order], rows["nlp"].to_numpy()[order]
    return keys, values


def scores(docs: DataFrame, model: Tables, keys: list[str], hot: int = HOT) -> DataFrame:
    """(keys, _surprise, _n) for each row of `docs` (model, text, keys): the sum of -log p over the n characters of the text, null where there is no
    model or text."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(_hot(model[-1][0], hot))
    known = model[0][0].select("model").distinct().withColumn("_known", F.lit(True))
    known = F.broadcast(known) if known.count() <= MAX_BROADCAST else known
    rows = docs.select(*keys, "model", "text").join(known, "model", "left").select(*keys, F.coalesce("model", F.lit(0).cast("long")).alias("model"), F.coalesce(F.col("_known") & (F.length("text") > 0), F.lit(False)).alias("_known"), F.coalesce("text", F.lit("")).alias("text"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot_keys, hot_nlp = sent.value
        nothing = np.empty(0, np.int64)
        for whole in batches:
            for start in range(0, len(whole), _ROWS):
                pdf = whole.iloc[start : start + _ROWS]
                total, n = np.zeros(len(pdf)), np.fromiter(map(len, pdf.text), np.int64, len(pdf))
                miss, times = [nothing] * len(pdf), [nothing] * len(pdf)
                index = np.flatnonzero(pdf["_known"].to_numpy(bool))
                own, models = [pdf.text.iat[i] for i in index], pdf.model.to_numpy(np.int64)[index]  # no nulls: these would make floats of the hashes
                for a, b in _pieces(own):
                    g, lengths = _grams(own[a:b])
                    ends = np.cumsum(lengths)
                    key = g ^ np.repeat(models[a:b], lengths)
                    at = _slot(key)
                    hit = hot_keys[at] == key
                    total[index[a:b]] = np.add.reduceat(np.where(hit, hot_nlp[at], 0.0), ends - lengths)
                    rest = np.flatnonzero(~hit)
                    cuts = np.searchsorted(rest, ends)
                    for i, x, y in zip(index[a:b], [0, *cuts[:-1]], cuts, strict=True):
                        if y > x:
                            miss[i], times[i] = np.unique(g[rest[x:y]], return_counts=True)
                yield pdf.drop(columns="text").assign(_total=total, _n=n, _miss=miss, _times=times)

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    part = rows.mapInPandas(score, f"{kinds}, model long, _known boolean, _total double, _n long, _miss array<long>, _times array<long>")
    part = written(part.withColumn("_row", F.monotonically_increasing_id()), "scored")
    sent.unpersist()  # so that no worker holds it in what follows
    rest = part.where(F.size("_miss") > 0).select("_row", "model", F.explode(F.arrays_zip(F.col("_miss").alias("g"), F.col("_times").alias("m"))).alias("x")).select("_row", "model", "x.g", "x.m")
    # Written, so that the join back is of plain tables and an n-gram of very many documents is split.
    found = written(looked_up(rest.select("model", "g").distinct(), model), "looked-up")
    sums = rest.join(found, ["model", "g"]).groupBy("_row").agg(F.sum(F.col("nlp") * F.col("m")).alias("_more"))
    surprise = F.when(F.col("_known"), F.col("_total") + F.coalesce("_more", F.lit(0.0)))
    return part.drop("_miss", "_times").join(sums, "_row", "left").select(*keys, surprise.alias("_surprise"), "_n")


def _hashed_id() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"))


def _may_be_in(ids: DataFrame) -> Column:
    """Whether the id of a row may be among `ids`: true for all that are, and for few others while there are fewer than BLOOM_BITS."""
    place = F.pmod(_hashed_id(), F.lit(BLOOM_BITS))
    words = ids.select(place.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("x")).toArrow()  # BLOOM_BITS / 64 rows at most
    bits = np.zeros(BLOOM_BITS // 64, np.int64)
    bits[words["w"].to_numpy().astype(np.int64)] = words["x"].to_numpy()
    sent = ids.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def found(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series((sent.value[at >> 6] >> (at & 63) & 1).astype(bool))

    return found(place)


_KEYS = ["_key1", "_key2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """With what tells rows apart that can be judged differently."""
    return docs.withColumns({"_key1": F.xxhash64("doc_id", "lang", "text"), "_key2": F.xxhash64("text", "lang", "doc_id", F.lit("2"))})


def verdicts(docs: DataFrame, labels: DataFrame, low: float = LOW, reach: float = REACH, high: float = HIGH, least: float = LEAST, hot: int = HOT) -> DataFrame:
    """(doc_id, lang, _key1, _key2, _n, _perplexity, _excess, _low, _high, _keep) for each row of `docs` (doc_id, lang, text), without the text."""
    held_out = F.pmod(_hashed_id(), F.lit(FOLDS)) == 0
    lang = F.coalesce(F.col("lang"), F.lit(""))
    trusted = written(labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct(), "trusted")
    slim = docs.select("doc_id", "lang", "text")
    # Both grow, so this join shuffles at every size, each text once.
    training = slim.where("length(text) > 0 and doc_id is not null").where(~held_out).where(_may_be_in(trusted)).join(trusted.where(~held_out).hint("merge"), "doc_id", "left_semi")
    model = tables(count_grams(training.select(F.xxhash64(lang).alias("model"), "text")))
    rows = _keyed(slim).withColumn("model", F.xxhash64(lang))
    found = written(scores(rows, model, ["doc_id", "lang", *_KEYS], hot).withColumns({"_mean": F.col("_surprise") / F.col("_n"), "_lang": lang}), "scores")
    sample = found.where("_mean is not null").where(held_out).join(trusted.where(held_out).hint("merge"), "doc_id", "left_semi").select("_lang", "_mean", "_n")
    sample = written(sample, "sample")
    mid = sample.groupBy("_lang").agg(F.percentile_approx("_mean", 0.5, 10_000).alias("_mid"))
    excess = (F.col("_mean") - F.col("_mid")) * F.sqrt("_n")
    ends = sample.join(mid, "_lang").withColumn("e", excess).groupBy("_lang", "_mid").agg(F.percentile_approx("e", [low, 0.5, high], 10_000).alias("q"))
    q = F.col("q")
    # A row for each language.
    fences = written(ends.select("_lang", "_mid", (q[1] - F.greatest(reach * (q[1] - q[0]), F.lit(least))).alias("_low"), F.greatest(q[2], q[1] + least).alias("_high")), "fences")
    if fences.count() <= MAX_BROADCAST:
        fences = F.broadcast(fences)
    found = found.join(fences, "_lang", "left").withColumn("_excess", excess)
    keep = F.coalesce(F.col("_excess").between(F.col("_low"), F.col("_high")), F.lit(True))
    return found.select("doc_id", "lang", *_KEYS, "_n", F.exp("_mean").alias("_perplexity"), "_excess", "_low", "_high", keep.alias("_keep"))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Columns of `docs` with _n, _perplexity, _excess, _low, _high, _keep."""
    found = verdicts(docs, labels, **options).drop("doc_id", "lang").dropDuplicates(_KEYS)
    return _keyed(docs).join(found, _KEYS).drop(*_KEYS)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of trusted text, its fence and the verdict."""
    found = verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", F.col("_n").alias("n_chars"), F.col("_perplexity").alias("perplexity"), F.col("_excess").alias("excess"), F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("_keep").alias("keep"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject."""
    gone = written(verdicts(docs, table(spark, sf_dir, "labels")).where("not _keep").select(*_KEYS).distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_DOCS else gone
    return _keyed(docs).join(gone, _KEYS, "left_anti").select(docs.columns)
