"""Aggregations: shares, funnels, probes, percentiles, merges, budgets and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.session import written


def shares(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, share): counts and their share of all; the total is a sum over the groups."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def counts_by(rows: DataFrame, key: str, of: str, values: list[str]) -> DataFrame:
    """A column of counts for each of the given values."""
    return rows.groupBy(key).agg(*[F.count_if(F.col(of) == v).alias(v) for v in values])


def top(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys; ties go to the smaller key."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def clusters(rows: DataFrame, term: str, organisations: str, place: str) -> DataFrame:
    """Per lower-cased term: records, distinct organisations (over one character) and distinct places."""
    org = F.explode_outer(F.filter(organisations, lambda o: F.length(o) > 1))
    return (
        rows.select(F.lower(term).alias("term"), F.col(place).alias("p"), org.alias("o"), F.monotonically_increasing_id().alias("r"))
        .groupBy("term")
        .agg(F.countDistinct("o").alias("players"), F.countDistinct("p").alias("places"))
    )


def probe(rows: DataFrame, term: str, ts: str, as_of: Column, days: int) -> DataFrame:
    """Per term: first date, total and count of the last days. What was not measured is null, not 0."""
    return rows.groupBy(F.col(term).alias("term")).agg(F.to_date(F.min(ts)).alias("first"), F.count(F.lit(1)).alias("total"), F.count_if(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days))).alias("recent"))


def baseline(probes: DataFrame) -> DataFrame:
    """Mean of the terms' own recent shares, and the greatest total, over terms that were measured and found."""
    found = probes.where("total > 0 and recent is not null")
    return found.agg(F.round(F.avg(F.col("recent") / F.col("total")), 6).alias("share"), F.max("total").alias("total"))


def most_informative(answers: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key's sources (complete, total, recent): a complete one with the greatest total found, else
    the first complete one, else the partial one with the greatest total, whose recent count is then not measured."""
    rank = F.when(F.col("complete") & (F.col("total") > 0), 0).when(F.col("complete"), 1).otherwise(2)
    w = Window.partitionBy(key).orderBy(rank, F.when(rank == 1, F.lit(0)).otherwise(F.col("total")).desc(), order)
    best = answers.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return best.withColumn("recent", F.when(F.col("complete"), F.col("recent"))).drop("_n")


def places(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, lo, hi, total): a key's total values in order hold this value at places lo to hi - 1, from 0; nulls are left out.

    Equal values are counted first, distinct ones are sorted by ranges, and a small table of the ranges' sums carries the places on: no task sees a whole key.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("m"))
    dealt = written(counts.repartitionByRange(key, value).withColumn("part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(key)
    sums = dealt.groupBy(key, "part").agg(F.sum("m").alias("s"))
    sums = sums.select(key, "part", F.coalesce(F.sum("s").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("s").over(own).alias("total"))
    inside = Window.partitionBy(key, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("upto", F.sum("m").over(inside)).join(sums, [key, "part"]).select(key, value, (F.col("base") + F.col("upto") - F.col("m")).alias("lo"), (F.col("base") + F.col("upto")).alias("hi"), "total")


def _at(place: Column, value: str) -> Column:
    return F.max(F.when((F.col("lo") <= place) & (place < F.col("hi")), F.col(value)))


def nearest_rank(rows: DataFrame, key: str, value: str, at: dict[str, float]) -> DataFrame:
    """Percentiles per key by nearest rank: the element at round-half-even(p * (n - 1))."""
    return places(rows, key, value).groupBy(key).agg(*[_at(F.bround(F.lit(p) * (F.col("total") - 1)), value).alias(n) for n, p in at.items()], F.max(value).alias("most"))


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Median (interpolated), p95 (element int(0.95 n) - 1, from 0) and count per key."""
    n = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    p95 = F.greatest(F.floor(F.lit(95) * F.col("n") / 100), F.lit(1)) - 1
    found = places(rows, key, value).join(n, F.col(key).eqNullSafe(F.col("_key"))).groupBy(key, "n").agg(_at(low, value).alias("a"), _at(high, value).alias("b"), _at(p95, value).alias("p95"))
    return found.select(key, F.round((F.col("a") + F.col("b")) / 2, 6).alias("median"), "p95", "n")


def merge_pool(rows: DataFrame, key: Column, order: str, first: list[str], gather: list[str]) -> DataFrame:
    """A row per key: of the record that comes first the columns `first`, and of all records the distinct values of `gather`, in order."""
    every = rows.select(key.alias("key"), order, *first, *gather).groupBy("key").agg(F.array_sort(F.collect_list(F.struct(order, *first, *gather))).alias("r"))
    cols = [F.get("r", F.lit(0))[c].alias(c) for c in first] + [F.array_distinct(F.col("r").getField(c)).alias(f"{c}s") for c in gather]
    return every.select("key", F.size("r").alias("n"), *cols)


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def distinctive(rows: DataFrame, group: str, word: str, n: int, least: int = 2) -> DataFrame:
    """The n most distinctive words of each group: document frequency (at least `least`) over 1 + that elsewhere; ties to the
    more frequent, then the later word. Each (word, document) is one row of the input."""
    own = rows.groupBy(group, word).agg(F.count(F.lit(1)).alias("df"))
    all_ = F.sum("df").over(Window.partitionBy(word))
    scored = own.withColumn("score", F.round(F.col("df") / (1 + all_ - F.col("df")), 6)).where(F.col("df") >= least)
    w = Window.partitionBy(group).orderBy(F.desc("score"), F.desc("df"), F.desc(word))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def centroid_cosines(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Cosine of the mean vectors of each two groups."""
    mean = rows.select(group, F.posexplode(vector).alias("d", "x")).groupBy(group, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = mean.groupBy(group).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    m = mean.join(norm, group).select(F.col(group).alias("a"), "d", (F.col("x") / F.col("norm")).alias("xa"))
    o = m.select(F.col("a").alias("b"), "d", F.col("xa").alias("xb"))
    return m.join(o, "d").where("a < b").groupBy("a", "b").agg(F.round(F.sum(F.col("xa") * F.col("xb")), 5).alias("cosine"))


def statement(calls: DataFrame, budget: Column) -> DataFrame:
    """Per kind: reserved, settled, refunded, calls without an outcome, and what is left of the budget."""
    return calls.groupBy("kind").agg(
        F.sum("reserved").alias("reserved"),
        F.sum("actual").alias("settled"),
        F.sum(F.when(F.col("actual").isNotNull(), F.col("reserved") - F.col("actual"))).alias("refunded"),
        F.count_if(F.col("actual").isNull()).alias("unknown"),
        (F.first(budget) - F.sum(F.coalesce("actual", "reserved"))).alias("remaining"),
    )
