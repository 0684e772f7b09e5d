"""Mixing sources to target weights by the cube method of balanced sampling.

Each source has a target of words. A document is taken floor(target / words of its
source) times, and once more with the fraction as its inclusion probability. The cube
method settles these fractions: three undecided documents at a time move along the
direction that keeps both the expected number of documents and of words (the null
space of the two constraints) until one of them is 0 or 1. So each block of a source
leaves two undecided documents at most, those of all blocks go to the next level, and
the last few of a source, with some documents that stayed behind, are the landing problem, which is small enough to try all
choices for the one nearest to the expected words.

A source is cut into blocks of about `block` documents by a hash, so a source with a
third of all rows is many tasks. Only (id, source, size, digest of the text) is shuffled.
Of n repeated rows with the fraction p, floor(n * p) are taken once more for certain, and
one row alone carries what is left of n * p into the flight, so a source is as near its
target as without repeats. Random numbers come from the block's key: reruns agree.

Defined results: a null text has size 0; a null source is a source, last in order; of
repeated rows it is open which are taken once more, but not how many; a source without
words has target 0 and takes nothing; an empty table gives an empty result. Other columns
of the input are left alone and can have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.session import table, written

#: Weights of the sources in order, repeating; no source is taken more than so many times.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 4_096
#: Units that stay behind for the landing, besides the two that a flight leaves: it tries 2 ** 16 choices at most.
LANDING = 14
MAX_BROADCAST_SOURCES = 100_000
#: Repeats of a row that one task writes.
REPEATS = 100_000
_EPS = 1e-9


def size_of(text: Column) -> Column:
    """Number of words, that is of runs without ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, place, source_size, target) from (source, source_size).

    The total is shared by weight; no target exceeds `most` times its source's size, and
    the excess is reshared by weight. That is target = min(most * size, level * weight)
    for one level, which is the greatest of the levels reached by capping the sources in order of
    cap / weight one after the other. There is a row for each source, so one task sees few rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    level = (F.sum("source_size").over(Window.partitionBy()) - (F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(Window.partitionBy()))
        .select("source", "place", "source_size", F.greatest(F.lit(0.0), F.least("cap", F.col("level") * F.col("weight"))).alias("target"))
    )


def _direction(a: tuple, b: tuple, c: tuple) -> tuple[float, float, float]:
    """A vector that both constraints map to zero, for three units of (documents, words)."""
    u = (b[0] * c[1] - c[0] * b[1], c[0] * a[1] - a[0] * c[1], a[0] * b[1] - b[0] * a[1])
    if any(u):
        return u
    return (b[0], -a[0], 0.0)  # words are in proportion to documents: one constraint is left


def _move(pi: list[float], u: tuple, r: float) -> list[float]:
    """One step of the flight: along u as far as the cube allows, or against it, such that the mean is kept."""
    up = min([((1 - p) if d > 0 else p) / abs(d) for p, d in zip(pi, u, strict=True) if d])
    down = min([(p if d > 0 else (1 - p)) / abs(d) for p, d in zip(pi, u, strict=True) if d])
    step = up if r * (up + down) < down else -down
    out = [p + step * d for p, d in zip(pi, u, strict=True)]
    return [0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p for p in out]


def _land(pi: np.ndarray, docs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The choice of 0 or 1 for a few units whose words, then documents, are nearest to what pi expects."""
    bits = (np.arange(1 << len(pi))[:, None] >> np.arange(len(pi)) & 1).astype(float)
    off = np.abs(bits @ words - pi @ words) + np.abs(bits @ docs - pi @ docs)
    return bits[np.argmin(off)]


def flight(pi: np.ndarray, docs: np.ndarray, words: np.ndarray, rng: np.random.Generator, land: bool = False) -> np.ndarray:
    """Inclusion after the flight phase over the units in order: all but two are 0 or 1; with `land` all are.

    For the landing, LANDING units spread over the order stay behind with the last two.
    """
    out = np.array(pi, float)
    open_ = np.flatnonzero((out >= _EPS) & (out <= 1 - _EPS))
    closed = np.setdiff1d(np.arange(len(out)), open_)
    out[closed] = np.round(out[closed])
    behind = np.unique(np.linspace(0, len(open_) - 1, LANDING).astype(int)) if land and len(open_) else np.empty(0, int)
    units = list(zip(docs.tolist(), words.tolist(), strict=True))
    draws = rng.random(len(out)).tolist()
    held: list[int] = []
    for i in np.delete(open_, behind).tolist():
        held.append(i)
        if len(held) == 3:
            new = _move([out[j] for j in held], _direction(*(units[j] for j in held)), draws[i])
            for j, q in zip(held, new, strict=True):
                out[j] = q
            held = [j for j, q in zip(held, new, strict=True) if 0 < q < 1]
    if land:
        last = np.array([*open_[behind], *held], int)
        out[last] = _land(out[last], docs[last], words[last])
    return out


def _flown(units: DataFrame, level: int, land: bool, seed: int) -> DataFrame:
    def fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # Large units first: what is left undecided is small.
        pdf = pdf.sort_values(["size", "salt", "doc_id", "digest"], ascending=[False, True, True, True], kind="stable")
        rng = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        pdf["pi"] = flight(pdf.pi.to_numpy(), np.ones(len(pdf)), pdf["size"].to_numpy(float), rng, land)
        return pdf

    return units.groupBy("place", "part").applyInPandas(fly, units.schema)


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def units_decided(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, digest, n, source_size, target, base, extra): of the n rows alike, `extra` are taken base + 1 times, the others base times."""
    units = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), _digest(F.col(text_col)).alias("digest"))
    units = written(units.groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("n")), "units")
    goals = written(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("of_source")).drop("of_source"), weights, most), "targets")
    counts = units.groupBy("source").agg(F.count(F.lit(1)).alias("k")).withColumnRenamed("source", "s")
    goals = goals.join(counts, goals["source"].eqNullSafe(counts["s"])).drop("s").withColumnRenamed("source", "s")
    if goals.count() <= MAX_BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    units = (
        units.join(goals, units["source"].eqNullSafe(goals["s"]))
        .drop("s")
        .withColumn("ratio", ratio)
        .withColumns({"base": F.floor(F.col("ratio") + _EPS), "salt": F.xxhash64("doc_id", "size", "digest", F.lit(seed))})
        .withColumn("share", F.greatest(F.lit(0.0), F.col("ratio") - F.col("base")) * F.col("n"))
        .withColumn("certain", F.floor(F.col("share") + _EPS))
        .withColumn("pi", F.greatest(F.lit(0.0), F.col("share") - F.col("certain")))
        .drop("share")
        .withColumn("part", F.pmod("salt", F.ceil(F.col("k") / block)))
    )
    done, level = [], 0
    largest = units.agg(F.max("k")).first()[0] or 0
    while True:
        last = largest <= block
        units = written(_flown(units, level, last, seed), f"flight{level}")
        if last:
            done.append(units)
            break
        open_ = (F.col("pi") > 0) & (F.col("pi") < 1)
        done.append(units.where(~open_))
        # Two units of a block at most are left; a source that had one block lands with the others.
        left = units.where(open_).drop("k", "part")
        counts = left.groupBy("place").agg(F.count(F.lit(1)).alias("k"))
        units = left.join(counts, "place").withColumn("part", F.pmod("salt", F.ceil(F.col("k") / block))).select(units.columns)
        largest, level = units.agg(F.max("k")).first()[0] or 0, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "digest", "n", "source_size", "target", "base", (F.col("certain") + F.col("pi").cast("long")).alias("extra"))


def decide(docs: DataFrame, *args, **kwargs) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, copies): n rows alike are taken `copies` times; arguments as for units_decided."""
    groups = F.array(F.struct(F.col("extra").alias("n"), (F.col("base") + 1).alias("copies")), F.struct((F.col("n") - F.col("extra")).alias("n"), F.col("base").alias("copies")))
    found = units_decided(docs, *args, **kwargs).withColumn("g", F.explode(F.filter(groups, lambda g: g["n"] > 0)))
    return found.select("doc_id", "source", "size", F.col("g.n").alias("n"), "source_size", "target", F.col("g.copies").alias("copies"))


def _repeated(found: DataFrame) -> DataFrame:
    """Each row n times; rows with very many repeats are dealt to many tasks first."""
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    few = found.where(F.col("n") <= REPEATS).withColumn("_row", times(F.col("n")))
    many = found.where(F.col("n") > REPEATS).withColumn("_part", times(F.ceil(F.col("n") / REPEATS)))
    many = many.repartition("doc_id", "source", "size", "copies", "_part").withColumn("_row", times(F.least(F.lit(REPEATS), F.col("n") - (F.col("_part") - 1) * REPEATS))).drop("_part")
    return few.unionByName(many)


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    found = decide(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return _repeated(found).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def take(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each once, with the column `copies`: how often it is taken. A column of that name in `docs` gives way to it.

    Repeated rows of which some only are taken once more are numbered: by their place in their partition, and the partitions' counts.
    """
    columns = [c for c in docs.columns if c != "copies"]
    docs = docs.select(*columns)
    units = written(units_decided(docs), "decided")
    unit = ["_id", "_source", "_size", "_digest"]
    names = {"doc_id": "_id", "source": "_source", "size": "_size", "digest": "_digest", "base": "_base", "extra": "_extra", "n": "_of"}
    found = units.where("base > 0 or extra > 0").select(*[F.col(a).alias(b) for a, b in names.items()])
    rows = docs.withColumns({"_n": size_of(F.col("text")), "_h": _digest(F.col("text"))})
    same = rows["doc_id"].eqNullSafe(found["_id"]) & rows["source"].eqNullSafe(found["_source"]) & (rows["_n"] == found["_size"]) & (rows["_h"] == found["_digest"])
    some = (F.col("_extra") > 0) & (F.col("_extra") < F.col("_of"))
    alike = rows.join(found.where(~some), same).select(*columns, F.when(F.col("_extra") > 0, F.col("_base") + 1).otherwise(F.col("_base")).alias("copies"))
    if found.where(some).isEmpty():
        return alike
    apart = written(rows.join(found.where(some), same).select(*columns, *unit, "_base", "_extra").withColumn("_at", F.monotonically_increasing_id()), "repeats").withColumn("_part", F.shiftright("_at", 33))
    counts = apart.groupBy(*unit, "_part").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*unit).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).select(*[F.col(c).alias(c + "2") for c in [*unit, "_part"]], "_before")
    met = F.lit(True)
    for c in [*unit, "_part"]:
        met = met & F.col(c).eqNullSafe(F.col(c + "2"))
    placed = apart.withColumn("_place", F.row_number().over(Window.partitionBy(*unit, "_part").orderBy("_at"))).join(counts, met)
    copies = F.col("_base") + (F.col("_before") + F.col("_place") <= F.col("_extra")).cast("long")
    return alike.unionByName(placed.select(*columns, copies.alias("copies")).where("copies > 0"))
