"""Where redirects end, and what was found through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.session import written


def resolved(redirects: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, final) for every source: the end of its chain; of a loop, and of what leads into one, the least address in the loop.

    Pointers are doubled: in round k each points 2**k steps ahead, so a chain of a million addresses takes twenty joins; only sources that have not come
    to an end are joined again. A round in which none comes to an end leaves those in loops and before them: they go on until they have made as many
    steps as they are, so all point into a loop. Of several targets of a source the least counts; null ends and redirects of an address to itself are none."""
    edges = redirects.select(F.col(src).alias("src"), F.col(dst).alias("at")).where("src is not null and at is not null and src <> at").groupBy("src").agg(F.min("at").alias("at"))
    edges = written(edges, "redirects")
    ended, going, steps, n = [], edges.withColumn("done", F.lit(False)), 1, None
    while True:
        every = going
        for part in ended:
            every = every.unionByName(part)
        ahead = every.select(F.col("src").alias("at"), F.col("at").alias("next"), F.col("done").alias("there"))
        moved = going.drop("done").join(ahead, "at", "left").select("src", F.coalesce("next", "at").alias("at"), F.coalesce("there", F.lit(True)).alias("done"))
        moved = written(moved, "jumps")
        steps *= 2
        going = moved.where("not done")
        left = going.count()
        ended.append(moved.where("done"))
        if not left or (left == n and steps >= left):
            break
        n = left
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    out = out.select("src", F.col("at").alias("final"))
    return out.unionByName(_in_loops(going.select("src", "at"), edges, left)) if left else out


def _in_loops(ahead: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """(src, final): `ahead` points into a loop from each source; the least of each loop is spread by doubling along its own addresses."""
    loop = written(ahead.select(F.col("at").alias("src")).distinct().join(edges, "src").select("src", "at", F.least("src", "at").alias("final")), "loops")
    # Each address of a loop is a source too, and so many steps ahead of one of them; no other address is pointed to.
    steps = 1
    while steps <= n:
        ahead_of = loop.select(F.col("src").alias("at"), F.col("at").alias("to"), F.col("final").alias("other"))
        loop, steps = written(loop.join(ahead_of, "at").select("src", F.col("to").alias("at"), F.least("final", "other").alias("final")), "loops"), steps * 2
    return ahead.join(loop.select(F.col("src").alias("at"), "final"), "at").select("src", "final")


def through(rows: DataFrame, address: str, ends: DataFrame) -> DataFrame:
    """`rows` with `final`, the end of the redirects of `address`, itself where it has none."""
    known = ends.select(F.col("src").alias(address), F.col("final").alias("final"))
    return rows.join(known, address, "left").withColumn("final", F.coalesce("final", address))


def leaf_coverage(hits: DataFrame, stages: dict[str, DataFrame], ends: DataFrame) -> DataFrame:
    """(leaf, one column for each stage): distinct addresses of the stage that lead where hits of the leaf (url, leaf) lead."""
    leaves = through(hits.select("url", "leaf").distinct(), "url", ends).select("final", "leaf").distinct()
    every = None
    for name, rows in stages.items():
        found = through(rows.select("url").distinct(), "url", ends).select("final", "url", F.lit(name).alias("stage"))
        every = found if every is None else every.unionByName(found)
    # Addresses are counted before the leaves of their end come to them.
    counts = every.groupBy("final").agg(*(F.count_if(F.col("stage") == s).alias(s) for s in stages))
    return leaves.join(counts, "final", "left").groupBy("leaf").agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in stages))
