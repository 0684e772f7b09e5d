"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one equi-join on the same key; edges that
join a large group through one centre stay linear in the number of nodes.
Every round is written to the shared folder, so lineage stays short and a lost
executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.session import drop_path, new_path


def _saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of `edges`; component is the least node it reaches.

    Loops, repeated edges and either direction are allowed; edges with a null
    end are ignored. An empty table gives an empty result.
    """
    spark = edges.sparkSession
    pairs = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    cur, path = _saved(pairs, "cc")
    nodes, nodes_path = _saved(cur.select(F.col("u").alias("node")).union(cur.select(F.col("v"))).distinct(), "cc-nodes")
    seen = None
    for _ in range(max_rounds):
        # Large star: every neighbour above u is hung on the least of u's neighbourhood.
        both = cur.where("u <> v").select("u", "v").union(cur.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join is of plain tables, and a node of very many edges is split where it is too large for a task.
        least, least_path = _saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours are hung on the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        nxt, nxt_path = _saved(small, "cc")
        sign = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_path(spark, path)
        drop_path(spark, least_path)
        cur, path = nxt, nxt_path
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return nodes.join(cur.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
