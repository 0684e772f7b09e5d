"""The query gate: is what a query finds one technical reading, several, or none?

Results of a query are clustered into senses; the largest sense tells what the query is understood as, the second largest whether
there is another reading. Only the two largest senses need centroids; they are kept as sums for each dimension, so no two senses are
compared but those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions import urls
from glimmer.operators import decide, resolve

CONSUMER = "(?i)download|/shop/|price|dictionary"
#: The largest mean cosine distance between members of a sense.
APART = 0.18


def readings(results: DataFrame, consumer: str = CONSUMER) -> DataFrame:
    """(query, key, url, vector, sense, place): results with their sense and its place among those of the query, the largest first, ties to the least key."""
    labels = resolve.senses(results.select("query", "key", "vector"), "query", "key", "vector", APART)
    sizes = labels.groupBy("query", "sense").agg(F.count(F.lit(1)).alias("n"))
    # A query has as many senses as results at most, which its searches bound.
    sizes = sizes.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "sense")))
    marked = results.withColumn("consumer", F.col("url").rlike(consumer))
    return marked.join(labels, ["query", "key"]).join(sizes.drop("n"), ["query", "sense"])


def centroid_cosine(rows: DataFrame) -> DataFrame:
    """(query, cosine) of the mean vectors of the two largest senses, where there are two."""
    sums = [F.sum(F.when(F.col("place") == p, F.col("x").cast("double"))).alias(f"x{p}") for p in (1, 2)]
    each = rows.where("place <= 2").select("query", "place", F.posexplode("vector").alias("d", "x")).groupBy("query", "d").agg(*sums)
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    return each.groupBy("query").agg((dot("x1", "x2") / F.sqrt(dot("x1", "x1") * dot("x2", "x2"))).alias("cosine"))


def judged(rows: DataFrame) -> DataFrame:
    """(query, hits, hosts, groups, top, second, consumer, cosine, verdict) of what readings() gives. Too few hits or hosts come first; the consumer
    share is that of the largest sense; a second reading counts from a quarter of the hits, if its centroid is not near that of the first."""
    of = lambda p: F.count_if(F.col("place") == p)
    shares = rows.withColumn("host", urls.host(F.col("url"))).groupBy("query").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct(F.when(F.col("host") != "", F.col("host"))).alias("hosts"), F.max("place").cast("long").alias("groups"),
        (of(1) / F.count(F.lit(1))).alias("top"), (of(2) / F.count(F.lit(1))).alias("second"), (F.count_if((F.col("place") == 1) & F.col("consumer")) / of(1)).alias("consumer"),
    )
    return decide.fitness(shares.join(centroid_cosine(rows), "query", "left"))
