"""Lists that grow from batch to batch: until nothing new comes, and by accepting proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.session import written


def _there(spark, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def until_no_growth(answers: DataFrame, path: str, most: int | None = None) -> DataFrame:
    """(name, id, batch) of answers (batch from 0, id, name), read batch by batch: trimmed names in lower case that no earlier batch had, each with its least
    id. A batch without a new name is the last one, as is the one that reaches `most` names; what follows is not looked at.

    Each batch is a folder under `path`; one that is complete is not worked out again, so a lost driver goes on where it was. Names that are null or
    empty are none; a batch without rows is one without new names."""
    spark, n, have = answers.sparkSession, 0, 0
    schema = f"name string, id {answers.schema['id'].dataType.simpleString()}"
    while True:
        at = f"{path}/batch={n}"
        if not _there(spark, f"{at}/_SUCCESS"):
            name = F.lower(F.trim("name"))
            new = answers.where(F.col("batch") == n).select(name.alias("name"), "id").where("name <> ''").groupBy("name").agg(F.min("id").alias("id"))
            if n:
                known = spark.read.schema(schema).parquet(*(f"{path}/batch={k}" for k in range(n))).select("name")
                new = new.join(known, "name", "left_anti")
            new.write.mode("overwrite").parquet(at)
        grown = spark.read.schema(schema).parquet(at).count()
        n, have = n + 1, have + grown
        if not grown or (most is not None and have >= most):
            break
    out = spark.read.schema(f"{schema}, batch int").option("basePath", path).parquet(*(f"{path}/batch={k}" for k in range(n)))
    return out if most is None else out.orderBy("batch", "id", "name").limit(most)


HEAD = "mechanism string, event_date string, proposed long, accepted long, duplicates long, evidence_from_duplicates long"


def accept(new: DataFrame, heads: DataFrame | None = None, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Proposals (key, at, id, evidence, mechanism, event_date) taken up in the order of (at, id): (heads, pairs) of the keys in `new`.

    The first proposal of a key is accepted; later ones are duplicates that add the evidence that the key lacks, the event date if it has none, and
    their mechanism if it is longer than the key's and contains it (in any case). heads: (key, mechanism, event_date, four counters), pairs: new
    (key, evidence) only. `heads` and `pairs` are the state so far; nothing is gathered by key, so a key with a third of all proposals is many tasks.

    A mechanism that was passed over once is never taken later, since what has grown since contains what it lacked; so distinct ones with
    their first places are enough, and each round takes the next one of every key, as many rounds as the longest growth. Null evidence is none; a null
    mechanism is an empty one, which nothing replaces; a null key is a key."""
    order = F.struct("at", "id")
    new = new.select("key", "at", "id", "evidence", F.coalesce("mechanism", F.lit("")).alias("mechanism"), "event_date")
    first = new.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("mechanism", order).alias("first_mechanism"), F.min_by("evidence", order).alias("first_evidence"),
        F.min_by("event_date", F.when(F.col("event_date").isNotNull(), order)).alias("date"),
    )
    if heads is None:
        heads = new.sparkSession.createDataFrame([], f"key {new.schema['key'].dataType.simpleString()}, {HEAD}")
    old = heads.select(F.col("key").alias("_key"), *(F.col(x.split()[0]).alias(f"old_{x.split()[0]}") for x in HEAD.split(", ")))
    base = first.join(old, F.col("key").eqNullSafe(F.col("_key")), "left").withColumn("is_new", F.col("old_proposed").isNull())
    base = written(base.withColumn("mechanism", F.when(F.col("is_new"), F.col("first_mechanism")).otherwise(F.col("old_mechanism"))).drop("_key"), "heads")

    offered = written(new.groupBy("key", "mechanism").agg(F.min(order).alias("place")), "mechanisms")
    cur, taken = base.select("key", "mechanism").where("mechanism <> ''"), []
    while True:
        now = cur.select(F.col("key").alias("_key"), F.col("mechanism").alias("_now"))
        longer = (F.length("mechanism") > F.length("_now")) & F.contains(F.lower("mechanism"), F.lower("_now"))
        grown = offered.join(now, F.col("key").eqNullSafe(F.col("_key"))).where(longer).groupBy("key").agg(F.min_by("mechanism", "place").alias("mechanism"))
        cur = written(grown, "grown")
        if cur.isEmpty():
            break
        taken.append(cur.withColumn("round", F.lit(len(taken))))
    if taken:
        every = taken[0]
        for more in taken[1:]:
            every = every.unionByName(more)
        last = every.groupBy("key").agg(F.max_by("mechanism", "round").alias("grown")).withColumnRenamed("key", "_key")
        base = base.join(last, F.col("key").eqNullSafe(F.col("_key")), "left").withColumn("mechanism", F.coalesce("grown", "mechanism"))

    found = new.where("evidence is not null").select("key", "evidence").distinct()
    if pairs is not None:
        was = pairs.select(F.col("key").alias("_key"), F.col("evidence").alias("_evidence"))
        found = found.join(was, F.col("key").eqNullSafe(F.col("_key")) & (F.col("evidence") == F.col("_evidence")), "left_anti")
    found = written(found, "pairs")
    added = found.groupBy(F.col("key").alias("_added")).agg(F.count(F.lit(1)).alias("added"))
    base = base.join(added, F.col("key").eqNullSafe(F.col("_added")), "left")
    was = lambda c: F.coalesce(F.col(f"old_{c}"), F.lit(0))
    own = F.when(F.col("is_new") & F.col("first_evidence").isNotNull(), 1).otherwise(0)
    out = base.select(
        "key", "mechanism", F.coalesce("old_event_date", "date").alias("event_date"), (was("proposed") + F.col("n")).alias("proposed"),
        F.when(F.col("is_new"), 1).otherwise(F.col("old_accepted")).cast("long").alias("accepted"),
        (was("duplicates") + F.col("n") - F.col("is_new").cast("long")).alias("duplicates"),
        (was("evidence_from_duplicates") + F.coalesce("added", F.lit(0)) - own).cast("long").alias("evidence_from_duplicates"),
    )
    return out, found
