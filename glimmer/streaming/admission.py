"""Structured Streaming variants: admission quotas and duplicates across packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glimmer.operators import growth

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls per day and caller, by event time; a day is closed when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("calls")).select(F.to_date("w.start").alias("day"), "user_id", "calls")


def first_of_each(events: DataFrame, keys: list[str], within: str = "7 days") -> DataFrame:
    """The first event of each key; state of a key is dropped when the watermark has passed it."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def admit(events: DataFrame, path: str, checkpoint: str, per_caller: int, per_day: int) -> StreamingQuery:
    """Exact admission, a packet at a time: earlier decisions of the packet's days are read from `path`, refused calls do not count.

    A packet's days are closed to earlier events: within a day, calls of a later packet come after those admitted before. Each packet
    writes to a folder of its own number, so one that is run again replaces what it wrote.
    """

    def packet(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        calls = df.select(F.to_date("ts").alias("day"), F.col("user_id").alias("caller"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
        days = calls.select("day").distinct()
        try:
            before = spark.read.option("basePath", path).parquet(path).where(f"ok and packet < {n}").select("day", "caller", "at", "id").join(days, "day", "left_semi")
        except Exception as e:  # the first packet finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            before = calls.limit(0)
        _decided(before, calls, per_caller, per_day).write.mode("overwrite").parquet(f"{path}/packet={n}")

    return events.writeStream.foreachBatch(packet).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _decided(before: DataFrame, calls: DataFrame, per_caller: int, per_day: int) -> DataFrame:
    """The calls with `ok`, after those admitted before."""
    from pyspark.sql import Window

    every = before.withColumn("_old", F.lit(True)).unionByName(calls.withColumn("_old", F.lit(False)))
    first = [F.desc("_old"), F.col("at"), F.col("id")]
    mine = F.row_number().over(Window.partitionBy("day", "caller").orderBy(*first))
    own = every.withColumn("_ok", mine <= per_caller)
    nth = F.sum(F.col("_ok").cast("int")).over(Window.partitionBy("day").orderBy(*first).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("ok", F.col("_ok") & (nth <= per_day)).where(~F.col("_old")).drop("_ok", "_old")


def merge_evidence(proposals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Proposals accepted across packets (growth.accept). The state is two tables, of heads and of (key, evidence) pairs; a packet writes what it changes to a
    folder of its own number and reads those before it, so one that is run again finds the same state and replaces what it wrote."""

    def packet(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        old, pairs = (heads_of(spark, path, n), pairs_of(spark, path, n)) if n else (None, None)
        new_heads, new_pairs = growth.accept(df, old, pairs)
        new_pairs.write.mode("overwrite").parquet(f"{path}/pairs/packet={n}")
        new_heads.write.mode("overwrite").parquet(f"{path}/heads/packet={n}")

    return proposals.writeStream.foreachBatch(packet).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heads_of(spark: SparkSession, path: str, before: int = 1 << 30) -> DataFrame:
    """The heads after the packets before `before`: the last one of each key."""
    rows = spark.read.parquet(f"{path}/heads").where(F.col("packet") < before)
    last = rows.groupBy("key").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("key", "packet"))), "packet").alias("x"))
    return last.select("key", "x.*")


def pairs_of(spark: SparkSession, path: str, before: int = 1 << 30) -> DataFrame:
    return spark.read.parquet(f"{path}/pairs").where(F.col("packet") < before).select("key", "evidence")
