"""Stage tables of runs: writing, versions and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_stage(df: DataFrame, path: str, by: str = "run_id") -> None:
    """A stage's table, a folder for each run; runs that are written again are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_packet(df: DataFrame, path: str, packet: int) -> None:
    """A part of a stage's table; a packet that is run again replaces what it wrote."""
    df.write.mode("overwrite").parquet(f"{path}/packet={packet}")


def read_stage(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if run is None else df.where(F.col("run_id") == run)


def of_version(rows: DataFrame, version: int, legacy: bool = False) -> DataFrame:
    """Result rows of the version; with `legacy` also those without one."""
    same = F.col("version") == version
    return rows.where(same | F.col("version").isNull() if legacy else same)


def reviews(pairs: DataFrame) -> DataFrame:
    """Suggested pairs as a review table."""
    return pairs.withColumns({"decision": F.lit("pending"), "comment": F.lit(None).cast("string")})


def reviewed(pairs: DataFrame, edited: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with the decisions that a review gave them; others stay pending."""
    return pairs.join(edited.select(*keys, F.col("decision").alias("_d")), keys, "left").withColumn("decision", F.coalesce("_d", F.lit("pending"))).drop("_d")


def flat_export(cards: DataFrame, excluded: DataFrame, per_run: int = 12) -> DataFrame:
    """(run, n, id, kind): cards renumbered in each run and up to so many excluded items of each."""
    own = lambda df: F.row_number().over(Window.partitionBy("run").orderBy("id"))
    a = cards.select("run", "id", F.lit("card").alias("kind")).withColumn("n", own(cards))
    b = excluded.select("run", "id", F.lit("excluded").alias("kind")).withColumn("n", own(excluded)).where(F.col("n") <= per_run)
    return a.unionByName(b).select("run", F.col("n").cast("long").alias("n"), "id", "kind")
